"""A data source that writes each stream as a file of its own, in big-endian 4-byte words.

    spark.dataSource.register(WordFiles)
    streams.write.format("word_files").mode("append").save(folder)

Tasks write under names of their own in a folder of the write; the files of the attempts that Spark commits are then
moved to ``<stream_id>.bin``, so that a task that fails or is run twice leaves nothing that readers see. Readers of
``*.bin`` do not look into that folder. It goes when the write ends, well or not; a task that still runs when a write is
given up may make it again, of no use to anyone.

Rows have stream_id and words. Words that are none are left out, a null of words is an empty stream. Ids are written as
text, with signs that file names must not have as percent codes; a null id, and an id that has two rows, fail the write.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from polyweft.functions.words import WORD_MAX


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, of a URI or of a local path."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where each stream's bytes lie, and what the file will be called


class WordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "word_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        missing = {"stream_id", "words"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"a stream needs the columns stream_id and words; missing: {sorted(missing)}")
        return WordFileWriter(self.options["path"].rstrip("/"), overwrite)


class WordFileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.own = f"{path}/_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        store, own = _place(self.own)
        store.create_dir(own, recursive=True)
        files = []
        for row in rows:
            if row["stream_id"] is None:
                raise ValueError("a stream without an id has no file name")
            words = np.array([w for w in row["words"] or [] if w is not None and 0 <= w <= WORD_MAX], ">u4")
            at = f"{own}/{uuid.uuid4().hex}"  # an attempt's own
            with store.open_output_stream(at) as out:
                out.write(words.tobytes())
            files.append((at, quote(str(row["stream_id"]), safe=" ") + ".bin"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _place(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a stream id has several rows")
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(path)):
                if old.is_file and old.base_name.endswith(".bin"):
                    store.delete_file(old.path)
        for at, name in files:
            store.move(at, f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, own = _place(self.own)
        if store.get_file_info(own).type != fs.FileType.NotFound:
            store.delete_dir(own)
