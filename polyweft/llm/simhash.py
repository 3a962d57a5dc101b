"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints are links when few bits differ. Cut a fingerprint into ``parts`` of equal width; two that differ
in ``radius`` bits at most differ in ``radius // parts`` at most in some part. Inside a part every bit i has a
non-zero vector phi(i) of r + 1 bits, r being that number, and each non-zero vector v gives one mask: the bits
with an odd inner product of phi(i) and v. The r vectors of any r differing bits leave some non-zero v
orthogonal to all of them, so both fingerprints agree under that mask: no pair within the radius is missed,
whatever ``parts`` is. More parts mean fewer tables with shorter keys.

Rows of a key are sorted into one run. Small runs are compared with themselves vectorised over the partition.
In large ones a search takes one fingerprint after another and compares it with those not yet reached only,
so that a tight group of n costs about n comparisons; what it returns is a spanning forest of the links,
n - 1 rows at most, and never all pairs.

A key that many rows share is split: its rows agree in the masked bits, so the same covering is laid over the
other bits. Of 64 bits and radius 3 a key then fixes about 48, and a run has 2**16 distinct fingerprints at most,
whatever the input.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyweft.llm.common import WORD, free_name, give_back, let_go, looked_up, met, written
from polyweft.llm.components import components, extended

SEED = 42
#: Runs up to this length are compared by shifts over the whole batch.
SMALL_RUN = 48
#: Rows from which a key is split.
LARGE_RUN = 4096


def shingles(text: bytes, n: int) -> list[bytes]:
    """The n-word shingles of ``text``, repeats included: A-Z lower-cased, space-joined; of fewer words the whole sequence; of none nothing."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= n:
        return [b" ".join(words)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[s:e] for s, e in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())]


def fingerprint(items: list[bytes], seeds: int = 1) -> np.ndarray:
    """``seeds`` unsigned 64-bit words: a bit is 1 if set in over half the XXH64 values of the items."""
    out = np.zeros(seeds, np.uint64)
    if not items:
        return out
    for k in range(seeds):
        h = np.fromiter((xxhash.xxh64_intdigest(x, SEED + k) for x in items), np.uint64, len(items))
        set_ = np.zeros(64, np.int64)
        for at in range(0, len(h), 4096):  # bounded memory for very long texts
            set_ += np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[k] = np.packbits(set_ * 2 > len(h)).view(">u8")[0]
    return out


def masks(bits: int, radius: int, parts: int) -> list[int]:
    """The masks of all parts, as integers of ``bits`` bits."""
    r, width = radius // parts, bits // parts
    out = []
    for p in range(parts):
        for v in range(1, 2 ** (r + 1)):
            odd = [i for i in range(width) if ((i % (2 ** (r + 1) - 1) + 1) & v).bit_count() % 2]
            out.append(sum(1 << (p * width + i) for i in odd))
    return out


def _as_signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def table_keys(words: list[Column], radius: int, parts: int) -> Column:
    """An array with the 64-bit key of every table; tables have different salts, and keys hash the masked words."""
    keys = []
    for t, m in enumerate(masks(64 * len(words), radius, parts)):
        used = [(w, (m >> (64 * k)) & (2**64 - 1)) for k, w in enumerate(words)]
        keys.append(F.xxhash64(F.lit(t), *[w.bitwiseAND(F.lit(_as_signed(m)).cast("long")) for w, m in used if m]))
    return F.array(*keys)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= radius


def _forest(ids: np.ndarray, words: np.ndarray, close) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span each component of one run: breadth first, each step against what is not reached yet."""
    left = np.arange(len(ids))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = close(words[at], words[left])
            if hit.any():
                reached, left = left[hit], left[~hit]
                yield np.full(len(reached), ids[at]), ids[reached]
                queue.extend(reached.tolist())


def _linked(batches: Iterator[pa.RecordBatch], close, n_words: int, seen=None) -> Iterator[pa.RecordBatch]:
    """Links of batches sorted by key; a run that goes on in the next batch is kept for it. ``seen`` is given all runs."""

    def done(key: np.ndarray, ids: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        if seen:
            seen(key, ids, words)
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        length = np.diff(edge)
        small = length <= SMALL_RUN
        run_of = np.repeat(np.arange(len(length)), length)
        a, b = [], []
        use = np.flatnonzero(small[run_of] & (length[run_of] > 1))
        end = edge[1:][run_of]
        for k in range(1, SMALL_RUN):
            use = use[use + k < end[use]]
            if not len(use):
                break
            hit = use[close(words[use], words[use + k])]
            a.append(ids[hit])
            b.append(ids[hit + k])
        for r in np.flatnonzero(~small):
            part = slice(edge[r], edge[r + 1])
            for x, y in _forest(ids[part], words[part], close):
                a.append(x)
                b.append(y)
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    kept: list[list[np.ndarray]] = []  # pieces of the last run; put together once, when it ends
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        new = [cols[0], cols[1], np.stack(cols[2 : 2 + n_words], 1).view(np.uint64)]
        cut = int(np.searchsorted(new[0], new[0][-1], "left"))
        if cut or (kept and kept[-1][0][-1] != new[0][-1]):
            kept.append([x[:cut] for x in new])
            yield from done(*(np.concatenate(x) for x in zip(*kept)))
            kept = []
        kept.append([x[cut:] for x in new])
    if kept:
        yield from done(*(np.concatenate(x) for x in zip(*kept)))


def _split_keys(words: list[Column], radius: int, parts: int, table: Column, key: Column) -> Column:
    """Keys of the rows of a large run: the covering of the bits that the key's table leaves free."""
    r, by_table = radius // parts, []
    for m in masks(64 * len(words), radius, parts):
        free = [i for i in range(64 * len(words)) if not m >> i & 1]
        by_table.append([sum(1 << b for n, b in enumerate(free) if ((n % (2 ** (r + 1) - 1) + 1) & v).bit_count() % 2) for v in range(1, 2 ** (r + 1))])
    of = lambda k: F.array(*[F.array(*[F.lit(_as_signed(m >> (64 * k) & (2**64 - 1))).cast("long") for m in row]) for row in by_table])
    rows = [F.element_at(of(k), table + 1) for k in range(len(words))]
    numbers = F.sequence(F.lit(1), F.lit(len(by_table[0])))
    return F.transform(numbers, lambda v: F.xxhash64(key, v, *[w.bitwiseAND(F.element_at(row, v)) for w, row in zip(words, rows)]))


def links(prints: DataFrame, words: list[str], radius: int, parts: int = 1) -> DataFrame:
    """(a, b) of ids whose ``words`` differ in ``radius`` bits at most: a set of links with the same components as all such pairs.

    ``prints`` is a written table with a unique ``id`` and long columns.
    """
    n = len(words)
    columns = [F.col(w) for w in words]
    keyed = prints.select("id", *words, F.posexplode(table_keys(columns, radius, parts)).alias("table", "key"))
    many = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > LARGE_RUN), "large-runs")
    marked = looked_up(keyed, many, "key")
    split = F.when(F.col("many").isNull(), F.array("key")).otherwise(_split_keys(columns, radius, parts, F.col("table"), F.col("key")))
    count = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.select(F.explode(split).alias("key"), "id", *words).repartition(count, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda it: _linked(it, lambda x, y: _near(x, y, radius), n), "a long, b long").distinct()


def _prints(docs: DataFrame, id_col: str, text_col: str, makers: list[tuple[int, bool, int]]) -> DataFrame:
    """id and columns w0, w1, ... of each row. makers: words of a shingle, whether repeats count, and 64-bit words to make."""
    total = sum(m[2] for m in makers)

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, total), np.uint64)
            for i, t in enumerate(batch.column(1).to_pylist()):
                at = 0
                for n, repeats, k in makers:
                    items = shingles(t or b"", n)
                    out[i, at : at + k] = fingerprint(items if repeats else list(dict.fromkeys(items)), k)
                    at += k
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[:, j].view(np.int64)) for j in range(total)]], names=["id", *[f"w{j}" for j in range(total)]])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, " + ", ".join(f"w{j} long" for j in range(total)))


def grouped(prints: DataFrame, words: list[str], radius: int, parts: int = 1) -> DataFrame:
    """``prints`` with component_id, the least id reachable. Equal fingerprints are one class and are compared once."""
    sums = prints.groupBy(*words).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = written(sums, "classes")
    found = components(links(classes.where("id is not null").select("id", *words), words, radius, parts))
    roots = written(classes.join(found.withColumnRenamed("node", "id"), "id", "left").select(*words, "n", F.coalesce("root", "id").alias("component_id")), "roots")
    # a fingerprint that many rows share is looked up where they are; there are at most rows / LARGE_RUN of them
    key, large = F.struct(*words), roots.where(F.col("n") > LARGE_RUN)
    marked = looked_up(prints.withColumn("print", key), large.select(key.alias("print"), F.col("component_id").alias("of_many")), "print").drop("print")
    rest = marked.where("of_many is null").drop("of_many").join(roots.where(F.col("n") <= LARGE_RUN).drop("n"), words)
    return rest.unionByName(marked.where("of_many is not null").withColumnRenamed("of_many", "component_id"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat an id are one node
    of the graph and give a row each. A class of equal fingerprints whose ids are all null has a null component_id.
    An empty table gives no rows.
    """
    prints = written(_prints(docs, id_col, text_col, [(n, True, 1)]), "prints")
    return grouped(prints, ["w0"], radius).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


#: The stage: texts are near-duplicates if they share ``STAGE_SHARE`` (as a fraction) or more of their distinct
#: five-word shingles, counted exactly. Links come first from the covering of 128-bit SimHash fingerprints, cut into
#: ``STAGE_PARTS``, at ``STAGE_RADIUS`` bits. At 0.8, with any lengths, 24 bits differ in the mean at most (19.4 for long
#: texts), for which keys would have a few bits; pairs of texts that the covering leaves in different components share a
#: shingle of their prefixes, and fingerprints pass over those beyond ``STAGE_BITS``, five deviations above that mean.
STAGE_WORDS, STAGE_SHARE, STAGE_BITS, STAGE_PRINTS = 5, (4, 5), 46, 2
STAGE_RADIUS, STAGE_PARTS = 11, 4
#: Shingles are counted in so many buckets.
BUCKETS = 1 << 17
#: Large runs are counted in parts of so many shingles, by tiles of so many rows and columns.
BLOCK, TILE, COLUMNS = 1 << 19, 256, 1024
_PRINT = [f"w{k}" for k in range(STAGE_PRINTS)]


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """64 other bits of each value, by SplitMix64's finish."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _set_print(h: np.ndarray) -> np.ndarray:
    """The fingerprint over a set of shingle hashes."""
    out = np.zeros(STAGE_PRINTS, np.uint64)
    for k in range(STAGE_PRINTS):
        set_ = np.zeros(64, np.int64)
        for at in range(0, len(h), 4096):  # bounded memory for very long texts
            set_ += np.unpackbits(_mixed(h[at : at + 4096], k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[k] = np.packbits(set_ * 2 > len(h)).view(">u8")[0]
    return out


def _nodes(docs: DataFrame, id_col: str, text_col: str, node: str) -> DataFrame:
    """``docs`` with the number of each row in the graph: its id, or, where rows repeat that, a hash of id and text. Rows without an id have one of the text alone."""
    repeated = written(docs.groupBy(F.col(id_col).cast("long").alias("id")).count().where("count > 1 or id is null").select("id", F.lit(True).alias("again")), "repeated")
    flag, key = free_name(docs, "repeated_id", "long_id")
    marked = looked_up(docs.withColumn(key, F.col(id_col).cast("long")), repeated.select(F.col("id").alias(key), F.col("again").alias(flag)), key)
    hashed = F.shiftrightunsigned(F.xxhash64(key, text_col), 2).bitwiseOR(1 << 62)  # after all usual ids
    return marked.withColumn(node, F.when(F.col(flag), hashed).otherwise(F.col(key))).drop(flag, key)


def _hashes(text: bytes | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    items = set(shingles(text or b"", STAGE_WORDS))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in items), np.uint64, len(items)))


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, n, hashes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_hashes(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "n", "hashes"])
            del sets
            give_back()

    return texts.mapInArrow(run, "id long, n long, hashes array<long>")


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _sketches(texts: DataFrame) -> DataFrame:
    """(id, n, fingerprint) of each text that has a shingle; rows with a bucket ``at`` follow: ``n`` texts' shingles fell into it in a task."""
    columns = ["id", "n", *_PRINT, "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n, prints = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, STAGE_PRINTS), np.uint64)
            for i, t in enumerate(batch.column(1).to_pylist()):
                h = _hashes(t)
                np.add.at(sums, _bucket(h), 1)
                n[i], prints[i] = len(h), _set_print(h)
            give_back()
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(n[some]), *[pa.array(prints[some, k].view(np.int64)) for k in range(STAGE_PRINTS)], pa.nulls(len(some), pa.int64())], names=columns)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(sums[at]), *[pa.nulls(len(at), pa.int64())] * STAGE_PRINTS, pa.array(at)], names=columns)

    return texts.select("id", "t").mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def _bucket_sums(sketches: DataFrame) -> np.ndarray:
    """How many texts' shingles fall into each bucket."""
    out = np.zeros(BUCKETS, np.int64)
    summed = sketches.where("at is not null").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    out[summed["at"].to_numpy()] = summed["n"].to_numpy()
    return out


def _covered(sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of near-duplicates found by the covering of their fingerprints. Texts of one fingerprint are met as one class and linked with its least id."""
    prints = sketches.where("at is null").select("id", *_PRINT)
    classes = written(prints.groupBy(*_PRINT).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    many = classes.where("n > 1").select(*_PRINT, F.col("id").alias("a"))
    within = prints.withColumnRenamed("id", "b").join(many, _PRINT).where("a != b").select("a", "b").distinct()
    return _verified(links(classes.select("id", *_PRINT), _PRINT, STAGE_RADIUS, STAGE_PARTS).unionByName(within), texts)


def _keyed(texts: DataFrame, sums: np.ndarray) -> DataFrame:
    """(key, id, root, n, fingerprint) of each text (id, t, root) for every shingle of its prefix.

    All texts order their shingles alike, rare buckets first. Two sets of which one holds at most n shingles and
    that share 0.8 of their union share at least ceil(0.8 n): one of the first n - ceil(0.8 n) + 1 is common to both
    prefixes. No pair is missed, however the order was counted; it keeps common passages out of the keys.
    """
    sent = texts.sparkSession.sparkContext.broadcast(sums)
    num, den = STAGE_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        rank = sent.value
        for batch in batches:
            ids, roots = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            keys, prints = [np.zeros(0, np.uint64)], np.zeros((len(ids), STAGE_PRINTS), np.uint64)
            n, count = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for i, t in enumerate(batch.column(1).to_pylist()):
                h = _hashes(t)
                if len(h):
                    n[i], count[i] = len(h), len(h) - -(-len(h) * num // den) + 1
                    keys.append(h[np.lexsort((h, rank[_bucket(h)]))[: count[i]]])
                    prints[i] = _set_print(h)
            give_back()
            row = np.repeat(np.arange(len(ids)), count)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids[row]), pa.array(roots[row]), pa.array(n[row]), *[pa.array(prints[row, k].view(np.int64)) for k in range(STAGE_PRINTS)]], names=["key", "id", "root", "n", *_PRINT])

    return texts.select("id", "t", "root").mapInArrow(run, "key long, id long, root long, n long, " + ", ".join(f"{w} long" for w in _PRINT))


def _may_share(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows (n, fingerprint) can be near-duplicates by their sizes and bits."""
    num, den = STAGE_SHARE
    a, b = x[..., 0].astype(np.int64), y[..., 0].astype(np.int64)
    return (np.minimum(a, b) * den >= np.maximum(a, b) * num) & _near(x[..., 1:], y[..., 1:], STAGE_BITS)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows (root, n, fingerprint) of different roots can be near-duplicates."""
    return (x[..., 0] != y[..., 0]) & _may_share(x[..., 1:], y[..., 1:])


def _candidates(keyed: DataFrame) -> DataFrame:
    """Ids of different roots that share a key and may be near-duplicates, as (a, b): all pairs of small runs, of large ones a spanning forest.

    The members of large runs follow as rows with a key, the id as ``a``, the size and the fingerprint.
    """
    count = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["a", "b", "key", "n", *_PRINT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large: list[np.ndarray] = []

        def seen(key: np.ndarray, ids: np.ndarray, words: np.ndarray) -> None:
            length = np.diff(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))))
            of = np.repeat(length > SMALL_RUN, length)
            if of.any():
                large.append(np.column_stack((ids[of], key[of], words[of, 1:].view(np.int64))))

        for found in _linked(batches, _apart, 2 + STAGE_PRINTS, seen):
            none = pa.nulls(found.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*found.columns, *[none] * (2 + STAGE_PRINTS)], names=names)
            while large:
                yield members(large.pop())
        while large:
            yield members(large.pop())

    def members(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.nulls(len(x), pa.int64()), *[pa.array(x[:, k]) for k in range(1, x.shape[1])]], names=names)

    dealt = keyed.repartition(count, "key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that share enough shingles; two texts of a repeated id both count for it."""
    num, den = STAGE_SHARE
    pairs = written(pairs, "pairs")
    ids = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = written(_shingle_sets(met(texts, ids, "id", "left_semi")), "sets")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("hashes").alias(f"h_{c}"))
    both = F.size(F.array_intersect("h_a", "h_b")).cast("long")
    return pairs.join(side("b"), "b").join(side("a"), "a").where(both * (num + den) >= (F.col("n_a") + F.col("n_b")) * num).select("a", "b").distinct()


def _shared(row: np.ndarray, shingle: np.ndarray, n_rows: int, row_b: np.ndarray, shingle_b: np.ndarray, n_rows_b: int) -> np.ndarray:
    """How many shingles each row of one side has in common with each of the other, counted exactly: products of memberships, ``COLUMNS`` shingles at a time."""
    common = np.intersect1d(shingle, shingle_b)
    out = np.zeros((n_rows, n_rows_b), np.float32)  # whole numbers far below 2**24
    for at in range(0, len(common), COLUMNS):
        some = common[at : at + COLUMNS]
        sides = []
        for rows, shingles_, n in ((row, shingle, n_rows), (row_b, shingle_b, n_rows_b)):
            place = np.minimum(np.searchsorted(some, shingles_), len(some) - 1)
            use = some[place] == shingles_
            sides.append(np.zeros((n, len(some)), np.float32))
            sides[-1][rows[use], place[use]] = 1
        out += sides[0] @ sides[1].T
    return out


def _joining(ids: np.ndarray, root: np.ndarray, part: np.ndarray, words: np.ndarray, hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """Near-duplicates of one run that join different roots: as many links as join all that can be joined, never all pairs.

    Rows of the same ``part`` are met elsewhere if there is more than one. Pairs that sizes and fingerprints let pass
    are counted exactly, in tiles.
    """
    num, den = STAGE_SHARE
    n, root = words[:, 0].astype(np.int64), root.copy()
    _, shingle, times = np.unique(hashes, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(ids)), n)
    keep = times[shingle] > 1  # others no pair can share
    row, shingle = row[keep], shingle[keep]
    begin = np.searchsorted(row, np.arange(len(ids) + 1))
    mixed = part.min() != part.max()
    a, b = [], []
    for i, j in itertools.combinations_with_replacement(range(0, len(ids), TILE), 2):
        x, y = slice(i, min(i + TILE, len(ids))), slice(j, min(j + TILE, len(ids)))
        may = (root[x, None] != root[y]) & _may_share(words[x, None], words[None, y])
        if mixed:
            may &= part[x, None] != part[y]
        if i == j:
            may = np.triu(may, 1)
        if not may.any():
            continue
        of_x, of_y = slice(begin[x.start], begin[x.stop]), slice(begin[y.start], begin[y.stop])
        both = _shared(row[of_x] - i, shingle[of_x], x.stop - i, row[of_y] - j, shingle[of_y], y.stop - j)
        r, s = np.nonzero(may & (both * (num + den) >= (n[x, None] + n[y]) * num))
        _, first = np.unique(np.stack((root[i + r], root[j + s])), axis=1, return_index=True)
        for k in first.tolist():
            u, v = i + r[k], j + s[k]
            if root[u] != root[v]:
                a.append(int(ids[u]))
                b.append(int(ids[v]))
                root[root == root[v]] = root[u]
    return a, b


def _across(large: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of near-duplicates in different components that share a key of a large run, counted where the run is.

    A forest's link may fail where another pair of its run would hold: all pairs left are asked here, by their whole sets, and only
    links that hold and join components come out. A run of more than ``BLOCK`` shingles is dealt in parts, each two of them to a task.
    """
    rows = met(large, found.withColumnRenamed("node", "id"), "id").select("key", "id", F.coalesce("root", "id").alias("root"), "n", *_PRINT)
    rows = written(rows, "large-runs")
    sums = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("held")).where("low < high")
    mixed = written(sums.select("key", F.ceil(F.col("held") / BLOCK).alias("parts")), "mixed-runs")
    asked = written(looked_up(rows, mixed, "key", "inner").withColumn("part", F.pmod(F.xxhash64("id"), "parts")), "asked")
    sets = written(_shingle_sets(met(texts, written(asked.select("id").distinct(), "ids"), "id", "left_semi")), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            cols = [np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(3, 7 + STAGE_PRINTS)]
            hashes = np.concatenate([x.column(7 + STAGE_PRINTS).flatten().to_numpy() for x in held])
            a, b = _joining(cols[0], cols[1], cols[2], np.stack(cols[3:], 1).view(np.uint64), hashes)
            held.clear()
            del cols, hashes
            give_back()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        last = None
        for batch in batches:
            run_of = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            edge = np.flatnonzero(np.concatenate(([True], (run_of[1:] != run_of[:-1]).any(1), [True]))) if len(run_of) else []
            for lo, hi in itertools.pairwise(edge):
                if held and last != run_of[lo].tolist():
                    yield done()
                held.append(batch.slice(lo, hi - lo))
                last = run_of[lo].tolist()
        if held:
            yield done()

    count = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    paired = asked.join(sets.select("id", "hashes"), "id").select("*", others).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    dealt = paired.select("key", "low", "high", "id", "root", "part", "n", *_PRINT, "hashes").repartition(count, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(run, "a long, b long")


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of near-duplicates; columns as they were, whatever their names.

    Groups are the components of all pairs that share 0.8 or more of their distinct five-word shingles: links come from
    the covering of the fingerprints, are counted exactly, and a prefix join asks the pairs of texts that are then still in
    different components. Null texts are
    empty and texts without a word are one group. The least id of a group stays. Ids are whole numbers (others raise).
    Rows that repeat an id, and rows without one, stand each for their own text, after other rows and in the order of a hash;
    of rows that repeat id and text one stays. An empty table gives no rows.
    """
    node = free_name(docs, "near_node")[0]
    rows = _nodes(docs, id_col, text_col, node)
    texts = rows.select(F.col(node).alias("id"), F.col(text_col).cast("binary").alias("t"))
    sketches = written(_sketches(texts), "sketches")
    near = written(_covered(sketches, texts), "covered")
    found = components(near)
    rooted = met(texts, found.withColumnRenamed("node", "id"), "id").withColumn("root", F.coalesce("root", "id"))
    candidates = written(_candidates(_keyed(rooted, _bucket_sums(sketches))), "candidates")
    pairs = candidates.where("key is null and a != b").select("a", "b").distinct()
    large = candidates.where("key is not null").select("key", F.col("a").alias("id"), "n", *_PRINT)
    found = extended(found, _verified(pairs, texts))
    found = extended(found, written(_across(large, found, texts), "across"))
    # texts without a word have no shingle and stand in no link
    blank = texts.where(~F.coalesce(F.col("t").cast("string"), F.lit("")).rlike(WORD)).select("id")
    least = blank.agg(F.min("id")).first()[0]
    drop = found.where("node != root").select("node")
    if least is not None:
        drop = drop.unionByName(blank.where(F.col("id") != least).select(F.col("id").alias("node")))
    drop = written(drop.withColumnRenamed("node", node), "dropped")
    return met(rows, drop, node, "left_anti").dropDuplicates([node]).select(*docs.columns)
