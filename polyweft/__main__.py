"""python -m polyweft info | validate FILE | demo: small commands over word streams; exit code 1 on failure."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    s = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="polyweft")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("info")
    commands.add_parser("demo")
    commands.add_parser("validate").add_argument("path")
    args = parser.parse_args(argv)
    from polyweft.functions import words as W

    if args.command == "info":
        print(json.dumps({"labels": list(W.LABELS), "word_max": W.WORD_MAX}))
        return 0
    from polyweft.operators import streams as S
    from polyweft.sources import files

    spark = _session()
    if args.command == "demo":
        from pyspark.sql import functions as F

        from polyweft.functions import text as T

        words = spark.createDataFrame([(1, "Café in 日本")], "stream_id long, t string").select("stream_id", T.encode(F.col("t")).alias("words"))
        stream = S.from_arrays(words)
    else:
        stream = files.read_words_json(spark, args.path, valid=False)
    row = S.summary(stream).first()
    print(json.dumps(row.asDict() if row else {"valid": False, "errors": ["no words"]}, default=str))
    return 0 if row and row["valid"] else 1


if __name__ == "__main__":
    sys.exit(main())
