"""Distributions whose figures lie just between two roundings, against exact fractions and the SQL."""

import itertools
from fractions import Fraction

import duckdb

from polyweft.plans import metric_queries


def test_halves_go_to_even_in_any_order_of_rows(spark, tmp_path):
    # squares over 6400: 210937.5 and 215312.5 millionths
    users = [list(zip("abcde", p)) for c in ((21, 17, 18, 14, 10), (22, 19, 9, 16, 14)) for p in itertools.permutations(c)]
    users += [[("a", 129), ("b", 128)], [("a", 1)], [(None, 2), ("b", 2), ("a", 1)], [(f"t{i}", 2 ** max(0, 7 - i)) for i in range(9)]]
    assert sum(Fraction(10**6 * sum(n * n for _, n in u), sum(n for _, n in u) ** 2).denominator == 2 for u in users) > 200
    rows = [(u, label) for u, counts in enumerate(users) for label, n in counts for _ in range(n)]
    spark.createDataFrame(rows, "user_id long, event_type string").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    df = metric_queries.distribution_metrics(spark, str(tmp_path))
    got = {r.user_id: r.asDict() for r in df.collect()}
    for u, counts in enumerate(users):
        ns = sorted((n for _, n in counts), reverse=True)
        total, squares, a, b = sum(ns), sum(n * n for n in ns), ns[0], (ns + [0])[1]
        want = {"hhi": Fraction(squares, total**2), "effective": Fraction(total**2, squares), "spread": Fraction(a, ns[-1]), "pair_share": Fraction(a + b, total), "pair_balance": Fraction(b, a), "pair_gap": Fraction(a - b, total), "bimodality": Fraction((a + b) * b, total * a)}
        assert {k: got[u][k] for k in want} == {k: round(10**6 * v) for k, v in want.items()}, counts
    assert got[len(users) - 2]["first"] == "b"  # null stands last among equal counts
    assert got[len(users) - 1]["entropy"] == 1992188  # exactly 1992187.5
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    sql = con.sql(metric_queries.ORACLES["distribution_metrics"])
    assert sorted(map(repr, sql.select(*df.columns).fetchall())) == sorted(repr(tuple(r)) for r in df.collect())
