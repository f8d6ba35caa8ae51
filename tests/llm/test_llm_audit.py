"""The filter audit against all 120 orders applied one by one."""

from itertools import permutations

from llm_cases import awkward, brute_audit, table
from pyspark.sql import functions as F

from tessera.llm.filter_audit import audit_orders, failure_masks, order_intervals


def test_intervals_cover_every_order_once():
    orders = list(permutations(range(5)))
    for mask in range(1, 32):
        seen = {}
        for m, step, first, after in order_intervals():
            if m == mask:
                seen.update((r, (*seen.get(r, ()), step)) for r in range(first, after))
        for rank, order in enumerate(orders):
            assert seen[rank] == (next(s for s, f in enumerate(order, 1) if mask >> f & 1),)
    assert order_intervals("A") == [(1, 1, 0, 1)]


def _rows():
    rows = [(i, t, (None, "", "web", "books")[k % 4]) for k, (i, t) in enumerate(awkward())]
    prose = " ".join(f"word{k}" for k in range(60))
    rows += [(100, prose, "web"), (90, prose, "books"), (100, prose, "web"), (None, prose, "web"), (95, prose + " #", "books"), (96, "ABC " * 60, "web")]
    return rows


def _compare(spark, rows, labels, clash=False):
    docs = table(spark, rows, clash).withColumn("source", F.col("source"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    if clash:
        marks = marks.select("*", F.lit("x").alias("part"), F.lit("x").alias("mask"), F.lit("x").alias("label"))
    got = audit_orders(failure_masks(docs, marks)).collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want)
    for r in got:
        assert list(r)[3:] == want[r["part"], r["filter_order"], r["step"]], r
    return got


def test_audit_against_all_orders(spark):
    rows = _rows()
    labels = [(i, k % 3, k % 2) for k, (i, _, _) in enumerate(rows)]  # repeated and null ids too
    got = _compare(spark, rows, labels)
    assert {r["part"] for r in got} == {"", "web", "books"} and len(got) == 3 * 600
    _compare(spark, rows, [(None, None, None)], clash=True)


def test_audit_of_nothing(spark):
    assert _compare(spark, [], []) == []
