"""Passage containment against brute force: long and short passages, word edges, white space."""

import random

from tessera.operators.match import contains_passages


def test_containment_matches_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["alpha", "beta", "gam", "ma", "delta", "x", "é", "yy"])
    docs = [(k, "".join(word() + rng.choice([" ", " ", "  ", "\n", ""]) for _ in range(rng.randint(1, 40)))) for k in range(40)]
    docs += [(100, ""), (101, None), (102, "x"), (103, "gamma")]
    passages = [(0, ""), (1, None), (2, "x"), (3, "am"), (4, "zeta"), (5, " "), (6, "a b"), (7, "delta x yy  é")]
    for k in range(10, 120):  # cut anywhere, also inside words
        t = rng.choice(docs[:40])[1]
        a = rng.randrange(len(t))
        passages.append((k, t[a:a + rng.choice([1, 2, 3, 4, 5, 9, 30, 80])]))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    p = spark.createDataFrame(passages, "item_id bigint, text string")
    got = [(r.doc_id, r.item_id) for r in contains_passages(d, "doc_id", "text", p, "item_id", "text").collect()]
    want = {(di, pi) for di, dt in docs for pi, pt in passages if dt and pt and pt in dt}
    assert len(got) == len(set(got)) and set(got) == want


def test_hot_url_last_wins(spark):
    """One url holding a third of the rows still reduces to its last row."""
    from pyspark.sql import functions as F

    from tessera.operators.index import last_wins
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("url"),
        F.col("id").cast("string").alias("title"), F.floor(F.col("id") / 100).alias("file_id"), (F.col("id") % 100).alias("pos"))
    got = {r.url: r.title for r in last_wins(df).collect()}
    assert len(got) == 1 + (n - n // 3) and got["hot"] == str(n - 3)


def test_only_branches_with_passages_are_planned(spark):
    d = spark.createDataFrame([(1, "one two three four five six"), (2, "xyz")], "doc_id bigint, text string")
    p = spark.createDataFrame([(7, "ne two three four fi")], "item_id bigint, text string")
    long_only = contains_passages(d, "doc_id", "text", p, "item_id", "text")
    assert [tuple(r) for r in long_only.collect()] == [(1, 7)]
    plan = long_only._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0 and plan.count("LogicalRDD") + plan.count("LocalRelation") <= 4
    p2 = p.union(spark.createDataFrame([(8, "y"), (9, "four five six"), (10, None)], p.schema))
    assert sorted(map(tuple, contains_passages(d, "doc_id", "text", p2, "item_id", "text").collect())) == [(1, 7), (1, 9), (2, 8)]
    assert contains_passages(d, "doc_id", "text", p.limit(0), "item_id", "text").count() == 0
    many = spark.createDataFrame([(k, "xyz"[:1 + k % 3]) for k in range(100)], p.schema)
    assert contains_passages(d, "doc_id", "text", many, "item_id", "text").count() == 134  # 'xyz' holds all, 'one ... six' the 34 that are 'x'
