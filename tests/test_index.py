"""Link upsert, chunk replace, stats, lookups."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import index as ix

LINKS = ("url string, title string, folder string, date_added timestamp, domain string, status string, "
         "created_at timestamp, updated_at timestamp")
NEW = "url string, title string, folder string, date_added timestamp, domain string, status string"
T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def test_upsert_keeps_created_at(spark):
    old = spark.createDataFrame([("u1", "Old", "f", T0, "d", "indexed", T0, T0),
                                 ("u2", "Keep", "f", T0, "d", "indexed", T0, T0)], LINKS)
    new = spark.createDataFrame([("u1", "New", "g", T0, "d", "failed"), ("u3", "Ins", "f", T0, "d", "indexed")], NEW)
    out = {r.url: r for r in ix.upsert_links(old, new, F.lit(T1)).collect()}
    assert (out["u1"].title, out["u1"].status, out["u1"].created_at, out["u1"].updated_at) == ("New", "failed", T0, T1)
    assert (out["u2"].title, out["u2"].updated_at) == ("Keep", T0)
    assert (out["u3"].created_at, out["u3"].updated_at) == (T1, T1)


def test_upsert_is_idempotent(spark):
    new = spark.createDataFrame([("u1", "A", "f", T0, "d", "indexed")], NEW)
    empty = spark.createDataFrame([], LINKS)
    once = ix.upsert_links(empty, new, F.lit(T1))
    twice = ix.upsert_links(once, new, F.lit(T1))
    assert sorted(once.collect()) == sorted(twice.collect())


def test_replace_chunks(spark):
    old = spark.createDataFrame([("u1", 0, "a"), ("u1", 1, "b"), ("u2", 0, "c")], "url string, chunk_index int, t string")
    new = spark.createDataFrame([("u1", 0, "z")], "url string, chunk_index int, t string")
    got = sorted((r.url, r.chunk_index, r.t) for r in ix.replace_chunks(old, new).collect())
    assert got == [("u1", 0, "z"), ("u2", 0, "c")]
    none = spark.createDataFrame([], "url string, chunk_index int, t string")
    assert ix.replace_chunks(old, none).count() == 3          # empty new set deletes nothing


def test_stats_and_lookup(spark):
    links = spark.createDataFrame([("u1", "A", "f", T0, "d", "indexed", T0, T0),
                                   ("u2", "B", "f", T0, "d", "failed", T0, T0)], LINKS)
    chunks = spark.createDataFrame([("u1", 0), ("u1", 1), ("u1", 2)], "url string, chunk_index int")
    s = ix.index_stats(links, chunks).first()
    assert (s.total_links, s.failed_links, s.total_chunks) == (2, 1, 3)
    e = ix.index_stats(spark.createDataFrame([], LINKS), spark.createDataFrame([], "url string, chunk_index int")).first()
    assert (e.total_links, e.failed_links, e.total_chunks) == (0, 0, 0)
    req = spark.createDataFrame([("u2",), ("nope",)], "url string")
    got = {r.url: r.title for r in ix.get_by_url(links, req).collect()}
    assert got == {"u2": "B", "nope": None}


def test_last_wins(spark):
    df = spark.createDataFrame([("u", "first", 0, 0), ("u", "second", 0, 5), ("v", "only", 1, 0),
                                ("u", "third", 1, 2)], "url string, title string, file_id int, pos int")
    got = {r.url: r.title for r in ix.last_wins(df).collect()}
    assert got == {"u": "third", "v": "only"}


def test_repeated_urls_and_chunks_count_once(spark):
    rows = [("u", "first", "f", T0, "d", "failed", 0, 0), ("u", "last", "f", T0, "d", "indexed", 0, 1), ("v", "only", "f", T0, "d", "indexed", 1, 0)]
    new = spark.createDataFrame(rows, NEW + ", file_id int, pos int")
    want = {"u": "last", "v": "only"}
    first = ix.first_snapshot(new, F.lit(T0))
    assert first.count() == 2 and {r.url: r.title for r in first.collect()} == want
    again = ix.upsert_links(first, new, F.lit(T1))
    assert again.count() == 2 and {r.url: r.title for r in again.collect()} == want
    assert {(r.created_at, r.updated_at) for r in again.collect()} == {(T0, T1)}
    chunks = spark.createDataFrame([("u", 0, "a"), ("u", 0, "a"), ("u", 1, "b")], "url string, chunk_index int, t string")
    assert ix.replace_chunks(chunks.limit(0), chunks).count() == 2
