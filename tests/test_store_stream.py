"""Snapshot publishing, export files read whole, streams equal batch runs."""

import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as ix
from tessera.plans import exports as xp
from tessera.plans import pages as pg
from tessera.session import ensure_checkpoint_dir
from tessera.sources import store
from tessera.sources.tables import read_table
from tessera.streaming.ingest import run_ingest
from tessera.streaming.progress import run_progress

SF = "/root/testdata/sf0.001"


def _root(spark):
    return f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"


def test_versions_hold_all_tables_and_readers_take_the_last(spark):
    root = _root(spark)
    assert store.read_current(spark, root, "links") is None and store.manifest(spark, root) is None
    a = spark.createDataFrame([("u1", 1)], "url string, v int")
    b = spark.createDataFrame([("u1", 2), ("u2", 3)], "url string, v int")
    assert store.publish_index(spark, root, {"links": a, "chunks": a}) == 1
    assert store.publish_index(spark, root, {"links": b, "chunks": a}, {"batch": 4}) == 2
    assert sorted(r.v for r in store.read_current(spark, root, "links").collect()) == [2, 3]
    assert store.read_current(spark, root, "chunks").count() == 1 and store.manifest(spark, root)["note"] == {"batch": 4}
    assert store.read_current(spark, root, "other") is None


def test_a_writer_that_stops_or_loses_leaves_the_old_version(spark, monkeypatch):
    root = _root(spark)
    a = spark.createDataFrame([("u1", 1)], "url string, v int")
    store.publish_index(spark, root, {"links": a})
    with monkeypatch.context() as m:  # stops between writing and publishing
        m.setattr(store, "_move_if_absent", lambda *x: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.publish_index(spark, root, {"links": a.union(a)})
    assert store.current_version(spark, root) == 1 and store.read_current(spark, root, "links").count() == 1
    with monkeypatch.context() as m:  # another writer took the number meanwhile
        m.setattr(store, "current_version", lambda *x: 0)
        with pytest.raises(Exception, match="exists"):
            store.publish_index(spark, root, {"links": a.union(a)})
    assert store.read_current(spark, root, "links").count() == 1


def test_exports_round_trip_through_files(spark):
    pages = read_table(spark, SF, "pages")
    path = xp.write_exports(spark, xp.build_exports(pages))
    files = xp.read_exports(spark, path)
    assert files.count() == xp.build_exports(pages).count()
    parsed = xp.parse_exports(
        files.withColumn("file_id", F.regexp_extract("file", r"file_id=(\d+)", 1).cast("bigint"))
             .select("file_id", "content"), xp.export_ingest_ts())
    assert parsed.count() == pages.count()


def test_stream_progress_equals_batch(spark):
    schema = read_table(spark, SF, "events").schema
    got = {r.status: r.n for r in run_progress(spark, f"{SF}/event[s].parquet", schema).collect()}
    want = {r.event_type: r["count"] for r in read_table(spark, SF, "events").groupBy("event_type").count().collect()}
    assert got == want


def test_stream_ingest_equals_batch(spark):
    schema = read_table(spark, SF, "pages").schema
    root = run_ingest(spark, f"{SF}/page[s].parquet", schema)
    links = store.read_current(spark, root, "links")
    chunks = store.read_current(spark, root, "chunks")
    batch = pg.page_links(spark, SF, 0)
    want_links = batch.where(F.col("outcome").isin("indexed", "failed")).count()
    assert links.count() == want_links
    assert chunks.count() == pg.page_chunks(batch).count()
    s = ix.index_stats(links, chunks).first()
    assert s.total_links == want_links


def test_stream_of_several_files_with_a_recrawl(spark):
    """Files arriving one by one, the last with pages seen before: as one batch run, each page once, searchable."""
    from tessera.operators.embed import hash_embedding
    from tessera.operators.retrieve import topk_batch
    from tessera.streaming.ingest import ingest_batch

    pages = read_table(spark, SF, "pages")
    src = _root(spark)
    for part in (pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1"), pages.where("page_id < 10")):
        part.coalesce(1).write.mode("append").parquet(src)
    root = run_ingest(spark, src, pages.schema, now="2024-06-01 00:00:00")
    links, chunks = store.read_current(spark, root, "links"), store.read_current(spark, root, "chunks")
    batch = pg.page_links(spark, SF, 0)
    assert links.count() == links.select("url").distinct().count() == batch.where(F.col("outcome").isin("indexed", "failed")).count()
    assert sorted(r.chunk_id for r in chunks.collect()) == sorted(r.chunk_id for r in pg.page_chunks(batch).collect())
    note = store.manifest(spark, root)["note"]
    version = store.current_version(spark, root)
    ingest_batch(spark, pages, root, "2025-01-01 00:00:00", note["batch"], note["stream"])  # a replay
    assert store.current_version(spark, root) == version
    index = pg.stored_index(spark, root)
    some = index.select("chunk_id", "chunk_text").limit(1).first()
    q = spark.createDataFrame([("q", some.chunk_text)], "query_id string, t string").withColumn("embedding", hash_embedding(F.col("t")))
    hit = topk_batch(index, q, 1, carry=["title", "folder"]).first()
    assert abs(hit.score - 1) < 1e-6 and hit.query_id == "q" and hit.title  # pages may hold equal chunks
