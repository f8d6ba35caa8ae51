"""Bucketed index versions: copy on write, joins without a shuffle, point lookups, time travel."""

import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as ix
from tessera.session import ensure_checkpoint_dir
from tessera.sources import store

def now():
    return F.to_timestamp(F.lit("2024-06-01 00:00:00"))



def _root(spark):
    return f"{ensure_checkpoint_dir(spark)}/b-{uuid.uuid4().hex}"


def _links(spark, ids, title="t", status="indexed"):
    rows = [(f"https://site{i % 7}.example/{i}", f"{title}{i}", "f", None, f"site{i % 7}", status) for i in ids]
    return spark.createDataFrame(rows, "url string, title string, folder string, date_added timestamp, domain string, status string")


def _chunks(spark, ids, tag="a", per=3):
    rows = [(f"https://site{i % 7}.example/{i}", k, f"{tag}-{i}-{k}") for i in ids for k in range(per)]
    return spark.createDataFrame(rows, "url string, chunk_index int, chunk_text string")


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.fixture(scope="module")
def index(spark):
    root = _root(spark)
    ix.merge_index(spark, root, _links(spark, range(200)), _chunks(spark, range(200)), now(), buckets=200)
    return root


def test_a_run_rewrites_the_buckets_it_touches(spark, index):
    before = store.files_of(spark, index)
    v = store.current_version(spark, index)
    ids = [17, 55]  # 1 % of the urls
    assert ix.merge_index(spark, index, _links(spark, ids, "new"), _chunks(spark, ids, "b", 2), F.to_timestamp(F.lit("2024-07-01 00:00:00"))) == v + 1
    after = store.files_of(spark, index)
    for table in ("links", "chunks"):
        assert len(after[table] - before[table]) <= 2 and len(after[table] & before[table]) >= len(before[table]) - 2
    links = {r.url: r for r in store.read_current(spark, index, "links").collect()}
    assert len(links) == 200 and links["https://site3.example/17"].title == "new17" and links["https://site4.example/18"].title == "t18"
    assert str(links["https://site3.example/17"].created_at) == "2024-06-01 00:00:00" and str(links["https://site3.example/17"].updated_at) == "2024-07-01 00:00:00"
    texts = {r.chunk_text for r in store.read_current(spark, index, "chunks").collect()}
    assert {"b-17-0", "b-17-1", "b-55-1", "a-18-2"} <= texts and not any(t.startswith("a-17-") for t in texts) and len(texts) == 598
    # the version before is whole
    assert store.read_current(spark, index, "chunks", version=v).count() == 600
    assert {r.title for r in store.read_current(spark, index, "links", version=v).collect()} == {f"t{i}" for i in range(200)}


def test_a_failed_link_keeps_its_chunks_and_new_urls_come_in(spark):
    root = _root(spark)
    ix.merge_index(spark, root, _links(spark, range(5)), _chunks(spark, range(5)), now(), buckets=4)
    ix.merge_index(spark, root, _links(spark, [2], status="failed").union(_links(spark, [9])), _chunks(spark, [9]), now())
    links = {r.url: r.status for r in store.read_current(spark, root, "links").collect()}
    assert links["https://site2.example/2"] == "failed" and len(links) == 6
    assert store.read_current(spark, root, "chunks").where("url = 'https://site2.example/2'").count() == 3
    v = ix.merge_index(spark, root, _links(spark, []), _chunks(spark, []), now(), {"batch": 7})
    assert store.manifest(spark, root)["note"] == {"batch": 7} and store.files_of(spark, root, v) == store.files_of(spark, root, v - 1)


def test_join_of_stored_tables_has_no_exchange(spark, index):
    chunks, links = (store.read_current(spark, index, t) for t in ("chunks", "links"))
    joined = chunks.hint("merge").join(links.drop("date_added"), "url")
    assert _exchanges(joined) == 0
    assert joined.count() == chunks.count()
    shuffled = chunks.repartition(3).join(links.drop("date_added").repartition(3), "url")
    assert sorted(map(str, joined.collect())) == sorted(map(str, shuffled.collect()))


def _scan(df):
    """(files read, rows that the scan gave out) of the executed plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    for leaf in _leaves(plan):
        metrics = leaf.metrics()
        if metrics.contains("numFiles"):
            return metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()


def _leaves(plan):
    if "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan()
    if plan.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage")):
        plan = plan.plan()
    kids = plan.children()
    return [plan] if kids.isEmpty() else [x for k in range(kids.size()) for x in _leaves(kids.apply(k))]


def test_lookup_reads_a_few_row_groups(spark, monkeypatch):
    monkeypatch.setattr(store, "ROW_GROUP", 1 << 14)
    root = _root(spark)
    rows = spark.range(20_000).select(F.concat(F.lit("https://x.example/"), F.col("id")).alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
    store.publish_index(spark, root, {"links": rows}, buckets=16)
    want = [f"https://x.example/{i}" for i in range(0, 20_000, 2_000)]
    asked = spark.createDataFrame([(u,) for u in [*want, "https://x.example/none", None]], "url string")
    found = store.lookup(spark, root, "links", asked)
    files, seen = _scan(found)
    assert sorted(r.url for r in found.collect()) == sorted(want)
    assert files <= 11 and seen < 20_000 * 0.25, (files, seen)
    absent = spark.createDataFrame([(f"https://x.example/1{i}a",) for i in range(10)], "url string")
    assert _scan(store.lookup(spark, root, "links", absent))[1] < 5_000  # Bloom filters: hardly any row group is read
    many = rows.where("id % 3 = 0").select("url")
    joined = store.lookup(spark, root, "links", many)
    assert joined.count() == 6_667
    assert store.lookup(spark, root, "links", asked.limit(0)).count() == 0 and store.lookup(spark, _root(spark), "links", asked) is None


def test_vacuum_keeps_what_recent_versions_name(spark):
    root = _root(spark)
    for k in range(4):
        ix.merge_index(spark, root, _links(spark, [k]), _chunks(spark, [k]), now(), buckets=2)
    assert store.vacuum(spark, root, keep=1) > 0
    assert store.read_current(spark, root, "links").count() == 4 and store.manifest(spark, root, 4)
    with pytest.raises(Exception, match="v0*3.json"):
        store.manifest(spark, root, 3)
