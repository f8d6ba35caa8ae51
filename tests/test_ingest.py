"""The path from exports to the index: as-of fetches, outcomes, errors as rows."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions.html import clean_html, clean_html_guarded
from tessera.operators.embed import DEFAULT_DIM, HashModel, guarded_embedder
from tessera.plans import ingest as ing
from tessera.session import ensure_checkpoint_dir
from tessera.sources import store

NOW = "2024-09-01 00:00:00"
LOG = "url string, fetched_at timestamp, fetch_id long, http_status int, content_type string, transport_error string, body string"
LINKS = "file_id long, pos int, url string, title string, folder string, date_added timestamp, icon string, as_of timestamp, extra string"
RULES = "origin string, entry int, ua string, ord int, allow boolean, prefix string"
BROKEN = "&#" + "9" * 4400 + ";"


def day(n):
    return datetime.datetime(2024, 1, n)


def page(words):
    return f"<html><body><article><p>{words} {'plain text of this page goes on. ' * 6}</p></article></body></html>"


def fetch(url, n, body, status=200, fetch_id=0, error=None):
    return (url, day(n), fetch_id, status, "text/html", error, body)


def link(url, as_of, pos=0, folder="f", icon=None, title="t"):
    return (1, pos, url, title, folder, day(2), icon, as_of, "x")


@pytest.fixture()
def ingest(spark):
    root = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"

    def run(links, log, rules=(), **options):
        ing.ingest_links(spark, root, spark.createDataFrame(links, LINKS), spark.createDataFrame(log, LOG),
                         spark.createDataFrame(list(rules), RULES), F.to_timestamp(F.lit(NOW)), buckets=3, **options)
        return [{r.url: r for r in store.read_current(spark, root, t).collect()} for t in ("links", "chunks", "quarantine")]
    return run


def test_a_link_gets_its_last_fetch_at_or_before_its_date(spark):
    links = spark.createDataFrame([("a", day(5)), ("b", day(5)), ("c", day(1)), ("d", None)], "url string, as_of timestamp")
    log = [fetch("a", 3, "old"), fetch("a", 5, "at"), fetch("a", 6, "later"), fetch("b", 4, "first", fetch_id=1),
           fetch("b", 4, "second", fetch_id=2), fetch("c", 2, "late"), fetch("d", 1, "x"), fetch("e", 1, "not asked")]
    got = {r.url: (r.body, r.transport_error) for r in ing.latest_fetch(links, spark.createDataFrame(log, LOG)).collect()}
    assert got == {"a": ("at", None), "b": ("second", None), "c": (None, ing.NOT_CRAWLED), "d": (None, ing.NOT_CRAWLED)}
    assert ing.latest_fetch(links, spark.createDataFrame([], LOG)).where(F.col("transport_error") == ing.NOT_CRAWLED).count() == 4


def test_folder_date_and_icon_arrive_and_errors_write_no_link(ingest):
    links = [link("http://s/ok", day(9), 0, "old"), link("http://s/ok", day(9), 1, "F/G", "data:i", "T"), link("http://s/gone", day(9)),
             link("http://s/bad", day(9)), link("http://s/short", day(9)), link("http://s/new", day(1)), link(None, day(9)),
             link("http://r/shut", day(9))]
    log = [fetch("http://s/ok", 3, page("fine")), fetch("http://s/gone", 3, "", 404), fetch("http://s/bad", 3, page(BROKEN)),
           fetch("http://s/short", 3, "<p>few</p>"), fetch("http://s/new", 4, page("too late")), fetch("http://r/shut", 3, page("no")),
           fetch("http://s/ok", 3, page("fine"))]  # a repeated log row
    stored, chunks, errors = ingest(links, log, [("http://r", 0, "*", 0, False, "/")])
    assert {u: r.status for u, r in stored.items()} == {"http://s/ok": "indexed", "http://s/gone": "failed", "http://s/new": "failed", "http://r/shut": "failed"}
    ok = stored["http://s/ok"]
    assert (ok.title, ok.folder, ok.icon, ok.date_added, ok.domain) == ("T", "F/G", "data:i", day(2), "s")
    assert set(chunks) == {"http://s/ok"} and len(chunks["http://s/ok"].embedding) == DEFAULT_DIM
    assert {u: (r.stage, r.error) for u, r in errors.items()} == {"http://s/bad": ("clean", "ValueError")}
    assert "4400 digits" in errors["http://s/bad"].message


def test_a_later_run_takes_a_url_out_of_quarantine(ingest):
    links = [link("http://s/a", day(9)), link("http://s/b", day(9), 1)]
    _, _, errors = ingest(links, [fetch("http://s/a", 3, page(BROKEN)), fetch("http://s/b", 3, page(BROKEN))])
    assert set(errors) == {"http://s/a", "http://s/b"}
    stored, chunks, errors = ingest(links[:1], [fetch("http://s/a", 5, page("mended"))])
    assert set(stored) == set(chunks) == {"http://s/a"} and set(errors) == {"http://s/b"}


def test_an_embedder_that_raises_costs_only_the_pages_it_raised_on(ingest):
    class Fussy(HashModel):
        def embed_batch(self, texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("cannot read this")
            return super().embed_batch(texts)

    links = [link(f"http://s/{k}", day(9), k) for k in range(4)]
    log = [fetch(f"http://s/{k}", 3, page("poison" if k == 2 else f"word{k}")) for k in range(4)]
    stored, chunks, errors = ingest(links, log, embedder=guarded_embedder(lambda: Fussy(DEFAULT_DIM)))
    assert set(stored) == set(chunks) == {f"http://s/{k}" for k in (0, 1, 3)}
    assert [(e.url, e.stage, e.error, e.message) for e in errors.values()] == [("http://s/2", "embed", "RuntimeError", "cannot read this")]


def test_empty_inputs_give_an_empty_version(ingest):
    assert ingest([], []) == [{}, {}, {}]


def test_guarded_cleaning_equals_cleaning_where_nothing_raises(spark):
    rows = spark.createDataFrame([(page("&eacute; <b>x</b>"),), ("",), (None,), ("<p>short</p>",)], "html string")
    for r in rows.select(clean_html("html").alias("a"), clean_html_guarded(F.col("html")).alias("b")).collect():
        assert r.b.text == r.a and r.b.error is None
