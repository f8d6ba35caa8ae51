"""Index state: the ``links`` and ``chunks`` tables as immutable snapshots.

``upsert_links`` and ``replace_chunks`` are pure functions of (old rows, new
rows); ``merge_index`` applies them to the buckets that a run touches and
publishes the result as the next version (``tessera.sources.store``), so a
failed or retried job never leaves a half-written table behind and re-running
a step gives the same result.

Scale notes.  ``upsert_links`` is one aggregate by ``url`` over old and new
rows (combined map-side, so a url repeated a million times sends one row per
task).  ``replace_chunks`` anti-joins the old chunks with the touched urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import store

# The stored columns of a link.
LINK_COLS = ("url", "title", "folder", "date_added", "domain", "status", "created_at", "updated_at")
# Columns that are stored too where a run has them (null for links of runs without).
LINK_EXTRAS = ("icon",)


def last_wins(links: DataFrame, key: str = "url", order: tuple[str, ...] = ("file_id", "pos")) -> DataFrame:
    """One row per ``key``: the last one in (file, position) order.

    ``max_by`` over a struct is a plain aggregation, so a url repeated a
    million times is combined map-side instead of sorted in one task.  Order
    columns that the rows lack are left out; the rows' own values break ties,
    so the choice is the same in every run.
    """
    cols = [c for c in links.columns if c != key]
    packed = F.struct(*[F.col(c) for c in cols])
    by = F.struct(*[F.col(c) for c in order if c in cols], *[F.col(c).cast("string") for c in cols if c not in order])
    return (links.groupBy(key).agg(F.max_by(packed, by).alias("_r"))
            .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]))


def _extras(*tables: DataFrame) -> tuple[str, ...]:
    """The optional link columns that any of the tables has."""
    return tuple(c for c in LINK_EXTRAS if any(c in t.columns for t in tables))


def _one_per_url(new: DataFrame) -> DataFrame:
    """The link columns a run writes, one row per url: the last one wins."""
    order = tuple(c for c in ("file_id", "page_id", "pos") if c in new.columns)
    cols = ("url", "title", "folder", "date_added", "domain", "status", *_extras(new))
    return last_wins(new.select(*cols, *order), order=order).select(*cols)


def first_snapshot(new: DataFrame, now: Column) -> DataFrame:
    """The link table of a first run: every url inserted once (the last of repeated rows)."""
    return _one_per_url(new).select("*", now.alias("created_at"), now.alias("updated_at"))


def upsert_links(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Insert or update by url: new values win, ``created_at`` kept from the
    old row (``now`` for inserts), ``updated_at`` = now; untouched rows stay.
    A url repeated in ``new`` counts once, with its last row."""
    fresh = (_one_per_url(new).withColumn("created_at", F.lit(None).cast("timestamp"))
             .withColumn("updated_at", now).withColumn("_new", F.lit(1)))
    stored = (*LINK_COLS, *_extras(old, new))
    both = old.select(*[c for c in stored if c in old.columns]).withColumn("_new", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
    # per url at most one old and one new row meet
    row = F.max_by(F.struct(*[F.col(c) for c in stored if c not in ("url", "created_at")]), F.col("_new")).alias("_r")
    merged = both.groupBy("url").agg(row, F.max("_new").alias("_new"), F.min("created_at").alias("_created"))
    cols = {c: F.col(f"_r.{c}") for c in stored}
    cols |= {"url": F.col("url"), "created_at": F.coalesce("_created", now)}
    return merged.select(*[cols[c].alias(c) for c in stored])


def replace_chunks(old: DataFrame, new: DataFrame, key: str = "url", touched: DataFrame | None = None) -> DataFrame:
    """All chunks of every url present in ``new`` are replaced by the new ones;
    urls absent from ``new`` (including a url whose new chunk set is empty)
    keep their old chunks.

    A chunk repeated in ``new`` (same url and index) counts once.  ``touched``
    names the urls with new chunks where the caller knows them, which saves
    building the chunks twice."""
    at = [c for c in (key, "chunk_index") if c in new.columns]
    once = new.dropDuplicates(at) if len(at) == 2 else new
    urls = (new if touched is None else touched).select(key).distinct()
    return old.join(urls, key, "left_anti").unionByName(once)


def merge_index(spark: SparkSession, root: str, links: DataFrame, chunks: DataFrame, now: Column, note: dict | None = None,
                buckets: int | None = None, errors: DataFrame | None = None) -> int:
    """Merge a run's link rows and chunks into the index under ``root``; the version published.

    Only the url buckets that hold a url of ``links`` (or ``errors``) are read
    and written, so the work follows the run and not the index.  A run without
    links changes nothing but the version's note.  ``errors`` (url and more):
    urls that raised; table ``quarantine`` takes them up, and lets go of the
    urls that this run wrote."""
    m = store.manifest(spark, root)
    if m is None:
        tables = {"links": first_snapshot(links, now), "chunks": chunks.dropDuplicates(["url", "chunk_index"])}
        return store.publish_index(spark, root, tables | ({"quarantine": errors.dropDuplicates(["url"])} if errors is not None else {}),
                                   note, buckets=buckets)
    number = store.bucket_of("url", m["buckets"])
    seen = links.select("url") if errors is None else links.select("url").unionByName(errors.select("url"))
    touched = sorted(r[0] for r in seen.select(number).distinct().collect())  # as many numbers as buckets at most
    old_links, old_chunks = (store.read_current(spark, root, t, buckets=touched) for t in ("links", "chunks"))
    indexed = links.where(F.col("status") == "indexed")
    tables = {"links": upsert_links(old_links, links, now), "chunks": replace_chunks(old_chunks, chunks, touched=indexed)}
    if errors is not None:
        held = store.read_current(spark, root, "quarantine", buckets=touched)
        once = errors.dropDuplicates(["url"])
        tables["quarantine"] = once if held is None else replace_chunks(held, once, touched=seen)
    return store.publish_index(spark, root, tables, note, touched=touched)


def index_stats(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """total_links, failed_links, total_chunks as one row (zeros when empty).

    One global aggregate over the union of both tables (partial counts per
    partition, one tiny final merge) -- no join."""
    u = (links.select(F.lit(1).alias("is_link"), (F.col("status") == "failed").alias("is_failed"))
         .unionByName(chunks.select(F.lit(0).alias("is_link"), F.lit(False).alias("is_failed"))))
    return u.agg(F.coalesce(F.sum("is_link"), F.lit(0)).cast("bigint").alias("total_links"),
                 F.count_if("is_failed").cast("bigint").alias("failed_links"),
                 (F.count(F.lit(1)) - F.coalesce(F.sum("is_link"), F.lit(0))).cast("bigint").alias("total_chunks"))


def get_by_url(links: DataFrame, requested: DataFrame) -> DataFrame:
    """Batch point lookup: every requested url with all link columns (null
    when the url is unknown).  Filter pushdown makes a single lookup a
    Parquet row-group skip."""
    return requested.select("url").join(links, "url", "left")


def list_urls(links: DataFrame) -> DataFrame:
    return links.select("url")
