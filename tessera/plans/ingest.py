"""One path from parsed link exports to the stored index.

Links are deduplicated by url (the last one wins), meet the latest crawl that
their export could know (``latest_fetch``), pass the robots and outcome rules,
are cleaned, chunked and embedded, and are merged into the index as one
version: ``links`` with the export's folder, date and icon, ``chunks``, and
``quarantine``.

Errors are rows.  A page whose cleaning raises, or a chunk whose embedding
raises, does not end the job: its url counts as ``error``, goes into
``quarantine`` with the stage, the exception's type and its message, and
writes neither link nor chunks.  A later run that gets through takes it out
again.  What an earlier version holds of such a url stays as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.html import clean_html_guarded
from tessera.functions.url import url_domain
from tessera.operators import index as ix
from tessera.operators.crawl import fetch_failed, fetch_outcome, robots_gate
from tessera.operators.embed import DEFAULT_DIM
from tessera.plans.pages import page_chunks

NOT_CRAWLED = "not crawled"
FETCH_COLS = ("http_status", "content_type", "transport_error", "body")


def latest_fetch(links: DataFrame, log: DataFrame) -> DataFrame:
    """As-of join: each link (unique ``url``, ``as_of``) with its last fetch at or before ``as_of``.

    ``log``: url, fetched_at, fetch_id (the larger one is later on a tie),
    http_status, content_type, transport_error, body.  A link without such a
    fetch has the transport error 'not crawled'; a null ``as_of`` reaches no
    fetch.  The choice is made on keys alone, by a maximum that is combined
    before the shuffle (a url crawled a million times sends one row a task);
    only the chosen fetches' bodies are joined.
    """
    known = log.select("url", "fetched_at", "fetch_id").join(links.select("url", "as_of"), "url")
    last = (known.where(F.col("fetched_at") <= F.col("as_of")).groupBy("url")
            .agg(F.max(F.struct("fetched_at", "fetch_id")).alias("_last")).select("url", "_last.*"))
    fetch = log.select("url", "fetched_at", "fetch_id", *FETCH_COLS).join(last, ["url", "fetched_at", "fetch_id"])
    missing = F.when(F.col("fetched_at").isNull(), F.lit(NOT_CRAWLED)).otherwise(F.col("transport_error"))
    return links.join(fetch, "url", "left").withColumn("transport_error", missing)


def judged_links(links: DataFrame, log: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per url: the link's columns, text, outcome, reason, error, message.

    outcome: 'failed' (not fetched), 'error' (cleaning raised), 'skipped' (no
    text) or 'indexed'.  Links with a null url are left out."""
    cols = ["url", "title", "folder", "date_added", "icon", "as_of"]
    order = [c for c in ("file_id", "pos") if c in links.columns]
    one = ix.last_wins(links.where(F.col("url").isNotNull()).select(*cols, *order), order=tuple(order)).select(*cols)
    fetched = fetch_failed(fetch_outcome(robots_gate(latest_fetch(one, log), rules)))
    done = fetched.select(*cols, url_domain(F.col("url")).alias("domain"), "fetch_failed", "fail_reason",
                          clean_html_guarded(F.col("content")).alias("_page")).select("*", "_page.*").drop("_page")
    outcome = (F.when(F.col("fetch_failed"), "failed").when(F.col("error").isNotNull(), "error")
               .when(F.col("text").isNull(), "skipped").otherwise("indexed"))
    reason = (F.when(F.col("fetch_failed"), F.col("fail_reason")).when(F.col("error").isNotNull(), F.col("message"))
              .when(F.col("text").isNull(), "No content after cleaning"))
    return done.withColumn("outcome", outcome).withColumn("reason", reason)


def ingest_links(spark: SparkSession, root: str, links: DataFrame, log: DataFrame, rules: DataFrame, now: Column,
                 embedder=None, note: dict | None = None, buckets: int | None = None) -> int:
    """Ingest parsed links (url, title, folder, date_added, icon, as_of, file_id, pos) into the index; its new version.

    ``embedder``: a column function text -> struct(embedding, error, message),
    see ``guarded_embedder``; by default chunks get hash embeddings.  Pages
    are cleaned once and chunks embedded once: both are written to the shared
    checkpoint folder before links, chunks and errors are taken from them.
    """
    rows = judged_links(links, log, rules).checkpoint()
    errors = rows.where(F.col("outcome") == "error").select("url", F.lit("clean").alias("stage"), "error", "message")
    if embedder is None:
        chunks = page_chunks(rows, hash_dim=DEFAULT_DIM)
    else:
        made = (page_chunks(rows).withColumn("_e", embedder(F.col("chunk_text"))).select("*", "_e.*").drop("_e").checkpoint())
        bad = (made.where(F.col("error").isNotNull()).groupBy("url")
               .agg(F.min(F.struct("chunk_index", "error", "message")).alias("_first"))
               .select("url", F.lit("embed").alias("stage"), "_first.error", "_first.message"))
        errors, rows = errors.unionByName(bad), rows.join(bad.select("url"), "url", "left_anti")
        chunks = made.drop("error", "message").join(bad.select("url"), "url", "left_anti")
    written = rows.where(F.col("outcome").isin("indexed", "failed")).withColumn("status", F.col("outcome"))
    errors = errors.withColumn("failed_at", now)
    return ix.merge_index(spark, root, written, chunks, now, note, buckets, errors=errors)
