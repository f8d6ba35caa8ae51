"""Saved-page ingest over the ``pages`` table.

``pages(page_id, url, html)`` stands in for what a crawler fetched.  Because
jobs never touch the network, the transport side of each fetch (HTTP status,
content type, transport error) is *simulated* from ``page_id`` with fixed
residues, so every branch of the outcome rules is exercised by whole-table
jobs; ``attempt`` shifts the residues to model a later re-crawl.  Robots
rules files are derived per site (origin) from the host name.

Link metadata: title from ``<title>``, folder = first path segment, domain =
netloc, ``date_added`` = 2024-01-01 + page_id days (UTC).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.html import clean_html, page_title
from tessera.functions.url import first_path_segment, url_domain, url_origin
from tessera.operators.chunk import chunk_documents, chunk_id
from tessera.operators.crawl import fetch_failed, fetch_outcome, robots_gate
from tessera.sources.tables import read_table

# Fixed values for the simulated transport: residues of (page_id + 7*attempt).
STATUS_MOD, STATUS_CODES = 19, ((3, 404), (7, 403), (11, 429), (13, 500), (17, 401))
CTYPE_MOD, CTYPES = 13, ((6, "application/pdf"), (8, "Application/XHTML+XML; charset=utf-8"))
CTYPE_DEFAULT = "text/html; charset=utf-8"
TRANSPORT_MOD, TRANSPORTS = 29, ((4, "timeout"), (9, "connection refused"))
DATE_BASE_EPOCH = 1704067200  # 2024-01-01T00:00:00Z
INGEST_TS = ("2024-06-01 00:00:00", "2024-07-01 00:00:00")  # first and second run


def _case(expr: Column, pairs, default) -> Column:
    out = None
    for key, val in pairs:
        out = (F.when(expr == key, F.lit(val)) if out is None else out.when(expr == key, F.lit(val)))
    return out.otherwise(F.lit(default) if default is not None else F.lit(None))


def crawl_log(pages: DataFrame, attempt: int = 0) -> DataFrame:
    """page_id, url, http_status, content_type, transport_error, body."""
    pid = F.col("page_id") + 7 * attempt
    kept = [c for c in ("title", "clean_text") if c in pages.columns]
    return pages.select(
        "page_id", "url", *kept,
        _case(pid % STATUS_MOD, STATUS_CODES, 200).cast("int").alias("http_status"),
        _case(pid % CTYPE_MOD, CTYPES, CTYPE_DEFAULT).alias("content_type"),
        _case(pid % TRANSPORT_MOD, TRANSPORTS, None).cast("string").alias("transport_error"),
        F.col("html").alias("body"))


def robots_rules(pages: DataFrame) -> DataFrame:
    """(origin, entry, ua, ord, allow, prefix), one rules file per site:
    'm.' hosts: ``*`` may not fetch /fr/; 'www.' hosts: our agent may not
    fetch /en/, everybody else nothing; other '.net' hosts: another agent is
    shut out, ``*`` has an empty Disallow (allow all); the rest: no file."""
    rule = "struct<entry:int,ua:string,ord:int,allow:boolean,prefix:string>"
    host = url_domain(F.col("url"))
    rules = (F.when(host.startswith("m."), F.expr(
        f"array(named_struct('entry',0,'ua','*','ord',0,'allow',false,'prefix','/fr/'),"
        f"named_struct('entry',0,'ua','*','ord',1,'allow',true,'prefix','/'))"))
        .when(host.startswith("www."), F.expr(
            "array(named_struct('entry',0,'ua','TesseraBot','ord',0,'allow',false,'prefix','/en/'),"
            "named_struct('entry',1,'ua','*','ord',0,'allow',false,'prefix','/'))"))
        .when(host.endswith(".net"), F.expr(
            "array(named_struct('entry',0,'ua','otherbot','ord',0,'allow',false,'prefix','/'),"
            "named_struct('entry',1,'ua','*','ord',0,'allow',true,'prefix',''))"))
        .otherwise(F.expr(f"cast(array() as array<{rule}>)")))
    return (pages.select(url_origin(F.col("url")).alias("origin"), rules.alias("rules"))
            .dropDuplicates(["origin"])
            .select("origin", F.inline("rules")))


def fetched(pages: DataFrame, attempt: int = 0) -> DataFrame:
    """Crawl log + allowed, status_code, error, content, fetch_failed, fail_reason."""
    log = crawl_log(pages, attempt)
    gated = robots_gate(log, robots_rules(pages))
    return fetch_failed(fetch_outcome(gated))


def page_links(spark: SparkSession, sf_dir: str, attempt: int = 0,
               cleaned: DataFrame | None = None) -> DataFrame:
    """One row per page: link metadata, cleaned text, outcome.

    outcome: 'failed' (fetch failed; the link row *is* written), 'skipped'
    with reason 'No content after cleaning' / 'No chunks generated' (no link
    row), or 'indexed'.  ``cleaned`` (from ``cleaned_pages``) lets several
    crawl attempts share one cleaning pass.
    """
    if cleaned is not None:
        return _links(fetched(cleaned, attempt), F.col("title"), F.col("clean_text"))
    return links_from_pages(read_table(spark, sf_dir, "pages"), attempt)


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """Pages with their title and cleaned text in place of their markup (of
    which only a marker stays): what does not depend on the crawl attempt --
    an attempt only decides whether the body was fetched."""
    return pages.select("page_id", "url", page_title(F.col("html")).alias("title"),
                        clean_html(F.col("html")).alias("clean_text"), F.substring("html", 1, 1).alias("html"))


def links_from_pages(pages: DataFrame, attempt: int = 0) -> DataFrame:
    """``page_links`` over any DataFrame of pages (a batch, a stream's
    micro-batch): outcome, title and text in one projection over one scan; a
    page whose fetch failed is not cleaned."""
    return _links(fetched(pages, attempt), page_title(F.col("body")), clean_html(F.col("content")))


def _links(f: DataFrame, title: Column, clean: Column) -> DataFrame:
    text = F.when(~F.col("fetch_failed"), clean)
    base = f.select("page_id", "url", title.alias("title"),
                    first_path_segment(F.col("url")).alias("folder"),
                    url_domain(F.col("url")).alias("domain"),
                    F.timestamp_seconds(F.lit(DATE_BASE_EPOCH) + F.col("page_id") * 86400).alias("date_added"),
                    "status_code", "error", "fetch_failed", "fail_reason", text.alias("text"))
    n_chunks = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != ""))
    outcome = (F.when(F.col("fetch_failed"), F.lit("failed"))
               .when(F.col("text").isNull(), F.lit("skipped"))
               .when(n_chunks == 0, F.lit("skipped"))
               .otherwise(F.lit("indexed")))
    reason = (F.when(F.col("fetch_failed"), F.col("fail_reason"))
              .when(F.col("text").isNull(), F.lit("No content after cleaning"))
              .when(n_chunks == 0, F.lit("No chunks generated")))
    return base.withColumn("outcome", outcome).withColumn("reason", reason)


def page_chunks(links: DataFrame, chunk_size: int = 400, overlap: int = 50, hash_dim: int | None = None) -> DataFrame:
    """Chunks of the indexed pages: chunk_id, url, chunk_index, chunk_text,
    start, end, and with ``hash_dim`` their embedding (what a stored index
    needs to be searched)."""
    ch = chunk_documents(links.where(F.col("outcome") == "indexed").select("url", "text"),
                         ["url"], "text", chunk_size=chunk_size, overlap=overlap, hash_dim=hash_dim)
    return ch.select(chunk_id(F.col("url"), F.col("chunk_index")).alias("chunk_id"), "url",
                     "chunk_index", "chunk_text", "start", "end", *(["embedding"] if hash_dim else []))


def stored_index(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The published chunks with their links' metadata, ready for ``topk_batch``; None if nothing is published.

    Both tables come from one manifest and are bucketed by url alike: the join moves neither."""
    from tessera.sources import store
    links, chunks = (store.read_current(spark, root, t, version) for t in ("links", "chunks"))
    if links is None or chunks is None:
        return None
    return chunks.hint("merge").join(links.select("url", "title", "folder", "domain", "date_added"), "url")


def page_index(spark: SparkSession, sf_dir: str, dim: int = 384, attempt: int = 0) -> DataFrame:
    """Searchable chunks of the first run with their link metadata:
    chunk_id, url, chunk_index, chunk_text, title, folder, domain,
    date_added, embedding.

    Built in one pass, the chunks carry their link's metadata as keys through
    the explode: same result as joining stored chunks to stored links on url
    (``chunk_link_join``), without shuffling chunk text for the join.
    """
    meta_cols = ["url", "title", "folder", "domain", "date_added"]
    links = page_links(spark, sf_dir, attempt).where(F.col("outcome") == "indexed")
    ch = chunk_documents(links.select(*meta_cols, "text"), meta_cols, "text", hash_dim=dim)
    return ch.select(chunk_id(F.col("url"), F.col("chunk_index")).alias("chunk_id"), "chunk_index",
                     "chunk_text", *meta_cols, "embedding")


def page_questions(spark: SparkSession, sf_dir: str, dim: int = 384) -> DataFrame:
    """Every page's title as a question, with that page's metadata as
    candidate filter values: query_id, question, folder, domain, date_added,
    embedding."""
    from tessera.operators.embed import hash_embedding
    pages = read_table(spark, sf_dir, "pages")
    return pages.select(
        F.col("page_id").alias("query_id"), page_title(F.col("html")).alias("question"),
        first_path_segment(F.col("url")).alias("folder"), url_domain(F.col("url")).alias("domain"),
        F.timestamp_seconds(F.lit(DATE_BASE_EPOCH) + F.col("page_id") * 86400).alias("date_added"),
    ).withColumn("embedding", hash_embedding(F.col("question"), dim))
