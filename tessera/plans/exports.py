"""Link exports built from ``pages`` and parsed back.

The driver tables hold no link-export files, so this job *derives* them: the
pages are grouped 50 to an export file; inside a file each page is a link in
folder ``<domain>/<language>`` (two nested H3 folders), except every seventh
page, which sits at the top level.  The ADD_DATE attribute cycles through the
shapes seen in real exports (seconds, fractional seconds, milliseconds,
missing, empty, non-numeric); every fifth link carries an ICON.  Building and
parsing are both plain DataFrame jobs; a file's text is assembled from at
most 50 links, so the per-file ``collect_list`` is bounded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.html import page_title
from tessera.functions.url import first_path_segment, url_domain
from tessera.operators.links import parse_exports
from tessera.plans.pages import INGEST_TS, crawl_log
from tessera.session import ensure_checkpoint_dir
from tessera.sources.tables import read_table

PAGES_PER_FILE = 50
ROOT_EVERY = 7
ICON_EVERY = 5
DATE_SHAPES = 11
DATE_BASE_EPOCH = 1704067200
EXPORT_INGEST_TS = "2024-08-01 00:00:00"
# When each export was handed in, by residue of file_id + 2: before, between and after the two crawl runs.
EXPORT_AS_OF = ("2024-05-15 00:00:00", "2024-06-15 00:00:00", "2024-08-01 00:00:00")
# Every so many-th page's body has numeric references that no decoder can read.
BROKEN_EVERY, BROKEN_DIGITS = 11, 4400

HEADER = ("<!DOCTYPE NETSCAPE-Bookmark-file-1>\n<META HTTP-EQUIV=\"Content-Type\" "
          "CONTENT=\"text/html; charset=UTF-8\">\n<TITLE>Bookmarks</TITLE>\n<H1>Bookmarks</H1>\n<DL><p>\n")
FOOTER = "</DL><p>\n"


def escape(col: Column) -> Column:
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(ch), F.lit(ent))
    return col


def _add_date_attr(pid: Column) -> Column:
    secs = F.lit(DATE_BASE_EPOCH) + pid * 86400
    shape = pid % DATE_SHAPES
    val = (F.when(shape == 1, (secs * 1000).cast("string"))
           .when(shape == 2, F.lit("abc"))
           .when(shape == 3, F.lit(""))
           .when(shape == 4, F.concat(secs.cast("string"), F.lit(".25")))
           .otherwise(secs.cast("string")))
    return F.when(shape == 0, F.lit("")).otherwise(F.concat(F.lit(' ADD_DATE="'), val, F.lit('"')))


def export_links(pages: DataFrame) -> DataFrame:
    """What each export lists: file_id, page_id, url, title, domain, lang,
    is_root, item (the DT line)."""
    pid = F.col("page_id")
    icon = F.when(pid % ICON_EVERY == 0,
                  F.concat(F.lit(' ICON="data:image/png;base64,AAAA'), pid.cast("string"), F.lit('"'))).otherwise("")
    return pages.select(
        F.floor(pid / PAGES_PER_FILE).cast("bigint").alias("file_id"), "page_id", "url",
        page_title(F.col("html")).alias("title"),
        url_domain(F.col("url")).alias("domain"), first_path_segment(F.col("url")).alias("lang"),
        (pid % ROOT_EVERY == 0).alias("is_root"),
    ).withColumn("item", F.concat(F.lit('<DT><A HREF="'), escape(F.col("url")), F.lit('"'),
                                  _add_date_attr(pid), icon, F.lit(">"), escape(F.col("title")),
                                  F.lit("</A>\n")))


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["v"]), "")


def build_exports(pages: DataFrame) -> DataFrame:
    """file_id, content: one Netscape-format export per 50 pages."""
    links = export_links(pages)
    inner = links.where(~F.col("is_root"))
    lang = inner.groupBy("file_id", "domain", "lang").agg(
        _joined(F.collect_list(F.struct("page_id", F.col("item").alias("v")))).alias("items"))
    lang = lang.withColumn("v", F.concat(F.lit("<DT><H3>"), escape(F.col("lang")), F.lit("</H3>\n<DL><p>\n"),
                                         F.col("items"), F.lit("</DL><p>\n")))
    dom = lang.groupBy("file_id", "domain").agg(
        _joined(F.collect_list(F.struct("lang", "v"))).alias("items"))
    dom = dom.withColumn("v", F.concat(F.lit("<DT><H3>"), escape(F.col("domain")), F.lit("</H3>\n<DL><p>\n"),
                                       F.col("items"), F.lit("</DL><p>\n")))
    # sort keys: domain folders first (by domain), then the top-level links (by page)
    parts = (dom.select("file_id", F.lit(0).alias("g"), F.col("domain").alias("k"), F.lit(0).cast("bigint").alias("p"), "v")
             .unionByName(links.where(F.col("is_root")).select(
                 "file_id", F.lit(1).alias("g"), F.lit("").alias("k"), F.col("page_id").alias("p"),
                 F.col("item").alias("v"))))
    body = parts.groupBy("file_id").agg(_joined(F.collect_list(F.struct("g", "k", "p", "v"))).alias("items"))
    return body.select("file_id", F.concat(F.lit(HEADER), F.col("items"), F.lit(FOOTER)).alias("content"))


def crawl_history(pages: DataFrame) -> DataFrame:
    """The crawl log of both runs: url, fetched_at, fetch_id, http_status, content_type, transport_error, body."""
    broken = F.replace("html", F.lit("<p>"), F.concat(F.lit("<p>&#"), F.repeat(F.lit("9"), BROKEN_DIGITS), F.lit("; ")))
    bodies = pages.withColumn("html", F.when(F.col("page_id") % BROKEN_EVERY == 5, broken).otherwise(F.col("html")))
    runs = [crawl_log(bodies, run).select("url", F.to_timestamp(F.lit(ts)).alias("fetched_at"), F.col("page_id").alias("fetch_id"),
                                          "http_status", "content_type", "transport_error", "body")
            for run, ts in enumerate(INGEST_TS)]
    return runs[0].unionByName(runs[1])


def export_as_of(file_id: Column) -> Column:
    return F.to_timestamp(F.element_at(F.array(*[F.lit(t) for t in EXPORT_AS_OF]), ((file_id + 2) % len(EXPORT_AS_OF) + 1).cast("int")))


def export_ingest_ts() -> Column:
    return F.to_timestamp(F.lit(EXPORT_INGEST_TS))


def parsed_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_exports(build_exports(read_table(spark, sf_dir, "pages")), export_ingest_ts())


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Whole export files: file (path), content.  A blank file parses to no links."""
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")))


def write_exports(spark: SparkSession, exports: DataFrame) -> str:
    """Write each export as its own text file under the shared checkpoint
    folder (a fresh directory per call); returns the directory."""
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/exports-{uuid.uuid4().hex}"
    exports.select("file_id", "content").write.partitionBy("file_id").text(out)
    return out
