"""The page index as a stored table: built once for a ``pages`` table, read by every retrieval query.

Version 1 holds the first crawl run, version 2 the second one merged into it.
A session remembers where it has stored the index of which files (path, size
and time of the ``pages`` table), so a changed table gets a new index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import index as ix
from tessera.operators.embed import DEFAULT_DIM
from tessera.plans import pages as pg
from tessera.session import ensure_checkpoint_dir
from tessera.sources import store
from tessera.sources.tables import read_table

_ROOTS: dict[tuple, tuple[str, DataFrame]] = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """What changes when a table's files change: names, sizes, times."""
    fs, p = store._path(spark, path)
    files = fs.listStatus(p)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def run_links(pages: DataFrame, cleaned: DataFrame, run: int) -> DataFrame:
    """Link rows that a crawl run writes (status indexed or failed), with the cleaned text."""
    links = pg.page_links(pages.sparkSession, "", attempt=run, cleaned=cleaned)
    return links.where(F.col("outcome").isin("indexed", "failed")).withColumn("status", F.col("outcome"))


def page_store(spark: SparkSession, sf_dir: str, runs: int = 1) -> str:
    """Root of the stored page index after so many crawl runs (1 or 2)."""
    path = f"{sf_dir.rstrip('/')}/pages.parquet"
    key = (spark.sparkContext.applicationId, path, _stamp(spark, path))
    pages = read_table(spark, sf_dir, "pages")
    if key not in _ROOTS:
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/page-index-{uuid.uuid4().hex}"
        _ROOTS[key] = (root, pg.cleaned_pages(pages).checkpoint())
    root, cleaned = _ROOTS[key]
    for run in range(store.current_version(spark, root), runs):
        links = run_links(pages, cleaned, run)
        chunks = pg.page_chunks(links, hash_dim=DEFAULT_DIM).withColumn("run", F.lit(run))
        ix.merge_index(spark, root, links, chunks, F.to_timestamp(F.lit(pg.INGEST_TS[run])), {"run": run})
    return root


def page_table(spark: SparkSession, sf_dir: str, table: str, runs: int) -> DataFrame:
    """``links`` or ``chunks`` as they are after so many runs."""
    return store.read_current(spark, page_store(spark, sf_dir, runs), table, version=runs)


def page_index(spark: SparkSession, sf_dir: str, runs: int = 1) -> DataFrame:
    """Searchable chunks with their links' metadata, from the stored tables."""
    return pg.stored_index(spark, page_store(spark, sf_dir, runs), version=runs)
