"""Readers for the input tables (Parquet; column pruning and filter pushdown
are left to Catalyst -- callers select only what they use)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Session setting: number of partitions that a table is spread to once when it
# is read.  Unset (the default): scans are never reshuffled, whatever their size.
SPREAD_CONF = "spark.tessera.read.spread"

# Row keys used to spread a table whose files give too few read tasks.
SPREAD_KEYS = {
    "documents": ("doc_id",), "pages": ("page_id",), "embeddings": ("vec_id",),
    "conversations": ("conv_id", "turn"), "events": ("event_id",), "benchmark": ("item_id",),
    "labels": ("doc_id",),
}


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: int | None = None) -> DataFrame:
    """Scan one table.

    Parquet files written as one row group are read by one task each, which
    would run all CPU-heavy text work of a small table on one core.  An
    explicit ``spread`` (or the session's ``SPREAD_CONF``) hash-spreads rows
    on the table's key to so many partitions (deterministic, so a retried
    task sees the same rows); without it the scan stays as it is.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    spread = spread or int(spark.conf.get(SPREAD_CONF, "0"))
    return df.repartition(spread, *SPREAD_KEYS[name]) if spread and name in SPREAD_KEYS else df
