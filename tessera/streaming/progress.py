"""Ingest progress as a stream: counts by status while files arrive.

``readStream`` over a directory (or glob) of Parquet event files ->
``groupBy(status).count()`` -> ``foreachBatch`` that overwrites a small
Parquet result with the complete counts.  The checkpoint lives in the shared
checkpoint folder, so a restarted query resumes instead of recounting.
``trigger(availableNow=True)`` processes what is there and stops (a
scheduled incremental job); drop it for a continuously running query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


def progress_counts(events: DataFrame, status_col: str = "event_type") -> DataFrame:
    return events.groupBy(F.col(status_col).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def run_progress(spark: SparkSession, source: str, schema, status_col: str = "event_type",
                 max_files_per_trigger: int = 1) -> DataFrame:
    """Run the stream to completion (availableNow) and return the counts."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/progress-{uuid.uuid4().hex}"
    out = f"{base}/counts"
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source))
    counts = progress_counts(stream, status_col)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (counts.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)
