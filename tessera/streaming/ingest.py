"""Background ingest as a stream: new page files run the batch ingest path.

Each micro-batch of pages goes through crawl outcome -> cleaning ->
chunking -> embedding -> link upsert + chunk replace against the published
index, and links and chunks are published together as its next version.  The
manifest holds the batch number: a micro-batch that is replayed after a
failure finds its number there and publishes nothing twice.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import index as ix
from tessera.operators.embed import DEFAULT_DIM
from tessera.plans.pages import links_from_pages, page_chunks
from tessera.session import ensure_checkpoint_dir
from tessera.sources import store


def ingest_batch(spark: SparkSession, pages: DataFrame, root: str, now: str, batch_id: int | None = None,
                 stream: str | None = None, attempt: int = 0) -> None:
    """Merge a batch of pages into the index under ``root``.

    ``now`` is the batch's timestamp; ``stream`` and ``batch_id`` name the
    micro-batch, which is merged once however often it is replayed."""
    done = store.manifest(spark, root)
    if done and batch_id is not None and done["note"].get("stream") == stream and done["note"].get("batch", -1) >= batch_id:
        return
    links = links_from_pages(pages, attempt).cache()
    try:
        written = links.where(F.col("outcome").isin("indexed", "failed")).withColumn("status", F.col("outcome"))
        ix.merge_index(spark, root, written, page_chunks(links, hash_dim=DEFAULT_DIM), F.to_timestamp(F.lit(now)),
                       {"stream": stream, "batch": batch_id})
    finally:
        links.unpersist()


def run_ingest(spark: SparkSession, source: str, schema, root: str | None = None,
               now: str | None = None, max_files_per_trigger: int = 1) -> str:
    """Stream page files from ``source`` into the index under ``root``.

    ``now`` fixes the timestamp of all batches (a replayed history); by
    default each batch takes the time it starts at (UTC)."""
    base = root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source))

    def each(batch: DataFrame, batch_id: int) -> None:
        at = now or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        ingest_batch(spark, batch, base, at, batch_id, stream=source)

    q = (stream.writeStream.foreachBatch(each)
         .option("checkpointLocation", f"{base}/_stream_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return base
