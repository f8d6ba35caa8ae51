"""Headline timings: one JSON line on stdout.

Runs the main jobs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` (default 8).  Every query is forced end to end with
the ``noop`` sink (all rows computed, nothing collected to the driver).
Set ``$BENCH_EVENT_LOG`` to a scratch folder to get Spark's event log there
(stage and task times) -- the UI stays off.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tessera.plans.catalog import REGISTRY  # noqa: E402
from tessera.session import build_session  # noqa: E402
from tessera.sources.tables import SPREAD_CONF  # noqa: E402

HEADLINE = (
    "main_text",            # HTML cleaning over all pages
    "chunk_text",           # sentence split + greedy overlapping chunks
    "embed_hash",           # chunk + hash embedding
    "topk_batch",           # exact leave-one-out top-k over the vector table
    "topk_batch_filtered",  # page index, per-question folder + date filters
    "compare_chunking",     # flagship: 3 strategies, embed, batch top-k, metrics
    "upsert_links",         # two ingest runs merged into the link table
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or list(HEADLINE)
    # the tables here are single-row-group files: spread them once when read
    extra = {"spark.driver.memory": "16g", SPREAD_CONF: str(cpus)}
    if os.environ.get("BENCH_EVENT_LOG"):
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]})
    spark = build_session(f"local[{cpus}]", app="tessera-bench", shuffle_partitions=max(8, 2 * cpus),
                          extra=extra)
    spark.sparkContext.setLogLevel("ERROR")
    # warm-up on the smallest tables: JVM code paths, Python workers, Arrow
    for name in names:
        REGISTRY[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
