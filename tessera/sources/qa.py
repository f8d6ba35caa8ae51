"""Labelled question sets (JSON) in, evaluation reports out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QA_SCHEMA = ("question string, expected_answer_keywords array<string>, "
             "ground_truth_urls array<string>, difficulty string")


def read_qa(spark: SparkSession, path: str, json_array: bool = True) -> DataFrame:
    """A JSON array file (``json_array``) or JSON-lines files of QA items.
    A missing ``ground_truth_urls`` reads as an empty list."""
    df = spark.read.schema(QA_SCHEMA).json(path, multiLine=json_array)
    return df.withColumn("ground_truth_urls",
                         F.coalesce("ground_truth_urls", F.array().cast("array<string>")))


def write_eval_report(spark: SparkSession, root: str, aggregates: DataFrame, details: DataFrame,
                      run_ts: str) -> str:
    """Timestamped report: ``aggregate`` and ``details`` JSON datasets under
    ``root/eval-<run_ts>-<id>``, each row tagged with ``run_ts``."""
    out = f"{root.rstrip('/')}/eval-{run_ts.replace(' ', 'T').replace(':', '-')}-{uuid.uuid4().hex[:8]}"
    aggregates.withColumn("run_ts", F.lit(run_ts)).write.json(f"{out}/aggregate")
    details.withColumn("run_ts", F.lit(run_ts)).write.json(f"{out}/details")
    return out
