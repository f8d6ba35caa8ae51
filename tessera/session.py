"""SparkSession helpers: one place for the settings every job relies on."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Settings the engine's plans assume.  Session time zone is UTC because link
# dates are epoch seconds; AQE re-plans joins at runtime and splits skewed
# shuffle partitions (one origin or source may hold a third of the rows).
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches carry whole documents; keep a batch well inside a
    # Python worker's memory even for long texts.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # a lookup of a few hundred urls is tested against each row group, not as one range
    "spark.sql.parquet.pushdown.inFilterThreshold": "256",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "tessera",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(ENGINE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    # checkpoint files of DataFrames that went out of scope are removed
    conf["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in conf.items():
        if not key.startswith("spark.ui"):
            try:
                spark.conf.set(key, value)
            except Exception:  # static conf of an already running session
                pass
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: dict[int, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in the Python workers (UDF, mapInPandas).

    The package is zipped once per driver process, written into the shared
    checkpoint folder (Hadoop FileSystem API) and handed to
    ``SparkContext.addPyFile``, which distributes it to every executor; jobs
    then work whatever the workers' current directory or PYTHONPATH.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for f in sorted(root.rglob("*.py")):
            zf.write(f, f"tessera/{f.relative_to(root).as_posix()}")
    data = buf.getvalue()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pyfiles/tessera-{hashlib.sha1(data).hexdigest()[:16]}.zip"
    jvm = sc._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        out = fs.create(hpath, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
    sc.addPyFile(path)
    _SHIPPED[key] = path


def apply_engine_conf(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else built."""
    for key, value in ENGINE_CONF.items():
        if key.startswith("spark.ui"):
            continue
        try:
            spark.conf.set(key, value)
        except Exception:
            pass
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared folder and is honoured as is.
    Only when it is unset and the master is local (tests) do we pick a scratch
    folder; on a cluster a machine-local folder would lose files, so there the
    setting is required.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master or ""
        if not (master.startswith("local[") or master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # core setting; the context keeps its own copy
            pass
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames made and collected here, once, leave no shuffle files behind when their job ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
