"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared_keys import U, is_set, mix, repeated_bitmap, segment_bits
from tessera.session import apply_engine_conf, ensure_checkpoint_dir

#: ASCII white space that separates words, as the bytes that ``bytes.split`` and ``str`` patterns use.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: One or more of the same characters, as a regular expression for Spark and DuckDB.
SPACE_RE = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings for jobs over whole texts: Arrow batches bounded in rows (and bytes where Spark can)."""
    apply_engine_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table as stored; no column or row is dropped and nothing is reshuffled."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: Column | str) -> Column:
    """A text column as string with null as the empty string."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def utf8_list(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def twin_ids(rows: DataFrame, id_col: str) -> bytes:
    """Bitmap of the ids of several rows (and, by chance, of a few others); ``row_marks`` reads it."""
    def keys(batch):
        yield mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U), 53)

    return repeated_bitmap(rows.select(id_col), keys, route_bits=max(20, segment_bits(rows) + 6))


def row_marks(twins: np.ndarray, ids: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """What tells rows of one id apart: 0 where the id surely is one row's, else a 64-bit digest of the text."""
    marks = np.zeros(len(ids), dtype=np.int64)
    for k in np.flatnonzero(is_set(twins, mix(ids.astype(np.int64).view(U), 53))).tolist():
        marks[k] = xxhash.xxh3_64_intdigest(texts[k], seed=1) - (1 << 63)
    return marks


def bounded_batches(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``max_bytes`` of ``column`` each (one row at least), so working arrays stay bounded."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if col.nbytes <= max_bytes:
            if batch.num_rows:
                yield batch
            continue
        sizes = [0 if x is None else len(x) for x in col.cast(pa.binary()).to_pylist()]
        begin = total = 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def give_back_memory() -> None:
    """Return freed memory to the system: a worker lives on from job to job, and the C library and Arrow keep what they once had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"_{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out.append(new)
    return out


def write_shared(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one file through Spark's file system (the shared folder need not be a local path)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
