"""Exact deduplication with counting quotient filters.

Every partition builds one counting quotient filter over the 64-bit
fingerprints of its normalised texts.  A filter is cut into segments by the
leading fingerprint bits; a segment stores, in its compact form, which
quotients occur (``occupieds``), where each quotient's run of sorted
remainders ends (``runends``), the remainders and their counts.  Segments of
all partitions meet in one merge per segment, which decodes the sorted
remainders back to fingerprints and adds their counts -- nothing is lost, as
remainder and quotient together are the fingerprint.  Fingerprints counted
more than once set one bit of a bitmap whose size is a fixed parameter; only
texts whose bit is set travel to the byte verification, where equal
fingerprints are grouped by the text itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_BYTES, bounded_batches, fresh, utf8_list

SEGMENT_BITS = 10      # segments of the fingerprint space
ROUTE_BITS = 26        # bitmap of repeated fingerprints: 2^26 bits = 8 MB, whatever the input
U = np.uint64


class CountingQuotientFilter:
    """Sorted fingerprints with counts, as quotient runs of remainders.

    ``bits`` is the fingerprint width within the filter, ``q`` the number of
    quotient bits; ``encode``/``decode`` are exact inverses.
    """

    @staticmethod
    def encode(values: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
        """``values``: sorted distinct uint64 below 2^bits; ``counts``: their multiplicities (>= 1)."""
        n = len(values)
        q = min(bits, max(1, int(n).bit_length()))
        r = bits - q
        quotient = (values >> U(r)).astype(np.int64)
        occupieds = np.zeros(1 << q, dtype=bool)
        occupieds[quotient] = True
        runends = np.ones(n, dtype=bool)
        runends[:-1] = quotient[1:] != quotient[:-1]
        width = max(1, (r + 7) // 8)
        remainder = (values & U((1 << r) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        counted = counts > 1
        return b"".join((
            np.array([n, q, bits, width], dtype="<u4").tobytes(),
            np.packbits(occupieds).tobytes(), np.packbits(runends).tobytes(),
            np.ascontiguousarray(remainder).tobytes(),
            np.packbits(counted).tobytes(), counts[counted].astype("<u8").tobytes()))

    @staticmethod
    def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts."""
        n, q, bits, width = (int(x) for x in np.frombuffer(blob, "<u4", 4))
        at = 16

        def flags(k: int) -> np.ndarray:
            nonlocal at
            size = (k + 7) // 8
            out = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=k).astype(bool)
            at += size
            return out

        occupieds, runends = flags(1 << q), flags(n)
        raw = np.zeros((n, 8), dtype=np.uint8)
        raw[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        run = np.cumsum(runends) - runends
        values = (np.flatnonzero(occupieds)[run].astype(U) << U(bits - q)) | raw.reshape(-1).view("<u8")
        counts = np.ones(n, dtype=np.uint64)
        counted = flags(n)
        counts[counted] = np.frombuffer(blob, "<u8", int(counted.sum()), at)
        return values, counts

    @staticmethod
    def merge(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All filters' fingerprints with added counts; the runs are already sorted."""
        parts = [CountingQuotientFilter.decode(b) for b in blobs]
        values = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
        return values[first], np.add.reduceat(counts, first) if len(first) else counts


def _normalised(column: pa.Array) -> list[bytes]:
    return [t.translate(None, SPACE_BYTES) for t in utf8_list(column)]


def _filters(batches):
    """One filter per partition, cut into segments."""
    parts = []
    for batch in batches:
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, _normalised(batch.column(0))), dtype=U, count=batch.num_rows))
    if not parts:
        return
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    rest = 64 - SEGMENT_BITS
    segment = (values >> U(rest)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(values) else []
    ends = [*starts[1:], len(values)]
    low = values & U((1 << rest) - 1)
    yield pa.RecordBatch.from_arrays([
        pa.array([int(segment[a]) for a in starts], pa.int32()),
        pa.array([CountingQuotientFilter.encode(low[a:b], counts[a:b], rest) for a, b in zip(starts, ends, strict=True)], pa.binary()),
    ], names=["segment", "filter"])


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """One segment: its slice of the bitmap of repeated fingerprints (null if there are none)."""
    values, counts = CountingQuotientFilter.merge(list(pdf["filter"]))
    repeated = values[counts > 1]
    if not len(repeated):
        return pd.DataFrame({"segment": [], "route": []}).astype({"segment": "int32", "route": "object"})
    bits = np.zeros(1 << (ROUTE_BITS - SEGMENT_BITS), dtype=np.uint8)
    bits[(repeated >> U(64 - ROUTE_BITS)).astype(np.int64)] = 1
    return pd.DataFrame({"segment": pdf["segment"].iloc[:1].astype("int32"), "route": [np.packbits(bits).tobytes()]})


def repeated_bitmap(texts: DataFrame) -> bytearray:
    """Bitmap over the leading ROUTE_BITS of all fingerprints that the merged filters count more than once.

    ``texts`` has the text as its only column.  The driver gets one bitmap of
    fixed size, never fingerprints.
    """
    merged = (texts.mapInArrow(_filters, "segment int, filter binary")
              .groupBy("segment").applyInPandas(_merged, "segment int, route binary"))
    size = 1 << (ROUTE_BITS - SEGMENT_BITS - 3)
    bitmap = bytearray(size << SEGMENT_BITS)
    for row in merged.collect():  # at most 2^SEGMENT_BITS rows of 2^(ROUTE_BITS - SEGMENT_BITS) bits
        bitmap[row["segment"] * size:(row["segment"] + 1) * size] = row["route"]
    return bitmap


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's group of equal texts: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after ASCII white space is deleted; null
    counts as empty.  The row with the most code points in its original text
    stays, then the smallest id; a null id comes after all others.  Repeated
    rows (same id and text) count in ``group_size``; exactly one of them is
    kept.  An empty table gives an empty result; further columns of ``df``,
    whatever their names, are not read.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType
    small = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    route = spark.sparkContext.broadcast(bytes(repeated_bitmap(small.select("text"))))

    def digests(batches):
        bits = np.frombuffer(route.value, dtype=np.uint8)
        for batch in bounded_batches(batches, "text"):
            norm = _normalised(batch.column(1))
            fp = np.fromiter(map(xxhash.xxh3_64_intdigest, norm), dtype=U, count=len(norm))
            at = (fp >> U(64 - ROUTE_BITS)).astype(np.int64)
            routed = (bits[at >> 3] >> (7 - (at & 7))) & 1
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(fp.view(np.int64)),
                pa.array([hashlib.sha256(t).hexdigest() for t in norm], pa.string()),
                pa.array([0 if t is None else len(t) for t in batch.column(1).to_pylist()], pa.int64()),
                pa.array([t if r else None for t, r in zip(norm, routed, strict=True)], pa.binary()),
            ], names=["doc_id", "fp", "sha", "n_cp", "norm"])

    rows = small.mapInArrow(digests, "doc_id long, fp long, sha string, n_cp long, norm binary")
    # one number orders rows by (most code points, smallest id); null ids rank behind all longs
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    behind = F.lit("9223372036854775808").cast("decimal(20,0)")
    rank = lambda: (F.col("n_cp").cast("decimal(11,0)") * two64 - F.coalesce(F.col("doc_id").cast("decimal(20,0)"), behind)).cast("decimal(38,0)")
    groups = (rows.where(F.col("norm").isNotNull())
              .groupBy("fp", "sha", "norm")  # byte verification: the text itself is a key
              .agg(F.count(F.lit(1)).alias("g_size"), F.max(rank()).alias("g_rank"), F.max("n_cp").alias("g_cp"))
              .select(F.col("fp").alias("g_fp"), F.col("sha").alias("g_sha"), "g_size", "g_rank",
                      (F.col("g_cp").cast("decimal(11,0)") * two64 - F.col("g_rank")).cast("decimal(38,0)").alias("g_id")))
    joined = (rows.drop("norm").withColumn("rank", rank())
              .join(groups, (F.col("fp") == F.col("g_fp")) & (F.col("sha") == F.col("g_sha")), "left"))
    keeper = F.col("g_size").isNull() | (F.col("rank") == F.col("g_rank"))
    out = joined.select(
        "doc_id",
        F.when(F.col("g_size").isNull(), F.col("doc_id"))
        .otherwise(F.when(F.col("g_id") < behind, F.col("g_id")).cast("long")).alias("keep_id"),
        F.coalesce("g_size", F.lit(1).cast("long")).alias("group_size"),
        keeper.alias("keeper"), F.col("sha").alias("text_sha256"))
    return _one_of_repeated(out).withColumn("doc_id", F.col("doc_id").cast(id_type)).withColumn("keep_id", F.col("keep_id").cast(id_type))


def _one_of_repeated(out: DataFrame) -> DataFrame:
    """Of rows repeated with the same id and text, all keepers alike, one is kept: rows are counted, then dealt again."""
    same = out.groupBy("doc_id", "keep_id", "group_size", "keeper", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return (same.select("doc_id", "keep_id", "group_size", "keeper", "text_sha256", one)
            .select("doc_id", "keep_id", "group_size", (F.col("keeper") & (F.col("copy") == 1)).alias("kept"), "text_sha256"))


def keep_one_of_equal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows that ``exact_dedup`` drops; all columns stay.

    Rows whose fingerprint occurs once pass straight from the scan.  The
    others are matched with the keepers by id (null-safe) and text digest;
    of rows repeated with the same id and text, one stays.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    route = spark.sparkContext.broadcast(bytes(repeated_bitmap(df.select(text.alias("text")))))

    @F.arrow_udf("boolean")
    def routed(column: pa.Array) -> pa.Array:
        bits = np.frombuffer(route.value, dtype=np.uint8)
        fp = np.fromiter(map(xxhash.xxh3_64_intdigest, _normalised(column)), dtype=U, count=len(column))
        at = (fp >> U(64 - ROUTE_BITS)).astype(np.int64)
        return pa.array(((bits[at >> 3] >> (7 - (at & 7))) & 1).astype(bool))

    flag, sha, keep_id, keep_sha = fresh(df, "routed", "sha", "keep_id", "keep_sha")
    rows = df.withColumn(flag, routed(text))
    keepers = (exact_dedup(rows.where(flag), id_col, text_col).where("kept")
               .select(F.col("doc_id").alias(keep_id), F.col("text_sha256").alias(keep_sha)))
    again = (rows.where(flag).withColumn(sha, F.sha2(F.regexp_replace(text, r"[ \t-\r]+", ""), 256))
             .join(keepers, F.col(id_col).eqNullSafe(F.col(keep_id)) & (F.col(sha) == F.col(keep_sha)))
             .dropDuplicates([id_col, sha]))
    return rows.where(~F.col(flag)).select(*df.columns).unionByName(again.select(*df.columns))
