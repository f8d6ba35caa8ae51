"""SimHash near-deduplication with pigeonring filtering.

Distinct 64-bit fingerprints lie on a ring of ``max_bits + 1`` segments.  By
the pigeonring principle two fingerprints at ``max_bits`` or fewer differing
bits have a start segment from which every chain of ``l`` consecutive
segments differs in at most ``l * max_bits / segments`` bits, rounded down.
For chains of one segment the budget is 0: such segments are equal.  For
chains of two it is 1: the next segment differs in one bit at most.  Only
fingerprints that share a chain with another one go on to the full check.

The full check works on balls, not pairs: fingerprints at two bits or fewer
both lie within one bit of a common point, so each survivor names all points
within one bit of it, and a point named by several links them to the least
of them.  A ball holds at most 65 fingerprints, so a group of near copies of
any size is linked without listing its pairs.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, fresh, utf8_list, written
from tessera.llm.components import components

BITS = 64
SEED = 42
BATCH_BYTES = 4 << 20     # of text turned into bit rows at a time
MAX_SHINGLES = 1 << 18    # bit rows of one text added up at a time


def shingle_hashes(text: bytes, shingle_words: int) -> list[int]:
    """XXH64 hashes of a text's word shingles, repeats included."""
    words = text.lower().split()  # bytes.lower changes A-Z only, bytes.split cuts at ASCII white space
    if not words:
        return []
    if len(words) <= shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle_words)), strict=False))
    return list(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), MAX_SHINGLES):
        rows = hashes[k:k + MAX_SHINGLES].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return total


def _fingerprint(text: bytes, shingle_words: int) -> int:
    hashes = np.array(shingle_hashes(text, shingle_words), dtype=np.uint64)
    return int.from_bytes(np.packbits(2 * _bit_counts(hashes) > len(hashes)).tobytes(), "big")


def _fingerprints(shingle_words: int):
    def run(batches):
        for batch in bounded_batches(batches, "text", BATCH_BYTES):
            out = pa.array([_fingerprint(t, shingle_words) for t in utf8_list(batch.column(1))], pa.uint64())
            yield pa.RecordBatch.from_arrays([batch.column(0), out.view(pa.int64())], names=["doc_id", "fp"])
    return run


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """``doc_id, fp`` of every whole text; the fingerprint as a signed long."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle_words), "doc_id long, fp long")


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of the ring's segments."""
    widths = [BITS // count + (k < BITS % count) for k in range(count)]
    return [(sum(widths[k + 1:]), w) for k, w in enumerate(widths)]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _near(value: Column, width: int) -> Column:
    """The value itself and all values one bit away."""
    bits = [F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(width)]
    return F.array(value, *[value.bitwiseXOR(b) for b in bits])


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (fp and keys) whose keys also belong to another fingerprint; only minima and maxima are gathered for a key."""
    live = rows.groupBy(*keys).agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo != hi").select(*keys)
    return rows.join(live, keys)


def ring_candidates(fps: DataFrame, max_bits: int) -> DataFrame:
    """Distinct fingerprints that share a viable chain with another one: a superset of those with a link."""
    count = max_bits + 1
    ring = _segments(count)
    starts = F.array(*[F.struct(F.lit(i).alias("start"), _segment(F.col("fp"), *ring[i]).alias("first"),
                                _segment(F.col("fp"), *ring[(i + 1) % count]).alias("next")) for i in range(count)])
    rows = fps.select("fp", F.explode(starts).alias("s")).select("fp", "s.start", "s.first", "s.next")
    rows = _shared(rows, ["start", "first"])                     # chains of one segment: no difference
    if 2 * max_bits // count == 1:                               # chains of two segments: one difference
        width = max(w for _, w in ring)
        # flips beyond a narrower segment's width only name points nobody else names
        rows = _shared(rows.select("fp", "start", "first", F.explode(_near(F.col("next"), width)).alias("point")), ["start", "first", "point"])
    return rows.select("fp").distinct()


def near_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """``a, b``: links that connect exactly the distinct fingerprints (``fp``) at ``max_bits`` or fewer bits.

    Every linked fingerprint has a link to the least fingerprint of each ball
    that it shares, so components are those of all pairs within ``max_bits``.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2: balls of one bit cover two differing bits")
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a != b")
    survivors = ring_candidates(fps, max_bits)
    if max_bits == 2:
        points = survivors.select("fp", F.explode(_near(F.col("fp"), BITS)).alias("point"))
        balls = points.groupBy("point").agg(F.collect_list("fp").alias("members"))
    else:  # one bit: equal but for a masked bit; two fingerprints at most
        masked = [F.struct(F.lit(b).alias("bit"), F.col("fp").bitwiseAND(F.lit(~(1 << b) if b < 63 else (1 << 63) - 1)).alias("rest")) for b in range(BITS)]
        points = survivors.select("fp", F.explode(F.array(*masked)).alias("point"))
        balls = points.groupBy("point").agg(F.collect_list("fp").alias("members"))
    pairs = balls.where(F.size("members") > 1).select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
    return pairs.where("a != b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).distinct()


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the
    smallest id reachable over links of ``max_bits`` or fewer differing bits,
    the row's own included.  Null and empty texts have no words and the
    fingerprint zero, linked like any other; texts with fewer words than a
    shingle hash as a whole.  Equal fingerprints, ties and repeated rows fall
    into one group.  Null ids never name a group unless all its ids are null.
    An empty table gives an empty result.
    """
    id_type = df.schema[id_col].dataType
    return _grouped(df, id_col, text_col, shingle_words, max_bits).select(
        F.col("doc_id").cast(id_type).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component_id").cast(id_type).alias("component_id"))


def _grouped(df: DataFrame, id_col: str, text_col: str, shingle_words: int, max_bits: int) -> DataFrame:
    """``doc_id, fp, root, component_id`` of every row; ``root`` is one fingerprint of the group."""
    rows = written(fingerprints(df, id_col, text_col, shingle_words), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = components(written(near_links(least.select("fp"), max_bits), "links"))
    rooted = (least.join(groups, least["fp"] == groups["node"], "left")
              .select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(named, "root").select(F.col("fp").alias("of"), "root", "component_id")
    return rows.join(of_fp, rows["fp"] == F.col("of"), "left").select("doc_id", "fp", "root", "component_id")


def keep_one_of_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each group of ``simhash_groups``: the one with the smallest id (null last), then fingerprint; all columns stay.

    Rows are found again by their id.  Where an id is null or repeated, the
    fingerprint tells its rows apart, and of rows alike in both, one stays.
    """
    groups = written(_grouped(df, id_col, text_col, shingle_words, max_bits), "simhash-groups")
    keep, keep_fp, fp = fresh(df, "keep", "keep_fp", "fp")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), "fp"))
    keepers = groups.groupBy("root").agg(first.alias("first")).select(F.col("first.id").alias(keep), F.col("first.fp").alias(keep_fp))
    unclear = (groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
               .select(F.col("doc_id").alias(keep)))
    same_id = F.col(id_col).eqNullSafe(F.col(keep))
    if unclear.isEmpty():
        return df.join(keepers, F.col(id_col) == F.col(keep)).select(*df.columns)
    clear = df.join(unclear, same_id, "left_anti").join(keepers, F.col(id_col) == F.col(keep)).select(*df.columns)

    @F.arrow_udf("long")
    def fingerprint(column: pa.Array) -> pa.Array:
        return pa.array([_fingerprint(t, shingle_words) for t in utf8_list(column)], pa.uint64()).view(pa.int64())

    again = (df.join(unclear, same_id, "left_semi").withColumn(fp, fingerprint(F.col(text_col).cast("string")))
             .join(keepers, same_id & (F.col(fp) == F.col(keep_fp))).dropDuplicates([id_col, fp]).select(*df.columns))
    return clear.unionByName(again)
