"""Which of very many 64-bit keys occur more than once, as a bitmap of a size that is given."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row

from tessera.session import ensure_checkpoint_dir, shuffles_removed

U = np.uint64
#: The bitmap has 2^ROUTE_BITS bits (8 MB) unless told otherwise; a bit set by another key only lets more rows through.
ROUTE_BITS = 26
#: A bitmap of up to so many bytes is collected at once.
COLLECTED_BYTES = 1 << 25
#: Keys held by a task before it deals them out.
HELD_KEYS = 1 << 22


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (wrapping arithmetic)."""
    x = x ^ U(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def segment_bits(df: DataFrame) -> int:
    """Leading key bits that deal keys out: about eight groups for each input partition, so a group stays small at any size."""
    return min(ROUTE_BITS - 3, max(4, (8 * df.rdd.getNumPartitions()).bit_length()))


def bitmap_slices(merged: DataFrame, n_bytes: int) -> Iterator[Row]:
    """The slices of a bitmap of so many bytes: a large one is written and comes a partition at a time, so the driver's JVM never holds it."""
    spark = merged.sparkSession
    with shuffles_removed(spark):
        if n_bytes <= COLLECTED_BYTES:
            return iter(merged.select("*").collect())  # a frame made here, as the setting holds for frames made under it
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bitmap-{uuid.uuid4().hex}"
        merged.write.parquet(path)
    return spark.read.schema(merged.schema).parquet(path).toLocalIterator()


def repeated_bitmap(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], *,
                    route_bits: int = ROUTE_BITS, key_bytes: int = 8, probes: int = 1) -> bytes:
    """Bitmap over the leading bits of the keys that occur twice or more among all that ``keys_of`` gives.

    Of a key, the bits that name its segment and the next ``8 * key_bytes`` are compared; a chance match sets bits more.
    A key sets ``probes`` bits, all in its segment's slice; the last three bytes tell ``is_set`` how.

    A task sorts its keys and sends each distinct one once, with those that
    repeat already marked; a frequent key thus costs each task one entry.
    The driver gets slices of the bitmap, never keys.
    """
    bits = segment_bits(rows)
    size = 1 << (route_bits - bits - 3)
    rest = max(0, 64 - bits - 8 * key_bytes)  # trailing bits that are not compared
    shift = U(64 - bits - rest)
    kind = f"<u{key_bytes}"

    def deal(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(parts) >> U(rest), return_counts=True)
        many = keys[counts > 1]
        segment = (keys >> shift).astype(np.int64)
        cuts = np.r_[0, np.flatnonzero(segment[1:] != segment[:-1]) + 1, len(keys)] if len(keys) else np.zeros(1, np.int64)
        of_many = np.searchsorted(many, keys[cuts[:-1]])
        ends = np.r_[of_many[1:], len(many)] if len(of_many) else of_many
        return pa.RecordBatch.from_arrays([
            pa.array(segment[cuts[:-1]].astype(np.int32)),
            pa.array([keys[a:b].astype(kind).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            pa.array([many[a:b].astype(kind).tobytes() for a, b in zip(of_many, ends, strict=True)], pa.binary()),
        ], names=["segment", "keys", "many"])

    def send(batches):
        parts, held = [], 0
        for batch in batches:
            for keys in keys_of(batch):
                parts.append(keys)
                held += len(keys)
                if held >= HELD_KEYS:
                    yield deal(parts)
                    parts, held = [], 0
        if parts:
            yield deal(parts)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(np.concatenate([np.frombuffer(b, kind) for b in pdf["keys"]]), kind="stable")
        many = np.concatenate([keys[1:][keys[1:] == keys[:-1]], *[np.frombuffer(b, kind) for b in pdf["many"]]]).astype(U)
        if not len(many):
            return pd.DataFrame({"segment": [], "slice": []}).astype({"segment": "int32", "slice": "object"})
        if rest:
            many |= U(int(pdf["segment"].iloc[0]) << 8 * key_bytes)  # the leading bits are the segment's
        flags = np.zeros(size * 8, dtype=np.uint8)
        for at in _addresses(many, route_bits, bits, rest, probes):
            flags[at & (size * 8 - 1)] = 1
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1].astype("int32"), "slice": [np.packbits(flags).tobytes()]})

    bitmap = bytearray(size << bits)
    merged = rows.mapInArrow(send, "segment int, keys binary, many binary").groupBy("segment").applyInPandas(merge, "segment int, slice binary")
    for row in bitmap_slices(merged, len(bitmap)):
        bitmap[row["segment"] * size:(row["segment"] + 1) * size] = row["slice"]
    return bytes(bitmap) + bytes([bits, key_bytes, probes])


def _addresses(compared: np.ndarray, route_bits: int, bits: int, rest: int, probes: int):
    """Bits of keys of which only the compared leading part is given: the first by its leading bits, the others by
    hashes within the segment."""
    yield (compared >> U(max(0, 64 - rest - route_bits))).astype(np.int64)
    slice_bits = route_bits - bits
    first = ((compared >> U(64 - rest - bits)) << U(slice_bits)).astype(np.int64)
    for j in range(1, probes):
        yield first | (mix(compared, 100 + j) >> U(64 - slice_bits)).astype(np.int64)


def is_set(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether all bits of each key are set."""
    bits, key_bytes, probes = (int(x) for x in bitmap[-3:])
    route_bits, rest = (8 * (len(bitmap) - 3)).bit_length() - 1, max(0, 64 - bits - 8 * key_bytes)
    out = np.ones(len(keys), dtype=bool)
    for at in _addresses(keys >> U(rest), route_bits, bits, rest, probes):
        out &= ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
    return out


class RangeHashes:
    """Polynomial hashes of all ranges of a sequence of 64-bit symbols, modulo 2^64, two operations a range."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, symbols: np.ndarray, base: int):
        n = len(symbols)
        power, inverse = self._powers.get(base, (np.zeros(0, U), np.zeros(0, U)))
        if len(power) <= n:
            size = max(1 << 16, 1 << (n + 1).bit_length())
            power, inverse = (np.multiply.accumulate(np.r_[U(1), np.full(size - 1, U(b), dtype=U)]) for b in (base, pow(base, -1, 1 << 64)))
            self._powers[base] = power, inverse
        self.inverse = inverse
        self.prefix = np.zeros(n + 1, dtype=U)
        np.cumsum(symbols * power[:n], out=self.prefix[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[begin]) * self.inverse[begin]


#: Two odd bases (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
