"""The first occurrence of each of very many named windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared_keys import ROUTE_BITS, U, bitmap_slices, mix, segment_bits

#: A named window: 96 bits of name, document, mark of the row among those of its id, position.
WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("id", "<i8"), ("mark", "<i8"), ("pos", "<u4")])
#: Windows held by a task before it deals them out.
HELD = 1 << 21


def _first_of_each(rows: np.ndarray) -> np.ndarray:
    """For each name the rows of smallest id, each with its first position, sorted by name."""
    rows = rows[np.lexsort((rows["pos"], rows["mark"], rows["id"], rows["h2"], rows["h1"]))]
    if not len(rows):
        return rows
    new = np.r_[True, (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])]
    least = rows["id"][np.flatnonzero(new)][np.cumsum(new) - 1]
    return rows[new | (rows["id"] == least) & np.r_[True, rows["mark"][1:] != rows["mark"][:-1]]]


def deal_windows(rows: DataFrame, named) -> DataFrame:
    """``bucket, windows``: a task's windows by leading name bits, each name once with its first place in the task.

    ``named(batch)`` yields arrays (name, second name, id, position) or, if rows of one
    id are to be told apart, (name, second name, id, position, mark).
    """
    shift = U(64 - segment_bits(rows))

    def deal(parts):
        first = _first_of_each(np.concatenate(parts))
        bucket = (first["h1"] >> shift).astype(np.int64)
        cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(first)] if len(first) else np.zeros(1, np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(bucket[cuts[:-1]].astype(np.int32)),
            pa.array([first[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["bucket", "windows"])

    def send(batches):
        parts, held = [], 0
        for batch in batches:
            for h1, h2, ids, pos, *mark in named(batch):
                part = np.zeros(len(h1), dtype=WINDOW)
                part["h1"], part["h2"], part["id"], part["pos"] = h1, h2 >> U(32), ids, pos
                if mark:
                    part["mark"] = mark[0]
                parts.append(part)
                held += len(part)
                if held >= HELD:
                    yield deal(parts)
                    parts, held = [], 0
        if parts:
            yield deal(parts)

    return rows.mapInArrow(send, "bucket int, windows binary")


def first_windows(dealt: DataFrame) -> DataFrame:
    """``id, mark, starts``: the positions of each row's windows that are the first of their name, as packed little-endian arrays.

    A bucket meets in one task with each name at most once for every block
    that the tasks sent (once for each row of its smallest id); a row's list
    has its own windows only.
    """
    def merge(table: pa.Table) -> pa.Table:
        first = _first_of_each(np.concatenate([np.frombuffer(b, WINDOW) for b in table.column("windows").to_pylist()]))
        first = first[np.lexsort((first["mark"], first["id"]))]
        new = (first["id"][1:] != first["id"][:-1]) | (first["mark"][1:] != first["mark"][:-1])
        cuts = np.r_[0, np.flatnonzero(new) + 1, len(first)] if len(first) else np.zeros(1, np.int64)
        pos = np.ascontiguousarray(first["pos"])
        return pa.table({"id": pa.array(first["id"][cuts[:-1]].astype(np.int64)), "mark": pa.array(first["mark"][cuts[:-1]].astype(np.int64)),
                         "starts": pa.array([pos[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    return (dealt.groupBy("bucket").applyInArrow(merge, "id long, mark long, starts binary")
            .groupBy("id", "mark").agg(F.collect_list("starts").alias("starts")))


def _address(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, bits: int, route_bits: int) -> np.ndarray:
    """Where a (name, document) has its bit: the name's bucket, then a hash of both."""
    both = mix(h1 + mix(h2 >> U(32), 41) * U(3) + mix(ids.astype(np.int64).view(U), 43), 47)
    low = route_bits - bits
    return ((h1 >> U(64 - bits)) << U(low)) | (both >> U(64 - low))


def first_bitmap(dealt: DataFrame, route_bits: int = ROUTE_BITS) -> bytes:
    """Bitmap of 2^route_bits bits of all (name, smallest document of the name); its last byte tells the bits that name a bucket.

    A (name, document) whose bit is not set surely has the name in a smaller document.
    """
    bits = segment_bits(dealt)
    size = 1 << (route_bits - bits - 3)

    def merge(table: pa.Table) -> pa.Table:
        first = _first_of_each(np.concatenate([np.frombuffer(b, WINDOW) for b in table.column("windows").to_pylist()]))
        flags = np.zeros(size * 8, dtype=np.uint8)
        flags[(_address(first["h1"], first["h2"].astype(U) << U(32), first["id"], bits, route_bits) & U(size * 8 - 1)).astype(np.int64)] = 1
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "slice": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    bitmap = bytearray(size << bits)
    for row in bitmap_slices(dealt.groupBy("bucket").applyInArrow(merge, "bucket int, slice binary"), len(bitmap)):
        bitmap[row["bucket"] * size:(row["bucket"] + 1) * size] = row["slice"]
    return bytes(bitmap) + bytes([bits])


def maybe_first(bitmap: np.ndarray, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each (name, document) may be the first of its name; False is certain."""
    at = _address(h1, h2, ids, int(bitmap[-1]), (8 * (len(bitmap) - 1)).bit_length() - 1).astype(np.int64)
    return ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
