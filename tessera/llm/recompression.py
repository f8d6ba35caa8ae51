"""Substring dedup by recompression.

Words are named by hashes.  In each round, runs of one symbol and then pairs
of a left and a right symbol (a seeded coin of the symbol decides) get new
names, which are hashes of what they stand for: the names are global, agreed
on by all tasks without a dictionary.  Whether a symbol is formed depends on
few neighbours only, its support; so wherever the words of the support occur,
the same symbol is formed inside.

A window's anchor is the symbol of least scrambled name among those whose
support lies in the window: equal windows have equal anchors.  A window
inside one long run has no such symbol and is its own anchor.  Three passes
over the texts follow: anchors are counted, windows whose anchor occurs
more than once are compared by a 96-bit name, and each word that a window
covers is removed unless that window is the first of its name.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, row_marks, twin_ids, utf8_list
from tessera.llm.firsts import deal_windows, first_windows
from tessera.llm.shared_keys import BASES, RangeHashes, U, is_set, mix, repeated_bitmap

WINDOW_WORDS = 20
#: Rounds of naming.  Two make symbols of four words at most (runs apart) with supports of sixteen, which fit a window.
ROUNDS = 2
BATCH_BYTES = 4 << 20
_LAST_ID = (1 << 63) - 1


def recompress(names: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names and supports ``[begin, end)`` in words of the symbols after ``rounds`` of run and pair naming.

    ``names``: the words of all documents in a row; ``doc``: their documents.
    A support that would reach beyond its document lies one word outside it.
    """
    n = len(names)
    begin, end = np.arange(n), np.arange(1, n + 1)
    for r in range(rounds):
        names, begin, end, doc = _name_runs(names, begin, end, doc, 4 * r + 1)
        names, begin, end, doc = _name_pairs(names, begin, end, doc, 4 * r + 2)
    return names, begin, end


def _neighbours(begin: np.ndarray, end: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Supports that take in the symbol before ``first`` and the one after ``last``, or one word beyond the document."""
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(doc) - 1)
    left = np.where((first > 0) & (doc[before] == doc[first]), begin[before], begin[first] - 1)
    right = np.where((last < len(doc) - 1) & (doc[after] == doc[last]), end[after], end[last] + 1)
    return left, right


def _name_runs(names, begin, end, doc, seed):
    if not len(names):
        return names, begin, end, doc
    first = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[first[1:], len(names)] - 1
    left, right = _neighbours(begin, end, doc, first, last)
    length = (last - first + 1).astype(U)
    return np.where(length > U(1), mix(names[first] + mix(length, seed), seed), names[first]), left, right, doc[first]


def _name_pairs(names, begin, end, doc, seed):
    if not len(names):
        return names, begin, end, doc
    coin = (mix(names, seed) & U(1)).astype(bool)
    paired = np.r_[coin[:-1] & ~coin[1:] & (doc[:-1] == doc[1:]), False]  # a left symbol before a right one
    first = np.flatnonzero(~np.r_[False, paired[:-1]])
    pair = paired[first]
    last = first + pair
    left, right = _neighbours(begin, end, doc, first, last)
    named = np.where(pair, mix(names[first] * U(3) + mix(names[last], seed + 1), seed), names[first])
    # a pair is formed whatever stands beside it; a single symbol is single because of its neighbours
    return named, np.where(pair, begin[first], left), np.where(pair, end[last], right), doc[first]


def _least_in_ranges(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the least rank in each range [lo, hi), the leftmost of equals; ranges are not empty."""
    out = np.empty(len(lo), dtype=np.int64)
    table = np.arange(len(rank))
    level, size = np.frexp((hi - lo).astype(np.float64))[1] - 1, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            a, b = table[:-size], table[size:]
            table = np.where(rank[a] <= rank[b], a, b)
            size *= 2
        here = np.flatnonzero(level == k)
        a, b = table[lo[here]], table[hi[here] - size]
        out[here] = np.where(rank[a] <= rank[b], a, b)
    return out


class Windows:
    """All windows of a batch of texts: where they start, their anchors' keys and positions, and their names."""

    def __init__(self, words_of: list[list[bytes]], window: int):
        sizes = np.array([len(w) for w in words_of], dtype=np.int64)
        self.offset = np.r_[0, np.cumsum(sizes)]
        names = np.fromiter((h for words in words_of for h in map(xxhash.xxh3_64_intdigest, words)), dtype=U, count=int(sizes.sum()))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.repeat(self.offset[:-1], np.maximum(sizes - window + 1, 0))
        within = np.arange(len(starts)) - np.repeat(np.cumsum(np.maximum(sizes - window + 1, 0)) - np.maximum(sizes - window + 1, 0), np.maximum(sizes - window + 1, 0))
        self.start = starts + within
        self.doc = doc[self.start] if len(starts) else np.zeros(0, np.int64)
        self.position = within
        symbols, begin, end = recompress(names, doc)
        hashes = [RangeHashes(names, BASES[0]), RangeHashes(mix(names, 7), BASES[1])]
        self.name = [mix(h(self.start, self.start + window)) for h in hashes]
        lo = np.searchsorted(begin, self.start, "left")
        hi = np.searchsorted(end, self.start + window, "right")
        some = np.flatnonzero(lo < hi)
        best = _least_in_ranges(mix(symbols, 11), lo[some], hi[some])
        self.key = mix(self.name[0], 13)          # a window without a symbol is its own anchor
        self.key[some] = mix(hashes[0](begin[best], end[best]), 17)
        self.at = -1 - self.start                 # what tells anchors apart: a symbol, or the window itself
        self.at[some] = best

    def anchor_keys(self) -> np.ndarray:
        """The key of every anchor, once for each place."""
        _, first = np.unique(self.at, return_index=True)
        return self.key[first]


def _words(batch: pa.RecordBatch, column: int) -> list[list[bytes]]:
    return [t.split() for t in utf8_list(batch.column(column))]



def _kept(words: list[bytes], starts: np.ndarray, window: int) -> list[bytes]:
    """The words that no window starting at ``starts`` covers."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return [w for w, covered in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not covered]


def repeated_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every row.

    A word is removed if a window of ``window`` consecutive words covers it
    whose word sequence also starts earlier: in a row with a smaller id, or
    earlier in the same row.  Windows are judged on the input.  The kept
    words are joined by one space (UTF-8 bytes).  Null and empty texts have
    no words, texts shorter than a window lose none.  A null id comes after
    all others.  Rows of one id (or with a null id) never repeat each other:
    each is judged against smaller ids and itself.  An empty table gives an empty
    result; other columns are not read.
    """
    if window < 16 + 4:
        raise ValueError("window must be 20 words or more: supports of symbols take up to 16")
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def keys_of(batch):
        for part in bounded_batches([batch], "text", BATCH_BYTES):
            yield Windows(_words(part, 0), window).anchor_keys()

    ids = rows.select(F.coalesce("doc_id", F.lit(_LAST_ID)).alias("id"))
    twins = spark.sparkContext.broadcast(twin_ids(ids, "id"))
    shared = spark.sparkContext.broadcast(repeated_bitmap(rows.select("text"), keys_of))

    def candidates(batch):
        """Windows of a batch whose anchor occurs more than once."""
        words = _words(batch, 1)
        windows = Windows(words, window)
        return words, windows, np.flatnonzero(is_set(np.frombuffer(shared.value, np.uint8), windows.key))

    def keyed(part):
        """Ids, null as the last, and what tells rows of one id apart."""
        ids = part.column(0).fill_null(_LAST_ID).to_numpy(zero_copy_only=False)
        return ids, row_marks(np.frombuffer(twins.value, np.uint8), ids, utf8_list(part.column(1)))

    def named(batch):
        for part in bounded_batches([batch], "text", BATCH_BYTES):
            _, w, pick = candidates(part)
            ids, marks = keyed(part)
            yield w.name[0][pick], w.name[1][pick], ids[w.doc[pick]], w.position[pick], marks[w.doc[pick]]

    firsts = first_windows(deal_windows(rows, named))

    def split(batches):
        """Rows without a candidate are done; the others keep their text."""
        for batch in batches:
            for part in bounded_batches([batch], "text", BATCH_BYTES):
                words, w, pick = candidates(part)
                busy = np.zeros(part.num_rows, dtype=bool)
                busy[w.doc[pick]] = True
                texts = part.column(1).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    part.column(0), *map(pa.array, keyed(part)), pa.array([len(x) for x in words], pa.int64()),
                    pa.array([None if b else b" ".join(x) for x, b in zip(words, busy, strict=True)], pa.binary()),
                    pa.array([t if b else None for t, b in zip(texts, busy, strict=True)], pa.binary()),
                ], names=["doc_id", "id", "mark", "n_words", "kept_text", "text"])

    parted = rows.mapInArrow(split, "doc_id long, id long, mark long, n_words long, kept_text binary, text binary")
    done = parted.where("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_text")
    busy = parted.where("text is not null").select("doc_id", "id", "mark", "text").join(firsts, ["id", "mark"], "left").select("doc_id", "text", "starts")

    def remove(batches):
        for batch in batches:
            for part in bounded_batches([batch], "text", BATCH_BYTES):
                words, w, pick = candidates(part)
                cut = np.searchsorted(w.doc[pick], np.arange(part.num_rows + 1))
                out = []
                for k, lists in enumerate(part.column(2).to_pylist()):
                    first = np.concatenate([np.frombuffer(b, "<u4") for b in lists]) if lists else np.zeros(0, "<u4")
                    starts = np.setdiff1d(w.position[pick[cut[k]:cut[k + 1]]], first.astype(np.int64))
                    out.append(_kept(words[k], starts, window))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(x) for x in words], pa.int64()),
                    pa.array([len(a) - len(b) for a, b in zip(words, out, strict=True)], pa.int64()),
                    pa.array([b" ".join(x) for x in out], pa.binary())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    judged = busy.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text binary")
    return done.unionByName(judged).withColumn("doc_id", F.col("doc_id").cast(id_type))
