"""Byte-level BPE encoding and decoding.

The words (pretokens) that occur most often in the whole input are counted by
Spark, merged once on the driver and compiled into a minimal acyclic
transducer whose outputs are their token ids; every task maps that file into
memory and looks words up in it.  Words that are not in the lexicon are
merged exactly, pair by pair in rank order, so the lexicon decides speed only.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, give_back_memory, scratch_path, write_shared, written
from tessera.llm.lexicon import Lexicon, compile_lexicon

#: Words in the lexicon (a bound for the driver and the mapped file, not for the results).
LEXICON_WORDS = 1 << 17
#: A task counts words in a table of at most this size; its rarest half is let go when it is full.
COUNT_TABLE = 1 << 18
#: Results that a task remembers at most.
MEMO_WORDS = 1 << 18
#: Tokens that are decoded together (some ten bytes of working arrays for each byte of their text).
DECODE_TOKENS = 1 << 17
ID_BITS = 32
ID_MASK = (1 << ID_BITS) - 1
NO_MERGE = 1 << 62
HASH = 0x9E3779B97F4A7C15  # an odd multiplier
#: Characters of text whose words are looked up together.
SLICE_CHARS = 1 << 20
#: The pretoken pattern of byte-level BPE with white space spelt out (fixed value).
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


# The same pattern for texts up to U+00FF, whose letters, numbers and white space are few; the standard library is
# faster on it (fixed values: the Latin-1 members of \p{L}, \p{N} and White_Space).
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", r"\t-\r \x85\xa0"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


@lru_cache(1)
def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: bytes that are printable
    Latin-1 stand for themselves, the others follow from U+0100 on in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in own}
    rest = [b for b in range(256) if b not in set(own)]
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian int32."""
    return np.array(ids, dtype="<i4").tobytes()


class Vocabulary:
    """What encoding needs of a tokenizer file; small and picklable."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = spec["normalizer"] is None and pre == {**pre, "type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if model["type"] != "BPE" or not plain or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only byte-level BPE without normalizer, prefix space and dropout is supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that strip or match whole words only are not supported")
        symbols, vocab = byte_symbols(), model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, bytes] = {i: bytes(symbols[c] for c in t) for t, i in vocab.items()}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}
        of_byte = {b: vocab[c] for c, b in symbols.items()}
        self.byte_ids = [of_byte[b] for b in range(256)]
        # rank and new id in one number, so that the least is the merge to do
        self.steps: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.steps[vocab[a], vocab[b]] = rank << ID_BITS | vocab[a + b]
        self._keys = None

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE of one pretoken: the pair of lowest rank first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 128:
            return self._merge_long(ids)
        get = self.steps.get
        pairs = [get(pair, NO_MERGE) for pair in zip(ids, ids[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == NO_MERGE:
                break
            at = pairs.index(best)
            ids[at:at + 2] = [best & ID_MASK]
            del pairs[at]
            if at:
                pairs[at - 1] = get((ids[at - 1], ids[at]), NO_MERGE)
            if at < len(pairs):
                pairs[at] = get((ids[at], ids[at + 1]), NO_MERGE)
        return ids

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of many words at once, as packed int32: in every round each word merges its pair of lowest rank."""
        short = [k for k, w in enumerate(words) if len(w) <= 128]
        out = [b"" if len(w) <= 128 else pack(self.merge(w)) for w in words]
        flat = np.frombuffer(b"".join([words[k] for k in short]), dtype=np.uint8)
        tokens = np.array(self.byte_ids, dtype=np.int64)[flat]
        owner = np.repeat(np.arange(len(short)), [len(words[k]) for k in short])
        done_tokens, done_owner = [], []
        while len(tokens):
            step = np.full(len(tokens), NO_MERGE, dtype=np.int64)
            pair = np.flatnonzero(owner[1:] == owner[:-1])
            step[pair] = self._table(tokens[pair], tokens[pair + 1])
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[begin, len(owner)])
            best = np.repeat(np.minimum.reduceat(step, begin), sizes)
            live = best < NO_MERGE
            done_tokens.append(tokens[~live])
            done_owner.append(owner[~live])
            tokens, owner, step, best = tokens[live], owner[live], step[live], best[live]
            at = np.flatnonzero(step == best)
            # of overlapping equal pairs the leftmost merges: every other one in a row of neighbours
            head = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1] + 1][:len(at)], np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            tokens[at] = best[at] & ID_MASK
            stay = np.ones(len(tokens), dtype=bool)
            stay[at + 1] = False
            tokens, owner = tokens[stay], owner[stay]
        if done_owner:
            owner = np.concatenate(done_owner)
            order = np.argsort(owner, kind="stable")
            packed = np.concatenate(done_tokens)[order].astype("<i4").tobytes()
            ends = 4 * np.cumsum(np.bincount(owner, minlength=len(short)))
            begin = 0
            for k, end in zip(short, ends.tolist(), strict=True):
                out[k] = packed[begin:end]
                begin = end
        return out

    def _table(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge steps of many pairs, from a hash table with linear probing."""
        if self._keys is None:
            bits = max(8, (4 * len(self.steps)).bit_length())
            keys, values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NO_MERGE, dtype=np.int64)
            for (a, b), step in self.steps.items():
                h = ((a << ID_BITS | b) * HASH % (1 << 64)) >> (64 - bits)
                while keys[h] >= 0:
                    h = (h + 1) % (1 << bits)
                keys[h], values[h] = a << ID_BITS | b, step
            self._keys, self._values, self._shift = keys, values, np.uint64(64 - bits)
        key = left << ID_BITS | right
        h = ((key.view(np.uint64) * np.uint64(HASH)) >> self._shift).astype(np.int64)
        found = self._keys[h]
        out = self._values[h]
        out[found != key] = NO_MERGE
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            h[rest] = (h[rest] + 1) % len(self._keys)
            found = self._keys[h[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self._values[h[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, n log n."""
        n, get = len(ids), self.steps.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p >> ID_BITS, k, p & ID_MASK, ids[k], ids[k + 1]) for k in range(n - 1) if (p := get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            r = after[k] if ids[k] == a else n
            if r >= n or ids[r] != b:
                continue  # one of the two is gone
            ids[k], ids[r] = new, -1
            after[k] = after[r]
            if after[k] < n:
                before[after[k]] = k
                if (p := get((new, ids[after[k]]))) is not None:
                    heapq.heappush(heap, (p >> ID_BITS, k, p & ID_MASK, new, ids[after[k]]))
            if (j := before[k]) >= 0 and (p := get((ids[j], new))) is not None:
                heapq.heappush(heap, (p >> ID_BITS, j, p & ID_MASK, ids[j], new))
        return [i for i in ids if i >= 0]


def _splitter(special: dict[str, int]):
    """Text -> its pretokens, with the special tokens as pieces of their own."""
    find_any, find_latin = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
    cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None

    def find(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return find_any(text)
        return find_latin(text)

    def pieces(text: str) -> list[str]:
        if cut is None or not cut.search(text):
            return find(text)
        out = []
        for k, part in enumerate(cut.split(text)):
            out += [part] if k % 2 else find(part)
        return out

    return pieces


def _count_words(special: dict[str, int], table: int, emit: int):
    def count(batches):
        give_back_memory()  # what earlier jobs left in this worker
        pieces, seen = _splitter(special), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(pieces(text))
                    if len(seen) > table:
                        kept = seen.most_common(table // 2)
                        seen.clear()
                        seen.update(dict(kept))
        top = seen.most_common(emit)
        seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])
        del top
        give_back_memory()
    return count


def frequent_words(df: DataFrame, text_col: str, special: dict[str, int], words: int = LEXICON_WORDS) -> list[str]:
    """The words counted most often over all texts of ``df``; each task's table is bounded, so counts of rare words are lower bounds."""
    counted = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_words(special, COUNT_TABLE, words), "word string, n long")
    total = written(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    # a histogram of counts (some hundred rows) tells from which count on words fit the lexicon
    step = F.floor(F.log2("n") * 32).cast("int")
    room, least = words, None
    for row in sorted(total.groupBy(step.alias("step")).count().collect(), reverse=True):
        if row["count"] > room:
            break
        room, least = room - row["count"], row["step"]
    return [] if least is None else [r["word"] for r in total.where(step >= least).collect()]


class Encoder:
    """The encoder of one task: mapped lexicon, bounded memory of results, exact merges for the rest."""

    def __init__(self, vocabulary: Vocabulary, lexicon_path: str | None, memo_words: int = MEMO_WORDS):
        self.vocabulary, self.memo_words = vocabulary, memo_words
        self.lexicon = Lexicon(lexicon_path) if lexicon_path else None
        self.pieces = _splitter(vocabulary.special)
        self.fixed = {s: pack([i]) for s, i in vocabulary.special.items()}
        self.memo, self.older = dict(self.fixed), {}

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of words that are not remembered: from the lexicon, else merged."""
        out, rare, raw_rare = {}, [], []
        for word in words:
            if (packed := self.older.get(word)) is None:
                raw = word.encode("utf-8")
                ids = self.lexicon.get(raw) if self.lexicon else None
                if ids is None:
                    rare.append(word)
                    raw_rare.append(raw)
                    continue
                packed = pack(ids)
            out[word] = packed
        out.update(zip(rare, self.vocabulary.merge_many(raw_rare), strict=True))
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        pieces = [self.pieces(t) for t in texts]
        new = self._learn({w for p in pieces for w in p if w not in self.memo})
        if len(self.memo) + len(new) > self.memo_words:  # what is not met again before the next time is let go
            self.older, self.memo = self.memo, dict(self.fixed)
        self.memo.update(new)
        get, older = self.memo.get, self.older
        out = [b"".join([get(w) or older[w] for w in p]) for p in pieces]
        for w in [w for w in new if len(w) > 64]:
            del self.memo[w]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(key: tuple, vocabulary, lexicon: str | None, memo_words: int) -> Encoder:
    """One encoder for each worker and lexicon; a new lexicon replaces the old one."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary.value, SparkFiles.get(lexicon) if lexicon else None, memo_words)
    return _ENCODERS[key]


def _column_encoder(df: DataFrame, tokenizer_path: str, text_col: str, lexicon_words: int, memo_words: int):
    """The function of a task that gives the token ids of a column of texts; counts the words of ``df`` for its lexicon."""
    spark = df.sparkSession
    vocabulary = Vocabulary(tokenizer_path)
    words = sorted(w.encode("utf-8") for w in frequent_words(df, text_col, vocabulary.special, lexicon_words)
                   if w not in vocabulary.special) if lexicon_words else []
    lexicon = None
    if words:
        path = scratch_path(spark, "lexicon")
        write_shared(spark, path, compile_lexicon(words, [vocabulary.merge(w) for w in words]))
        spark.sparkContext.addFile(path)
        lexicon = path.rsplit("/", 1)[-1]
    shared = spark.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary file
    key = (tokenizer_path, lexicon, memo_words)

    def encode(column: pa.Array) -> pa.Array:
        encoder = _encoder(key, shared, lexicon, memo_words)
        packed, part, size = [], [], 0
        for text in column.to_pylist():
            part.append(text or "")
            size += len(part[-1])
            if size >= SLICE_CHARS:
                packed += encoder.encode_many(part)
                part, size = [], 0
                give_back_memory()
        packed += encoder.encode_many(part)
        give_back_memory()
        at = np.zeros(len(packed) + 1, dtype=np.int64)
        np.cumsum([len(p) // 4 for p in packed], out=at[1:])
        if at[-1] >= 1 << 31:
            raise ValueError("one Arrow batch has over 2^31 tokens; lower spark.sql.execution.arrow.maxRecordsPerBatch")
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))

    return encode


def _column_decoder(df: DataFrame, tokenizer_path: str):
    """The function of a task that gives the texts of a column of token ids."""
    tokens = Vocabulary(tokenizer_path).tokens
    known = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)] + [b""]  # the last one is for ids that are not there
    sizes = np.array([len(t) for t in known], dtype=np.int64)
    shared = df.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(known), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes))

    def decode(column: pa.Array) -> pa.Array:
        flat, begin, size = shared.value
        at = column.offsets.to_numpy().astype(np.int64)
        first, at = int(at[0]), at - at[0]
        raw, ends, done = [], np.zeros(len(at), dtype=np.int64), 0
        for a in range(0, int(at[-1]), DECODE_TOKENS):  # across the rows, so that a long one is cut as well
            b = min(a + DECODE_TOKENS, int(at[-1]))
            ids = column.values[first + a:first + b].fill_null(-1).to_numpy(zero_copy_only=False)
            ids = np.where((ids < 0) | (ids >= len(size) - 1), len(size) - 1, ids)
            count = size[ids]
            total = np.cumsum(count)
            raw.append(flat[np.repeat(begin[ids] - (total - count), count) + np.arange(total[-1])].tobytes())
            rows = slice(np.searchsorted(at, a, side="right"), np.searchsorted(at, b, side="right"))
            ends[rows] = done + total[at[rows] - a - 1]
            done += int(total[-1])
        if done >= 1 << 31:
            raise ValueError("one Arrow batch has over 2^31 bytes of text; lower spark.sql.execution.arrow.maxRecordsPerBatch")
        packed = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(b"".join(raw))])
        try:
            return packed.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([x.decode("utf-8", "replace") for x in packed.to_pylist()], pa.string())

    return decode


def bpe_encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", out_col: str = "token_ids", lexicon_words: int = LEXICON_WORDS,
               memo_words: int = MEMO_WORDS) -> DataFrame:
    """``df`` with ``out_col``, the token ids (array of int) of every whole text.

    As the tokenizers library encodes without added special tokens, truncation
    or padding: special tokens spelt out in a text become their ids.  Null
    and empty texts give an empty array; an empty table gives an empty
    result.  ``out_col`` replaces a column of that name.  Each row is encoded
    alone: ties, repeated rows and hot sources change nothing.  ``memo_words``
    bounds the words a worker remembers (two generations of so many): less
    memory costs time and changes no result.
    """
    encode = F.arrow_udf(_column_encoder(df, tokenizer_path, text_col, lexicon_words, memo_words), "array<int>")
    return df.withColumn(out_col, encode(F.col(text_col).cast("string")))


def bpe_decode(df: DataFrame, tokenizer_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``, the text that ``ids_col`` stands for, special tokens included.

    Bytes that are no UTF-8 become U+FFFD; ids that the vocabulary lacks are
    left out; null gives an empty text.  Each row is decoded alone: ties and
    repeated rows change nothing, an empty table gives an empty result.
    """
    return df.withColumn(out_col, F.arrow_udf(_column_decoder(df, tokenizer_path), "string")(F.col(ids_col)))


def bpe_round_trip(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "token_ids", out_col: str = "decoded",
                   lexicon_words: int = LEXICON_WORDS, memo_words: int = MEMO_WORDS) -> DataFrame:
    """``df`` with the token ids of every whole text and the text decoded from them: ``bpe_encode``, then ``bpe_decode``.

    One call a batch does both.  Where the decoder follows the encoder as a
    function of its own, Spark puts the encoder into the decoder's argument
    and encodes every text twice.  Nulls, ties, repeated rows and empty tables
    are as in those two; ``ids_col`` and ``out_col`` replace columns of these
    names.
    """
    encode, decode = _column_encoder(df, tokenizer_path, text_col, lexicon_words, memo_words), _column_decoder(df, tokenizer_path)

    def both(column: pa.Array) -> pa.Array:
        ids = encode(column)
        return pa.StructArray.from_arrays([ids, decode(ids)], names=["ids", "decoded"])

    (coded,) = fresh(df, "coded")
    both_of = F.arrow_udf(both, "struct<ids: array<int>, decoded: string>")
    return (df.withColumn(coded, both_of(F.col(text_col).cast("string")))
            .withColumn(ids_col, F.col(coded)["ids"]).withColumn(out_col, F.col(coded)["decoded"]).drop(coded))
