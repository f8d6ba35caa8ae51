"""Token ids of a corpus as binary files, with Elias-Fano document boundaries.

Texts are dealt to ranges of ascending document id (a text is about as large
as its ids) and encoded there.  Each range is cut into blocks, and each block
is one file, written by Spark's own file writer (whose commit protocol
leaves one whole copy of each file when tasks are tried again):

  ``b"TKEF"``, version, bytes of an id (2 or 4), shard, block, documents,
  documents without id (last), tokens, least document id, sizes of the two
  coded sequences -- the sequences: first token of each document and one past
  the last; document ids less the least one -- the ids, little endian -- a
  line feed that ends the file.

Files in order of (shard, block) hold the documents in ascending order of id.
A block's ids are one array that can be mapped into memory; ``select`` on its
boundaries gives any document's place in it.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, written
from tessera.llm.elias_fano import EliasFano, ef_encode

MAGIC, VERSION = b"TKEF", 1
_HEAD = struct.Struct("<4sHHIIQQQqQQ")
#: Tokens of a block (a document with more is a block of its own), bytes of text in a shard and in one of a small table.
BLOCK_TOKENS = 1 << 22
SHARD_BYTES = 64 << 20
SMALL_SHARD = 1 << 20
#: Bytes of text whose words are looked up together, and words that a task remembers at most.
SLICE_BYTES = 16 << 20
MEMO_WORDS = 1 << 19


def _word_rules(spec: dict) -> bool:
    """True if the tokenizer treats every run without ASCII white space by itself: white space is dropped by the
    split, and neither the normalizer nor an added token looks across it."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = norm.get("normalizers", [norm])
    pieces = pre.get("pretokenizers", [pre])
    plain = [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    split = (len(pieces) == 2 and pieces[0].get("type") == "Split" and pieces[0]["behavior"] == "Removed" and pieces[0]["invert"]
             and pieces[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
             and pieces[1].get("type") == "ByteLevel" and not pieces[1]["add_prefix_space"] and not pieces[1]["use_regex"])
    tokens = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    return plain and split and tokens and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")


class TextEncoder:
    """Ids of whole texts by the tokenizers library.

    Where the tokenizer's rules allow it, each distinct word between white
    space is given to the library once and remembered: a word of printable
    ASCII and Latin letters goes to the library's model piece by piece, any
    other word through all of the library's steps.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.by_word = _word_rules(spec)
        self.memo, self.pieces = {}, {}
        if self.by_word:
            letters = [chr(c) for c in range(0xC0, 0x300) if unicodedata.category(chr(c))[0] == "L"]
            self._plain = re.compile(f"[!-~{''.join(letters)}]+").fullmatch
            letter = f"a-z{''.join(c for c in letters if c == c.lower())}"
            self._cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[0-9]|[^{letter}0-9]+").findall
            own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
            rest = [b for b in range(256) if b not in set(own)]
            self._symbol = {b: 0x100 + k for k, b in enumerate(rest)}
            special = "|".join(re.escape(t["content"]) for t in spec["added_tokens"])
            # texts whose letters A-Z may be lowered first: no combining marks, no added token in any case
            self._keep_case = r"[\x{0300}-\x{10FFFF}]" + (f"|(?i:{special})" if special else "")
            self._special = re.compile(special, re.I).search if special else lambda _: None

    def _pack(self, ids) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            symbols = piece.encode("utf-8").decode("latin-1").translate(self._symbol)
            ids = self.pieces[piece] = self._pack([t.id for t in self.library.model.tokenize(symbols)])
        return ids

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of words that are not known yet."""
        if len(self.memo) + len(words) > MEMO_WORDS:
            self.memo = {}
        if len(self.pieces) > MEMO_WORDS:
            self.pieces = {}
        others = []
        for raw in words:
            word = raw.decode("utf-8")
            if self._plain(word) and not self._special(word):
                # lowering Latin letters below U+0300 gives letters that the split and NFC leave alone
                word = word.lower()
                self.memo[raw] = self._piece(word) if word.isalpha() else b"".join([self._piece(p) for p in self._cut(word)])
            else:
                others.append(raw)
        for raw, ids in zip(others, self._whole([w.decode("utf-8") for w in others]), strict=True):
            self.memo[raw] = ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, where each text begins and one past the last), null as empty."""
        texts = texts.fill_null("")
        end = b"" if end_id is None else self._pack([end_id])
        if not self.by_word:
            coded = [ids + end for ids in self._whole(texts.to_pylist())]
            return np.frombuffer(b"".join(coded), self.dtype), np.cumsum([0, *(len(c) // self.width for c in coded)])
        texts = pc.if_else(pc.match_substring_regex(texts, self._keep_case), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_pylist()
        known = self.memo
        new = [w for w in distinct if w not in known]
        if new:
            old = {w: known[w] for w in distinct if w in known} if len(known) + len(new) > MEMO_WORDS else known
            self._learn(new)
            known = self.memo if old is known else {**old, **self.memo}
        coded = [known[w] for w in distinct] + [end]
        sizes = np.array([len(c) for c in coded], dtype=np.int64) // self.width
        flat, begin = np.frombuffer(b"".join(coded), self.dtype), np.cumsum(sizes) - sizes
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        # the end id is one more word of each text
        code = np.insert(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(distinct))
        count = sizes[code]
        total = np.cumsum(count)
        ids = flat[np.repeat(begin[code] - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        last_word = ends + np.arange(len(ends))  # the end's place among the words
        return ids, np.r_[0, total[last_word]] if len(ends) else np.zeros(1, dtype=np.int64)


_ENCODERS: dict[int, TextEncoder] = {}


def _encoder(tokenizer_json: str) -> TextEncoder:
    """One encoder for each Python worker and tokenizer."""
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(tokenizer_json)
    return _ENCODERS[key]


def pack_block(shard: int, block: int, width: int, doc_ids: list[int | None], sizes: np.ndarray, ids: bytes) -> bytes:
    """One file's bytes; ``doc_ids`` ascend, those that are null come last."""
    known = [i for i in doc_ids if i is not None]
    least = known[0] if known else 0
    starts = ef_encode(np.r_[0, np.cumsum(sizes)])
    # differences of 64-bit ids fit 64 bits without sign
    names = ef_encode(np.array(known, dtype=np.int64).view(np.uint64) - np.array([least], dtype=np.int64).view(np.uint64))
    head = _HEAD.pack(MAGIC, VERSION, width, shard, block, len(doc_ids), len(doc_ids) - len(known), int(np.sum(sizes)), least, len(starts), len(names))
    return head + starts + names + ids


class TokenBlock:
    """Reader of one file: boundaries, document ids and the id array, all views of the file's bytes."""

    def __init__(self, data: bytes):
        magic, version, self.width, self.shard, self.block, self.n_docs, self.n_unnamed, self.n_tokens, self.least, a, b = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        view, at = memoryview(data), _HEAD.size
        self.starts, self.names = EliasFano(view[at:at + a]), EliasFano(view[at + a:at + a + b])
        if len(data) < at + a + b + self.n_tokens * self.width:
            raise ValueError(f"token file {self.shard}/{self.block} is cut short")
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_tokens, at + a + b)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects."""
        return self.ids[self.starts.select(i):self.starts.select(i + 1)]

    def doc_ids(self) -> pa.Array:
        known = (self.names.decode() + np.array([self.least], dtype=np.int64).view(np.uint64)).view(np.int64)
        return pa.concat_arrays([pa.array(known, pa.int64()), pa.nulls(self.n_unnamed, pa.int64())])


def _blocks(tokenizer, end_id: int, block_tokens: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer.value)
        number, names, sizes, parts, held, shard = 0, [], [], [], 0, None

        def block() -> pa.RecordBatch:
            data = pack_block(shard, number, encoder.width, names, np.concatenate(sizes), b"".join(parts))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

        for batch in bounded_batches(batches, "text", SLICE_BYTES):
            shard, doc_ids = batch.column(0)[0].as_py(), batch.column(1).to_pylist()
            ids, at = encoder.encode(batch.column(2), end_id)
            begin = 0
            while begin < len(doc_ids):
                end = int(np.searchsorted(at, at[begin] + block_tokens - held, side="right")) - 1
                if end <= begin and names:
                    yield block()
                    number, names, sizes, parts, held = number + 1, [], [], [], 0
                    continue
                end = max(end, begin + 1)  # a long document is a block of its own
                names += doc_ids[begin:end]
                sizes.append(np.diff(at[begin:end + 1]))
                parts.append(ids[at[begin]:at[end]].tobytes())
                held += int(at[end] - at[begin])
                begin = end
        if names:
            yield block()
    return cut


def write_token_files(df: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                      block_tokens: int = BLOCK_TOKENS, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every whole text and write the files under ``path`` (a new folder).

    ``df`` is read three times (its size, the ranges, the texts), so it should
    be a stored table.  Null and empty texts have the end id alone.  Rows are
    in ascending order of id, null ids last; rows of one id are ordered by
    their text's hash, and equal rows by their place in ``df``, so a hot id is
    spread over several shards.  An id must be an integer.  A table without
    rows gives no file with content.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(-(-size // shard_bytes), min(2 * spark.sparkContext.defaultParallelism, 1 + size // SMALL_SHARD))
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())  # bounded by the vocabulary file
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("row")]
    ranged = (rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
              .repartitionByRange(int(shards), *order).sortWithinPartitions(*order))
    blocks = ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(_blocks(tokenizer, end_id, block_tokens), "data binary")
    # a string column is written as the bytes it holds: one block, one file
    blocks.select(F.col("data").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def _documents(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                block = TokenBlock(data.as_buffer())
                starts = block.starts.decode().astype(np.int64)
                doc_ids = block.doc_ids()
                step = max(1, (1 << 20) * block.n_docs // max(1, block.n_tokens))
                for begin in range(0, block.n_docs, step):
                    end = min(block.n_docs, begin + step)
                    at = starts[begin:end + 1]
                    ids = block.ids[at[0]:at[-1]].astype("<u4")
                    cuts = (at - at[0]).tolist()
                    raw = ids.tobytes()
                    crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                    n = end - begin
                    columns = [pa.array(np.full(n, block.shard)), pa.array(np.full(n, block.block)), doc_ids.slice(begin, n),
                               pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.array(cuts, dtype=np.int32)), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", "doc_id", "local", "n_tokens", "ids_crc32"] + ["token_ids"] * with_ids)
    return read


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files under ``path``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (of the ids as 32-bit integers), and with ``with_ids`` its token_ids.

    Each file gives its documents' places by itself; the number of ids before
    a file is a sum over the files, taken per shard and then over shards.
    """
    batch_rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch_rows, "10000")
    spark.conf.set(batch_rows, "1")  # a row is a whole file
    try:
        files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")
        rows = written(files.mapInArrow(_documents(with_ids), "shard long, block long, doc_id long, local long, n_tokens long, ids_crc32 long"
                                        + (", token_ids array<int>" if with_ids else "")), "token-rows")
    finally:
        spark.conf.set(batch_rows, before)
    blocks = rows.groupBy("shard", "block").agg(F.sum("n_tokens").alias("size"))
    shards = blocks.groupBy("shard").agg(F.sum("size").alias("size"))
    before_me = lambda w: F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    # one row a shard: bounded by the corpus size over SHARD_BYTES
    first = shards.select("shard", before_me(Window.orderBy("shard")).alias("first"))
    inside = blocks.select("shard", "block", before_me(Window.partitionBy("shard").orderBy("block")).alias("inside"))
    base: Column = F.col("first") + F.col("inside")
    places = inside.join(first, "shard").select("shard", "block", base.alias("base"))
    return rows.join(places, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32",
                                                        *(["token_ids"] if with_ids else []))
