"""Sentence splitting and greedy overlapping chunking of documents.

Plan shape (no shuffle at all): scan -> project (normalise, split sentences,
per-sentence token and character counts, all JVM built-ins) -> one Arrow UDF
that walks the chunk boundaries over two integer arrays per document -> project
(a chunk's text is its sentences joined by spaces: linear in the document,
however many chunks it has) -> explode.

Why a UDF for the walk: the start of chunk *n+1* depends on where chunk *n*
ended (a pointer chase).  Windows can compute each boundary's candidates, but
following the chain then needs either a per-document ``collect_list`` plus a
quadratic fold, or a shuffle of the whole corpus.  The Arrow UDF sees only
``array<int>`` columns (never the text), is vectorised with numpy
(``searchsorted`` for both ends of every window) and keeps the job narrow, so
it scales with the number of documents and needs memory proportional to one
document's sentence count.

Walk rule (sentences 0..n-1, token prefix sums P):
  en(i)  = max(i+1, max{b : P[b]-P[i] <= size})     one long sentence stands alone
  emit [i, en); stop when en == n
  k      = largest index in [i, en-1] with P[en]-P[k] >= overlap
  next   = k if it exists else en; next = max(next, i+1)
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import normalize_ws, split_sentences, word_count

# The three chunking strategies the evaluation compares, and the
# ingest default (size, overlap) in words.
DEFAULT_STRATEGIES = (("small", 150, 20), ("default", 400, 50), ("large", 800, 100))
DEFAULT_CHUNK_SIZE = 400
DEFAULT_OVERLAP = 50

SPAN_TYPE = T.ArrayType(T.StructType([
    T.StructField("strategy", T.IntegerType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("s_from", T.IntegerType()),
    T.StructField("s_to", T.IntegerType()),
    T.StructField("c_start", T.IntegerType()),
    T.StructField("c_end", T.IntegerType()),
    T.StructField("n_tokens", T.IntegerType()),
]))

_SPAN_FIELDS = ("strategy", "chunk_index", "s_from", "s_to", "c_start", "c_end", "n_tokens")


def walk_chunks(tokens: np.ndarray, size: int, overlap: int,
                prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sentence ranges [from, to) of the chunks of one document."""
    n = len(tokens)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if prefix is None:
        prefix = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(tokens, out=prefix[1:])
    # en(i) for every i at once; back(e) = last b with P[b] <= P[e] - overlap
    ends = np.maximum(np.arange(1, n + 1), np.searchsorted(prefix, prefix[:n] + size, side="right") - 1)
    back = np.searchsorted(prefix, prefix - overlap, side="right") - 1
    froms, tos = [], []
    i = 0
    while True:
        e = int(ends[i])
        froms.append(i)
        tos.append(e)
        if e >= n:
            return np.asarray(froms, dtype=np.int64), np.asarray(tos, dtype=np.int64)
        k = min(int(back[e]), e - 1)
        nxt = k if k >= i else e
        i = nxt if nxt > i else i + 1


def _flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list<int> Arrow array, as int64 numpy."""
    arr = arr.cast(pa.list_(pa.int64()))
    offsets = arr.offsets.to_numpy().astype(np.int64)
    values = arr.values.to_numpy(zero_copy_only=False).astype(np.int64)
    return values, offsets


def _walk_batch(toks: pa.Array, lens: pa.Array, sizes: pa.Array, overlaps: pa.Array):
    """Spans of every document of an Arrow batch: (columns, chunks per doc,
    doc index per chunk)."""
    tv, to = _flat(toks)
    lv, lo = _flat(lens)
    sv, so = _flat(sizes)
    ov, oo = _flat(overlaps)
    cols: dict[str, list] = {f: [] for f in _SPAN_FIELDS}
    counts = np.zeros(len(toks), dtype=np.int64)
    for d in range(len(toks)):
        t = tv[to[d]:to[d + 1]]
        if len(t) == 0:
            continue
        ln = lv[lo[d]:lo[d + 1]]
        starts = np.zeros(len(ln) + 1, dtype=np.int64)
        np.cumsum(ln + 1, out=starts[1:])
        prefix = np.zeros(len(t) + 1, dtype=np.int64)
        np.cumsum(t, out=prefix[1:])
        for s_idx, (size, overlap) in enumerate(zip(sv[so[d]:so[d + 1]], ov[oo[d]:oo[d + 1]])):
            a, b = walk_chunks(t, int(size), int(overlap), prefix)
            m = len(a)
            counts[d] += m
            cols["strategy"].append(np.full(m, s_idx))
            cols["chunk_index"].append(np.arange(m))
            cols["s_from"].append(a)
            cols["s_to"].append(b)
            cols["c_start"].append(starts[a])
            cols["c_end"].append(starts[b] - 1)
            cols["n_tokens"].append(prefix[b] - prefix[a])
    flat = {f: (np.concatenate(cols[f]) if cols[f] else np.zeros(0, dtype=np.int64)) for f in _SPAN_FIELDS}
    return flat, counts, np.repeat(np.arange(len(toks)), counts)


def _as_list_of_structs(flat: dict, counts: np.ndarray, extra: dict | None = None) -> pa.Array:
    fields = [pa.array(flat[f], type=pa.int32()) for f in _SPAN_FIELDS]
    names = list(_SPAN_FIELDS)
    for name, arr in (extra or {}).items():
        fields.append(arr)
        names.append(name)
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    values = pa.StructArray.from_arrays(fields, names=names)
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)


@F.arrow_udf(SPAN_TYPE)
def chunk_spans(toks: pa.Array, lens: pa.Array, sizes: pa.Array, overlaps: pa.Array) -> pa.Array:
    """Per document: chunk spans for every (size, overlap) strategy given.

    Reads the flat Arrow buffers (no per-element Python objects): prefix sums
    and both window ends with numpy, then the walk per document/strategy."""
    flat, counts, _ = _walk_batch(toks, lens, sizes, overlaps)
    return _as_list_of_structs(flat, counts)


def hashed_span_type():
    return T.ArrayType(T.StructType(SPAN_TYPE.elementType.fields + [
        T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def chunk_spans_hashed(dim: int):
    """``chunk_spans`` that also returns each chunk's hash embedding.

    Input adds the token hash codes of every *sentence* (computed once per
    document in the JVM).  Word tokens never cross a sentence end ('.', '!'
    or '?' then a space), so a chunk's tokens are exactly the tokens of its
    sentences: its vector is one ``bincount`` over a contiguous slice of the
    document's codes.  Identical to hashing the chunk text, but each sentence
    is tokenised and hashed once however many strategies or overlaps reuse it.
    """
    from tessera.operators.embed import codes_to_vectors

    @F.arrow_udf(hashed_span_type())
    def spans_hashed(toks: pa.Array, lens: pa.Array, codes: pa.Array, sizes: pa.Array,
                     overlaps: pa.Array) -> pa.Array:
        flat, counts, doc_of = _walk_batch(toks, lens, sizes, overlaps)
        codes = codes.cast(pa.list_(pa.list_(pa.int64())))
        sent_off = codes.offsets.to_numpy().astype(np.int64)          # doc -> first sentence
        inner = codes.values                                           # list<int64> per sentence
        tok_off = inner.offsets.to_numpy().astype(np.int64)           # sentence -> first token
        values = inner.values.to_numpy(zero_copy_only=False).astype(np.int64)
        first = tok_off[sent_off[doc_of] + flat["s_from"]]
        last = tok_off[sent_off[doc_of] + flat["s_to"]]
        vecs = codes_to_vectors(values, first, last, dim)
        emb = pa.ListArray.from_arrays(
            pa.array(np.arange(0, (len(first) + 1) * dim, dim, dtype=np.int32)), pa.array(vecs.ravel()))
        return _as_list_of_structs(flat, counts, {"embedding": emb})

    return spans_hashed


def with_sentences(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``norm_text``, ``sentences``, ``sent_tokens``, ``sent_chars``."""
    return (df
            .withColumn("norm_text", normalize_ws(F.col(text_col)))
            .withColumn("sentences", split_sentences(F.col("norm_text")))
            .withColumn("sent_tokens", F.transform("sentences", word_count))
            .withColumn("sent_chars", F.transform("sentences", F.length)))


def explode_sentences(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """One row per sentence: keys, sent_index, sentence, n_tokens, start, end.

    Character offsets come from the same Arrow walk helper (a one-sentence
    "strategy" with size 0 and overlap 0 yields one chunk per sentence), so no
    window or shuffle is needed.
    """
    s = with_sentences(df.select(*keys, text_col), text_col)
    spans = chunk_spans(F.col("sent_tokens"), F.col("sent_chars"),
                        F.array(F.lit(0)), F.array(F.lit(0)))
    return (s.select(*keys, "sentences", F.posexplode(spans).alias("pos", "sp"))
            .select(*keys,
                    F.col("sp.chunk_index").alias("sent_index"),
                    F.element_at("sentences", F.col("sp.s_from") + 1).alias("sentence"),
                    F.col("sp.n_tokens").alias("n_tokens"),
                    F.col("sp.c_start").alias("start"),
                    F.col("sp.c_end").alias("end")))


def chunk_documents(df: DataFrame, keys: Sequence[str], text_col: str = "text",
                    strategies: Sequence[tuple[str, int, int]] | None = None,
                    chunk_size: int = DEFAULT_CHUNK_SIZE,
                    overlap: int = DEFAULT_OVERLAP, hash_dim: int | None = None) -> DataFrame:
    """One row per chunk.

    Output: keys, [strategy, chunk_size, overlap when ``strategies`` given],
    chunk_index, chunk_text, start, end, s_from, s_to, n_tokens.
    Blank documents give no chunks.  All strategies come out of one pass over
    the documents: the strategy list is a literal array handed to the UDF, so
    there is no join and no replication of the input rows.  With
    ``hash_dim`` the chunks also get their hash ``embedding`` from sentence
    token codes computed once per document (see ``chunk_spans_hashed``).
    """
    multi = strategies is not None
    strats = list(strategies) if multi else [("single", chunk_size, overlap)]
    for name, size, ov in strats:
        if size < 1 or ov < 0:
            raise ValueError(f"bad strategy {name}: size={size} overlap={ov}")
    sizes = F.array(*[F.lit(int(s)) for _, s, _ in strats])
    overlaps = F.array(*[F.lit(int(o)) for _, _, o in strats])
    names = F.array(*[F.lit(n) for n, _, _ in strats])
    s = with_sentences(df.select(*keys, text_col), text_col)
    if hash_dim:
        from tessera.functions.text import token_hash_codes
        codes = F.transform("sentences", token_hash_codes)
        spans = chunk_spans_hashed(hash_dim)(F.col("sent_tokens"), F.col("sent_chars"), codes, sizes, overlaps)
    else:
        spans = chunk_spans(F.col("sent_tokens"), F.col("sent_chars"), sizes, overlaps)
    spanned = s.select(*keys, F.col("sentences").alias("_sentences"), spans.alias("_spans"))
    texts = F.transform("_spans", lambda sp: F.struct(
        sp.alias("sp"),
        F.array_join(F.slice("_sentences", sp["s_from"] + 1, sp["s_to"] - sp["s_from"]), " ").alias("text")))
    exploded = spanned.select(*keys, F.explode(texts).alias("_x")).select(
        *keys, F.col("_x.sp").alias("sp"), F.col("_x.text").alias("_text"))
    cols: list[Column] = [F.col(k) for k in keys]
    if multi:
        idx = F.col("sp.strategy") + 1
        cols += [F.element_at(names, idx).alias("strategy"),
                 F.element_at(sizes, idx).alias("chunk_size"),
                 F.element_at(overlaps, idx).alias("overlap")]
    cols += [
        F.col("sp.chunk_index").alias("chunk_index"),
        F.col("_text").alias("chunk_text"),
        F.col("sp.c_start").alias("start"),
        F.col("sp.c_end").alias("end"),
        F.col("sp.s_from").alias("s_from"),
        F.col("sp.s_to").alias("s_to"),
        F.col("sp.n_tokens").alias("n_tokens"),
    ]
    if hash_dim:
        cols.append(F.col("sp.embedding").alias("embedding"))
    return exploded.select(*cols)


def chunk_id(*parts: Column) -> Column:
    """Deterministic chunk id: sha256 of the key parts joined by U+0001.

    Re-running or retrying an ingest yields the same ids, so replacing a
    url's chunks is idempotent.
    """
    return F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]), 256)
