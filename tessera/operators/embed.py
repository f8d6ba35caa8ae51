"""Embedding: the deterministic hash embedder and the pluggable model hook.

Hash embedder (offline default).  Tokens are lower-cased letter/digit runs;
``h = int(md5(token)[:8], 16)``; each distinct ``h`` of a text counts once
(presence, not frequency: frequent function words would otherwise dominate
every cosine); bucket ``h % dim``; sign ``+1`` when ``(h // dim)`` is even
else ``-1``; the signed bucket sums are L2-normalised and stored as
``array<float>``.  Token hashing runs in the JVM (``md5`` +
``conv``); the per-row bucket count is one ``np.bincount`` inside an Arrow UDF
(a dense vector cannot be built from an array of codes in linear time with
Spark's higher-order functions).

Model hook.  ``model_embedder(factory)`` wraps any object with
``embed_batch(list[str]) -> list[list[float]]`` in an iterator pandas UDF: the
model is built once per Python worker and fed Arrow batches, never single rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import token_hash_codes

DEFAULT_DIM = 384  # width of the reference's vector column

VECTOR = T.ArrayType(T.FloatType())
SLICE_CELLS = 1 << 22  # numbers in the working matrix (32 MB)


def _codes_to_vector(codes, dim: int) -> np.ndarray:
    if not codes:
        return np.zeros(dim, dtype=np.float32)
    h = np.unique(np.asarray(codes, dtype=np.int64))
    buckets = h % dim
    signs = 1.0 - 2.0 * ((h // dim) % 2)
    v = np.bincount(buckets, weights=signs, minlength=dim)
    norm = np.sqrt(np.dot(v, v))
    if norm > 0:
        v = v / norm
    return v.astype(np.float32)


def codes_to_vectors(values: np.ndarray, first: np.ndarray, last: np.ndarray, dim: int) -> np.ndarray:
    """Vectors for many token ranges ``values[first[i]:last[i]]`` at once:
    distinct (row, hash) pairs, one ``bincount`` over (row, bucket), then
    row-wise L2 norm."""
    if len(first) * dim >= 1 << 31:
        raise ValueError("vectors of one Arrow batch exceed its offsets; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    out = np.zeros((len(first), dim), dtype=np.float32)
    step = max(1, SLICE_CELLS // dim)
    for a in range(0, len(first), step):  # the wide working matrix stays bounded
        out[a:a + step] = _slice_to_vectors(values, first[a:a + step], last[a:a + step], dim)
    return out


def _slice_to_vectors(values: np.ndarray, first: np.ndarray, last: np.ndarray, dim: int) -> np.ndarray:
    n = len(first)
    lengths = last - first
    rows = np.repeat(np.arange(n), lengths)
    starts_out = np.cumsum(lengths) - lengths
    idx = np.arange(int(lengths.sum())) - np.repeat(starts_out, lengths) + np.repeat(first, lengths)
    # presence: each distinct (row, hash) once; hashes are < 2**32
    pairs = np.unique((rows.astype(np.int64) << 32) | values[idx])
    rows, h = pairs >> 32, pairs & 0xFFFFFFFF
    signs = 1.0 - 2.0 * ((h // dim) % 2)
    m = np.bincount(rows * dim + h % dim, weights=signs, minlength=n * dim).reshape(n, dim)
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    np.divide(m, norms[:, None], out=m, where=norms[:, None] > 0)
    return m.astype(np.float32)


def _hash_vector_udf(dim: int):
    @F.arrow_udf(VECTOR)
    def hash_vectors(codes: pa.Array) -> pa.Array:
        codes = codes.cast(pa.list_(pa.int64()))
        off = codes.offsets.to_numpy().astype(np.int64)
        values = codes.values.to_numpy(zero_copy_only=False).astype(np.int64)
        vecs = codes_to_vectors(values, off[:-1], off[1:], dim)
        return pa.ListArray.from_arrays(
            pa.array(np.arange(0, (len(codes) + 1) * dim, dim, dtype=np.int32)), pa.array(vecs.ravel()))
    return hash_vectors


def hash_embedding(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """array<float>(dim) hash embedding of a text column."""
    return _hash_vector_udf(dim)(token_hash_codes(text))


def embed_hash(df: DataFrame, text_col: str, out_col: str = "embedding",
               dim: int = DEFAULT_DIM) -> DataFrame:
    return df.withColumn(out_col, hash_embedding(F.col(text_col), dim))


# --- pluggable model hook -------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+")


class HashModel:
    """Pure-Python twin of the JVM hash embedder (same vectors)."""

    def __init__(self, dim: int = DEFAULT_DIM):
        self.dim = dim

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            codes = [int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16)
                     for tok in _TOKEN.findall((t or "").lower())]
            out.append(_codes_to_vector(codes, self.dim).tolist())
        return out


def model_embedder(factory: Callable[[], object]):
    """Iterator pandas UDF ``text -> array<float>`` around a model factory.

    ``factory()`` runs once per Python worker; the model's ``embed_batch``
    receives whole Arrow batches, order kept, empty batch -> empty result.
    """
    state: dict = {}

    @F.pandas_udf(VECTOR)
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = state.get("model")
        if model is None:
            model = state["model"] = factory()
        for texts in batches:
            if len(texts) == 0:
                yield pd.Series([], dtype=object)
                continue
            vecs = model.embed_batch(texts.fillna("").tolist())
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in vecs])

    return embed


GUARDED_VECTOR = T.StructType([T.StructField("embedding", VECTOR), T.StructField("error", T.StringType()),
                               T.StructField("message", T.StringType())])


def guarded_embedder(factory: Callable[[], object]):
    """``model_embedder`` that turns exceptions into rows: text -> struct(embedding, error, message).

    When ``embed_batch`` raises, or returns another number of vectors, the
    batch's texts are embedded one by one, and those that raise get the
    exception's type and message.  A factory that raises ends the job: no row
    is to blame."""
    state: dict = {}

    def one(model, text: str) -> dict:
        try:
            [vector] = model.embed_batch([text])
            return {"embedding": np.asarray(vector, dtype=np.float32), "error": None, "message": None}
        except Exception as fault:
            return {"embedding": None, "error": type(fault).__name__, "message": str(fault)}

    @F.pandas_udf(GUARDED_VECTOR)
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = state.get("model")
        if model is None:
            model = state["model"] = factory()
        for batch in batches:
            texts = batch.fillna("").tolist()
            try:
                vectors = model.embed_batch(texts) if texts else []
                if len(vectors) != len(texts):
                    raise ValueError("as many vectors as texts are needed")
                rows = [{"embedding": np.asarray(v, dtype=np.float32), "error": None, "message": None} for v in vectors]
            except Exception:
                rows = [one(model, t) for t in texts]
            yield pd.DataFrame(rows, columns=GUARDED_VECTOR.names)

    return embed


def check_dims(df: DataFrame, col: str = "embedding", dim: int = DEFAULT_DIM) -> DataFrame:
    """Split rows by vector width: adds ``dim_ok``; callers quarantine the rest."""
    return df.withColumn("dim_ok", F.coalesce(F.size(col) == dim, F.lit(False)))
