"""Exact cosine top-k retrieval: one question or many at once, with filters.

Batch plan.  Neither side goes through the driver or is broadcast; blocks of
questions and blocks of the index meet by a shuffle.

1. A bounded sample of the index gives the pivots.  Every index row belongs to
   the cell of its nearest pivot and, for each filter that any question uses,
   of a hash of the equality value or of the sample's quantile range it lies
   in; one aggregate gives each cell's size, its range of angles to the pivot
   and its ranges of filter values.  The number of cells is bounded whatever
   the data (``VALUE_CELLS`` for one filter, ``VALUE_PARTS`` for several, times
   the pivots).
2. A question's k-th best score within the sample (under its own filters) is a
   floor for its k-th best overall.  By the triangle inequality of angles, no
   row of a cell is nearer to the question than the angle between question and
   pivot less the cell's outer angle (or the inner angle less that), so cells
   that cannot reach the floor, and cells outside its filters, are left out.
   The result stays exact.
3. Neighbouring small cells are packed into one block, large ones are salted
   into several, of at most ``max_block_bytes`` of vectors on either side, so
   a question meets few blocks and a hot cell (many equal vectors) or a hot
   set of questions is spread.  In a pair of blocks, single-precision products
   (with a bound of their error) leave out what cannot reach the question's
   k-th best so far; the rest is scored in double precision.  A task holds k
   rows a question and a slice of products, never the candidates of all; a
   window over the blocks' top-k gives the global one.  Where the copies of
   both sides would be many times their size, the questions take turns: a
   round's hits are written and its shuffle files removed before the next, so
   the disk holds a share of the copies, not all of them.

Order.  Score DESC (NaN, from a zero vector, first -- as SQL engines order
it), then key ASC.  Ranking uses the score rounded to 9 decimals so that two
engines summing in a different order still agree on ties.

Filters (applied before top-k, as a pre-filter): per query, nullable columns
``folder``/``domain`` (equality) and ``date_from``/``date_to`` (inclusive
range on ``date_added``); a null query value means "no filter".
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ensure_checkpoint_dir, shuffles_removed

DEFAULT_K = 5
MAX_BLOCK_BYTES = 32 * 1024 * 1024  # vectors of a block of questions or of index rows
SCORE_CELLS = 1 << 19               # rows x queries scored per numpy call: a slice of products stays in a core's cache
QUESTIONS_AT_ONCE = 1024
RESCORED_CELLS = 1 << 20            # numbers of candidates' vectors scored in double precision per numpy call (8 MB a side)
LEAST_PAIRS = 1 << 26               # (question, row) pairs worth a task of their own
MAX_TASKS = 4096
ROUND_BYTES = 1 << 29               # rows, vectors and hits that a round of questions may shuffle (or both sides once, if that is more)
PIVOTS, SAMPLE_ROWS = 32, 1024
VALUE_CELLS, VALUE_PARTS = 64, 1024  # parts of one filter's values, of all filters' values together
ANGLE_SLACK = 1e-6                  # above the rounding error of an arc cosine


@dataclass
class FilterSpec:
    """How query filter columns map onto index columns."""
    equal: Sequence[tuple[str, str]] = field(default_factory=list)   # (query col, index col)
    ranges: Sequence[tuple[str, str, str]] = field(default_factory=list)  # (index col, from col, to col)

    @property
    def query_cols(self) -> list[str]:
        cols = [q for q, _ in self.equal]
        for _, lo, hi in self.ranges:
            cols += [lo, hi]
        return cols

    @property
    def index_cols(self) -> list[str]:
        return [i for _, i in self.equal] + [i for i, _, _ in self.ranges]


LINK_FILTERS = FilterSpec(equal=[("folder", "folder"), ("domain", "domain")],
                          ranges=[("date_added", "date_from", "date_to")])


def _matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None, dtype=np.float64) -> np.ndarray:
    """A column of vectors as float64 rows (``dtype`` None: as stored); all must have the same width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes[0]) if width is None and len(sizes) else width or 0
    wrong = int((sizes != width).sum())
    if wrong:  # never dropped in silence: split such rows off with check_dims first
        raise ValueError(f"{wrong} vectors do not have the width {width}; see check_dims")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (flat if dtype is None else flat.astype(dtype, copy=False)).reshape(len(sizes), width)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None]


def _ranked(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of index rows and questions, and the same rounded for ranking with NaN on top."""
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (x @ q.T) / (np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] * np.sqrt(np.einsum("ij,ij->i", q, q))[None, :])
    r = np.round(s, 9)
    return s, np.where(np.isnan(r), np.inf, r)


def _whole(values) -> tuple[np.ndarray, np.ndarray]:
    """Nullable whole numbers -> (values, not-null mask)."""
    ser = pd.array(values, dtype="Int64")
    return ser.to_numpy(dtype=np.int64, na_value=0), ~np.asarray(ser.isna())


def _codes(left, right) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of values as whole numbers, equal where the values are; null is -1."""
    codes, _ = pd.factorize(pd.Series([*left, *right], dtype=object))
    return codes[:len(left)], codes[len(left):]


class _Rules:
    """Which index rows each question may have, by its filters and its own row: values as numbers, compared a slice at a time."""

    def __init__(self, rows: dict, asked: dict, spec: FilterSpec, self_key: str | None, key: str):
        self.equal = [_codes(rows[icol], asked[qcol]) for qcol, icol in spec.equal]
        self.ranges = [(*_whole(rows[icol]), *_whole(asked[col]), holds) for icol, lo, hi in spec.ranges
                       for col, holds in ((lo, np.greater_equal), (hi, np.less_equal))]
        self.own = None if self_key is None else _codes(rows[key], asked[self_key])

    def forbid(self, scores: np.ndarray, of: np.ndarray, at: np.ndarray) -> None:
        """Set the scores (questions ``of`` x rows ``at``) of rows that a question may not have to minus infinity."""
        for row, asked in self.equal:
            want = asked[of]
            if (want >= 0).any():
                scores[(want >= 0)[:, None] & (row[at][None, :] != want[:, None])] = -np.inf
        for value, known, bound, given, holds in self.ranges:
            if given[of].any():
                scores[given[of][:, None] & ~(known[at][None, :] & holds(value[at][None, :], bound[of][:, None]))] = -np.inf
        if self.own is not None:
            row, asked = self.own[0][at], self.own[1][of]
            order = np.argsort(row, kind="stable")
            low, high = (np.searchsorted(row[order], asked, side) for side in ("left", "right"))
            while (some := np.flatnonzero(low < high)).size:  # once, unless keys repeat
                scores[some, order[low[some]]] = -np.inf
                low[some] += 1


def _first_k(score: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k best columns of each row above minus infinity; of equal ones the first."""
    if score.shape[1] <= k:
        return score > -np.inf
    kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k][:, None]
    above, tied = score > kth, score == kth
    room = k - above.sum(axis=1, keepdims=True)
    return (above | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= room))) & (score > -np.inf)


class _Vectors:
    """Vectors as stored, their lengths, and their directions in single precision."""

    def __init__(self, column, width: int | None = None, order=slice(None)):
        self.raw = _matrix(column, width, None)[order]  # whole rows: Arrow would take the numbers of a list one by one
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.raw, self.raw, dtype=np.float64))
        self.odd = ~((self.norm > 0) & np.isfinite(self.norm))  # no cosine: first for every question
        self.unit = np.empty(self.raw.shape, dtype=np.float32)  # divided in double precision, without a copy of all in it
        np.divide(self.raw, np.where(self.odd, 1, self.norm)[:, None], out=self.unit, casting="same_kind")
        self.unit[self.odd] = 0

    def wide(self, which) -> np.ndarray:
        return self.raw[which].astype(np.float64)


def _least(score: np.ndarray, slack: float) -> np.ndarray:
    """The least single-precision product that may come with such a score: below any cosine, above what is forbidden; rounded down."""
    return np.nextafter(np.maximum(score - slack, -2).astype(np.float32), np.float32(-np.inf))


class _Best:
    """The k best rows so far of a slice of questions, ranked by rounded score, then by the order of the rows' keys.

    Rows wait with their single-precision products.  Of these, what cannot be among a question's k best by the
    products themselves is dropped; only the rest is scored in double precision.
    """

    def __init__(self, x: _Vectors, q: _Vectors, whole: np.ndarray, k: int, floor: np.ndarray, place: np.ndarray, slack: float):
        n = len(whole)
        self.x, self.q, self.whole, self.k, self.place, self.least, self.slack = x, q, whole, k, place, floor, slack
        self.row, self.score, self.rank = np.full((n, k), -1, np.int64), np.zeros((n, k)), np.full((n, k), -np.inf)
        self.waiting, self.held, self.most = [], 0, 2 * k * n  # a first floor soon, then fewer merges

    def add(self, of: np.ndarray, at: np.ndarray, product: np.ndarray) -> None:
        self.waiting.append((of, at, product))
        self.held += len(of)
        if self.held > self.most:
            self.settle()
            self.most = 8 * self.row.size

    def _scored(self, of: np.ndarray, at: np.ndarray):
        """Slices of the (question, row) pairs that reach the question's floor, with score and rounded score."""
        rescored = max(1, RESCORED_CELLS // max(1, self.x.raw.shape[1]))
        for c in range(0, len(of), rescored):
            m, n = of[c:c + rescored], at[c:c + rescored]
            asked = self.whole[m]
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.einsum("ij,ij->i", self.q.wide(asked), self.x.wide(n)) / (self.x.norm[n] * self.q.norm[asked])
            rank = _rounded(score)
            good = rank >= self.least[m]
            yield m[good], n[good], score[good], rank[good]

    def settle(self) -> None:
        if not self.held:
            return
        of, at, product = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.held = [], 0
        order = np.lexsort((-product, of))
        of, at, product = of[order], at[order], product[order]
        who, first, count = np.unique(of, return_index=True, return_counts=True)
        kth = np.where(count >= self.k, product[np.minimum(first + self.k, first + count) - 1], -np.inf).astype(np.float64)
        bound = np.repeat(_least(np.maximum(self.least[who], kth - self.slack), self.slack), count)
        for part in self._scored(of[product >= bound], at[product >= bound]):
            self.merge(*part)

    def merge(self, of: np.ndarray, at: np.ndarray, score: np.ndarray, rank: np.ndarray) -> None:
        """Take scored pairs into the k best."""
        who = np.unique(of)
        old = self.row[who] >= 0
        of = np.r_[of, np.repeat(who, self.k)[old.ravel()]]
        at, score, rank = np.r_[at, self.row[who][old]], np.r_[score, self.score[who][old]], np.r_[rank, self.rank[who][old]]
        order = np.lexsort((self.place[at], -rank, of))
        of, at, score, rank = of[order], at[order], score[order], rank[order]
        nth = np.arange(len(of)) - np.searchsorted(of, of)
        keep = nth < self.k
        of, nth = of[keep], nth[keep]
        self.row[of, nth], self.score[of, nth], self.rank[of, nth] = at[keep], score[keep], rank[keep]
        self.least[who] = np.maximum(self.least[who], self.rank[who, -1])


def _rounded(score: np.ndarray) -> np.ndarray:
    """Scores as they rank: nine decimals, NaN on top."""
    r = np.round(score, 9)
    return np.where(np.isnan(r), np.inf, r)


def _best(x: _Vectors, q: _Vectors, cell: np.ndarray, needed: np.ndarray | _Needs, place: np.ndarray, floor: np.ndarray, k: int, rules: _Rules):
    """Slices of (questions, their k best rows or -1, scores, rounded scores).

    Rows are sorted by cell, then by key (``place`` is the order of the keys); ``needed`` tells which cells a
    question must see; rows that rank below a question's ``floor`` may be left out.
    """
    slack = 1.05 * (x.raw.shape[1] + 8) * 2.0 ** -24 + 1e-9  # rounding of a single-precision product, of both directions, of the rank
    rescored = max(1, RESCORED_CELLS // max(1, x.raw.shape[1]))
    edge = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
    for begin in range(0, len(q.norm), QUESTIONS_AT_ONCE):
        whole = np.arange(begin, min(begin + QUESTIONS_AT_ONCE, len(q.norm)))
        best = _Best(x, q, whole, k, floor[whole].copy(), place, slack)
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            of = whole[needed[whole, cell[a]]]
            step = max(1, SCORE_CELLS // max(1, len(of)))
            for low in range(a, b, step) if len(of) else ():
                at = np.arange(low, min(low + step, b))
                s = q.unit[of] @ x.unit[low:low + len(at)].T
                for odd, rows in ((x.odd[at], s.T), (q.odd[of], s)):
                    if odd.any():
                        rows[odd] = np.inf
                least = best.least[of - begin]
                rules.forbid(s, of, at)
                near = s >= _least(least, slack)[:, None]  # compared in single precision
                n_near = int(np.count_nonzero(near))
                if n_near > 2 * k * len(of) and len(at) > k:  # a weak floor or none: the slice's own k-th best product is a better one
                    kth = np.partition(s, len(at) - k, axis=1)[:, len(at) - k].astype(np.float64)
                    near = s >= _least(np.maximum(least, kth - slack), slack)[:, None]
                    n_near = int(np.count_nonzero(near))
                if 10 * n_near <= s.size or n_near <= rescored:
                    i, j = np.divmod(np.flatnonzero(near), len(at))
                    best.add(of[i] - begin, at[j], s[i, j])
                else:  # many equal vectors
                    with np.errstate(divide="ignore", invalid="ignore"):
                        score = (q.wide(of) @ x.wide(at).T) / (q.norm[of][:, None] * x.norm[at][None, :])
                    rank = np.where(near, _rounded(score), -np.inf)
                    rank[rank < least[:, None]] = -np.inf
                    i, j = np.divmod(np.flatnonzero(_first_k(rank, k)), len(at))
                    best.merge(of[i] - begin, at[j], score[i, j], rank[i, j])
        best.settle()
        yield whole, best


def _cell_of(pivots: np.ndarray):
    """Column function: vector -> (cell, angle to its pivot); the last cell is for zero vectors."""
    unit = _unit(pivots)

    @F.arrow_udf("cell int, angle double")
    def assign(vectors: pa.Array) -> pa.Array:
        x = _unit(_matrix(vectors, unit.shape[1]))
        cos = x @ unit.T
        cell = np.where(x.any(axis=1), cos.argmax(axis=1), len(unit)) if len(x) else np.zeros(0, dtype=int)
        near = np.arccos(np.clip(cos.max(axis=1), -1, 1)) if len(x) else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.where(cell < len(unit), near, 0.0))], names=["cell", "angle"])
    return assign


def _needed_cells(q: np.ndarray, asked: dict, sample: dict, cells: dict, pivots: np.ndarray, spec: FilterSpec, k: int, self_key, key) -> tuple[np.ndarray, np.ndarray]:
    """Which cells each question must see (questions x cells), and its floor: its k-th best score in the sample."""
    unit = _unit(q)
    theta = np.arccos(np.clip(unit @ _unit(pivots).T, -1, 1))
    theta = np.c_[theta, np.zeros(len(q))][:, cells["cell"]]
    least = np.maximum(0, np.maximum(theta - cells["far"], cells["near"] - theta) - ANGLE_SLACK)
    reach = np.cos(np.minimum(least, np.pi))
    reach[:, cells["cell"] == len(pivots)] = np.inf  # zero vectors come first for every question
    reach[~unit.any(axis=1)] = np.inf                # and every row ties for a zero question
    floor = np.full(len(q), -np.inf)
    if len(sample["x"]) >= k:
        r = np.ascontiguousarray(_ranked(sample["x"], q)[1].T)
        _Rules(sample["rows"], asked, spec, self_key, key).forbid(r, np.arange(len(q)), np.arange(r.shape[1]))
        floor = np.partition(r, r.shape[1] - k, axis=1)[:, r.shape[1] - k]
    need = reach >= floor[:, None] - 1e-9
    for icol, lo, hi in spec.ranges:
        for col, edge, beyond in ((lo, "max", np.less), (hi, "min", np.greater)):
            bound, given = _whole(asked[col])
            value, known = cells[f"{edge}:{icol}"]
            need &= ~(given[:, None] & (~known[None, :] | beyond(value[None, :], bound[:, None])))
    for name in asked:
        if name.startswith("_value"):
            wanted, given = _whole(asked[name])
            need &= ~given[:, None] | (wanted[:, None] == cells[name][None, :])
    return need, floor


def _packed(sizes: Sequence[int], most: int) -> np.ndarray:
    """The block of each cell: neighbours together while they have at most ``most`` rows, a larger cell alone."""
    block, held, out = -1, most + 1, []
    for n in sizes:
        if held + n > most:
            block, held = block + 1, 0
        held += n
        out.append(block)
    return np.array(out, dtype=np.int64)


def _packed_bits(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """Rows of n flags as the bytes they are packed in."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -(-n // 8))


def _bits(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """Rows of n flags from their packed bytes."""
    return np.unpackbits(_packed_bits(column, n), axis=1, count=n).astype(bool)


class _Needs:
    """Questions x cells, kept packed; ``needs[questions, cell]`` gives the flags of one cell."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, n: int):
        self.packed = _packed_bits(column, n)

    def __getitem__(self, at) -> np.ndarray:
        who, cell = at
        return (self.packed[who, cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)


def _value_cell(col: Column, n: int) -> Column:
    """The part of an equality value (null stays null)."""
    return F.when(col.isNotNull(), F.pmod(F.hash(col), F.lit(n)))


def _range_cell(col: Column, bounds: Sequence[int]) -> Column:
    """How many of the bounds a value has reached; null is -1."""
    reached = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= col)) if len(bounds) else F.lit(0)
    return F.when(col.isNotNull(), reached).otherwise(F.lit(-1))


def _filters_used(queries: DataFrame, spec: FilterSpec) -> tuple[list[tuple[str, str]], list[str]]:
    """The equality filters and the ranged index columns that some question uses (the first three of each)."""
    given = {c: F.max(F.col(c).isNotNull()).alias(c) for c in spec.query_cols}
    used = queries.agg(*given.values()).first() if given else {}
    return [e for e in spec.equal if used[e[0]]][:3], list(dict.fromkeys(i for i, lo, hi in spec.ranges if used[lo] or used[hi]))[:3]


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of whole numbers as a DataFrame, by Arrow: rows of a list would start Python workers of their own."""
    kinds = {"int": pa.int32(), "long": pa.int64()}
    fields = [tuple(c.split()) for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return spark.createDataFrame(pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)}), schema)


@dataclass
class BatchSearch:
    """A planned search: its hits, and how many (question, row) pairs it scores of all there are."""
    hits: DataFrame
    pairs_scored: int
    pairs_in_all: int


def search_batch(index: DataFrame, queries: DataFrame, k: int = DEFAULT_K, *,
                 key_cols: Sequence[str] = ("chunk_id",), carry: Sequence[str] = (),
                 vec_col: str = "embedding", query_vec_col: str = "embedding",
                 filters: FilterSpec | None = None, exclude_self: str | None = None,
                 max_block_bytes: int = MAX_BLOCK_BYTES, pivots: int = PIVOTS) -> BatchSearch:
    """Plan ``topk_batch`` and tell how much of the work the pivots save."""
    spark: SparkSession = index.sparkSession
    spec, keys, carry = filters or FilterSpec(), list(key_cols), list(carry)
    ranged = [F.unix_micros(F.col(i).cast("timestamp")).alias(f"__r_{i}") for i, _, _ in spec.ranges]
    idx = index.where(F.col(vec_col).isNotNull()).select(
        *dict.fromkeys(keys + carry + [i for _, i in spec.equal]), F.col(vec_col).alias("_vec"), *ranged)
    bounds = [F.unix_micros(F.col(c).cast("timestamp")).alias(c) for _, lo, hi in spec.ranges for c in (lo, hi)]
    equal = dict.fromkeys([q for q, _ in spec.equal] + ([exclude_self] if exclude_self else []))
    routed, routed_ranges = _filters_used(queries, spec)
    n_parts = int(min(VALUE_CELLS, VALUE_PARTS ** (1 / max(1, len(routed) + len(routed_ranges))) + 1e-9))
    types = {f.name: f.dataType for f in idx.schema.fields}
    values = [f"_value{n}" for n in range(len(routed))]
    wanted = [_value_cell(F.col(q).try_cast(types[i]), n_parts).alias(n) for n, (q, i) in zip(values, routed, strict=True)]
    qs = queries.select(  # those without a vector go in ``need``: a filter here would compute an embedding twice
        "query_id", F.col(query_vec_col).alias("_vec"), *equal, *bounds, *wanted)
    ranged_spec = FilterSpec(equal=spec.equal, ranges=[(f"__r_{i}", lo, hi) for i, lo, hi in spec.ranges])
    fields = {f.name: f for f in idx.schema.fields}
    found = T.StructType([T.StructField("_qno", T.LongType()), *[fields[c] for c in dict.fromkeys(keys + carry)], T.StructField("score", T.DoubleType()),
                          T.StructField("score_nan", T.BooleanType()), T.StructField("rscore", T.DoubleType())])
    rank_type = "rank int, score double"

    seen = idx.orderBy(F.xxhash64(*keys), *keys).limit(SAMPLE_ROWS).toArrow()  # a bounded sample
    if not len(seen):
        none = spark.createDataFrame([], T.StructType([queries.schema["query_id"], *T.StructType.fromDDL(rank_type).fields[:1],
                                                       *[fields[c] for c in dict.fromkeys(keys + carry)], *T.StructType.fromDDL(rank_type).fields[1:]]))
        return BatchSearch(none, 0, 0)
    x = _matrix(seen["_vec"])
    sample = {"x": x, "rows": {c: seen[c].to_pylist() for c in {keys[0], *ranged_spec.index_cols}}}
    pivot = np.unique(_unit(x)[x.any(axis=1)], axis=0)
    pivots = max(1, min(pivots, 2 * VALUE_PARTS // n_parts ** (len(routed) + len(routed_ranges))))
    pivot = pivot[:: max(1, len(pivot) // pivots)][:pivots] if len(pivot) else np.zeros((0, x.shape[1]))
    if not len(pivot):
        pivot = np.eye(1, x.shape[1])
    place = _cell_of(pivot).asNondeterministic()(F.col("_vec"))  # so that no filter on the cell computes it again
    parts = [F.coalesce(_value_cell(F.col(i), n_parts), F.lit(-1)) for _, i in routed]
    for i in routed_ranges:
        seen_values = np.sort(seen[f"__r_{i}"].drop_null().to_numpy())
        bounds = seen_values[np.arange(1, n_parts) * len(seen_values) // n_parts] if len(seen_values) else seen_values
        parts.append(_range_cell(F.col(f"__r_{i}"), np.unique(bounds).tolist()))
    part = F.lit(0)  # one number for a row's part in each filter; -1 to n_parts - 1
    for p in parts:
        part = part * F.lit(n_parts + 1) + p + F.lit(1)
    placed = idx.withColumn("_place", place).withColumn("_value", part.cast("int")).withColumn("_cell", F.col("_place.cell"))
    edges = [f(c).alias(f"{n}:{c}") for c, _, _ in ranged_spec.ranges for n, f in (("min", F.min), ("max", F.max))]
    stats = placed.groupBy("_cell", "_value").agg(F.count(F.lit(1)).alias("n"), F.min("_place.angle").alias("near"), F.max("_place.angle").alias("far"), *edges)
    stats = sorted(stats.collect(), key=lambda r: (r["_value"], r["_cell"]))  # bounded by the pivots and parts
    per_block = max(1, max_block_bytes // (8 * pivot.shape[1]))
    block = _packed([r["n"] for r in stats], per_block)
    block_start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    cells = {"cell": np.array([r["_cell"] for r in stats]), "value": np.array([r["_value"] for r in stats]),
             "near": np.array([r["near"] for r in stats]), "far": np.array([r["far"] for r in stats])}
    cells |= {n: cells["value"] // (n_parts + 1) ** (len(parts) - 1 - at) % (n_parts + 1) - 1 for at, n in enumerate(values)}
    cells |= {f"{n}:{c}": _whole([r[f"{n}:{c}"] for r in stats]) for c, _, _ in ranged_spec.ranges for n in ("min", "max")}

    def need(batches):
        for batch in batches:
            batch = batch.filter(batch.column("_vec").is_valid())
            rows = {c: batch.column(c).to_pylist() for c in dict.fromkeys([*equal, *ranged_spec.query_cols, *values, "_qno"])}
            q = _matrix(batch.column("_vec"), pivot.shape[1])
            step = max(1, SCORE_CELLS // max(1, len(sample["x"]), len(stats)))
            bits, floors, lists = [], [], []
            for a in range(0, len(q), step):
                part = {c: v[a:a + step] for c, v in rows.items()}
                needed, floor = _needed_cells(q[a:a + step], part, sample, cells, pivot, ranged_spec, k, exclude_self, keys[0])
                bits += [x.tobytes() for x in np.packbits(needed, axis=1)]
                floors.append(floor)
                lists += [np.flatnonzero(m) for m in np.logical_or.reduceat(needed, block_start, axis=1)]
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            flat = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.binary()), pa.array(np.concatenate([*floors, np.zeros(0)])),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*batch.schema.names, "_cells", "_floor", "_blocks"])

    def count(batches):
        """Questions that must see each cell (whole numbers from 0) and block (from -1 down)."""
        seen_by = np.zeros(len(stats) + len(block_start), dtype=np.int64)
        total = 0
        for batch in batches:
            needed = _bits(batch.column("_cells"), len(stats))
            seen_by += np.r_[needed.sum(axis=0), np.logical_or.reduceat(needed, block_start, axis=1).sum(axis=0)]
            total += batch.num_rows
        names = np.r_[np.arange(len(stats)), -1 - np.arange(len(block_start)), len(stats)]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.r_[seen_by, total])], names=["what", "n"])

    numbered = qs.withColumn("_qno", F.monotonically_increasing_id())
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/queries-{uuid.uuid4().hex}"
    schema = T.StructType([*numbered.schema.fields, *T.StructType.fromDDL("_cells binary, _floor double, _blocks array<int>").fields])
    numbered.mapInArrow(need, schema).write.parquet(path)  # written once: the running numbers must not change
    asking = spark.read.schema(schema).parquet(path)
    counts = {r["what"]: r["n"] for r in asking.select("_cells").mapInArrow(count, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop(len(stats), 0)
    scored = sum(counts.get(c, 0) * r["n"] for c, r in enumerate(stats))
    n_rows, work = (np.add.reduceat(x, block_start).tolist() for x in ([r["n"] for r in stats], [r["n"] * counts.get(c, 0) for c, r in enumerate(stats)]))

    def cuts(rounds: int) -> dict[int, tuple[int, int]]:
        """For each block of cells: how many blocks of rows, and how many of the questions of a round."""
        # a block of questions is as large as memory allows, or smaller where cores would idle
        worth = max(LEAST_PAIRS, scored // (4 * rounds * spark.sparkContext.defaultParallelism))
        cut = {}
        for g, n in enumerate(n_rows):
            m = -(-counts.get(-1 - g, 0) // rounds)
            if m:
                n_b = -(-n // per_block)
                cut[g] = (n_b, max(-(-m // per_block), min(m, -(-work[g] // (rounds * n_b * worth)))))
        return cut

    row_bytes, vec_bytes = seen.nbytes // len(seen), seen["_vec"].nbytes // len(seen)
    hit_bytes = row_bytes - vec_bytes + 32
    sent = sum(n_rows[g] * n_q * row_bytes + counts[-1 - g] * n_b * (vec_bytes + k * hit_bytes) for g, (n_b, n_q) in cuts(1).items())
    most = max((-(-counts.get(-1 - g, 0) // per_block) for g in range(len(n_rows))), default=1)  # a round has a full block of questions
    rounds = max(1, min(most, -(-sent // max(ROUND_BYTES, row_bytes * sum(n_rows) + vec_bytes * total))))
    cut = cuts(rounds)
    plan = [(c, int(cells["cell"][c]), int(cells["value"][c]), g, *cut[g]) for c, g in enumerate(block.tolist()) if counts.get(c, 0)]
    plan = F.broadcast(_small(spark, plan, "_c int, _cell int, _value int, _g int, _nb long, _nq long"))  # one row a cell
    blocks = F.broadcast(_small(spark, [(g, *x) for g, x in cut.items()], "_g int, _nb long, _nq long"))
    tasks = max(1, min(MAX_TASKS, 2 * sum(b * s for b, s in cut.values())))
    group = ["_g", "_b", "_s"]

    left = (placed.drop("_place").join(plan, ["_cell", "_value"]).withColumn("_b", F.pmod(F.xxhash64(*keys), F.col("_nb")))
            .withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nq") - 1))).drop("_cell", "_value", "_nb", "_nq"))
    shown = list(dict.fromkeys(keys + carry))

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(rows) or not len(asked):
            return pa.table({n: pa.array([], t) for n, t in arrow_types})
        by_key = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in keys], null_placement="at_start").to_numpy()
        place = np.empty(len(rows), dtype=np.int64)
        place[by_key] = np.arange(len(rows))
        order = np.lexsort((place, rows["_c"].to_numpy()))
        needs = asked["_cells"].to_pylist()
        alike = np.array(sorted(range(len(asked)), key=needs.__getitem__))  # neighbours see the same cells
        x, q = _Vectors(rows["_vec"], None, order), _Vectors(asked["_vec"], pivot.shape[1], alike)
        rows, place, asked = rows.drop(["_vec"]).take(pa.array(order)), place[order], asked.drop(["_vec"]).take(pa.array(alike))
        rules = _Rules({c: rows[c].to_pylist() for c in {keys[0], *ranged_spec.index_cols}},
                       {c: asked[c].to_pylist() for c in dict.fromkeys([*equal, *ranged_spec.query_cols])}, ranged_spec, exclude_self, keys[0])
        qno, parts = asked["_qno"].to_numpy(), []
        rows = rows.select([*shown, "_c"])
        for whole, best in _best(x, q, rows["_c"].to_numpy(), _Needs(asked["_cells"], len(stats)), place, asked["_floor"].to_numpy(), k, rules):
            i, j = np.nonzero(best.row >= 0)
            hit, score = rows.take(pa.array(best.row[i, j])), best.score[i, j]
            nan = np.isnan(score)  # Arrow may turn NaN (zero vector) into null: carried as a flag
            parts.append(pa.Table.from_arrays([pa.array(qno[whole[i]]), *[hit[c] for c in shown], pa.array(np.where(nan, 0.0, score)), pa.array(nan),
                                               pa.array(best.rank[i, j])], schema=pa.schema(arrow_types)))
        pa.default_memory_pool().release_unused()  # workers live on and take turns: what each keeps adds up
        return pa.concat_tables(parts)

    arrow_types = [("_qno", pa.int64()), *[(c, seen.schema.field(c).type) for c in shown],
                   ("score", pa.float64()), ("score_nan", pa.bool_()), ("rscore", pa.float64())]
    order = [F.col("rscore").desc()] + [F.col(c).asc() for c in keys]

    def best_of(asking: DataFrame) -> DataFrame:
        right = (asking.drop("query_id", *values).withColumn("_g", F.explode("_blocks")).drop("_blocks").join(blocks, "_g")
                 .withColumn("_s", F.pmod(F.xxhash64("_qno"), F.col("_nq")))
                 .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1))).drop("_nb", "_nq"))
        local = (left.repartition(tasks, *group).groupBy(*group).cogroup(right.repartition(tasks, *group).groupBy(*group))
                 .applyInArrow(meet, found))
        return local.withColumn("rank", F.row_number().over(Window.partitionBy("_qno").orderBy(*order))).where(F.col("rank") <= k)

    top = best_of(asking)
    if rounds > 1:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hits-{uuid.uuid4().hex}"
        for turn in range(rounds):
            with shuffles_removed(spark):
                best_of(asking.where(F.pmod(F.xxhash64("_qno", F.lit(rounds)), F.lit(rounds)) == turn)).write.parquet(f"{path}/round-{turn}")
        top = spark.read.schema(top.schema).parquet(*[f"{path}/round-{turn}" for turn in range(rounds)])
    score = F.when(F.col("score_nan"), F.lit(float("nan"))).otherwise(F.col("score"))
    hits = (top.join(asking.select("_qno", "query_id"), "_qno")
            .select("query_id", "rank", *dict.fromkeys(keys + carry), score.alias("score")))
    return BatchSearch(hits, scored, total * sum(r["n"] for r in stats))


def topk_batch(index: DataFrame, queries: DataFrame, k: int = DEFAULT_K, **how) -> DataFrame:
    """Top-k index rows per query: query_id, rank, key_cols, carry, score (options as for ``search_batch``).

    ``queries`` needs ``query_id`` (of any type) and a vector column, plus the
    filter columns of ``filters``.  ``exclude_self`` names a query column whose
    value, when equal to the index's first key column, excludes that row
    (leave-one-out search over a table against itself).  Index rows and
    questions without a vector are left out; vectors of another width are an
    error.  Rows of one key may be repeated; an empty side gives no hits.
    ``index`` is read three times (sample, cells, search), and once more for
    each further round of questions, so it should be a stored table.
    """
    return search_batch(index, queries, k, **how).hits


def topk_single(index: DataFrame, query_vec: Sequence[float], k: int = DEFAULT_K, *,
                key_cols: Sequence[str] = ("chunk_id",), carry: Sequence[str] = (),
                vec_col: str = "embedding", filters: dict | None = None) -> DataFrame:
    """One question: ``filters`` is the request's dict (folder, domain,
    date_from, date_to); unknown keys are ignored, a present key with value
    None matches nothing (``col = NULL``).  Ranked as in ``topk_batch``."""
    filters = filters or {}
    known = {"folder", "domain", "date_from", "date_to"}
    present = {key: val for key, val in filters.items() if key in known}
    idx = index
    if any(v is None for v in present.values()):
        idx = idx.where(F.lit(False))
    for key in ("folder", "domain"):
        if present.get(key) is not None:
            idx = idx.where(F.col(key) == F.lit(present[key]))
    if present.get("date_from") is not None:
        idx = idx.where(F.col("date_added") >= F.lit(present["date_from"]))
    if present.get("date_to") is not None:
        idx = idx.where(F.col("date_added") <= F.lit(present["date_to"]))
    keys, carry, question = list(key_cols), list(carry), np.array([[float(x) for x in query_vec]])
    rows = idx.where(F.col(vec_col).isNotNull()).select(*dict.fromkeys(keys + carry), F.col(vec_col).alias("_vec"))

    @F.arrow_udf("double")
    def score_of(vectors: pa.Array) -> pa.Array:
        return pa.array(_ranked(_matrix(vectors, question.shape[1]), question)[0][:, 0], from_pandas=False)

    scored = rows.select(*dict.fromkeys(keys + carry), score_of("_vec").alias("score"))
    # partial top-k in every task, k rows in all after that; NaN sorts first, as in the batch form
    best = [F.round("score", 9).desc(), *[F.col(c).asc() for c in keys]]
    top = scored.orderBy(*best).limit(k)
    return top.select(F.row_number().over(Window.orderBy(*best)).alias("rank"), *dict.fromkeys(keys + carry), "score")
