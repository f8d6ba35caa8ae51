"""Quality classifier: Bradley-Terry ranking, thresholded by score quantile.

Every document has a strength, linear in features of its text.  From
preference pairs (a document marked good is preferred to one marked bad) the
weights are learnt by logistic loss on feature differences.  The threshold is
the quantile of the labelled documents' strengths at the share of bad labels;
scores are strengths moved so that this threshold lies at ``CUT``.

The fit uses every labelled document.  They are dealt into groups of bounded
size, each with both labels; a group is written as one row of packed features.
Moments, the sums of each Newton step and the counts that find the threshold
are passes over these rows, of which the driver gets a few numbers a group.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import utf8_list, written

#: Labelled rows in a group, about.
GROUP_ROWS = 8192
#: Rows of the rarer label that a group should have; fewer rows than that in all are sent to every group.
RARER_ROWS = 64
#: Preference pairs of each row of the label that a group has more of.
PARTNERS = 4
#: Up to so many labelled rows in all go to every task (16 bytes each), so that no text is shuffled; more meet the texts' features by a shuffle.
SENT_LABELS = 1_000_000
STEPS = 30
RIDGE = 1e-3
#: Score of the threshold: predicted 1 from here on.
CUT = 0.3
FOLDS = 5
#: Counted parts of the range of strengths, and at most so many passes to find the threshold in them.
BINS, NARROWINGS = 512, 8

FEATURES = (
    "log_words", "word_length", "symbols", "pipes", "exclamations", "upper", "digits", "full_stops", "commas", "other_marks",
    "not_ascii", "adjacent_repeats", "vocabulary", "top_word", "repeated_lines", "log_line_words", "no_text",
)
_ASCII = np.arange(128)


def _set(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars])


_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_SYMBOLS = _set("#*$%&<>")
_OTHER = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "#*$%&<>|!.,"])


def features(text: bytes) -> list[float]:
    """Features of one whole text; all 0 but ``no_text`` if it has no words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    letters = max(1, int(count[_UPPER].sum() + count[_LOWER].sum()))
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        np.log1p(n), sum(map(len, words)) / n, count[_SYMBOLS].sum() / n, count[ord("|")] / n, count[ord("!")] / n,
        count[_UPPER].sum() / letters, count[_DIGIT].sum() / letters, count[ord(".")] / n, count[ord(",")] / n, count[_OTHER].sum() / n,
        count[0xC0:].sum() / len(text), sum(map(eq, words, words[1:])) / n, np.log1p(len(seen)) / np.log1p(n),
        max(seen.values()) / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), 0.0,
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features_udf(column: pa.Array) -> pa.Array:
    return pa.array([list(map(float, features(t))) for t in utf8_list(column)], pa.list_(pa.float64()))


@dataclass(frozen=True)
class Ranking:
    """A fitted model: standardised features times weights, less the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.strength(x) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Groups:
    """Groups of labelled rows: a written table ``grp, x, good, own`` of packed features, labels and first-copy marks."""

    def __init__(self, table: DataFrame, seed: int):
        self.table, self.seed = table, seed

    def sums(self, part) -> list[np.ndarray]:
        """``part(x, good, own, group)`` of every group, in the order of the groups."""
        width = len(FEATURES)

        def run(batches):
            for batch in batches:
                for grp, x, good, own in zip(*(batch.column(c).to_pylist() for c in ("grp", "x", "good", "own")), strict=True):
                    x = np.frombuffer(x, np.float64).reshape(-1, width)
                    got = part(x, np.frombuffer(good, np.bool_), np.frombuffer(own, np.bool_), grp)
                    yield pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([np.asarray(got, np.float64).tobytes()], pa.binary())], names=["grp", "got"])

        rows = self.table.mapInArrow(run, "grp long, got binary").collect()  # a few numbers a group
        return [np.frombuffer(r["got"], np.float64) for r in sorted(rows, key=lambda r: r["grp"])]


def _pairs(good: np.ndarray, group: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Winners and losers: every row of a group is in a pair, those of the label it has more of in ``PARTNERS`` each."""
    rng = np.random.default_rng([seed, group])
    win, lose = rng.permutation(np.flatnonzero(good)), rng.permutation(np.flatnonzero(~good))
    if not len(win) or not len(lose):
        return win[:0], lose[:0]
    few, many = sorted((win, lose), key=len)
    picked = np.concatenate([np.resize(np.roll(few, -j), len(many)) for j in range(PARTNERS)])
    many = np.tile(many, PARTNERS)
    return (picked, many) if few is win else (many, picked)


def fit_ranking(groups: Groups, bad_share: float) -> Ranking:
    """Weights from preference pairs by Newton steps on the logistic loss of feature differences.

    Without both labels nothing can be preferred: all weights are 0 and every score is ``CUT``.
    """
    width, seed = len(FEATURES), groups.seed

    def moments(x, good, own, _):
        x, good = x[own], good[own]
        mean = x.mean(axis=0) if len(x) else np.zeros(width)
        return np.r_[len(x), good.sum(), mean, ((x - mean) ** 2).sum(axis=0)]

    n, n_good, mean, spread = 0, 0, np.zeros(width), np.zeros(width)
    for got in groups.sums(moments):
        m, group_mean = got[0], got[2:2 + width]
        if m:
            apart = group_mean - mean
            spread = spread + got[2 + width:] + apart ** 2 * (n * m / (n + m))
            mean = mean + apart * (m / (n + m))
            n, n_good = n + int(m), n_good + int(got[1])
    if not 0 < n_good < n:
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    scale = np.sqrt(spread / n)
    scale[scale < 1e-9] = 1.0

    def newton(x, good, _, group, w):
        z = np.clip((x - mean) / scale, -8, 8)
        win, lose = _pairs(good, group, seed)
        d = z[win] - z[lose]
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))  # P(winner preferred) = sigmoid(w . d)
        return np.r_[len(d), d.T @ (p - 1), ((d * (p * (1 - p))[:, None]).T @ d).ravel()]

    w = np.zeros(width)
    for _ in range(STEPS):
        got = sum(groups.sums(lambda x, good, own, group, w=w: newton(x, good, own, group, w)))
        gradient = got[1:1 + width] / got[0] + RIDGE * w
        hessian = got[1 + width:].reshape(width, width) / got[0] + RIDGE * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    # each class counts as much as it does among all labels, however many of its labels have a document
    weight = (bad_share / (n - n_good), (1 - bad_share) / n_good)
    return Ranking(mean, scale, w, _threshold(groups, Ranking(mean, scale, w, 0.0), weight, bad_share))


def _threshold(groups: Groups, model: Ranking, weight: tuple[float, float], share: float) -> float:
    """Middle between the strength at which ``share`` of the weight is reached and the next one.

    Counts in parts of a range narrow it down to few values, which are then read.
    """
    high = 8 * float(np.abs(model.weights).sum()) + 1.0
    low, high, before = -high, high, 0.0  # strengths are clipped sums

    def parts(edges):
        def part(x, good, own, _):
            s = model.strength(x)[own]
            at = np.searchsorted(edges, s, side="right") - 1
            inside = (at >= 0) & (at < BINS)
            return np.r_[np.bincount(at[inside & ~good[own]], minlength=BINS), np.bincount(at[inside & good[own]], minlength=BINS)]
        return part

    def values(x, good, own, _):
        s, g = model.strength(x)[own], good[own]
        inside = (s >= low) & (s < high)
        value, of = np.unique(s[inside], return_inverse=True)
        below, above = s[s < low], s[s >= high]
        return np.r_[below.max() if len(below) else -np.inf, above.min() if len(above) else np.inf, value,
                     np.bincount(of, ~g[inside], len(value)), np.bincount(of, g[inside], len(value))]

    for _ in range(NARROWINGS):
        edges = np.linspace(low, high, BINS + 1)
        count = sum(groups.sums(parts(edges))).reshape(2, BINS)
        reached = before + np.cumsum(weight[0] * count[0] + weight[1] * count[1])
        k = min(int(np.searchsorted(reached, share - 1e-12)), int(np.flatnonzero(count.sum(axis=0))[-1]))
        if edges[k] == low and edges[k + 1] == high:
            break
        before = float(reached[k - 1]) if k else before
        low, high = float(edges[k]), float(edges[k + 1])
        if count[:, k].sum() <= GROUP_ROWS:
            break
    got = groups.sums(values)
    least, next_up = max(g[0] for g in got), min(g[1] for g in got)
    value, bad, good = (np.concatenate(x) for x in zip(*(np.split(g[2:], 3) for g in got), strict=True))
    order = np.argsort(value, kind="stable")
    value, rows = value[order], (bad + good)[order]
    reached = before + np.cumsum((weight[0] * bad + weight[1] * good)[order])
    k = min(int(np.searchsorted(reached, share - 1e-12)), len(value) - 1)
    if k == len(value) - 1 and next_up == np.inf:  # the largest strength: the middle of the last two rows
        return float((value[k] + (value[k] if rows[k] > 1 else value[k - 1] if k else least)) / 2)
    # rows of one strength: the next row is of the same strength unless the share is reached with the last of them
    more = rows[k] > 1 and reached[k] > share + 1e-12
    return float((value[k] + (value[k] if more else value[k + 1] if k + 1 < len(value) else next_up)) / 2)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 42) -> Ranking:
    """Fit on all labelled rows of ``df`` outside the held-out fold.

    Labels other than 0 and 1 and labels without a document are left out.
    """
    usable = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("l_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("l_id")) != 0))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    total = sum(counts.values())
    texts = df.select(F.col(id_col).alias("t_id"), F.col(text_col).cast("string").alias("text"))
    features_of = lambda rows: rows.withColumn("x", _features_udf("text")).drop("text")
    on = F.col("t_id") == F.col("l_id")
    rows = features_of(texts.join(F.broadcast(usable), on)) if total <= SENT_LABELS else features_of(texts).join(usable, on)
    n_groups = max(1, -(-total // GROUP_ROWS))
    # the rarer label is sent to as many groups as each needs to have some of it
    rarer = min((0, 1), key=lambda v: counts.get(v, 0))
    copies = min(n_groups, -(-RARER_ROWS * n_groups // max(1, counts.get(rarer, 0))))
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == rarer, F.lit(copies - 1)).otherwise(F.lit(0))))
    dealt = rows.select("l_id", "label", "x", copy.alias("copy")).select(
        "l_id", "label", "x", "copy",
        F.pmod(F.xxhash64(F.lit(seed), "l_id") + F.col("copy") * F.lit(max(1, n_groups // copies)), F.lit(n_groups)).alias("grp"))

    def pack(table: pa.Table) -> pa.Table:
        x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(table), len(FEATURES))
        good, own = table["label"].to_numpy() == 1, table["copy"].to_numpy() == 0
        order = np.lexsort((*x.T, own, good, pd.factorize(table["l_id"].to_pandas(), sort=True)[0]))
        return pa.table({"grp": table["grp"].slice(0, 1), **{n: pa.array([np.ascontiguousarray(v[order]).tobytes()], pa.binary()) for n, v in (("x", x), ("good", good), ("own", own))}})

    packed = written(dealt.groupBy("grp").applyInArrow(pack, "grp long, x binary, good binary, own binary"), "labelled")
    return fit_ranking(Groups(packed, seed), counts.get(0, 0) / max(1, total))


def score_quality(df: DataFrame, model: Ranking, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``df`` with ``out_col``, a score from 0 to 1 of every whole text.

    Null and empty texts are scored as texts without words.  Rows are scored
    one by one: ties and repeated rows get equal scores; an empty table gives
    an empty result; ``out_col`` replaces a column of that name.
    """
    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        x = np.array([features(t) for t in utf8_list(column)], dtype=np.float64).reshape(len(column), len(FEATURES))
        return pa.array(model.score(x))

    return df.withColumn(out_col, score(F.col(text_col).cast("string")))
