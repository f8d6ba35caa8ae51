"""Quality rules as a short-circuit cascade, with DataFrame functions only.

A rule rejects a document by one metric of its text.  Each rule's cost
(time over a sample, less the time of a scan alone) and selectivity (share of
the sample that it rejects) are estimated first; rules then run in the order
of rejection per cost.  A metric is computed inside ``CASE WHEN no rule has
failed yet``, so a document pays only up to its first failing rule.  The
verdict is the conjunction of all rules, hence the same for every order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, text_or_empty

#: Rows of the sample on which costs and selectivities are estimated.  Only the order of rules depends on it.
SAMPLE_ROWS = 500
#: Words in a window of the repetition rule.
WINDOW = 5
#: Characters that count as symbols (fixed value).
SYMBOLS = "#*$%&|<>"

SPACES = r"[ \t-\r]+"


@dataclass(frozen=True)
class Rule:
    """Rejects a document when ``rejects(frame column of the metric, n_words)`` is true."""

    name: str
    metric: str
    rejects: Callable[[Column, Column], Column]


#: The default rules.  The first two are the base rules; the others reject texts that are mostly symbols,
#: shouting, repeated lines, or have words of an implausible mean length.  Texts without words fail ``few_words``.
RULES = (
    Rule("few_words", "n_words", lambda m, n: n < 10),
    Rule("repeated_windows", "n_repeat_words", lambda m, n: 100 * m > 20 * n),
    Rule("symbols", "n_symbols", lambda m, n: 4 * m > n),
    Rule("upper_case", "n_upper", lambda m, n: m > 2 * n),
    Rule("repeated_lines", "dup_line_pct", lambda m, n: m > 50),
    Rule("word_length", "word_chars", lambda m, n: (m > 40 * n) | (2 * m < 3 * n)),
)
BASE = ("few_words", "repeated_windows")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row (and only where the expression is reached)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count_of(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _dup_lines(text: Column, words: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return _let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _dup_line_pct(text: Column, words: Column) -> Column:
    """Their share of all lines with a word, in whole percent."""
    share = lambda x: F.floor(100 * (F.size(x) - F.size(F.array_distinct(x))) / F.size(x))
    return _let(_lines(text), lambda x: F.when(F.size(x) > 0, share(x)).otherwise(F.lit(0)).cast("long"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))


def _repeat_words(text: Column, words: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more in the text.

    Windows are compared by the 64-bit hash of their words' 64-bit hashes,
    within one text only.  Sorting (hash, position) puts equal windows next
    to each other; the covered words are the union of the repeated windows,
    summed over their sorted positions.  Linear in memory, n log n in time.
    """
    none = F.lit(0).cast("long")

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
        return F.transform(starts, lambda i: F.xxhash64(*[F.element_at(hashes, (i + k).cast("int")) for k in range(WINDOW)]))

    def repeated(order: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(order, k)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(order, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))

    def covered(at: Column) -> Column:
        length = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(length, none, lambda total, x: total + x)

    def count(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_let(order, lambda o: _let(repeated(o), covered)))

    return F.when(F.size(words) <= WINDOW, none).otherwise(
        _let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: _let(windows(hashes), count)))


#: Metrics as expressions of a text and its words.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: _count_of(text, SPACES),
    "n_symbols": lambda text, words: _count_of(text, f"[^{SYMBOLS}]+"),
    "n_upper": lambda text, words: _count_of(text, r"\P{Lu}+"),
    "n_dup_lines": _dup_lines,
    "dup_line_pct": _dup_line_pct,
    "n_repeat_words": _repeat_words,
}


def _words(text: Column) -> Column:
    """Words of a text that is not null."""
    trimmed = F.regexp_replace(text, r"^[ \t-\r]+|[ \t-\r]+$", "")
    return _let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES)))


def text_metrics(df: DataFrame, text_col: str = "text", metrics: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """``df`` with a long column per metric, computed over every whole text (null: empty, all metrics 0).

    A column of ``df`` with the name of a metric is replaced.
    """
    columns = [c for c in df.columns if c.lower() not in {m.lower() for m in metrics}]
    text, words = fresh(df, "text", "words")
    df = df.withColumn(text, text_or_empty(text_col)).withColumn(words, _words(F.col(text)))
    return df.select(*columns, *[METRICS[m](F.col(text), F.col(words)).alias(m) for m in metrics])


def _judge(text: Column, rules: list[Rule]) -> Column:
    """The first of ``rules`` that rejects the text.  CASE evaluates a metric only if no earlier rule has rejected."""
    def verdict(t: Column, words: Column) -> Column:
        case = F
        for r in rules:
            case = case.when(r.rejects(METRICS[r.metric](t, words), F.size(words)), F.lit(r.name))
        return case

    return _let(text, lambda t: _let(_words(t), lambda words: verdict(t, words)))


def rule_order(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by estimated rejection per cost, highest first; on an empty table, as given."""
    text, words = F.col("t"), F.col("w")
    frame = df.select(text_or_empty(text_col).alias("t")).limit(sample_rows).withColumn("w", _words(text)).persist()
    try:
        def seconds(of: DataFrame, what: Column) -> tuple[float, int, int]:
            began = time.perf_counter()
            row = of.agg(F.count(F.lit(1)).alias("n"), F.count_if(what).alias("hit")).first()
            return time.perf_counter() - began, row["n"], row["hit"]

        frame.count()
        base, n, _ = seconds(frame, F.length(text) < 0)
        if not n:
            return list(rules)
        gain = []
        for k, rule in enumerate(rules):
            cost, _, hit = seconds(frame, rule.rejects(METRICS[rule.metric](text, words), F.size(words)))
            gain.append((-(hit / n) / max(cost - base, 1e-3), k, rule))
        return [rule for *_, rule in sorted(gain, key=lambda x: x[:2])]
    finally:
        frame.unpersist()


def quality_cascade(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, *,
                    measured: bool = False, failed_col: str = "failed_rule") -> DataFrame:
    """``df`` with ``failed_col``: the first rule in cascade order that rejects the document, null if none does.

    With ``measured``, the metrics already are columns of ``df`` under their
    own names (from ``text_metrics``) and are read, not computed again.
    Null and empty texts have no words and fail ``few_words``.  Rows are
    judged one by one, so ties, repeated rows and skewed sources change
    nothing; an empty table gives an empty result.
    """
    order = rule_order(df, text_col, rules)
    columns = [c for c in df.columns if c.lower() != failed_col.lower()]
    if measured:
        verdict = F.coalesce(*[F.when(r.rejects(F.col(r.metric), F.col("n_words")), F.lit(r.name)) for r in order])
    else:
        verdict = _judge(text_or_empty(text_col), order)
    return df.select(*columns, verdict.alias(failed_col))


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that pass every rule; all columns stay."""
    (failed,) = fresh(df, "failed_rule")
    return quality_cascade(df, text_col, failed_col=failed).where(F.col(failed).isNull()).select(*df.columns)
