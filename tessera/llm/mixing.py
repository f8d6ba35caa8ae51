"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length in words, per source.  A source's
target is met by whole repeats of all its documents plus a remaining budget;
the remaining budget is fitted over the counts by length: a proportional
share of every length, with the rounding carried from long to short, leaves
a small rest that a bounded-knapsack dynamic program meets exactly where some
subset of the left-over counts does.  Which documents fill a length's count
is decided by a seeded hash of their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, text_or_empty, written

WEIGHTS = (5.0, 2.0, 1.0)   # by the rank of the source, repeating
MAX_REPEATS = 3
#: Documents of one source and length are ranked within so many hash ranges, so that no group of theirs meets in one task.
SPREAD = 64
#: Words kept back for the dynamic program: twice the longest document, this many at most (bounds its table).
HOLD_WORDS = 1 << 20


def word_count(text_col: str = "text") -> Column:
    """Number of words, runs of anything but ASCII white space (null: 0)."""
    return F.regexp_count(text_or_empty(text_col), F.lit(r"[^ \t-\r]+")).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (src, source, source_size) with ``target``.

    Sources ranked by code point, null last, share the sum of all sizes by
    weight; a target stops at ``max_repeats`` times its source's size, and
    the excess goes to the others by weight until none is above.
    """
    spark = sources.sparkSession
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = written(sources.withColumn("weight", F.element_at(table, (rank % len(weights) + 1).cast("int")))
                     .withColumn("cap", F.col("source_size").cast("double") * max_repeats), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0  # words for each unit of weight; grows until no source is above its cap
    while True:
        capped = F.col("weight") * share > F.col("cap")
        row = ranked.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("at_cap"),
                         F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            break
        new = (total - row["at_cap"]) / row["weight"]
        if new <= share:
            break
        share = new
    return ranked.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(float(share)))).drop("weight", "cap")


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size (distinct, positive) sum to ``budget`` words, or as near below as the counts allow."""
    take = np.zeros(len(sizes), dtype=np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    order = np.argsort(-sizes, kind="stable")
    rough = max(0, budget - min(2 * int(sizes.max()), HOLD_WORDS))
    carry = 0  # in words times total
    for i in order:  # proportional share of each size, rounding carried on
        size, count = int(sizes[i]), int(counts[i])
        carry += size * count * rough
        take[i] = min(count, carry // (size * total))
        carry -= int(take[i]) * size * total
    rest = budget - int((take * sizes).sum())
    return take + _knapsack(sizes[order], (counts - take)[order], rest)[np.argsort(order)]


def _knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack over sums up to ``budget``: bit s of ``reach`` says that s words can be taken.

    Counts are split into powers of two; ``by[s]`` is the item that first
    reached s, which gives the choice back.  Stops as soon as the budget is met.
    """
    items, reach, mask = [], 1, (1 << (budget + 1)) - 1
    by = np.full(budget + 1, -1, dtype=np.int32)
    for i, (size, left) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        step, left = 1, min(left, budget // size)
        while left > 0 and not reach >> budget & 1:
            n = min(step, left)
            new = (reach << n * size) & mask & ~reach
            if new:
                raw = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), dtype=np.uint8)
                for at in np.flatnonzero(raw) if budget > 1 << 16 else (slice(None),):
                    bits = np.flatnonzero(np.unpackbits(np.atleast_1d(raw[at]), bitorder="little"))
                    by[bits + (int(at) * 8 if not isinstance(at, slice) else 0)] = len(items)
                reach |= new
            items.append((i, n))
            left, step = left - n, step * 2
    take = np.zeros(len(sizes), dtype=np.int64)
    at = reach.bit_length() - 1
    while at > 0:
        i, n = items[by[at]]
        take[i] += n
        at -= n * int(sizes[i])
    return take


def _fit_source(max_repeats: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        """One source's counts by length (a row for each length): repeats of all documents and extra ones by length."""
        sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        source_size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        repeats, extra = 0, np.zeros(len(sizes), dtype=np.int64)
        if source_size:
            repeats = min(max_repeats, int((target + 0.5) // source_size))
            if repeats < max_repeats:
                some = sizes > 0
                extra[some] = fit_budget(sizes[some], counts[some], round(target) - repeats * source_size)
        return pd.DataFrame({"src": pdf["src"], "size": sizes, "repeats": repeats, "extra": extra})
    return fit


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
                size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
                seed: int = 42, names: tuple[str, str, str, str] = ("size", "source_size", "target", "copies")) -> DataFrame:
    """``df`` with four more columns: words, the source's words, its target, and how often the mix takes the row.

    ``size`` overrides the column that measures a row (words of the text).
    Null texts and texts without words have size 0; they add nothing to a
    target and get the repeats of their source.  Null is a source of its own,
    ranked last.  Rows with the same id rank as ties, each on its own.
    Reruns with the same seed agree.  An empty table gives an empty result.
    """
    columns = list(df.columns)
    c_src, c_size, c_hash, c_part, c_rank = fresh(df, "src", "size", "hash", "part", "rank")
    rows = (df.withColumn(c_src, F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")))
            .withColumn(c_size, word_count(text_col) if size is None else size.cast("long"))
            .withColumn(c_hash, F.xxhash64(F.lit(seed), F.col(id_col)))
            .withColumn(c_part, F.shiftrightunsigned(F.col(c_hash), 64 - (SPREAD - 1).bit_length()).cast("int")))
    # the order of signed hashes within a part is as good as any; parts are ranges of the unsigned hash
    cells = written(rows.groupBy(F.col(c_src).alias("src"), F.col(c_size).alias("size"), F.col(c_part).alias("part"))
                    .agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    lengths = cells.groupBy("src", "size").agg(F.sum("n").alias("n"))
    sources = (lengths.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
               .withColumn("source", F.when(F.col("src") != "", F.substring("src", 2, 2147483647))))
    targets = source_targets(sources, weights, max_repeats).drop("source")
    fits = (lengths.join(targets, "src").groupBy("src")
            .applyInPandas(_fit_source(max_repeats), "src string, size long, repeats long, extra long"))
    before = Window.partitionBy("src", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    plan = (cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
            .join(fits, ["src", "size"]).join(targets, "src"))
    plan = plan.select(*[F.col(c).alias(f"p_{c}") for c in ("src", "size", "part", "before", "repeats", "extra", "source_size", "target")])
    clash = [c for c in columns if c.lower().startswith("p_")]
    ranked = rows.withColumn(c_rank, F.row_number().over(Window.partitionBy(c_src, c_size, c_part).orderBy(c_hash, id_col)))
    if clash:  # a column of the table has a name of the plan: look the plan's columns up under other names
        new = dict(zip(plan.columns, fresh(df, *plan.columns), strict=True))
        plan = plan.select(*[F.col(a).alias(b) for a, b in new.items()])
    p = dict(zip(("src", "size", "part", "before", "repeats", "extra", "source_size", "target"), plan.columns, strict=True))
    joined = ranked.join(plan, (F.col(c_src) == F.col(p["src"])) & (F.col(c_size) == F.col(p["size"])) & (F.col(c_part) == F.col(p["part"])))
    copies = F.col(p["repeats"]) + F.when(F.col(p["before"]) + F.col(c_rank) <= F.col(p["extra"]), 1).otherwise(0)
    added = {names[0]: F.col(c_size), names[1]: F.col(p["source_size"]), names[2]: F.col(p["target"]), names[3]: copies.cast("long")}
    return joined.select(*[c for c in columns if c.lower() not in {n.lower() for n in names}], *[c.alias(n) for n, c in added.items()])


def take_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """The mix itself: every row as often as ``mix_sources`` takes it; the columns of ``df``."""
    names = fresh(df, "words", "source_words", "target_words", "copies")
    (again,) = fresh(df, "again")
    mixed = mix_sources(df, id_col, text_col, source_col, seed=seed, names=tuple(names)).where(F.col(names[3]) > 0)
    return mixed.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[3])))).select(*df.columns)
