"""Interaction of filters: what each removes, in every order in which they may be applied.

A document's outcome depends only on its mask, the set of filters that it
fails.  With the orders numbered by their Lehmer rank (lexicographic), a
document of mask m leaves at step s exactly for the orders that begin with
s-1 filters outside m and then one of m; all orders of one such beginning are
neighbours, an interval of (k-s)! ranks.  So the corpus is scanned once and
counted by mask; each count is added where its intervals begin and taken away
where they end, and one running sum over the ranks gives every order's
figures.  The cost after the scan depends on the number of masks and parts,
not on documents times orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_RE, fresh, text_or_empty, written

LETTERS = "ABCDE"


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, SPACE_RE), lambda w: w != "")


def text_failures(text: Column) -> Column:
    """Mask of the filters that look at one text (bit k: letter k fails): A few words, B few distinct words,
    C capitals, D symbols."""
    w = words(text)
    n, distinct = F.size(w).cast("long"), F.size(F.array_distinct(w))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def order_intervals(letters: str = LETTERS) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of the orders in which a document of ``mask`` leaves at ``step``.

    Neighbouring intervals are joined.  A few hundred rows for five filters, whatever the corpus."""
    k = len(letters)
    ranks = {}
    for rank, order in enumerate(permutations(range(k))):  # permutations come in lexicographic order
        for step in range(1, k + 1):
            ranks.setdefault(order[:step], rank)
    out = []
    for mask in range(1, 1 << k):
        for step in range(1, k + 1):
            begins = sorted(rank for head, rank in ranks.items() if len(head) == step
                            and mask >> head[-1] & 1 and not any(mask >> f & 1 for f in head[:-1]))
            width, ends = factorial(k - step), []
            for rank in begins:
                if ends and ends[-1][1] == rank:
                    ends[-1][1] = rank + width
                else:
                    ends.append([rank, rank + width])
            out += [(mask, step, a, b) for a, b in ends]
    return out


def failure_masks(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Documents counted by (part, mask): columns part, mask, n, good, toxic.

    The texts are read once; what is shuffled is a digest, an id and a mask of
    each document.  Filter E (an equal text has a smaller id) compares SHA-256
    digests: the documents that do not fail it are those with the least id of
    their text, found by an equi-join on (text, id), so a text with very many
    copies is spread by their ids.  Null texts are empty, a null id is smaller
    and larger than none, so such rows never fail E and make no other row fail
    it.  Of several label rows of one id, any counts.
    """
    text = text_or_empty(text_col)
    narrow = written(docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("_text"), text_failures(text).alias("mask")), "audit")
    least = narrow.where(F.col("_id").isNotNull()).groupBy("_text").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(1))
    label, = fresh(labels.select(id_col), "label")
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias(f"{label}_good"), F.max((F.col("toxic") == 1).cast("int")).alias(f"{label}_toxic"))
    last = (F.col("_first").isNull() & F.col("_id").isNotNull()).cast("int") * (1 << 4)
    judged = narrow.join(least, ["_text", "_id"], "left").join(marks, "_id", "left")
    counted = (judged.select("part", (F.col("mask") + last).alias("mask"), F.coalesce(f"{label}_good", F.lit(0)).alias("good"),
                          F.coalesce(f"{label}_toxic", F.lit(0)).alias("toxic"))
            .groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")))
    return written(counted, "masks")  # 32 rows a part at most; read several times


def audit_orders(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``masks``: part, mask, n, good, toxic.  A part has at most 2^k masks and
    its result k * k! rows, so all windows are bounded; parts are spread by
    one shuffle of the masks' counts.  A table without rows gives none.
    """
    k, spark = len(letters), masks.sparkSession
    orders = ["".join(p) for p in permutations(letters)]
    masks = masks.repartition("part").withColumnRenamed("mask", "m")
    measures = ("removed", "good_lost", "toxic_lost")
    table = spark.createDataFrame(order_intervals(letters), "m int, step int, first int, after int")
    met = masks.join(F.broadcast(table), "m")  # a fixed table
    edges = met.select("part", "step", F.explode(F.array(
        F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("after").alias("rank"), F.lit(-1).alias("sign")))).alias("e"),
        "n", "good", "toxic").select("part", "step", "e.rank", *[(F.col("e.sign") * F.col(c)).alias(m) for c, m in zip(("n", "good", "toxic"), measures, strict=True)])
    fails = masks.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(F.col("m").bitwiseAND(1 << f) != 0, F.col("n")).otherwise(0)) for f in range(k)]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("m") == 1 << f, F.col("n")).otherwise(0)) for f in range(k)]).alias("alone"))
    ranks = F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank")
    cells = (fails.select("part", ranks).select("part", "rank", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
             .select("part", "step", "rank", *[F.lit(0).cast("long").alias(m) for m in measures]))
    changes = cells.unionByName(edges).groupBy("part", "step", "rank").agg(*[F.sum(m).alias(m) for m in measures])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = changes.select("part", "step", "rank", *[F.sum(m).over(along).alias(m) for m in measures]).where(F.col("rank") < len(orders))
    name = F.element_at(F.array(*[F.lit(o) for o in orders]), F.col("rank") + 1)
    letter = F.instr(F.lit(letters), F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    steps = totals.withColumn("filter_order", name).withColumn("_f", letter).join(fails, "part")
    by_filter, in_order = Window.partitionBy("part", "_f"), Window.partitionBy("part", "rank").orderBy("step").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(in_order)).alias("kept"), "removed",
        (F.element_at("fails", F.col("_f")) - F.col("removed")).alias("redundant"), F.element_at("alone", F.col("_f")).alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(by_filter).alias("shapley"))
