"""Which documents contain which passages (ground truth for passage questions).

A theta join ``instr(doc, passage) > 0`` would test every (document, passage)
pair.  Instead both sides meet on a key that containment implies: the words
strictly inside a passage stand whole and in a row in every text that
contains it.  A passage of five words or more is keyed by its second to fourth
word (and a document by all its three-word runs), one of three or four words
by its second word.  Shorter passages have no whole word inside: a few of them
are tested directly, more are keyed by their first characters (and documents
by all their character runs of that length).  The passages are classed by one
count, and only the branches that have passages are planned, so the documents
are usually read twice: for the keys, and for the substring test that decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_WORDS = 3
SHORT_CHARS = 4
#: So many passages without a whole word inside are tested against every document.
DIRECT = 64
_SPACES = r"[ \t-\r]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def _grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters of a text that is that long."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: text.substr(i, F.lit(n)))


def _candidates(docs: DataFrame, passages: DataFrame, keys_of_doc: Column) -> DataFrame:
    """(_d, _p) pairs that share a key; the passage side is broadcast by Spark when it measures small."""
    keyed = docs.select("_d", F.explode(F.array_distinct(keys_of_doc)).alias("_key"))
    return keyed.join(passages.select("_p", "_key"), "_key").select("_d", "_p")


def contains_passages(docs: DataFrame, doc_key: str, doc_text: str,
                      passages: DataFrame, passage_key: str, passage_text: str) -> DataFrame:
    """(doc_key, passage_key) for every document text containing a passage, each pair once.

    Keys are not null; documents with the same key count as one if any contains the passage.  Null and empty
    texts contain nothing, empty passages are in no document."""
    d = docs.select(F.col(doc_key).alias("_d"), F.col(doc_text).alias("_text"))
    p = passages.select(F.col(passage_key).alias("_p"), F.col(passage_text).alias("_passage")).where(F.length("_passage") > 0)
    n_words = F.size(_words(F.col("_passage")))
    classed = p.withColumn("_class", F.when(n_words >= RUN_WORDS + 2, "run").when(n_words >= 3, "word").otherwise("short"))
    counts = {r["_class"]: r["count"] for r in classed.groupBy("_class").count().collect()}
    of = lambda name: classed.where(F.col("_class") == name).withColumn("_w", _words(F.col("_passage")))
    run = lambda w, i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(RUN_WORDS)])
    found = []
    if "run" in counts:
        tokens = d.select("_d", _words(F.col("_text")).alias("_w")).where(F.size("_w") >= RUN_WORDS)
        runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (RUN_WORDS - 1)), lambda i: run(F.col("_w"), i))
        found.append(_candidates(tokens, of("run").withColumn("_key", run(F.col("_w"), F.lit(2))), runs))
    if "word" in counts:
        found.append(_candidates(d, of("word").withColumn("_key", F.element_at("_w", 2)), _words(F.col("_text"))))
    if 0 < counts.get("short", 0) <= DIRECT:
        short = [(r["_p"], r["_passage"]) for r in of("short").collect()]
        hits = F.filter(F.array(*[F.struct(F.lit(key).alias("p"), F.contains("_text", F.lit(text)).alias("in")) for key, text in short]), lambda x: x["in"])
        found.append(d.where(F.col("_text").isNotNull()).select("_d", F.explode(hits).alias("x")).select("_d", F.col("x.p").cast(p.schema["_p"].dataType).alias("_p")))
    elif "short" in counts:
        for n in range(1, SHORT_CHARS + 1):
            exact = F.length("_passage") >= n if n == SHORT_CHARS else F.length("_passage") == n
            found.append(_candidates(d.where(F.length("_text") >= n), of("short").where(exact).withColumn("_key", F.substring("_passage", 1, n)),
                                     _grams(F.col("_text"), n)))
    if not found:
        none = p.select(F.col("_p").alias(passage_key)).limit(0)
        return d.select(F.col("_d").alias(doc_key)).limit(0).join(none, F.lit(False))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    sure = pairs.distinct().join(p, "_p").join(d, "_d").where(F.contains("_text", "_passage"))
    return sure.select(F.col("_d").alias(doc_key), F.col("_p").alias(passage_key)).distinct()
