"""Corpus pipeline: quality rules, exact dedup, near-dedup, mixing, tokens.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read back as the
next stage's ``docs``.  All stages but the last return the columns of
``documents``; the last returns each row of the mix with its token ids.
Further columns of a table stay up to the last stage, whatever their names;
the last returns its own columns alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_round_trip
from tessera.llm.catalog import MAX_BITS, SHINGLE_WORDS, tokenizer_file
from tessera.llm.common import documents, prepare, written
from tessera.llm.exact_dedup import keep_one_of_equal
from tessera.llm.mixing import take_mix
from tessera.llm.quality_rules import keep_good
from tessera.llm.simhash import keep_one_of_near


#: Words that a worker of the tokens stage remembers: fewer than by default, as the stages before have filled the executors' heaps.
MEMO_WORDS = 1 << 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule.

    Null and empty texts have no words and go.  Rows are judged one by one:
    ties and repeated rows share their verdict; an empty table stays empty.
    """
    prepare(spark)
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (ASCII white space apart).

    The longest original stays, then the smallest id.  Null counts as an empty
    text; of rows repeated with the same id and text, one stays.  An empty
    table stays empty.
    """
    prepare(spark)
    return keep_one_of_equal(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by SimHash.

    The smallest id stays, null last.  Texts without words, null included,
    share the fingerprint zero; of rows alike in id and fingerprint, one stays.
    An empty table stays empty.
    """
    prepare(spark)
    return keep_one_of_near(docs, shingle_words=SHINGLE_WORDS, max_bits=MAX_BITS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: repeated rows are copies, rows with no copy go.

    Null is a source of its own, ranked last; texts without words, null
    included, get the repeats of their source.  Rows of one id rank as ties,
    each on its own.  An empty table stays empty.
    """
    prepare(spark)
    return take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of the ids and of the text decoded from them.

    Null and empty texts have no ids and decode to the empty text.  Rows are
    coded one by one, however long and however often repeated; an empty table
    stays empty.
    """
    prepare(spark)
    coded = bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), tokenizer_file(), memo_words=MEMO_WORDS)
    return coded.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: Mixing selects by a seeded hash and a dynamic program, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read back."""
    docs = documents(prepare(spark), sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
