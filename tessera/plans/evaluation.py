"""Evaluation jobs over the ``documents`` corpus and ``benchmark`` passages.

Questions are the benchmark passages; a question's truth is the set of
documents whose text contains the passage (empty for some passages, which
exercises the empty-truth rules).  Document ``d`` is published at
``https://<source>.docs.example/doc/<doc_id>``; like the reference's
evaluation index, title = url, folder = 'eval', no date.

``compare_chunking`` builds one isolated index per strategy in a single job:
the strategy is a key of the chunk rows, of the query rows (the query set is
repeated once per strategy) and of every metric grouping, and a query only
scores chunks of its own strategy (an equality filter inside the scorer).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalize_ws
from tessera.functions.url import url_domain
from tessera.operators.chunk import DEFAULT_STRATEGIES, chunk_documents, chunk_id
from tessera.operators.embed import DEFAULT_DIM, hash_embedding
from tessera.operators.evaluate import metric_means, question_metrics
from tessera.operators.match import contains_passages
from tessera.operators.retrieve import DEFAULT_K, FilterSpec, topk_batch
from tessera.sources.tables import read_table

EVAL_FOLDER = "eval"


def doc_url(source: Column, doc_id: Column) -> Column:
    return F.concat(F.lit("https://"), source, F.lit(".docs.example/doc/"), doc_id.cast("string"))


def eval_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, url, text (all documents)."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", doc_url(F.col("source"), F.col("doc_id")).alias("url"), "text")


def passage_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read_table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").cast("bigint").alias("query_id"),
                    F.col("text").alias("question"))


def passage_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, url): documents containing the passage verbatim; written once, so its readers share it."""
    docs = eval_documents(spark, sf_dir)
    q = passage_questions(spark, sf_dir)
    return contains_passages(docs, "url", "text", q, "query_id", "question").select("query_id", "url").checkpoint()


def eval_links(docs: DataFrame) -> DataFrame:
    return docs.select("url", F.col("url").alias("title"), F.lit(EVAL_FOLDER).alias("folder"),
                       url_domain(F.col("url")).alias("domain"),
                       F.lit(None).cast("timestamp").alias("date_added"))


def strategy_index(docs: DataFrame, strategies: Sequence[tuple[str, int, int]],
                   dim: int = DEFAULT_DIM) -> DataFrame:
    """Chunks of every strategy with ids and hash embeddings."""
    ch = chunk_documents(docs, ["doc_id", "url"], "text", strategies=strategies, hash_dim=dim)
    return ch.withColumn("chunk_id", chunk_id(F.col("strategy"), F.col("url"), F.col("chunk_index")))


def strategy_hits(index: DataFrame, questions: DataFrame,
                  strategies: Sequence[tuple[str, int, int]], k: int,
                  dim: int = DEFAULT_DIM, carry: tuple[str, ...] = ()) -> DataFrame:
    """Top-k per (strategy, question) against that strategy's chunks only."""
    n = len(strategies)
    names = F.array(*[F.lit(s[0]) for s in strategies])
    q = (questions.where(normalize_ws(F.col("question")) != "")
         .withColumn("embedding", hash_embedding(F.col("question"), dim))
         .select("query_id", "embedding", F.posexplode(names).alias("s_idx", "strategy"))
         .withColumn("item_id", F.col("query_id"))
         .withColumn("query_id", F.col("query_id") * n + F.col("s_idx")))
    hits = topk_batch(index, q, k, key_cols=["chunk_id"], carry=["url", "strategy", *carry],
                      filters=FilterSpec(equal=[("strategy", "strategy")]))
    return hits.withColumn("query_id", F.expr(f"query_id div {n}"))  # exact integer division


def compare_chunking(spark: SparkSession, sf_dir: str,
                     strategies: Sequence[tuple[str, int, int]] = DEFAULT_STRATEGIES,
                     k: int = DEFAULT_K, dim: int = DEFAULT_DIM,
                     index: DataFrame | None = None) -> DataFrame:
    """Per strategy: chunk_size, overlap, total_chunks and mean metrics."""
    docs = eval_documents(spark, sf_dir)
    if index is None:
        # built once, written to the checkpoint folder, read by search and
        # sizes; only the columns the evaluation reads are written
        index = strategy_index(docs, strategies, dim).select(
            "chunk_id", "url", "strategy", "embedding").checkpoint()
    questions = passage_questions(spark, sf_dir)
    truth = passage_truth(spark, sf_dir)
    hits = strategy_hits(index, questions, strategies, k, dim)
    strat = spark.createDataFrame(list(strategies), "strategy string, chunk_size int, overlap int")
    names = F.array(*[F.lit(s[0]) for s in strategies])
    qs = questions.withColumn("strategy", F.explode(names))
    truth_s = truth.withColumn("strategy", F.explode(names))
    per_q = question_metrics(hits, truth_s, qs, k, group=["strategy"])
    means = metric_means(per_q, ["strategy"])
    sizes = index.groupBy("strategy").agg(F.count(F.lit(1)).alias("total_chunks"))
    return (strat.join(sizes, "strategy", "left").join(means, "strategy", "left")
            .select("strategy", "chunk_size", "overlap",
                    F.coalesce("total_chunks", F.lit(0)).cast("bigint").alias("total_chunks"),
                    *[F.round(F.coalesce(F.col(f"mean_{m}"), F.lit(0.0)), 6).alias(f"mean_{m}")
                      for m in ("precision_at_k", "recall", "recall_distinct", "mrr")]))


# --- single-strategy evaluation details and the labelled question set --------

DEFAULT_ONLY = (("default", 400, 50),)


def default_hits(spark: SparkSession, sf_dir: str, k: int = DEFAULT_K, dim: int = DEFAULT_DIM,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    docs = eval_documents(spark, sf_dir)
    # written once: the search reads it several times
    index = strategy_index(docs, DEFAULT_ONLY, dim).select("chunk_id", "url", "strategy", *carry, "embedding").checkpoint()
    return strategy_hits(index, passage_questions(spark, sf_dir), DEFAULT_ONLY, k, dim, carry)


def question_difficulty(spark: SparkSession, sf_dir: str, truth: DataFrame | None = None) -> DataFrame:
    """query_id, n_truth, difficulty: 'hard' when no document holds the
    passage, 'medium' for one, else 'easy'.  Counted with an aggregate (no
    per-question url list is built)."""
    q = passage_questions(spark, sf_dir).select("query_id")
    truth = passage_truth(spark, sf_dir) if truth is None else truth
    n = truth.groupBy("query_id").agg(F.count_distinct("url").alias("n_truth"))
    d = q.join(n, "query_id", "left").withColumn("n_truth", F.coalesce("n_truth", F.lit(0)))
    return d.withColumn("difficulty", F.when(F.col("n_truth") == 0, "hard")
                        .when(F.col("n_truth") == 1, "medium").otherwise("easy"))


def qa_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled question set: question, expected_answer_keywords,
    ground_truth_urls (sorted), difficulty -- derived from the passages (see
    ``question_difficulty``); keywords are the passage's distinct words of six
    letters or more."""
    from tessera.functions.text import word_tokens
    q = passage_questions(spark, sf_dir)
    pairs = passage_truth(spark, sf_dir)
    truth = pairs.groupBy("query_id").agg(F.array_sort(F.collect_set("url")).alias("ground_truth_urls"))
    kw = F.array_distinct(F.filter(word_tokens(F.col("question")), lambda w: F.length(w) >= 6))
    out = (q.join(truth, "query_id", "left").join(question_difficulty(spark, sf_dir, pairs), "query_id")
           .withColumn("ground_truth_urls", F.coalesce("ground_truth_urls", F.array().cast("array<string>"))))
    return out.select("query_id", "question", kw.alias("expected_answer_keywords"), "ground_truth_urls",
                      "difficulty")


def check_qa_set(qa: DataFrame) -> DataFrame:
    """One row of violation counts (all zero = the set is usable)."""
    url_ok = lambda u: u.rlike(r"(?i)^https?://[^/?#]+")
    blank = lambda c: F.col(c).isNull() | (normalize_ws(F.col(c)) == "")
    return qa.agg(
        F.count(F.lit(1)).alias("n_questions"),
        (F.count(F.lit(1)) < 15).alias("too_few_questions"),
        F.count_if(blank("question") | F.col("expected_answer_keywords").isNull()
                   | F.col("ground_truth_urls").isNull() | F.col("difficulty").isNull()).alias("missing_fields"),
        F.count_if(~F.col("difficulty").isin("easy", "medium", "hard")).alias("bad_difficulty"),
        F.count_if(F.size("ground_truth_urls") == 0).alias("no_truth_url"),
        F.count_if(~F.forall("ground_truth_urls", url_ok)).alias("bad_truth_url"),
        (F.count_if(F.col("difficulty") == "hard") < 3).alias("too_few_hard"),
        (F.count(F.lit(1)) - F.count_distinct(F.lower(normalize_ws(F.col("question"))))).alias("duplicate_questions"))


def eval_details(spark: SparkSession, sf_dir: str, k: int = DEFAULT_K) -> DataFrame:
    """Per question: the answer (generation hook, deterministic stand-in),
    truth urls, retrieved urls in rank order, metrics."""
    from tessera.operators import answer as ans
    from tessera.operators.evaluate import question_metrics
    hits = default_hits(spark, sf_dir, k, carry=("chunk_text",)).checkpoint().withColumn("title", F.col("url"))
    truth = passage_truth(spark, sf_dir)
    q = passage_questions(spark, sf_dir)
    m = question_metrics(hits, truth, q, k)
    answers = ans.generate_answers(ans.build_prompts(q, hits), hits)
    ret = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "url"))).alias("_r"))
    tru = truth.groupBy("query_id").agg(F.array_sort(F.collect_set("url")).alias("_t"))
    return (m.join(ret, "query_id", "left").join(tru, "query_id", "left").join(answers, "query_id", "left")
            .select("query_id", "answer",
                    F.coalesce(F.array_join("_t", ","), F.lit("")).alias("truth_urls"),
                    F.coalesce(F.array_join(F.transform("_r", lambda x: x["url"]), ","), F.lit("")).alias("retrieved_urls"),
                    *[F.round(F.col(c), 6).alias(c) for c in ("precision_at_k", "recall", "recall_distinct", "mrr")]))
