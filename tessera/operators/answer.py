"""Augmentation and answers: numbered sources, prompts, generation hook.

All of it is per question over at most k hit rows, so ``collect_list`` per
question is bounded by k (never by the data).  Generation is a pluggable
``mapInPandas`` batch job over the prompt table: the generator is built once
per Python worker and any failure becomes the answer text
``"Error generating response: ..."`` instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The answer when nothing was retrieved, and our prompt layout.
NO_HITS_ANSWER = "I couldn't find any relevant bookmarks to answer your question."
SYSTEM_PROMPT = ("Answer the question from the numbered sources only. If the sources do not "
                 "hold the answer, say you do not know. Cite sources as [Source N].")
PROMPT_TEMPLATE = "### System\n{system}\n\n### Sources\n{context}\n\n### Question\n{question}\n\n### Answer\n"


def source_block(rank: Column, title: Column, url: Column, text: Column) -> Column:
    """``[Source i (title - url)]:\\ntext``; a missing title reads 'Unknown'."""
    return F.format_string("[Source %d (%s - %s)]:\n%s", rank, F.coalesce(title, F.lit("Unknown")),
                           F.coalesce(url, F.lit("")), text)


def format_sources(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, title, url, chunk_text) + ``block``."""
    return hits.withColumn("block", source_block(F.col("rank"), F.col("title"), F.col("url"),
                                                 F.col("chunk_text")))


def build_prompts(questions: DataFrame, hits: DataFrame, system: str = SYSTEM_PROMPT,
                  template: str = PROMPT_TEMPLATE) -> DataFrame:
    """One row per question: question_id, question, n_sources, context, prompt
    (prompt is null when there is nothing to ground the answer on)."""
    blocks = (format_sources(hits).groupBy("query_id")
              .agg(F.sort_array(F.collect_list(F.struct("rank", "block"))).alias("_b")))
    ctx = F.array_join(F.transform("_b", lambda x: x["block"]), "\n\n")
    head, rest = template.split("{system}")
    mid, rest = rest.split("{context}")
    mid2, tail = rest.split("{question}")
    prompt = F.concat(F.lit(head), F.lit(system), F.lit(mid), F.col("context"), F.lit(mid2),
                      F.col("question"), F.lit(tail))
    return (questions.join(blocks, "query_id", "left")
            .withColumn("n_sources", F.coalesce(F.size("_b"), F.lit(0)))
            .withColumn("context", F.when(F.col("n_sources") > 0, ctx))
            .withColumn("prompt", F.when(F.col("n_sources") > 0, prompt))
            .drop("_b"))


class TitleListGenerator:
    """Deterministic stand-in generator: names its sources."""

    def generate(self, system: str, question: str, titles: list[str], blocks: list[str]) -> str:
        return f"{len(titles)} sources: " + "; ".join(titles)


ANSWER_SCHEMA = T.StructType([T.StructField("query_id", T.LongType()),
                              T.StructField("answer", T.StringType())])


def generate_answers(prompts: DataFrame, hits: DataFrame,
                     factory: Callable[[], object] = TitleListGenerator,
                     system: str = SYSTEM_PROMPT) -> DataFrame:
    """query_id, answer.  No sources -> the fixed no-hits answer, generator
    not called.  Hits are gathered per question (bounded by k) first."""
    per_q = (hits.groupBy("query_id").agg(F.sort_array(F.collect_list(
        F.struct("rank", F.coalesce("title", F.lit("Unknown")).alias("title"),
                 source_block(F.col("rank"), F.col("title"), F.col("url"), F.col("chunk_text")).alias("block")))
    ).alias("src")))
    work = prompts.select("query_id", "question").join(per_q, "query_id", "left")
    state: dict = {}

    def run(batches):
        gen = state.get("gen")
        if gen is None:
            gen = state["gen"] = factory()
        for pdf in batches:
            out = []
            for qid, question, src in zip(pdf["query_id"], pdf["question"], pdf["src"]):
                if src is None or len(src) == 0:
                    out.append(NO_HITS_ANSWER)
                    continue
                titles = [s["title"] for s in src]
                blocks = [s["block"] for s in src]
                try:
                    out.append(gen.generate(system, question, titles, blocks))
                except Exception as e:  # noqa: BLE001 -- a failed answer is data
                    out.append(f"Error generating response: {e}")
            yield pd.DataFrame({"query_id": pdf["query_id"], "answer": out})

    return work.mapInPandas(run, ANSWER_SCHEMA)


def answers_with_sources(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per question: answer + ordered sources array."""
    src = (hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.col("chunk_text").alias("text"), "score", "url", "title", "folder",
        "date_added", "domain"))).alias("sources")))
    return (answers.join(src, "query_id", "left")
            .withColumn("sources", F.coalesce("sources", F.array().cast(src.schema["sources"].dataType))))
