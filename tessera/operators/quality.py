"""Answer quality: faithfulness and answer relevance from a pluggable judge.

The judge runs as a ``mapInPandas`` batch job, built once per Python worker.
Scores are sanitised the same way whatever the judge: NaN -> 0, an exception
-> 0 for that question (the job never fails on one bad answer).  A warning is
logged when the judge is the same model as the generator.

Means follow one of two policies: ``count_missing`` (a question without an
answer or contexts counts 0) or ``skip_missing`` (such questions are left out;
no scored question at all -> 0).
"""

from __future__ import annotations

import logging
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)
_WORD = re.compile(r"[^\W_]+")

SCORES = T.StructType([T.StructField("query_id", T.LongType()),
                       T.StructField("faithfulness", T.DoubleType()),
                       T.StructField("answer_relevance", T.DoubleType())])


class OverlapJudge:
    """Deterministic offline judge: word overlap.

    faithfulness = share of the answer's words found in the contexts;
    answer_relevance = share of the question's words found in the answer.
    """

    name = "overlap"

    @staticmethod
    def _words(text: str) -> set[str]:
        return set(_WORD.findall((text or "").lower()))

    def faithfulness(self, question: str, answer: str, contexts: list[str]) -> float:
        a = self._words(answer)
        ctx = self._words(" ".join(contexts))
        return len(a & ctx) / len(a) if a else float("nan")

    def answer_relevance(self, question: str, answer: str, contexts: list[str]) -> float:
        q = self._words(question)
        return len(q & self._words(answer)) / len(q) if q else float("nan")


def _clean(x) -> float:
    try:
        x = float(x)
    except (TypeError, ValueError):
        return 0.0
    return 0.0 if math.isnan(x) else x


def judge_answers(items: DataFrame, factory: Callable[[], object] = OverlapJudge,
                  generator_name: str | None = None) -> DataFrame:
    """items: query_id, question, answer, contexts (array<string>) -> scores.
    Rows without an answer or without contexts are not judged (null scores)."""
    state: dict = {}

    def run(batches):
        judge = state.get("judge")
        if judge is None:
            judge = state["judge"] = factory()
            if generator_name and getattr(judge, "name", None) == generator_name:
                log.warning("judge and generator are the same model (%s)", generator_name)
        for pdf in batches:
            f, r = [], []
            for q, a, c in zip(pdf["question"], pdf["answer"], pdf["contexts"]):
                ctx = list(c) if c is not None else []
                if not a or not ctx:
                    f.append(None)
                    r.append(None)
                    continue
                try:
                    f.append(_clean(judge.faithfulness(q, a, ctx)))
                except Exception:  # noqa: BLE001
                    f.append(0.0)
                try:
                    r.append(_clean(judge.answer_relevance(q, a, ctx)))
                except Exception:  # noqa: BLE001
                    r.append(0.0)
            yield pd.DataFrame({"query_id": pdf["query_id"], "faithfulness": f, "answer_relevance": r})

    return items.select("query_id", "question", "answer", "contexts").mapInPandas(run, SCORES)


def quality_means(scores: DataFrame, policy: str = "count_missing") -> DataFrame:
    cols = ("faithfulness", "answer_relevance")
    if policy == "count_missing":
        aggs = [F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(f"mean_{c}") for c in cols]
    elif policy == "skip_missing":
        aggs = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in cols]
    else:
        raise ValueError(policy)
    return scores.agg(*aggs).withColumn("policy", F.lit(policy))
