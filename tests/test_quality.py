"""Judge sanitising, mean policies and the QA-set checks."""

import math

from tessera.operators.quality import judge_answers, quality_means
from tessera.plans.evaluation import check_qa_set

ITEMS = "query_id bigint, question string, answer string, contexts array<string>"


def test_judge_sanitises_nan_and_errors(spark):
    class Flaky:  # local class: shipped to the Python workers by value
        name = "flaky"

        def faithfulness(self, q, a, c):
            return float("nan")

        def answer_relevance(self, q, a, c):
            raise ValueError("judge down")

    items = spark.createDataFrame([(1, "q", "a", ["ctx"]), (2, "q", "", ["ctx"]), (3, "q", "a", [])], ITEMS)
    got = {r.query_id: r for r in judge_answers(items, Flaky).collect()}
    assert (got[1].faithfulness, got[1].answer_relevance) == (0.0, 0.0)
    assert got[2].faithfulness is None and got[3].answer_relevance is None     # not judged


def test_mean_policies(spark):
    scores = spark.createDataFrame([(1, 1.0, 0.5), (2, None, None)],
                                   "query_id bigint, faithfulness double, answer_relevance double")
    count = quality_means(scores, "count_missing").first()
    skip = quality_means(scores, "skip_missing").first()
    assert math.isclose(count.mean_faithfulness, 0.5) and math.isclose(skip.mean_faithfulness, 1.0)
    empty = spark.createDataFrame([], "query_id bigint, faithfulness double, answer_relevance double")
    assert quality_means(empty, "skip_missing").first().mean_faithfulness == 0.0


def test_qa_set_checks(spark):
    qa = spark.createDataFrame([
        ("What is X?", ["x"], ["https://a.example/"], "easy"),
        ("what is x? ", ["x"], ["ftp://b"], "hard"),
        ("", ["y"], [], "impossible"),
    ], "question string, expected_answer_keywords array<string>, ground_truth_urls array<string>, difficulty string")
    r = check_qa_set(qa).first()
    assert r.n_questions == 3 and r.too_few_questions and r.too_few_hard
    assert (r.missing_fields, r.bad_difficulty, r.no_truth_url, r.bad_truth_url, r.duplicate_questions) == (1, 1, 1, 1, 1)
