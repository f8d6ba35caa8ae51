"""Numbered sources, prompts, generation hook."""

from tessera.operators import answer as ans

HITS = "query_id bigint, rank int, title string, url string, chunk_text string"


def test_format_and_prompt(spark):
    hits = spark.createDataFrame([(1, 2, None, "https://b", "second"), (1, 1, "T", "https://a", "first")], HITS)
    blocks = {r.rank: r.block for r in ans.format_sources(hits).collect()}
    assert blocks[1] == "[Source 1 (T - https://a)]:\nfirst"
    assert blocks[2] == "[Source 2 (Unknown - https://b)]:\nsecond"
    q = spark.createDataFrame([(1, "why?"), (2, "nothing?")], "query_id bigint, question string")
    p = {r.query_id: r for r in ans.build_prompts(q, hits).collect()}
    assert p[1].n_sources == 2 and p[1].context == blocks[1] + "\n\n" + blocks[2] and "why?" in p[1].prompt
    assert p[2].n_sources == 0 and p[2].prompt is None


def test_no_hits_and_errors(spark):
    class Boom:  # local class: shipped to the Python workers by value
        def generate(self, *a):
            raise RuntimeError("model offline")

    hits = spark.createDataFrame([(1, 1, "T", "https://a", "x")], HITS)
    q = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id bigint, question string")
    got = {r.query_id: r.answer for r in ans.generate_answers(ans.build_prompts(q, hits), hits, Boom).collect()}
    assert got[2] == ans.NO_HITS_ANSWER
    assert got[1] == "Error generating response: model offline"
