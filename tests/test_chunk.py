"""Sentence packing: the reference's example cases plus rule-level checks."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators.chunk import chunk_documents, explode_sentences, walk_chunks


def _chunks(spark, text, size, overlap):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = chunk_documents(df, ["doc_id"], "text", chunk_size=size, overlap=overlap).orderBy("chunk_index").collect()
    return rows


def test_short_text_is_one_chunk(spark):
    text = "A brief note. It fits in a single chunk."
    rows = _chunks(spark, text, 100, 10)
    assert len(rows) == 1 and rows[0].chunk_text == text and rows[0].chunk_index == 0
    assert (rows[0].start, rows[0].end) == (0, len(text))


def test_size_bound_holds(spark):
    text = " ".join(f"Here is line number {i}." for i in range(50))
    rows = _chunks(spark, text, 50, 0)
    assert len(rows) > 1
    assert all(len(r.chunk_text.split()) <= 50 for r in rows)


def test_overlap_shares_sentences(spark):
    text = "Part one. Part two. Part three. Part four. Part five."
    rows = _chunks(spark, text, 4, 2)
    assert len(rows) > 1
    assert set(rows[0].chunk_text.split()) & set(rows[1].chunk_text.split())


def test_long_sentence_not_split(spark):
    long = ("This sentence keeps going on and on with many many words so that it is longer "
            "than the whole chunk budget set for this particular test case here.")
    text = f"Short start. {long} Short end."
    rows = _chunks(spark, text, 20, 5)
    assert any(long in r.chunk_text for r in rows)


def test_blank_text_has_no_chunks(spark):
    assert _chunks(spark, "   ", 400, 50) == []
    assert _chunks(spark, "", 400, 50) == []


def test_overlap_zero_still_repeats_one_sentence():
    # two-word sentences, size 4: [0,2) then restart at 1 (one repeated sentence)
    a, b = walk_chunks(np.array([2, 2, 2, 2]), 4, 0)
    assert list(zip(a, b)) == [(0, 2), (1, 3), (2, 4)]


def test_no_overlap_when_chunk_shorter_than_overlap():
    a, b = walk_chunks(np.array([1, 1, 5, 1]), 2, 10)
    assert list(zip(a, b)) == [(0, 2), (2, 3), (3, 4)]


def _reference_walk(tokens, size, overlap):
    """Straight re-statement of the packing loop, for comparison."""
    out, i, n = [], 0, len(tokens)
    while i < n:
        cur, j = 0, i
        while j < n and (cur + tokens[j] <= size or j == i):
            cur += tokens[j]
            j += 1
        out.append((i, j))
        if j >= n:
            break
        nxt, acc = j, 0
        for kk in range(j - 1, i - 1, -1):
            acc += tokens[kk]
            if acc >= overlap:
                nxt = kk
                break
        i = nxt if nxt > i else i + 1
    return out


def test_walk_matches_loop_on_random_inputs():
    rng = np.random.default_rng(7)
    for _ in range(300):
        toks = rng.integers(1, 30, size=rng.integers(1, 60))
        size, overlap = int(rng.integers(1, 80)), int(rng.integers(0, 40))
        a, b = walk_chunks(toks, size, overlap)
        assert list(zip(a.tolist(), b.tolist())) == _reference_walk(toks.tolist(), size, overlap)


def test_smaller_size_gives_more_chunks(spark):
    text = " ".join(f"Word{i} a b c d e f." for i in range(200))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    counts = {r.strategy: r.n for r in chunk_documents(
        df, ["doc_id"], "text", strategies=[("s", 50, 5), ("m", 150, 20), ("l", 400, 50)]
    ).groupBy("strategy").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts["s"] > counts["m"] > counts["l"]


def test_sentence_offsets_point_into_text(spark):
    text = "One two.  Three\nfour!   Five six seven? End"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = explode_sentences(df, ["doc_id"]).orderBy("sent_index").collect()
    norm = "One two. Three four! Five six seven? End"
    assert [r.sentence for r in rows] == ["One two.", "Three four!", "Five six seven?", "End"]
    assert [r.n_tokens for r in rows] == [2, 2, 3, 1]
    assert all(norm[r.start:r.end] == r.sentence for r in rows)


def test_sentence_level_hashing_equals_chunk_hashing(spark):
    from tessera.operators.embed import hash_embedding
    from tessera.sources.tables import read_table
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    strategies = [("s", 150, 20), ("l", 800, 100)]
    fused = chunk_documents(docs, ["doc_id"], "text", strategies=strategies, hash_dim=64)
    plain = fused.withColumn("again", hash_embedding(F.col("chunk_text"), 64))
    assert plain.where(F.col("embedding") != F.col("again")).count() == 0
    assert plain.count() > 100


def test_chunks_cover_the_document_without_gaps(spark):
    from tessera.functions.text import normalize_ws
    from tessera.sources.tables import read_table
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    norm = {r.doc_id: r.t for r in docs.select("doc_id", normalize_ws(F.col("text")).alias("t")).collect()}
    by_doc = {}
    for r in chunk_documents(docs, ["doc_id"], "text", chunk_size=60, overlap=10).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, t in norm.items():
        rows = sorted(by_doc.get(doc_id, []), key=lambda r: r.chunk_index)
        if not t:
            assert not rows
            continue
        assert rows[0].start == 0 and rows[-1].end == len(t)
        for a, b in zip(rows, rows[1:]):
            assert a.start < b.start <= a.end + 1          # progress, overlap or adjacency, never a gap
        assert all(t[r.start:r.end] == r.chunk_text for r in rows)
