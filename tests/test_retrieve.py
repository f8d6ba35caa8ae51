"""Exact top-k: order, ties, filters, no score floor, batch = union of singles."""

import datetime as dt

import numpy as np

from tessera.operators.retrieve import LINK_FILTERS, topk_batch, topk_single

IDX = "chunk_id string, url string, folder string, domain string, date_added timestamp, embedding array<float>"


def _basis(i, dim=8):
    v = [0.0] * dim
    v[i] = 1.0
    return v


def _index(spark):
    rows = [(f"c{i}", f"https://s{i % 2}.example/{i}", "A" if i < 4 else "B", f"s{i % 2}.example",
             dt.datetime(2024, 1, 1 + i), _basis(i)) for i in range(8)]
    rows.append(("c8", "https://s0.example/8", "B", "s0.example", dt.datetime(2024, 1, 9), [0.1] * 8))
    return spark.createDataFrame(rows, IDX)


def test_self_is_top1(spark):
    h = topk_single(_index(spark), _basis(3), 3, key_cols=["chunk_id"]).orderBy("rank").collect()
    assert h[0].chunk_id == "c3" and h[0].score > 0.99 and len(h) == 3


def test_filters(spark):
    idx = _index(spark)
    hits = topk_single(idx, [0.1] * 8, 20, key_cols=["chunk_id"], filters={"folder": "A"}).collect()
    assert {h.chunk_id for h in hits} == {"c0", "c1", "c2", "c3"}
    hits = topk_single(idx, [0.1] * 8, 20, key_cols=["chunk_id"],
                       filters={"date_from": dt.datetime(2024, 1, 3), "date_to": dt.datetime(2024, 1, 5),
                                "unknown": 1}).collect()
    assert {h.chunk_id for h in hits} == {"c2", "c3", "c4"}           # both ends inclusive
    assert topk_single(idx, [0.1] * 8, 5, filters={"folder": None}).count() == 0   # key present, null value


def test_no_score_floor_and_empty(spark):
    idx = _index(spark)
    assert topk_single(idx, _basis(0), 50, key_cols=["chunk_id"]).count() == 9
    empty = spark.createDataFrame([], IDX)
    assert topk_single(empty, _basis(0), 5).count() == 0


def test_ties_broken_by_key(spark):
    rows = [(f"k{i}", "u", "A", "d", dt.datetime(2024, 1, 1), [1.0, 0.0]) for i in (3, 1, 2)]
    idx = spark.createDataFrame(rows, IDX)
    got = [h.chunk_id for h in topk_single(idx, [1.0, 0.0], 2, key_cols=["chunk_id"]).orderBy("rank").collect()]
    assert got == ["k1", "k2"]


def test_batch_equals_singles(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(60, 16)).astype(np.float32)
    idx = spark.createDataFrame([(f"c{i:02d}", "u", "A" if i % 3 else "B", "d", dt.datetime(2024, 1, 1 + i % 20),
                                  vecs[i].tolist()) for i in range(60)], IDX)
    qv = rng.normal(size=(7, 16))
    q = spark.createDataFrame([(int(i), qv[i].tolist(), "A" if i % 2 else None, None,
                                dt.datetime(2024, 1, 5) if i % 3 == 0 else None, None) for i in range(7)],
                              "query_id bigint, embedding array<double>, folder string, domain string, "
                              "date_from timestamp, date_to timestamp")
    batch = topk_batch(idx, q, 4, key_cols=["chunk_id"], filters=LINK_FILTERS, max_block_bytes=256).collect()
    for i in range(7):
        f = {}
        if i % 2:
            f["folder"] = "A"
        if i % 3 == 0:
            f["date_from"] = dt.datetime(2024, 1, 5)
        single = topk_single(idx, qv[i].tolist(), 4, key_cols=["chunk_id"], filters=f).orderBy("rank").collect()
        mine = sorted((h for h in batch if h.query_id == i), key=lambda h: h.rank)
        assert [h.chunk_id for h in mine] == [h.chunk_id for h in single]
        assert np.allclose([h.score for h in mine], [h.score for h in single])


def test_zero_vector_scores_nan_first(spark):
    rows = [("a", "u", "A", "d", dt.datetime(2024, 1, 1), [0.0, 0.0]),
            ("b", "u", "A", "d", dt.datetime(2024, 1, 1), [1.0, 0.0])]
    h = topk_single(spark.createDataFrame(rows, IDX), [1.0, 0.0], 2, key_cols=["chunk_id"]).orderBy("rank").collect()
    assert h[0].chunk_id == "a" and np.isnan(h[0].score)


def test_wrong_widths_fail_and_ids_may_be_of_any_type(spark):
    import pytest

    from tessera.operators.retrieve import topk_batch
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("none", None)], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([((1, "x"), [1.0, 0.1]), ((2, "y"), [0.1, 1.0])], "query_id struct<a:int,b:string>, embedding array<double>")
    got = {(r.query_id.b, r["rank"]): r.chunk_id for r in topk_batch(index, q, 2).collect()}
    assert got == {("x", 1): "a", ("x", 2): "b", ("y", 1): "b", ("y", 2): "a"}
    blocks = topk_batch(index, q, 2, max_block_bytes=16)  # one question to a block
    assert {(r.query_id.b, r["rank"]): r.chunk_id for r in blocks.collect()} == got
    wide = index.unionByName(spark.createDataFrame([("c", [1.0, 0.0, 0.0])], index.schema))
    with pytest.raises(Exception, match="width"):
        topk_batch(wide, q, 1).collect()
    assert topk_batch(index, q.limit(0), 1).count() == 0


def _tables(spark, n, m, dim, seed, tight):
    """Index rows in bundles around a few directions, with copies, zero rows, null filter values; questions near them."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * tight
    x[:n // 3] = x[0]  # a third of the rows are one vector
    x[n // 2:n // 2 + 3] = 0
    q = centres[rng.integers(0, 6, m)] + rng.normal(size=(m, dim)) * tight
    q[0] = 0
    rows = [(i, x[i].tolist(), None if i % 11 == 0 else "ABC"[i % 3], "d", None if i % 13 == 0 else dt.datetime(2024, 1, 1 + i % 28)) for i in range(n)]
    asked = [(j, q[j].tolist(), (None, "A", "C", "none")[j % 4], None, dt.datetime(2024, 1, 9) if j % 3 else None, dt.datetime(2024, 1, 20) if j % 5 == 0 else None)
             for j in range(m)]
    return (spark.createDataFrame(rows, "vec_id long, embedding array<double>, folder string, domain string, date_added timestamp"),
            spark.createDataFrame(asked, "query_id long, embedding array<double>, folder string, domain string, date_from timestamp, date_to timestamp"), rows, asked)


def _exhaustive(rows, asked, k, filtered, own=False):
    out = {}
    for j, q, folder, _, lo, hi in asked:
        hits = []
        for i, x, f, _, d in rows:
            if own and i == j:
                continue
            if filtered and ((folder is not None and f != folder) or (lo and (d is None or d < lo)) or (hi and (d is None or d > hi))):
                continue
            a, b = np.array(x), np.array(q)
            norm = np.sqrt(a @ a) * np.sqrt(b @ b)
            hits.append((-np.inf if norm == 0 else -round(float(a @ b / norm), 9), i))
        out[j] = [i for _, i in sorted(hits)[:k]]
    return out


def test_pivot_search_equals_the_exhaustive_one(spark):
    from tessera.operators.retrieve import search_batch

    for seed, (tight, filtered, own, size) in enumerate(((0.05, False, False, 1 << 25), (0.05, True, False, 4000), (2.0, True, False, 1 << 25), (0.3, False, True, 4000))):
        index, queries, rows, asked = _tables(spark, 3000, 40, 8, seed, tight)
        queries = queries.withColumn("self", queries.query_id) if own else queries
        plan = search_batch(index, queries, 6, key_cols=["vec_id"], filters=LINK_FILTERS if filtered else None, exclude_self="self" if own else None, max_block_bytes=size)
        got = {}
        for r in sorted(plan.hits.collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append(r.vec_id)
        want = {j: hits for j, hits in _exhaustive(rows, asked, 6, filtered, own).items() if hits}
        for j in want:
            if j:  # question 0 is the zero vector: all rows tie
                assert got[j] == want[j], (seed, j)
        assert got[0] == want[0] and set(got) == set(want)
        assert plan.pairs_in_all == 3000 * 40 and plan.pairs_scored <= plan.pairs_in_all
        if tight < 0.1:
            assert plan.pairs_scored < 0.6 * plan.pairs_in_all  # bundles far from a question are left out


def test_questions_never_reach_the_driver(spark):
    from tessera.operators.retrieve import search_batch

    index, queries, _, _ = _tables(spark, 300, 20, 4, 9, 0.1)
    plan = search_batch(index, queries, 3, key_cols=["vec_id"]).hits._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "queries-" in plan


def test_small_cells_share_a_block_and_candidates_stay_bounded():
    """A question meets few blocks; a task holds k rows a question and a slice of products."""
    import tracemalloc

    import pyarrow as pa

    from tessera.operators.retrieve import FilterSpec, _best, _packed, _Rules, _Vectors

    assert _packed([10, 20, 30, 100, 5], 60).tolist() == [0, 0, 0, 1, 2]
    n, m, k = 3000, 3000, 50
    x = np.random.default_rng(1).normal(size=(n, 4))
    x[: n // 2] = x[0]  # equal vectors tie for every question
    x[n - 2] = 0
    column = pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))
    label = [i % 3 for i in range(n)]
    rules = _Rules({"id": list(range(n)), "label": label}, {"label": label[:m], "self": list(range(m))}, FilterSpec(equal=[("label", "label")]), "self", "id")
    tracemalloc.start()
    got = list(_best(_Vectors(column), _Vectors(column), np.zeros(n, int), np.ones((m, 1), bool), np.arange(n), np.full(m, -np.inf), k, rules))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6  # 8 * k candidates a question as a table took over 1 GB
    wide = x.astype(np.float32).astype(np.float64)
    for whole, best in got:
        for j in (0, 1, len(whole) // 2, len(whole) - 1):
            i = whole[j]
            with np.errstate(invalid="ignore"):
                score = np.round(wide @ wide[i] / (np.linalg.norm(wide, axis=1) * np.linalg.norm(wide[i])), 9)
            score = np.where(np.isnan(score), np.inf, score)
            fit = [r for r in range(n) if r != i and label[r] == label[i]]
            assert best.row[j].tolist() == sorted(fit, key=lambda r: (-score[r], r))[:k]


def test_equal_keys_of_the_question_itself_are_all_left_out(spark):
    from tessera.operators.retrieve import topk_batch

    rows = [(1, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (None, [0.5, 0.5]), (3, None)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = index.selectExpr("vec_id query_id", "vec_id self", "embedding").where("vec_id = 1")
    hits = topk_batch(index, asked.limit(1), 5, key_cols=["vec_id"], exclude_self="self").collect()
    assert [(h["rank"], h.vec_id) for h in sorted(hits, key=lambda h: h["rank"])] == [(1, None), (2, 2)]


def test_any_filter_that_questions_use_leaves_rows_out(spark):
    """Searches by domain or by date score the parts of the index that can hold a hit, not every pair."""
    from tessera.operators.retrieve import search_batch

    rng = np.random.default_rng(11)
    n, m, day = 2000, 60, dt.timedelta(days=1)
    x, start = rng.normal(size=(n, 8)), dt.datetime(2024, 1, 1)
    rows = [(i, x[i].tolist(), "A", None if i % 17 == 0 else f"d{i % 40}", None if i % 19 == 0 else start + i * day) for i in range(n)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<double>, folder string, domain string, date_added timestamp")
    for domain, dates in ((True, False), (False, True), (True, True)):
        asked = [(j, x[j].tolist(), None, f"d{j % 40}" if domain else None, start + (20 * j - 300) * day if dates else None,
                  start + (20 * j + 100) * day if dates else None) for j in range(m)]
        queries = spark.createDataFrame(asked, "query_id long, embedding array<double>, folder string, domain string, date_from timestamp, date_to timestamp")
        plan = search_batch(index, queries, 5, key_cols=["vec_id"], filters=LINK_FILTERS)
        got = {}
        for r in sorted(plan.hits.collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append(r.vec_id)
        want = {}
        for j, q, _, dom, lo, hi in asked:
            fit = [i for i, _, _, d, a in rows if (dom is None or d == dom) and (lo is None or (a is not None and lo <= a <= hi))]
            score = {i: -round(float(x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j])), 9) for i in fit}
            want[j] = sorted(fit, key=lambda i: (score[i], i))[:5]
        assert got == {j: hits for j, hits in want.items() if hits}
        assert plan.pairs_in_all == n * m and plan.pairs_scored < 0.4 * n * m  # every pair before, as only folders led to parts


def test_rescoring_is_bounded_in_bytes_whatever_the_width():
    import tracemalloc

    import pyarrow as pa

    from tessera.operators import retrieve as r
    rng = np.random.default_rng(0)
    n, dim, k = 1500, 384, 200
    x = (rng.normal(size=(1, dim)) + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32)), pa.array(x.ravel()))
    vectors = r._Vectors(column)
    exact = (vectors.wide(slice(None)) @ vectors.wide(slice(None)).T) / np.outer(vectors.norm, vectors.norm)
    rules = r._Rules({"id": list(range(n))}, {}, r.FilterSpec(), None, "id")
    floor = np.sort(exact, axis=1)[:, -2 * k]
    tracemalloc.start()
    hits = [b.row[:len(w)].copy() for w, b in r._best(vectors, vectors, np.zeros(n, int), np.ones((n, 1), bool), np.arange(n), floor, k, rules)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20  # the two sides of 65,536 candidates alone took 400 MB
    best = np.argsort(-np.round(exact, 9), axis=1, kind="stable")[:, :k]
    assert (np.sort(np.concatenate(hits), axis=1) == np.sort(best, axis=1)).all()


def test_only_what_can_be_among_the_best_is_scored_in_double_precision(monkeypatch):
    """Without a floor (a filter that few sample rows pass) single-precision products of the slice and of what waits give one."""
    import pyarrow as pa

    from tessera.operators import retrieve as r
    n, dim, k = 3000, 32, 5
    x = np.random.default_rng(2).normal(size=(n, dim)).astype(np.float32)
    x[7], x[11:15] = 0, x[20]  # first for every question; ties
    vectors = r._Vectors(pa.array(x.tolist(), pa.list_(pa.float32())))
    rules = r._Rules({"id": list(range(n))}, {"self": list(range(n))}, r.FilterSpec(), "self", "id")
    pairs, rounded = [], r._rounded
    monkeypatch.setattr(r, "_rounded", lambda score: pairs.append(score.size) or rounded(score))
    hits = np.concatenate([b.row[:len(w)] for w, b in r._best(vectors, vectors, np.zeros(n, int), np.ones((n, 1), bool), np.arange(n), np.full(n, -np.inf), k, rules)])
    assert sum(pairs) < 8 * k * n  # 1,576 a question before: whole slices, then all that passed a stale floor
    with np.errstate(invalid="ignore"):
        exact = rounded((vectors.wide(slice(None)) @ vectors.wide(slice(None)).T) / np.outer(vectors.norm, vectors.norm))
    np.fill_diagonal(exact, -np.inf)
    assert (hits == np.argsort(-exact, axis=1, kind="stable")[:, :k]).all()


def test_each_embedding_and_cell_is_computed_once(spark):
    """No filter on a computed vector or cell computes it again, and the plan's small tables start no Python workers."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tessera.operators.retrieve import search_batch
    rng = np.random.default_rng(4)
    idx = spark.createDataFrame([(f"c{i:02d}", rng.normal(size=8).astype(np.float32).tolist()) for i in range(40)], "chunk_id string, embedding array<float>")
    calls = spark.sparkContext.accumulator(0)

    @F.arrow_udf("array<float>")
    def embed(ids: pa.Array) -> pa.Array:
        calls.add(len(ids))
        return pa.array([None if i == 3 else [float(i + 1)] * 8 for i in ids.to_pylist()], pa.list_(pa.float32()))

    questions = spark.range(10).select(F.col("id").alias("query_id"), embed("id").alias("embedding"))
    search = search_batch(idx, questions, 3, filters=LINK_FILTERS.__class__())
    assert calls.value == 10
    plan = search.hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {r.query_id for r in search.hits.collect()} == set(range(10)) - {3}  # a question without a vector has no hits


def test_questions_take_turns_where_copies_would_fill_the_disk(spark, monkeypatch):
    """Many blocks of questions and rows: hits stay the same, and a round's copies are gone from the disk before the next."""
    from tessera.operators import retrieve
    rng = np.random.default_rng(17)
    vecs = np.round(rng.normal(size=(400, 16)), 1).astype(np.float32)
    idx = spark.createDataFrame([(f"c{i % 390:03d}", "u", "A" if i % 3 else "B", "d", dt.datetime(2024, 1, 1 + i % 20), vecs[i].tolist()) for i in range(400)], IDX).cache()
    q = spark.createDataFrame([(i, vecs[i].tolist(), [None, "A", "B"][i % 3]) for i in range(300)] + [(7, [0.0] * 16, None), (8, None, "A")],
                              "query_id int, embedding array<float>, folder string").cache()
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles

    def shuffled():
        found = files()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}

    def searched():
        before, hits = shuffled(), retrieve.topk_batch(idx, q, 5, filters=retrieve.FilterSpec(equal=[("folder", "folder")]), max_block_bytes=40 * 8 * 16)
        rows = sorted((r.query_id, r.rank, r.chunk_id, repr(r.score)) for r in hits.collect())
        return rows, len(shuffled() - before), [f for f in hits.inputFiles() if "/hits-" in f]

    once, left, none = searched()
    monkeypatch.setattr(retrieve, "ROUND_BYTES", 1 << 10)
    turns, left_now, written = searched()
    assert turns == once and len(once) > 1400
    assert not none and len({f.split("/round-")[1].split("/")[0] for f in written}) > 2
    assert left_now < left
