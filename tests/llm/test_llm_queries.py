"""Registered queries: oracles, empty tables, the pipeline."""

import hashlib
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from llm_cases import SCHEMA, awkward, brute_components, brute_fingerprint, table, words

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import corpus_pipeline  # noqa: E402
from check_oracle import frame_hash  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tessera.llm.catalog import ORACLES, REGISTRY, tokenizer_file  # noqa: E402
from tessera.llm.common import documents, prepare  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_registered():
    numbers = {k.split("_")[0] for k in REGISTRY}
    assert numbers == {f"op{n}" for n in range(1, 14)}
    assert {*REGISTRY, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracle(spark, con, key):
    df = REGISTRY[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLES[key])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert frame_hash(rows, df.columns) == frame_hash(res.fetchall(), cols)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables without rows, and with the awkward rows."""
    out = {}
    for name, rows in (("empty", []), ("awkward", awkward())):
        d = tmp_path_factory.mktemp(name)
        (table(spark, rows) if rows else spark.createDataFrame([], SCHEMA)).write.parquet(f"{d}/documents.parquet")
        labels = [(i, k % 2, 0) for k, (i, _) in enumerate(rows)]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        turns = [(i, k % 3 or None, "user", t) for k, (i, t) in enumerate(rows)]
        spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
        out[name] = str(d)
    return out


@pytest.mark.parametrize("key", sorted({*REGISTRY, "pipeline"}))
def test_empty_and_awkward_tables(spark, small, key):
    query = entry.queries()[key]
    assert query(spark, small["empty"]).count() == 0
    rows = query(spark, small["awkward"]).collect()
    if key == "op11_filter_audit":
        assert len(rows) == 600
    elif key == "op13_prefix_trie":
        assert sum(r["depth"] == 0 for r in rows) == 1
    elif key != "pipeline":
        assert len(rows) == len(awkward())


def test_pipeline_stages(spark):
    from tokenizers import Tokenizer

    prepare(spark)
    docs = documents(spark, SF)
    before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in REGISTRY["op10_quality_rules"](spark, SF).where("kept").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name != "tokens":
            assert out.columns == docs.columns
            after = [(r["doc_id"], r["text"], r["source"]) for r in rows]
        if name == "quality_rules":
            assert {r[0] for r in after} == kept and len(after) < len(before)
        elif name == "exact_dedup":
            norm = lambda t: "".join(words(t))
            want = {}
            for i, t, _ in before:
                want[norm(t)] = min(want.get(norm(t), (1, 0)), (-len(t), i))
            assert Counter(r[0] for r in after) == Counter(w[1] for w in want.values())
        elif name == "near_dedup":
            before.sort()
            group = brute_components([brute_fingerprint(t) for _, t, _ in before], lambda a, b: bin(a ^ b).count("1") <= 2)
            assert Counter(r[0] for r in after) == Counter(before[g][0] for g in set(group))
        elif name == "mix_sources":
            assert set(after) <= set(before) and max(Counter(after).values()) <= 3
            assert len({r[2] for r in after}) == len({r[2] for r in before})
        else:
            library = Tokenizer.from_file(tokenizer_file())
            text = {i: t for i, t, _ in before}
            assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in before)
            for r in rows:
                ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
                assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
                assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
                assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
        before = after
        docs = spark.createDataFrame(rows, out.schema)
