"""The conversation trie against one dictionary of all prefixes."""

import random
from collections import Counter

import duckdb
import pytest
from llm_cases import brute_trie
from pyspark.sql import functions as F

from tessera.llm.prefix_trie import prefix_trie
from tessera.llm.ternary import TernaryTree, by_medians

SCHEMA = "conv_id long, turn long, role string, text string"


def _compare(spark, rows, clash=False, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clash:
        df = df.select("*", *[F.lit("x").alias(c) for c in ("conv", "code", "size", "depth", "n_convs", "band", "shard", "seq")])
    got = Counter(tuple(r) for r in prefix_trie(df, **how).collect())
    assert got == brute_trie(rows, **{k: v for k, v in how.items() if k in ("group", "head_mod")})
    return got


def test_ternary_tree():
    rng = random.Random(1)
    keys = sorted({tuple(rng.randrange(4) for _ in range(rng.randrange(6))) for _ in range(300)})
    assert sorted(by_medians(len(keys))) == list(range(len(keys)))
    tree = TernaryTree()
    root = tree.root()
    ends = {keys[k]: tree.insert(root, keys[k])[-1] for k in by_medians(len(keys))}
    assert len(tree) == len({k[:d] for k in keys for d in range(len(k) + 1)})
    assert all(tree.parent[v] < v for v in range(len(tree)))
    assert all([tree.code[v] for v in tree.up(e)][-2::-1] == list(k) for k, e in ends.items())
    chain = TernaryTree()
    top = chain.root()
    for k in by_medians(1 << 10):
        chain.insert(top, [k])
    depth = [0] * len(chain)
    for v in range(len(chain)):
        for w in (chain.less[v], chain.more[v]):
            if w >= 0:
                depth[w] = depth[v] + 1
    assert max(depth) <= 10  # balanced


def _random_rows(seed, convs=150, texts=3, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 450), convs):
        n = rng.randint(0, longest)
        shared = rng.random() < 0.7
        for t in range(n):
            rows.append((c, t, ("user", "assistant")[t % 2], f"text {t} {rng.randrange(texts)}" if shared else f"{c} {t} " * rng.randint(1, 4)))
    return rows


@pytest.mark.parametrize("band,block", [(128, 1 << 16), (128, 40), (3, 25), (1, 7), (2, 1)])
def test_trie_equals_brute_force(spark, band, block):
    _compare(spark, _random_rows(band + block), band=band, block_turns=block)


def test_trie_of_awkward_conversations(spark):
    rows = [(100, None, "user", "first"), (100, 0, None, None), (100, 1, "user", ""), (100, 1, "user", ""), (100, 2, "user", "漢字 \U0001f600"),
            (101, 0, "user", "a"), (103, 0, "user", "a"), (103, 0, "user", "b"), (None, 0, "user", "lost"), (None, None, None, None),
            (205, 0, "user", "no base here"), (-5, 0, "user", "below zero"), (-105, 0, "u", "a"), (7, 5, "us", "era"), (8, 5, "user", "a"), (9, 5, "use", "ra")]
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 400) for t in range(9)]  # one large group of copies
    rows += [(c, t, "user", "same " * (t % 3)) for c in (500, 501, 577) for t in range(700)]  # long conversations
    rows += [(600, t, "user", "x" * 10_000) for t in range(3)]
    for how in ({}, {"band": 16, "block_turns": 100}):
        got = _compare(spark, rows, clash=True, **how)
    assert any(r[1] == 0 and r[2] is None for r in got)


def test_trie_of_nothing(spark):
    assert not prefix_trie(spark.createDataFrame([], SCHEMA)).collect()
    assert not prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect()


def test_trie_of_the_whole_table(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{path}'").fetchall()
    assert Counter(tuple(r) for r in prefix_trie(spark.read.parquet(path)).collect()) == brute_trie(rows)
