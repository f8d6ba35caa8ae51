"""Whitespace and sentence rules against Python's own definitions."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions.text import normalize_ws, split_sentences


def test_whitespace_matches_python_str_semantics(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rng = random.Random(5)
    samples = []
    for _ in range(200):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(rng.choice(["a", "Bé", "x.y", "ß", "­", "-", ""]))
            parts.append("".join(rng.choice(spaces) for _ in range(rng.randint(0, 3))))
        samples.append("".join(parts))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", normalize_ws(F.col("s")).alias("t")).collect()}
    for i, s in enumerate(samples):
        assert got[i] == re.sub(r"\s+", " ", s).strip(), repr(s)


def test_sentence_rule(spark):
    df = spark.createDataFrame([("Dr. Who went. Did he? Yes! Fine...   ok",), ("",), ("no end",)], "t string")
    rows = df.select(split_sentences(normalize_ws(F.col("t"))).alias("s")).collect()
    assert rows[0].s == ["Dr.", "Who went.", "Did he?", "Yes!", "Fine...", "ok"]
    assert rows[1].s == [] and rows[2].s == ["no end"]
