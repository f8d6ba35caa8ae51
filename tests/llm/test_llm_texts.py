"""Tokens, personal data, secrets, quality and mixing."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import awkward, order_id, table, words
from pyspark.sql import functions as F

from tessera.llm.bpe import Encoder, Vocabulary, _splitter, bpe_decode, bpe_encode, bpe_round_trip
from tessera.llm.catalog import tokenizer_file
from tessera.llm.common import documents, prepare
from tessera.llm.lexicon import Lexicon, compile_lexicon
from tessera.llm.mixing import _knapsack, fit_budget, mix_sources, source_targets, take_mix
from tessera.llm.pii import BASE_KINDS, find_pii, luhn, mod97, pii_spans, spans_text
from tessera.llm.quality_classifier import fit_quality, score_quality
from tessera.llm.quality_rules import RULES, keep_good, quality_cascade, rule_order, text_metrics
from tessera.llm.secrets import find_secrets, guess_cost, secret_spans

SF = "/root/testdata/sf0.01"


def test_lexicon_returns_every_word_and_no_other(tmp_path):
    rng = random.Random(1)
    found = sorted({bytes(rng.choice(b"abc\xc3") for _ in range(rng.randint(1, 7))) for _ in range(3000)})
    known, unknown = found[::2], found[1::2]
    ids = [[rng.randrange(50_000) for _ in range(rng.randint(1, 4))] for _ in known]
    (tmp_path / "lex").write_bytes(compile_lexicon(known, ids))
    lexicon = Lexicon(str(tmp_path / "lex"))
    assert [lexicon.get(w) for w in known] == ids
    assert all(lexicon.get(w) is None for w in unknown) and lexicon.get(b"") is None
    with pytest.raises(ValueError):
        compile_lexicon([b"b", b"a"], [[1], [2]])


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    prepare(spark)
    library = Tokenizer.from_file(tokenizer_file())
    rng = random.Random(3)
    pieces = ["a", "the", " ", "  ", "\n", "\t", "\x85", "\xa0", " ", "\x1c", "'s", "'ll", "é", "漢字", "٣", "½", "!!", "<|endoftext|>", "<|end", "​", "😀", "\x00", "é"]
    rows = awkward() + [(1000 + k, "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))) for k in range(300)]
    rows.append((2000, "abcdefghij" * 3000 + "é" * 2000))
    df = table(spark, rows, clash=True)
    path = tokenizer_file()
    both = bpe_round_trip(df, path, lexicon_words=200)
    assert set(both.columns) == set(df.columns) | {"token_ids", "decoded"}
    for coded in (both, bpe_decode(bpe_encode(df, path, lexicon_words=200), path)):
        got = coded.select("doc_id", "text", "token_ids", "decoded").collect()
        assert len(got) == len(rows)
        for r in got:
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["token_ids"] == ids
            assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_round_trip_encodes_once_and_takes_an_empty_table(spark):
    prepare(spark)
    df = table(spark, [(1, "one two"), (2, None)])
    plan = bpe_round_trip(df, tokenizer_file())._jdf.queryExecution().executedPlan().toString()
    (call,) = re.findall(r"ArrowEvalPython \[([^\]]*)\]", plan)
    assert call.count("both(") == 1
    assert bpe_round_trip(df.limit(0), tokenizer_file()).count() == 0


def test_decoding_in_slices_across_rows(spark, monkeypatch):
    from tessera.llm import bpe
    path = tokenizer_file()
    vocabulary = Vocabulary(path)
    texts = ["", "a b c", "", "", "many more words than a slice holds, été", "x", ""]
    ids = pa.array([None, *([i for w in _splitter({})(t) for i in vocabulary.merge(w.encode())] for t in texts)], pa.list_(pa.int32()))
    decode = bpe._column_decoder(table(spark, [(1, "a")]), path)
    for tokens in (1, 2, 3, 5, 1 << 17):
        monkeypatch.setattr(bpe, "DECODE_TOKENS", tokens)
        assert decode(ids).to_pylist() == ["", *texts]
        assert decode(ids.slice(2, 4)).to_pylist() == texts[1:5]


def test_latin_pattern_cuts_like_the_general_one():
    import regex

    from tessera.llm.bpe import LATIN_PATTERN, PATTERN
    rng = random.Random(12)
    for _ in range(3000):
        t = "".join(chr(rng.choice([rng.randrange(256), 32, 39, 115, 97, 49])) for _ in range(rng.randrange(30)))
        assert re.findall(LATIN_PATTERN, t) == regex.findall(PATTERN, t)


def test_decoding_leaves_out_unknown_ids(spark):
    prepare(spark)
    df = spark.createDataFrame([(1, [0, 99_999_999, None, 1]), (2, None), (3, [])], "i int, token_ids array<int>")
    first = Vocabulary(tokenizer_file()).tokens
    got = {r["i"]: r["decoded"] for r in bpe_decode(df, tokenizer_file()).collect()}
    assert got == {1: (first[0] + first[1]).decode(), 2: "", 3: ""}


def test_bpe_does_not_depend_on_the_lexicon():
    vocabulary = Vocabulary(tokenizer_file())
    encoder = Encoder(vocabulary, None)
    for w in (b" hello", b"a" * 127, b"a" * 129, "é".encode() * 100, bytes(range(33, 127)) * 3):
        assert vocabulary._merge_long([vocabulary.byte_ids[b] for b in w]) == vocabulary.merge(w)
    assert encoder.encode("") == b""


def base_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(3)
    parts = ["1", "2", "25", "300", "0000000000012", ".", "..", "@", "a", "b.c", "-", " ", "+", "(", ")", "é", "4111111111111111", "mail ", "٣"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert [s[:3] for s in find_pii(t) if s[0] in BASE_KINDS] == base_pii(t)


def test_pii_checksums_and_context(spark):
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765433")
    (span,) = find_pii("pay to GB82 WEST 1234 5698 7654 32 now")
    assert span[0] == "iban"
    assert not [s for s in find_pii("pay to GB82 WEST 1234 5698 7654 33 now") if s[0] == "iban"]
    alone, near = find_pii("x 123-45-6789"), find_pii("social security 123-45-6789")
    assert not alone and near[0][0] == "ssn"  # a context word lifts it over the threshold
    low, high = find_pii("we saw 10.0.0.1")[0][3], find_pii("server at 10.0.0.1")[0][3]
    assert high > low
    prepare(spark)
    rows = awkward() + [(900, "é mail a.b@c.de"), (901, "a" * 300_000), (902, "1" * 300_000), (903, "a@" * 100_000)]
    got = pii_spans(table(spark, rows, clash=True)).select("doc_id", "text", spans_text(F.col("pii")).alias("s")).collect()
    assert len(got) == len(rows)
    assert [r["s"] for r in got if r["doc_id"] == 900] == ["email:7:15"]


def test_account_numbers_end_before_the_words_that_follow():
    ibans = lambda t: [t[s:e] for kind, s, e, _ in find_pii(t) if kind == "iban"]
    for number in ("ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "SE45 5000 0000 0583 9825 7466",
                   "CZ65 0800 0000 1920 0014 5399", "PL61 1090 1014 0000 0712 1981 2874", "HU42 1177 3016 1111 1018 0000 0000", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"):
        for after in ("", " BIC CAIXESBBXXX", " BIC", " EUR 20", " CODE 1234 X", ". End", " and"):
            assert ibans(f"IBAN {number}{after}") == [number], (number, after)
        assert ibans(f"AB12 IBAN {number} {number}") == [number] * 2
        assert not ibans(f"IBAN {number[:-1]}{(int(number[-1]) + 1) % 10} BIC")


def base_secrets(text):
    key = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key")).replace("_?", "_?")
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(rf"({key})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_secret_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(5)
    parts = ["password", "PassWord", "token", "ſecret", "secret", "api_key", "apikey", "aPi_Key", ":", "=", " ", "'", '"', "abc12345", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "f", "_", "pwd = ", "é", "toKen"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(20)))
        assert [s[:3] for s in find_secrets(t) if s[0] != "guess"] == base_secrets(t)


def test_guess_cost_and_context_values(spark):
    assert guess_cost("password") < guess_cost("pa55word9") < guess_cost("k3Vq9zLw2T")
    assert guess_cost("aaaaaaaaaaaa") < 5 and guess_cost("qwertyuiop") < 5 and guess_cost("2023-05-06") < 8 and guess_cost("") == 0
    strong = find_secrets("Authorization: Bearer k3Vq9zLw2TxB7")
    assert [s[0] for s in strong] == ["guess"]
    assert not find_secrets("pwd = password123") and not find_secrets("pass qwertyuiop12")
    prepare(spark)
    rows = awkward() + [(900, "f" * 200_000), (901, "token" * 50_000)]
    got = secret_spans(table(spark, rows, clash=True)).collect()
    assert len(got) == len(rows) and not [r for r in got if r["text"] is None and r["secrets"]]


def guesses(text):
    return [text[s:e] for kind, s, e, _ in find_secrets(text) if kind == "guess"]


def test_secrets_behind_every_credential_word():
    strong = "x!9$k@Lw2#pQ"
    for word in ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key", "secret_key", "client_secret", "DB_PASSWORD", "userPassword", "pwd", "private_key", "access_key"):
        for sep in (" = ", ": ", "='", '": "', " "):
            assert guesses(f"a {word}{sep}{strong}") == [strong], (word, sep)
    assert guesses("token: a#8Kq!zT4%wLm9") == ["a#8Kq!zT4%wLm9"]
    assert guesses("secret_key=wJalrXUtnFEMI/K7MDENG/bPxRfiCY") == ["wJalrXUtnFEMI/K7MDENG/bPxRfiCY"]
    assert guesses(f"Bearer password={strong}") == guesses(f"authorization credentials {strong}") == guesses(f"pass my_password {strong}") == [strong]
    assert [s[0] for s in find_secrets("password = k3Vq9zLw2TxB7")] == ["assign"]  # a base span is kept there


def test_secrets_of_any_characters():
    for strong in ("qXmZvLkRwTbNpGhYcJdF", "qXm!ZvLk@RwTb", "83650274916038275", "correct-horse-battery-staple"):
        assert guesses(f"Authorization: Bearer {strong}") == [strong]
        assert guesses(f"passphrase = {strong}") == [strong]
    for plain in ("pass legislation through parliament", "the auth: authentication", "bearer certificates.", "secret agreements", "password: Authorization", "token distribution", "pwd=changeme"):
        assert not guesses(plain), plain


def test_secrets_are_judged_by_the_whole_value():
    for head in ("0" * 64, "abc" * 40, "changeme" * 4):
        assert guesses(f"pwd={head}k3Vq9zLw2TxB7mPq") == [head + "k3Vq9zLw2TxB7mPq"]
        assert not guesses(f"pwd={head}")
    assert guesses("pwd=k3Vq9zLw2TxB7!" + "0" * 64) == ["k3Vq9zLw2TxB7!" + "0" * 64]  # a base span covers the zeros only
    assert guess_cost("0" * 200_000) < 8 and guess_cost("ab1" * 60_000) < 12


def brute_guess_cost(value):
    """All segments tried, repeats of every start and length among them."""
    from tessera.llm import secrets as s
    n, lower, pick, best = len(value), value.lower(), np.log10(4), [0.0] + [np.inf] * len(value)
    plain = lower.translate(s._LEET)
    for i in range(n):
        ends = [(i + 1, s._brute(value[i]))]
        for j in range(i + 3, n + 1):
            if rank := s._RANK.get(lower[i:j]) or s._RANK.get(plain[i:j], 0) * 2:
                ends.append((j, pick + np.log10(rank * (2 if value[i:j] != lower[i:j] else 1))))
            for row in s.KEYBOARD:
                if lower[i:j] in row or lower[i:j] in row[::-1]:
                    ends.append((j, pick + np.log10(2 * len(row) * (j - i))))
        if m := s._DATE.match(value, i):
            ends.append((m.end(), pick + np.log10(200 if m.end() - i == 4 else 200 * 365)))
        for w in (1, 2, 3, 4):
            for c in range(2, (n - i) // w + 1):
                if value[i:i + w] * c == value[i:i + w * c]:
                    ends.append((i + w * c, pick + sum(map(s._brute, value[i:i + w])) + np.log10(c)))
        for j, cost in ends:
            best[j] = min(best[j], best[i] + cost)
    return best[n]


def test_guess_cost_is_the_least_over_all_segmentations():
    rng = random.Random(6)
    parts = ["a", "b", "ab", "aab", "0", "1", "00", "love", "money", "mama", "k3", "2023", "x!", "aaaa", "abab", "qwe", "Pass"]
    for _ in range(1500):
        v = "".join(rng.choice(parts[:rng.choice([3, 8, 17])]) * rng.choice([1, 1, 2, 5, 9]) for _ in range(rng.randrange(14)))
        assert abs(guess_cost(v) - brute_guess_cost(v)) < 1e-9, v


def brute_metrics(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    covered = set()
    for k in range(len(w) - 4):
        if windows[tuple(w[k:k + 5])] > 1:
            covered.update(range(k, k + 5))
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_metrics_and_cascade(spark):
    prepare(spark)
    rows = awkward() + [(900, "#a |b $c " * 20), (901, "LOUD TEXT IS HERE AGAIN AND MORE OF IT ALL CAPS\n" * 1), (902, "same line again\n" * 30), (903, "w " * 5), (904, "a b c d e")]
    df = table(spark, rows, clash=True)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = text_metrics(df).select("doc_id", "text", *names).collect()
    for r in got:
        assert tuple(r[n] for n in names) == brute_metrics(r["text"]), r["doc_id"]
    lazy = {(r["doc_id"], r["text"]): r["failed_rule"] for r in quality_cascade(df).collect()}
    eager = {(r["doc_id"], r["text"]): r["failed_rule"] for r in quality_cascade(text_metrics(df), measured=True).collect()}
    assert {k: v is None for k, v in lazy.items()} == {k: v is None for k, v in eager.items()}
    for (_, text), failed in lazy.items():
        n, _, _, _, again = brute_metrics(text)
        assert not (n < 10 or 100 * again > 20 * n) or failed
    assert all(lazy[i, dict(rows)[i]] for i in (900, 901, 902, 903, 904))
    plain = table(spark, rows)
    kept = keep_good(plain)
    assert kept.columns == plain.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, t in rows if lazy[i, t] is None)
    assert {r.name for r in rule_order(df)} == {r.name for r in RULES}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_classifier_held_out_accuracy(spark):
    prepare(spark)
    docs = documents(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_quality(docs, labels)
    scored = score_quality(docs.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 50 and all(0 <= r["score"] <= 1 for r in scored)
    assert np.mean([(r["score"] >= 0.3) == r["quality"] for r in held]) > 0.95
    changed = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = fit_quality(docs, changed)  # labels of the held-out fold are never read
    assert np.array_equal(again.weights, model.weights) and again.threshold == model.threshold


def test_classifier_awkward_cases(spark):
    prepare(spark)
    df = table(spark, awkward(), clash=True)
    none = fit_quality(df, spark.createDataFrame([], "doc_id long, quality int"))
    one = fit_quality(df, spark.createDataFrame([(4, 1), (None, 0), (6, None), (7, 3), (7, 1)], "doc_id long, quality int"))
    for model in (none, one):
        got = score_quality(df, model).collect()
        assert len(got) == len(awkward()) and all(abs(r["score"] - 0.3) < 1e-9 for r in got)


def test_knapsack_meets_the_budget_when_a_subset_does():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.choice(np.arange(1, 60), size=rng.integers(1, 8), replace=False)
        counts = rng.integers(0, 5, size=len(sizes))
        budget = int(rng.integers(0, 200))
        reach = {0}
        for s, c in zip(sizes.tolist(), counts.tolist(), strict=True):
            reach = {r + k * s for r in reach for k in range(c + 1)}
        take = _knapsack(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((take * sizes).sum()) == max(r for r in reach if r <= budget)
        fit = fit_budget(sizes, counts, budget)
        assert (fit <= counts).all() and int((fit * sizes).sum()) <= max(budget, 0)


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        unit = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / unit for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def test_mix(spark):
    prepare(spark)
    rng = random.Random(8)
    rows = [(k, "w " * rng.choice([0, 3, 3, 3, 7, 20, 150]), rng.choice(["b", "b", "b", "a", None, "", "é", "z"])) for k in range(600)]
    rows += [(None, None, "a"), (5, "w w", "tiny"), (5, "w w", "tiny"), (700, None, "empty")]
    df = table(spark, rows, clash=True)
    mixed = mix_sources(df)
    got = mixed.collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    target = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len(words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= 3 for s in target)
    again = Counter((r["doc_id"], r["text"], r["source"], r["copies"]) for r in mix_sources(df.repartition(7)).collect())
    assert again == Counter((r["doc_id"], r["text"], r["source"], r["copies"]) for r in got)
    out = take_mix(df)
    assert out.columns == df.columns
    assert Counter(r["doc_id"] for r in out.collect()) == sum((Counter({r["doc_id"]: r["copies"]}) for r in got), Counter())
    assert sorted(order_id(r["doc_id"]) for r in take_mix(df, seed=1).collect()) != sorted(order_id(r["doc_id"]) for r in out.collect())


def test_targets_without_words(spark):
    sources = spark.createDataFrame([("=a", "a", 0), ("", None, 0)], "src string, source string, source_size long")
    assert {r["target"] for r in source_targets(sources).collect()} == {0.0}


def test_bpe_of_mixed_white_space_equals_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(8)
    library, encoder = Tokenizer.from_file(tokenizer_file()), Encoder(Vocabulary(tokenizer_file()), None)
    alphabet = [" ", " ", " ", "  ", "   ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\u0085", "\x1c", "a", "bc", "'s", "'", "12", "3", "!", "?!", "\u00e9", "\u6f22", "\U0001f600",
                "<|endoftext|>", "<|", "word", "Word,", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(6000)] + ["", " ", "  ", "a ", "a  ", " a", "  a"]
    for text, packed in zip(texts, encoder.encode_many(texts), strict=True):
        assert np.frombuffer(packed, "<i4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_classifier_fits_on_every_labelled_row(spark, monkeypatch):
    """Also those beyond any number of rows a label, and both labels meet in every group however rare one is."""
    from tessera.llm import quality_classifier as qc

    prepare(spark)
    monkeypatch.setattr(qc, "GROUP_ROWS", 40)
    ids = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5]
    good = set(ids[::50])
    df = spark.createDataFrame([(i, ("many quiet words, all good. " if i in good else "BUY NOW!!! $$$ ") * (1 + i % 7) + str(i)) for i in range(700)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in good)) for i in ids], "doc_id long, quality int")
    seen, plain = [], qc.Groups.sums

    def sums(self, part):
        seen.append(self.table)
        return plain(self, part)

    monkeypatch.setattr(qc.Groups, "sums", sums)
    model = qc.fit_quality(df, labels)
    rows = seen[0].collect()
    own = [(np.frombuffer(r["own"], bool), np.frombuffer(r["good"], bool)) for r in rows]
    assert len(rows) > 5 and sum(o.sum() for o, _ in own) == len(ids) and sum((o & g).sum() for o, g in own) == len(good)
    assert all(g.any() and not g.all() for _, g in own)
    x = np.concatenate([np.frombuffer(r["x"], float).reshape(-1, len(qc.FEATURES))[o] for r, (o, _) in zip(rows, own, strict=True)])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) < 1e-9, 1, x.std(axis=0)))
    strength = np.sort(model.strength(x))
    k = len(ids) - len(good) - 1  # the share of bad labels
    assert abs(model.threshold - (strength[k] + strength[k + 1]) / 2) < 1e-9
    scored = {r["doc_id"]: r["score"] for r in score_quality(df, model).collect()}
    assert all((scored[i] >= 0.3) == (i in good) for i in ids)
