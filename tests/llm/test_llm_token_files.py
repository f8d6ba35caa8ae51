"""Token files: Elias-Fano sequences, the encoder and whole round trips against the tokenizers library."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward, table
from tokenizers import Tokenizer

from tessera.llm.catalog import tokenizer_file, word_tokenizer_file
from tessera.llm.elias_fano import EliasFano, ef_encode
from tessera.llm.token_files import TextEncoder, TokenBlock, pack_block, read_token_files, write_token_files


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 1 << 40), st.integers(0, (1 << 64) - 1)), max_size=700))
def test_elias_fano(values):
    values.sort()
    data = ef_encode(np.array(values, dtype=np.uint64))
    seq = EliasFano(data)
    assert seq.decode().tolist() == values and len(seq) == len(values)
    assert [seq.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        seq.select(len(values))


def test_boundaries_are_near_the_bound():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 800, 50_000)).astype(np.uint64)
    bits = 8 * len(ef_encode(ends)) / len(ends)
    assert bits < 3 + np.log2(ends[-1] / len(ends)) < 16  # 64 in a plain table


@pytest.fixture(scope="module")
def encoders():
    out = {}
    for path in (word_tokenizer_file(), tokenizer_file()):
        with open(path, encoding="utf-8") as f:
            out[path] = (TextEncoder(f.read()), Tokenizer.from_file(path))
    return out


def _same(encoder, library, texts):
    ids, at = encoder.encode(pa.array(texts, pa.string()), 2)
    for text, want, a, b in zip(texts, library.encode_batch([t or "" for t in texts], add_special_tokens=False), at, at[1:], strict=False):
        assert ids[a:b].tolist() == [*want.ids, 2], text


def test_word_path_is_used_where_rules_allow(encoders):
    assert encoders[word_tokenizer_file()][0].by_word and not encoders[tokenizer_file()][0].by_word


def test_encoder_equals_library(encoders):
    rng = random.Random(3)
    alphabet = [*"abcXYZ '.,-_!?#%()019", "'s", "'RE", "n't", "É", "é", "ß", "œ", "Ÿ", "İ", "ı", "ŉ", "ǅ", "ʼ", "ª", "µ", "²", "½", "×", " ", "\u0085", "\x1c",
                "\x00", "́", "̱", "H", "Σ", "σ", "ς", "漢", "字", "한", "‍", " ", "—", "…", "\U0001f600", "ﬁ", "Å", "K", "\n", "\t", "\r\n", "  ",
                "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "á̧", "ẞ", "ͅ", "﻿"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [None, "", " ", "Ünïcödé's ÉCOLE", "x" * 5000, "don't can'T 'S 12 3a4"] + [t for _, t in awkward()]
    for encoder, library in encoders.values():
        _same(encoder, library, texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_encoder_equals_library_on_any_text(texts):
    with open(word_tokenizer_file(), encoding="utf-8") as f:
        spec = f.read()
    if not hasattr(test_encoder_equals_library_on_any_text, "pair"):
        test_encoder_equals_library_on_any_text.pair = (TextEncoder(spec), Tokenizer.from_str(spec))
    _same(*test_encoder_equals_library_on_any_text.pair, texts)


def test_memory_of_words_is_bounded(encoders, monkeypatch):
    import tessera.llm.token_files as tf

    monkeypatch.setattr(tf, "MEMO_WORDS", 50)
    with open(word_tokenizer_file(), encoding="utf-8") as f:
        encoder = TextEncoder(f.read())
    library = encoders[word_tokenizer_file()][1]
    for k in range(5):
        _same(encoder, library, [f"w{j} common Words{j * k}, again" for j in range(40)])
    assert len(encoder.memo) < 200


def test_unknown_rules_take_the_whole_text(encoders):
    spec = json.loads(open(word_tokenizer_file(), encoding="utf-8").read())
    spec["normalizer"]["normalizers"][1]["content"] = "_"
    encoder, library = TextEncoder(json.dumps(spec)), Tokenizer.from_str(json.dumps(spec))
    assert not encoder.by_word
    _same(encoder, library, ["a  b c", "", "x"])


def test_block_reads_one_document():
    sizes = np.array([3, 0, 1, 2])
    block = TokenBlock(pack_block(7, 9, 2, [-(1 << 63), 5, (1 << 63) - 1, None], sizes, np.arange(6, dtype="<u2").tobytes()) + b"\n")
    assert (block.shard, block.block) == (7, 9)
    assert [block.document(i).tolist() for i in range(4)] == [[0, 1, 2], [], [3], [4, 5]]
    assert block.doc_ids().to_pylist() == [-(1 << 63), 5, (1 << 63) - 1, None]
    with pytest.raises(ValueError):
        TokenBlock(pack_block(0, 0, 2, [1], np.array([4]), b"12"))


@pytest.mark.parametrize("path", [word_tokenizer_file(), tokenizer_file()])
def test_files_round_trip(spark, tmp_path, path):
    library = Tokenizer.from_file(path)
    rows = awkward() + [(77, f"same id {k} " * k) for k in range(60)]
    out = str(tmp_path / "files")
    write_token_files(table(spark, rows, clash=True).repartition(3), out, path, block_tokens=3000, shard_bytes=20_000)
    got = sorted(read_token_files(spark, out, with_ids=True).collect(), key=lambda r: r["start"])
    assert len(list((tmp_path / "files").glob("part-*"))) > 5
    coded = {}
    for i, t in rows:
        coded.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["token_ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["token_ids"], "<u4").tobytes())
        coded[r["doc_id"]].remove(r["token_ids"])
        at += r["n_tokens"]
    assert not any(coded.values()) and len(got) == len(rows)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))


def test_files_of_nothing(spark, tmp_path):
    out = str(tmp_path / "none")
    write_token_files(table(spark, [(1, "x")]).limit(0), out, word_tokenizer_file())
    assert read_token_files(spark, out).count() == 0
