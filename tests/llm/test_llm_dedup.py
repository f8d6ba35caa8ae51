"""Deduplication operators against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward, brute_bytes, brute_components, brute_exact, brute_fingerprint, brute_words, order_id, table

from tessera.llm.common import prepare
from tessera.llm.components import components
from tessera.llm.exact_dedup import CountingQuotientFilter, exact_dedup, keep_one_of_equal
from tessera.llm.recompression import Windows, repeated_words
from tessera.llm.simhash import keep_one_of_near, near_links, ring_candidates, simhash_groups
from tessera.llm.suffix_dedup import COVER, COVER_MODULUS, repeated_bytes


@given(st.lists(st.tuples(st.integers(0, (1 << 54) - 1), st.integers(1, 1 << 40)), max_size=60), st.lists(st.integers(0, 99), max_size=60))
@settings(deadline=None, max_examples=60)
def test_quotient_filter_round_trip_and_merge(items, small):
    def enc(c):
        v = np.array(sorted(c), dtype=np.uint64)
        return CountingQuotientFilter.encode(v, np.array([c[int(x)] for x in v], dtype=np.int64), 54)
    a, b = dict(items), dict(Counter(small))
    values, counts = CountingQuotientFilter.decode(enc(a))
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == a
    values, counts = CountingQuotientFilter.merge([enc(a), enc(b), enc(a)])
    want = {k: 2 * a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == want
    assert values.tolist() == sorted(want)


def test_exact_dedup(spark):
    prepare(spark)
    rows = awkward() + [(70 + k, "many copies  here" if k % 2 else "manycopies here") for k in range(40)]
    got = [tuple(r) for r in exact_dedup(table(spark, rows, clash=True)).collect()]
    assert Counter(got) == Counter(brute_exact(rows))
    df = table(spark, rows, clash=True)
    kept = keep_one_of_equal(df)
    assert kept.columns == df.columns
    want = Counter(g[0] for g in brute_exact(rows) if g[3])
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_components_of_paths_stars_and_noise(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(300)] + [(1000, 1001 + k) for k in range(400)] + [(5000 + rng.randrange(200), 5000 + rng.randrange(200)) for _ in range(150)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    assert sorted(got) == nodes
    at = {n: k for k, n in enumerate(nodes)}
    pairs = {(at[a], at[b]) for a, b in links if a != b} | {(at[b], at[a]) for a, b in links if a != b}
    want = brute_components(list(range(len(nodes))), lambda x, y: (x, y) in pairs)
    groups = {}
    for n in nodes:
        groups.setdefault(want[at[n]], set()).add(got[n])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_connect_exactly_the_near_fingerprints(spark, bits):
    rng = random.Random(bits)
    values = {rng.getrandbits(64) for _ in range(300)}
    for v in list(values)[:60]:  # chains of near copies, with flips anywhere and at the segment edges
        for _ in range(rng.randint(1, 6)):
            for _ in range(rng.randint(1, 3)):
                v ^= 1 << rng.choice([rng.randrange(64), 0, 20, 21, 41, 42, 43, 63])
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = near_links(fps, bits).collect()
    near = lambda a, b: bin(a ^ b).count("1") <= bits
    assert all(near(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links)
    got = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links}
    want = brute_components(values, near)
    assert brute_components(values, lambda a, b: (a, b) in got or (b, a) in got) == want
    if bits:
        linked = {v for a in values for v in (a,) if any(near(a, b) and a != b for b in values)}
        assert linked <= {r["fp"] % (1 << 64) for r in ring_candidates(fps, bits).collect()}
    with pytest.raises(ValueError):
        near_links(fps, 3)


def test_simhash_groups(spark):
    prepare(spark)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(400)]
    rows = awkward() + [(100 + k, " ".join(base[:199] + ["new%d" % k] + base[200:])) for k in range(30)]
    df = table(spark, rows, clash=True)
    got = sorted((tuple(r) for r in simhash_groups(df).collect()), key=lambda r: (order_id(r[0]), r[1]))
    rows.sort(key=lambda r: order_id(r[0]))
    prints = [brute_fingerprint(t) for _, t in rows]
    group = brute_components(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, (2, 0)), order_id(i))
    name = lambda g: None if least[g][0] else least[g][1]
    want = sorted(((i, f"{p:016x}", name(g)) for (i, _), p, g in zip(rows, prints, group, strict=True)), key=lambda r: (order_id(r[0]), r[1]))
    assert got == want
    assert len(set(group[-30:])) < 30  # near copies are linked
    kept = keep_one_of_near(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(ids) == Counter(name(g) for g in set(group))


def distinct_ids(rows):
    out = {}
    for i, t in rows:
        out.setdefault(i, t)
    return list(out.items())


def test_repeated_words(spark):
    prepare(spark)
    rows = distinct_ids(awkward())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept_text"])) for r in repeated_words(table(spark, rows, clash=True)).collect()}
    assert got == brute_words(rows)
    again = repeated_words(table(spark, awkward())).collect()  # repeated ids: defined, and a row for each row
    assert len(again) == len(awkward())


def test_equal_windows_have_equal_anchors():
    rng = random.Random(9)
    vocab = [b"a", b"b", b"c", b"dd", b"e"]
    for _ in range(30):
        common = [rng.choice(vocab) for _ in range(rng.choice([20, 24, 60]))]
        texts = [[rng.choice(vocab) for _ in range(rng.randrange(30))] + common + [rng.choice(vocab) for _ in range(rng.randrange(30))] for _ in range(2)]
        w = Windows(texts, 20)
        key = {}
        for s, d, k in zip(w.position.tolist(), w.doc.tolist(), w.key.tolist(), strict=True):
            assert key.setdefault(tuple(texts[d][s:s + 20]), k) == k


def test_repeated_bytes(spark):
    prepare(spark)
    assert {(a - b) % COVER_MODULUS for a in COVER for b in COVER} == set(range(COVER_MODULUS))
    rows = distinct_ids(awkward())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeated_bytes(table(spark, rows, clash=True)).collect()}
    assert got == brute_bytes(rows)
    assert repeated_bytes(table(spark, awkward())).count() == len(awkward())


def test_repeats_of_many_lengths_and_offsets(spark):
    """Passages around the limit at every offset modulo the cover, many documents sharing one, and repeats inside a document."""
    prepare(spark)
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefghij klmnop\n") for _ in range(n))
    source = noise(400)
    rows = [(0, source)]
    for k in range(1, 130):
        size = rng.choice([49, 50, 51, 52, 60, 80, 81, 120, 250])
        a = rng.randrange(len(source) - size)
        cut = source[a:a + size]
        rows.append((k, noise(rng.randrange(70)) + cut + noise(rng.randrange(40)) + (cut if k % 5 == 0 else "")))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeated_bytes(table(spark, rows)).collect()}
    assert got == brute_bytes(rows)


def shared_ids():
    """Null-id rows and rows of one id with different texts (and the same text), long and short, that share different parts of a passage."""
    rng = random.Random(21)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)).split()
    passage = say(120)
    cut = lambda a, b, before, after: " ".join(say(before) + passage[a:b] + say(after))
    rows = [(1, cut(0, 60, 5, 5)), (None, cut(30, 110, 400, 3)), (None, cut(45, 75, 0, 0)), (None, cut(20, 85, 2, 9)), (None, cut(85, 120, 1, 1) + " " + " ".join(passage[85:120])),
            (7, cut(40, 100, 200, 0)), (7, cut(50, 90, 0, 3)), (7, cut(95, 120, 4, 0) + " x " + " ".join(passage[95:120])), (9, cut(60, 120, 3, 3)), (5, cut(100, 120, 3, 3))]
    same = cut(70, 110, 2, 2)
    return rows + [(7, same), (7, same), (None, same), (None, same), (None, "short"), (None, None)]


def test_repeated_words_of_rows_with_one_id(spark):
    prepare(spark)
    rows = shared_ids()
    want = []
    for i, t in rows:  # each row against smaller ids and itself
        smaller = [(n, x) for n, (j, x) in enumerate(rows) if order_id(j) < order_id(i)]
        want.append((i, *brute_words([*smaller, (len(rows), t)])[len(rows)]))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept_text"])) for r in repeated_words(table(spark, rows)).collect()]
    assert Counter(got) == Counter(want)


def test_repeated_bytes_of_rows_with_one_id(spark):
    prepare(spark)
    rows = shared_ids()
    want = []
    for i, t in rows:
        smaller = [(n, x) for n, (j, x) in enumerate(rows) if order_id(j) < order_id(i)]
        want.append((i, *brute_bytes([*smaller, (len(rows), t)])[len(rows)]))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeated_bytes(table(spark, rows)).collect()]
    assert Counter(got) == Counter(want)


def test_a_rank_is_not_expanded_whole(monkeypatch):
    """Two long runs of one character: every record has one rank; the result stays, the memory does not hold all windows at once."""
    import tracemalloc

    import pyarrow as pa

    from tessera.llm import suffix_dedup
    batch = pa.RecordBatch.from_arrays([pa.array([b"a" * 30_000, b"a" * 20_000 + b"b"], pa.binary()), pa.array([3, 8]), pa.array([0, 0]), pa.array([5, 7])], names=["bytes", "id", "mark", "pos"])
    table = pa.Table.from_batches(list(suffix_dedup._cover_suffixes(60)([batch])))
    found, peak = [], []
    for rows in (1 << 40, 1 << 10):
        monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", rows)
        tracemalloc.start()
        out = suffix_dedup._sort_bucket(table).to_pylist()
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        found.append([(r["id"], sorted(set(np.frombuffer(r["starts"], "<u4").tolist()))) for r in out])
    assert found[0] == found[1] == [(8, list(range(7, 7 + 20_000 - 49)))]
    assert 3 * peak[1] < peak[0], peak


def test_scans_that_give_bitmaps_leave_no_shuffle_files(spark):
    import numpy as np

    from tessera.llm.firsts import deal_windows, first_bitmap
    from tessera.llm.shared_keys import is_set, repeated_bitmap

    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles

    def shuffled():
        found = files()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.range(1000, numPartitions=4)
    before, said = shuffled(), spark.conf.get(setting)
    bitmap = repeated_bitmap(rows, lambda batch: iter([batch.column(0).to_numpy().astype(np.uint64) % np.uint64(600) * np.uint64(0x9E3779B97F4A7C15)]))
    first_bitmap(deal_windows(rows, lambda batch: iter([(*[batch.column(0).to_numpy().astype(np.uint64) << np.uint64(40)] * 2, batch.column(0).to_numpy(), np.zeros(batch.num_rows, int))])))
    assert not shuffled() - before and spark.conf.get(setting) == said
    hit = is_set(np.frombuffer(bitmap, np.uint8), np.arange(600, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert hit[:400].all() and not hit[400:].all()


def test_cover_suffixes_come_in_rounds_and_leave_no_shuffle_files(spark, monkeypatch, tmp_path):
    """The suffixes of every round are a part of all; no round's shuffle outlives it; results stay with many rounds and written bitmaps."""
    import pyarrow as pa

    from tessera.llm import shared_keys, suffix_dedup
    prepare(spark)
    texts = [b"abc" * 40 + b"x", b"q" * 50, "hé ".encode() * 33]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array([3, 8, 9]), pa.array([0, 0, 5]), pa.array([5, 7, 0])], names=["bytes", "id", "mark", "pos"])
    rows = lambda *how: [tuple(r.values()) for b in suffix_dedup._cover_suffixes(60, *how)([batch]) for r in b.to_pylist()]
    whole = rows()
    places = [(i, p + pos, text[max(0, p - 30):p + 50]) for text, i, pos in zip(texts, (3, 8, 9), (5, 7, 0), strict=True) for p in range(len(text) - 19) if p % 31 in COVER]
    assert sorted((i, pos + off, around) for _, _, around, off, i, _, pos in whole) == sorted(places)
    assert sorted(r for turn in range(3) for r in rows(3, turn)) == sorted(whole) and len(rows(3, 0)) < len(whole)

    made, write = [], suffix_dedup._cover_suffixes
    monkeypatch.setattr(suffix_dedup, "_cover_suffixes", lambda *how: made.append(how[1:]) or write(*how))
    monkeypatch.setattr(suffix_dedup, "ROUND_BYTES", 1 << 10)
    monkeypatch.setattr(suffix_dedup, "ROUND_SHARE", 40)
    monkeypatch.setattr(shared_keys, "COLLECTED_BYTES", 1 << 10)
    docs = distinct_ids(awkward() + [(900 + k, "one and the same passage of text that is over fifty bytes long, " * 3 + str(k) * k) for k in range(40)])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeated_bytes(table(spark, docs)).collect()}
    assert got == brute_bytes(docs)
    assert len(made) > 2 and sorted(made) == [(len(made), turn) for turn in range(len(made))]


def test_later_places_travel_as_runs():
    import pyarrow as pa

    from tessera.llm.suffix_dedup import RUN, _as_runs, _in_runs
    places = [[4, 5, 5, 6, 9], [9, 10], [0], [2, 2, 4]]
    found = pa.table({"id": [1, 1, 2, 3], "mark": [0, 7, 0, 0], "starts": pa.array([np.array(p, "<u4").tobytes() for p in places], pa.binary())})
    runs = _as_runs(found).to_pylist()
    assert [len(r["runs"]) // RUN.itemsize for r in runs] == [2, 1, 1, 2]
    assert [np.flatnonzero(_in_runs([r["runs"]], 12)).tolist() for r in runs] == [sorted(set(p)) for p in places]
    assert np.flatnonzero(_in_runs([r["runs"] for r in runs], 11)).tolist() == [0, 2, 4, 5, 6, 9, 10]
    assert _as_runs(found.slice(0, 0)).num_rows == 0


def test_bitmaps_grow_with_the_text(spark):
    """More keys than a bitmap of 8 MB holds: sized by the text, it stays as selective; all sizes hold every repeat."""
    from tessera.llm.firsts import deal_windows, first_bitmap, maybe_first
    from tessera.llm.suffix_dedup import MOST_BITS, NAME_BITS, NAME_SHARE, _bitmap_bits
    sizes = [_bitmap_bits(n, NAME_SHARE, NAME_BITS, MOST_BITS["names"]) for n in (0, 10**8, 2 * 10**9, 5 * 10**9, 10**12)]
    assert sizes == [27, 27, 28, 30, 30]
    name = lambda n: np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = spark.range(2000, numPartitions=4)
    of = lambda batch: [(h := batch.column(0).to_numpy().astype(np.uint64) % np.uint64(1000) * np.uint64(0x9E3779B97F4A7C15)), h, batch.column(0).to_numpy(), np.zeros(batch.num_rows, int)]
    loose = []
    for bits in (12, 20):
        bitmap = first_bitmap(deal_windows(rows, lambda batch: iter([tuple(of(batch))])), route_bits=bits)
        assert 8 * (len(bitmap) - 1) == 1 << bits
        flags = np.frombuffer(bitmap, np.uint8)
        assert maybe_first(flags, name(1000), name(1000), np.arange(1000)).all()
        loose.append(int(maybe_first(flags, name(1000), name(1000), np.arange(1000, 2000)).sum()))
    assert loose[1] < 10 < loose[0]
