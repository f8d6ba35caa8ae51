"""Tables with the awkward cases, and brute-force versions of the operators."""

import hashlib
import random
import re

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with names that operators use inside or return.
CLASH = ("keep_id", "kept", "fp", "sha", "size", "target", "copies", "p_src", "_src", "bucket", "id", "text_sha256", "_words", "failed_rule", "starts", "node", "root")


def table(spark, rows, clash=False):
    """documents from (doc_id, text[, source]); null-safe; optional clashing columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if clash:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit("x").alias(c) for c in CLASH])
    return df


def awkward():
    """Nulls, empty and blank texts, one very long text, ties, repeated rows, Unicode, runs of one word."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, other = say(70), say(26)
    long = say(30_000)
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a b"), (5, "ab"), (6, long), (7, long), (9, passage), (8, say(30) + " " + passage + "\n" + say(9)),
        (10, passage + " " + passage), (11, other), (12, say(15) + " " + other + " x " + passage[:200]), (13, "go " * 300), (14, "go " * 90 + say(3)),
        (15, say(12)), (15, say(12)), (16, "twin text of a few words"), (16, "twin text of a few words"), (17, "Twin  text of a few\nwords"),
        (None, say(25)), (None, passage), (18, " ".join(say(1) for _ in range(40))), (19, "ab ab " * 200), (20, "ba " + "ab ab " * 100),
        (21, "\U0001f600 " * 30), (22, "x" * 5000), (23, "x" * 49), (24, "x" * 50), (25, other + " " + other),
    ]
    for k in range(26, 60):
        parts = [say(rng.randint(1, 60))]
        if rng.random() < 0.5:
            a = rng.randrange(0, 200)
            parts.insert(rng.randrange(2), passage[a:a + rng.randint(40, 220)])
        rows.append((k, " ".join(parts)))
    return rows


def order_id(i):
    return (1, 0) if i is None else (0, i)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), order_id(i), i))
    out = []
    for norm, members in groups.items():
        best = min(m[:2] for m in members)
        left = True
        for m in members:
            kept = m[:2] == best and left
            left = left and not kept
            out.append((m[2], min(members, key=lambda x: x[:2])[2], len(members), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def brute_words(rows, length=20):
    """Rows with distinct ids."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: order_id(r[0])):
        w = words(t)
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - length + 1):
            s = tuple(w[k:k + length])
            if s in seen:
                gone[k:k + length] = True
            seen.add(s)
        out[i] = (len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())
    return out


def brute_bytes(rows, length=50):
    """Rows with distinct ids."""
    first, out = {}, {}
    rows = [(i, (t or "").encode()) for i, t in sorted(rows, key=lambda r: order_id(r[0]))]
    for i, t in rows:
        for k in range(len(t) - length + 1):
            first.setdefault(t[k:k + length], order_id(i))
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if first[t[k:k + length]] < order_id(i):
                gone[k:k + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes())
    return out


def brute_fingerprint(text, n=3):
    import xxhash
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[k:k + n]) for k in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, linked):
    """values: list; linked(a, b); -> index of the first member of each one's component."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if linked(values[a], values[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(values))]


def brute_audit(rows, labels):
    """rows: (id, text, source); labels: (id, quality, toxic).  Applies the five filters in each of the 120 orders."""
    from itertools import permutations

    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = words(t)
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t),
            i is not None and i > least[t]), strict=True) if bad}
        docs.append((part or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d[1:] for d in docs if d[0] == part]
        taken = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                taken[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in d[0] for d in mine) - len(gone), sum(d[0] == {f} for d in mine),
                                          sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(taken[order[step - 1]])
    return out


def brute_trie(rows, group=100, head_mod=6):
    """rows: (conv_id, turn, role, text) -> Counter of the trie's rows, by one dictionary of prefixes."""
    import zlib
    from collections import Counter

    turn_key = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()[:16]
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, turn_key(r))):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    nodes, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % head_mod
        base = c - int(np.fmod(c, group))
        rebuilt = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(rebuilt) + 1):
            nodes.setdefault(rebuilt[:d], []).append(c)
        ends.setdefault(rebuilt, []).append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    return Counter((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in nodes.items())
