"""The prefix trie of conversations: which openings are shared, and what is saved by keeping them once.

1. Turns become 16-byte digests where they are read; no text is shuffled.
   Ranges of (conversation, turn) number the turns, so a very long
   conversation is spread over tasks like any other rows.
2. Conversations are rebuilt and cut into bands of ``BAND`` turns; equal
   segments below one node are counted once, so a group of copies is one row
   before it is sorted.
3. Sorted segments are dealt to range shards.  Each shard gives its turns
   numbers in order (a dictionary of its own) and builds ternary search trees
   by median insertion, in blocks of bounded size; one pass backwards over the
   nodes gathers members, leaves and savings.
4. A node on the first or last path of a block may have parts in others, and
   a node that goes on into the next band has its subtree there.  These
   boundary nodes (few: two paths a block) are merged by their name, and their
   subtree sums are completed by pointer doubling, log2(depth) joins.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty, written
from tessera.llm.ternary import TernaryTree, by_medians

#: Turns of a band, so that no row or sort key is longer than 16 times that many bytes.
BAND = 128
#: Turns that a shard builds trees from at a time.
BLOCK_TURNS = 1 << 16
CODE = 16  # bytes of a turn's digest
_NODE = "depth long, k1 long, k2 long"
_PART_SCHEMA = (f"boundary boolean, {_NODE}, p1 long, p2 long, conv_id long, parent_conv_id long, n_convs long, size long, "
                "n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
_NONE_SHA = hashlib.sha256(b"").hexdigest()


# --- turns -------------------------------------------------------------------

def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation -> their number within the conversation's rows of this shard, from 1."""
    last, held = None, 0
    for batch in batches:
        conv = batch.column(1).to_numpy()
        if not len(conv):
            continue
        begins = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        sizes = np.diff(np.r_[begins, len(conv)])
        number = np.arange(len(conv)) - np.repeat(begins, sizes) + 1
        if last is not None and conv[0] == last:
            number[:sizes[0]] += held
        last, held = conv[-1], int(number[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], names=["shard", "conv", "code", "size", "number"])


def numbered_turns(conversations: DataFrame, *, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos, code, size) of every turn: its place from 1, digest of (role, text), code points of the text.

    Turns are in order of ``turn_col``, nulls first; those of one number are
    ordered by their digest, equal ones are repeated.  Rows without a
    conversation id belong to none and are left out."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    turn = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    # written once: a range shuffle looks at its input twice
    coded = written(conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.substring(F.unhex(turn), 1, CODE).alias("code"),
        F.length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")), "turns")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("code"), F.col("row")]
    ranged = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ranged.select(F.spark_partition_id().alias("shard"), "conv", "code", "size")
                   .mapInArrow(_number, "shard int, conv long, code binary, size long, number long"), "numbered")
    # conversations cut by a shard's end: at most two a shard, so the offsets are bounded by the number of shards
    parts = rows.groupBy("conv", "shard").agg(F.max("number").alias("n"))
    cut = parts.groupBy("conv").agg(F.count(F.lit(1)).alias("shards")).where("shards > 1").select("conv")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("shard")) - F.col("n")
    offsets = parts.join(F.broadcast(cut), "conv").select("conv", "shard", before.alias("before"))
    return rows.join(F.broadcast(offsets), ["conv", "shard"], "left").select(
        "conv", (F.col("number") + F.coalesce("before", F.lit(0))).alias("pos"), "code", "size")


def rebuilt_segments(turns: DataFrame, group: int, head_mod: int, band: int) -> DataFrame:
    """Segments of the rebuilt conversations: conv, band, seq (digests joined), sizes, total (turns of the conversation).

    Conversation c has the first h turns of conversation c - c % group, then
    its own after its first h; h = crc32(decimal c) % head_mod.  One without
    any turn has one empty segment."""
    h = F.crc32(F.col("conv").cast("string")) % head_mod
    base = F.col("conv") - F.col("conv") % group
    heads = (turns.where((F.col("pos") < head_mod) & (F.col("conv") % group == 0)).groupBy(F.col("conv").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", "code", "size"))).alias("head")))  # head_mod - 1 turns at most
    info = (turns.groupBy("conv").agg(F.max("pos").alias("n")).withColumn("base", base).join(heads, "base", "left")
            .select("conv", h.alias("h"), F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), h.cast("int")).alias("head"), "n")
            .withColumn("total", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    info = written(info, "rebuilt")
    given = info.select("conv", "total", F.posexplode("head").alias("at", "t")).select(
        "conv", (F.col("at") + 1).cast("long").alias("depth"), "t.code", "t.size", "total")
    own = (turns.where(F.col("pos") > h).join(info.select("conv", F.size("head").alias("b"), "total"), "conv")
           .select("conv", (F.col("pos") - h + F.col("b")).alias("depth"), "code", "size", "total"))
    none = info.where("total = 0").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("code"), F.lit(0).cast("long").alias("size"), "total")
    rows = given.unionByName(own).unionByName(none).withColumn("band", F.greatest(F.floor((F.col("depth") - 1) / band), F.lit(0)).cast("long"))
    # at most ``band`` turns a group, whatever the conversation
    s = F.sort_array(F.collect_list(F.struct("depth", "code", "size")))
    grouped = rows.repartition("conv", "band").groupBy("conv", "band").agg(s.alias("s"), F.max("total").alias("total"))
    seq = F.reduce("s", F.lit(b""), lambda a, t: F.concat(a, t["code"]))
    sizes = F.transform(F.filter("s", lambda t: t["depth"] > 0), lambda t: t["size"])
    return grouped.select("conv", "band", seq.alias("seq"), sizes.alias("sizes"), "total")


def _names(*cols: Column | str) -> list[Column]:
    """Two 64-bit hashes of the columns."""
    return [F.xxhash64(F.lit(seed), *cols) for seed in ("a", "b")]


def with_roots(segments: DataFrame, band: int) -> DataFrame:
    """Segments with the name (r1, r2) of the node that each hangs from and (n1, n2) of the node at its own end.

    The node at the end of band k is named by the exclusive or of the hashes
    of (band, segment) over bands 0 to k; the trie's root is (0, 0)."""
    a, b = _names("band", "seq")
    zero = F.lit(0).cast("long")
    segments = segments.withColumn("x1", a).withColumn("x2", b)
    one = segments.where(F.col("total") <= band).select("*", zero.alias("r1"), zero.alias("r2"))
    upto = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    more = segments.where(F.col("total") > band).select(
        "*", *[F.coalesce(F.bit_xor(f"x{k}").over(upto), zero).alias(f"r{k}") for k in (1, 2)])
    return one.unionByName(more).select(
        "conv", "band", "seq", "sizes", "r1", "r2", F.col("r1").bitwiseXOR(F.col("x1")).alias("n1"), F.col("r2").bitwiseXOR(F.col("x2")).alias("n2"),
        (F.col("total") <= (F.col("band") + 1) * band).alias("ends"))


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g1, g2, conv) in order -> SHA-256 of each group's conversations, comma-joined; a group is never held."""
    key, state = None, None
    for batch in batches:
        out = []
        for g1, g2, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (g1, g2) == key:
                state.update(b",%d" % conv)
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = (g1, g2), hashlib.sha256(b"%d" % conv)
        if out:
            yield _digest_rows(out)
    if key is not None:
        yield _digest_rows([(*key, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    g1, g2, sha = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(g1, pa.int64()), pa.array(g2, pa.int64()), pa.array(sha)], names=["g1", "g2", "ends_sha256"])


def distinct_segments(segments: DataFrame) -> DataFrame:
    """One row per (band, root, segment): members, smallest member, how many go on, digest of the members that end here."""
    g1, g2 = _names("band", "r1", "r2", "seq")
    ended = segments.where("ends").select(g1.alias("g1"), g2.alias("g2"), "conv")
    # one group's list goes through one task as a stream (the digest is sequential); nothing of it is kept
    digests = (ended.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "conv")
               .mapInArrow(_list_digests, "g1 long, g2 long, ends_sha256 string"))
    key = ["band", "r1", "r2", "seq"]
    counted = segments.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"), F.count_if(~F.col("ends")).alias("go_on"),
        F.first("sizes").alias("sizes"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    return counted.withColumn("g1", g1).withColumn("g2", g2).join(digests, ["g1", "g2"], "left").drop("g1", "g2")


# --- trees -------------------------------------------------------------------

def block_nodes(rows: list[dict], band: int) -> list[tuple]:
    """Nodes of one block of sorted segments, as rows of ``_PART_SCHEMA``.

    Nodes that no other block can have are finished; boundary nodes carry what
    hangs from them by finished children."""
    cut = [[r["seq"][k:k + CODE] for k in range(0, len(r["seq"]), CODE)] for r in rows]
    codes = sorted({c for turns in cut for c in turns})
    number = {c: k for k, c in enumerate(codes)}
    tree, roots, ends = TernaryTree(), {}, [0] * len(rows)
    n, least, size, sha, goes_on = [], [], [], [], {}
    for k in by_medians(len(rows)):
        r = rows[k]
        top = (r["band"], r["r1"], r["r2"])
        if top not in roots:
            roots[top] = tree.root()
        path = tree.insert(roots[top], [number[c] for c in cut[k]])
        for _ in range(len(tree) - len(n)):
            n.append(0)
            least.append(None)
            size.append(0)
            sha.append(None)
        for node, chars in zip(path, [0, *r["sizes"]], strict=True):
            n[node] += r["n"]
            least[node] = r["least"] if least[node] is None else min(least[node], r["least"])
            size[node] = chars
        ends[k], sha[path[-1]] = path[-1], r["ends_sha256"]
        if r["go_on"]:
            goes_on[path[-1]] = (r["n1"], r["n2"])
    name = {}
    for k in {0, len(rows) - 1}:
        name.update(dict.fromkeys(tree.up(ends[k])))
    for node in [*goes_on, *roots.values()]:
        name.update(dict.fromkeys(tree.up(node)))
    depth, state = [0] * len(tree), {}
    for top, node in roots.items():
        depth[node], name[node], state[node] = top[0] * band, top[1:], hashlib.sha256(struct.pack("<qqq", *top))
    children, leaves, saved = [0] * len(tree), [0] * len(tree), [0] * len(tree)
    for v in range(len(tree)):
        p = tree.parent[v]
        if p < 0:
            continue
        depth[v] = depth[p] + 1
        if v in name:
            state[v] = state[p].copy()
            state[v].update(codes[tree.code[v]])
            name[v] = goes_on.get(v) or struct.unpack("<qq", state[v].digest()[:16])
            if depth[v] % band == 0 and v not in goes_on:  # named as the same node is where it goes on
                name[v] = None
    for k, r in enumerate(rows):
        if ends[k] in name and name[ends[k]] is None:
            name[ends[k]] = (r["n1"], r["n2"])
    for v in range(len(tree) - 1, -1, -1):
        if v in name:
            continue  # its own part is added when all parts have met
        leaves[v] += not children[v]
        saved[v] += (n[v] - 1) * size[v]
        p = tree.parent[v]
        children[p] += 1
        leaves[p] += leaves[v]
        saved[p] += saved[v]
    out, top_nodes = [], set(roots.values())
    for v in range(len(tree)):
        p = tree.parent[v]
        below = (children[v], leaves[v], saved[v], sha[v])
        if v in top_nodes and depth[v]:  # its members are counted where the band above ends
            out.append((True, depth[v], *name[v], None, None, None, None, 0, 0, *below))
        elif v in name:
            out.append((True, depth[v], *name[v], *(name[p] if p >= 0 else (None, None)), least[v], None, n[v], size[v], *below))
        elif p in name:
            out.append((False, depth[v], None, None, *name[p], least[v], None, n[v], size[v], *below))
        else:
            out.append((False, depth[v], None, None, None, None, least[v], least[p], n[v], size[v], *below))
    return out


def _shard(band: int, block_turns: int):
    names = [part.split()[0] for part in _PART_SCHEMA.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            columns = zip(*block_nodes(rows, band), strict=True)
            kinds = [pa.bool_(), *[pa.int64()] * (len(names) - 2), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if rows and held + len(row["sizes"]) + 1 > block_turns:
                    yield flush()
                    rows, held = [], 0
                rows.append(row)
                held += len(row["sizes"]) + 1
        if rows:
            yield flush()
    return build


def merged_boundary(parts: DataFrame) -> DataFrame:
    """Boundary nodes, each once with its own figures and its subtree's."""
    key = ["depth", "k1", "k2"]
    one = parts.where("boundary").groupBy(*key).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256"))
    one = written(one, "boundary")
    kids = one.where("p1 is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("kids"))
    nodes = one.join(kids, key, "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    own_leaf, own_saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("size")
    nodes = written(nodes.select(*key, "p1", "p2", "conv_id", "n_convs", "n_children", "ends_sha256", (F.col("n_leaves") + own_leaf).alias("n_leaves"),
                                 (F.col("saved_tokens") + own_saved).alias("saved_tokens")), "boundary")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    # sums over descendants nearer than 2^i; (a1, a2) is the ancestor 2^i above
    sums = nodes.select(*key, F.col("p1").alias("a1"), F.col("p2").alias("a2"), "n_leaves", "saved_tokens")
    step = 1
    while step <= deepest:
        up = (F.col("depth") - step).alias("depth")
        gains = sums.where("a1 is not null").groupBy(up, F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        above = sums.select((F.col("depth") + step).alias("depth"), F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        sums = written(sums.join(gains, key, "left").join(above, ["depth", "a1", "a2"], "left").select(
            *key, F.col("b1").alias("a1"), F.col("b2").alias("a2"), (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens")), "boundary-sums")
        step *= 2
    return written(nodes.drop("n_leaves", "saved_tokens").join(sums.drop("a1", "a2"), key), "boundary")


def prefix_trie(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                group: int = 100, head_mod: int = 6, band: int = BAND, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (``rebuilt_segments``).

    Columns: conv_id (smallest member), depth, parent_conv_id (root: null),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  Null roles and
    texts are empty; rows without a conversation id are left out; turns of one
    number are ordered by digest and repeated rows are turns of their own;
    ids are integers.  Texts are compared by 128 bits of SHA-256.  A table
    without conversations has no node.
    """
    turns = numbered_turns(conversations, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    segments = with_roots(written(rebuilt_segments(turns, group, head_mod, band), "segments"), band)
    groups = written(distinct_segments(segments), "distinct-segments")
    order = ["band", "r1", "r2", "seq"]
    sorted_groups = groups.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(sorted_groups.mapInArrow(_shard(band, block_turns), _PART_SCHEMA), "trie-parts")
    edge = merged_boundary(parts)
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE_SHA)).alias("ends_sha256")]
    above = edge.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    at_edge = edge.join(above, ["depth", "p1", "p2"], "left").select("conv_id", "depth", F.col("above").alias("parent_conv_id"), *figures)
    inner = (parts.where("not boundary").join(above, ["depth", "p1", "p2"], "left")
             .select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), *figures))
    return inner.unionByName(at_edge)
