"""A minimal acyclic transducer from words to token ids.

Words (byte strings) are compiled into the smallest acyclic automaton, in
which words with a common suffix share states.  Every edge carries how many
words lie before it, so the sum along a word's path is its number among the
sorted words, and that number leads to its ids.  The automaton is a handful
of flat arrays in one file, which readers map into memory.  A bitmap of word
hashes in front saves most walks for words that are not there.
"""

from __future__ import annotations

import mmap
from collections.abc import Sequence

import numpy as np
import xxhash

MAGIC = b"LEX1"
GUARD_BITS = 22


def compile_lexicon(words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> bytes:
    """``words``: sorted, distinct, not empty strings; ``ids``: the output of each."""
    register: dict[tuple, int] = {}
    nodes: list[tuple] = []          # (final, ((label, child), ...)) of registered states, children first
    path: list[list] = [[False, []]]  # states of the last word that may still grow: [final, edges]
    last = b""

    def close(depth: int) -> None:
        """Replace the open states below ``depth`` by registered equal ones."""
        while len(path) - 1 > depth:
            final, edges = path.pop()
            key = (final, tuple(edges))
            state = register.get(key)
            if state is None:
                state = register[key] = len(nodes)
                nodes.append(key)
            label, _ = path[-1][1][-1]
            path[-1][1][-1] = (label, state)

    for word in words:
        if not last < word:
            raise ValueError("words must be sorted and distinct")
        common = 0
        for a, b in zip(last, word, strict=False):
            if a != b:
                break
            common += 1
        close(common)
        for byte in word[common:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    nodes.append((path[0][0], tuple(path[0][1])))  # the start state is the last

    sizes = []  # words from each state on
    first, labels, targets, before = [0], bytearray(), [], []
    for final, edges in nodes:
        n = int(final)
        for label, child in edges:
            labels.append(label)
            targets.append(child)
            before.append(n)
            n += sizes[child]
        sizes.append(n)
        first.append(len(labels))
    out_at = np.zeros(len(ids) + 1, dtype="<u4")
    np.cumsum([len(x) for x in ids], out=out_at[1:])
    parts = [np.array(first, dtype="<u4"), np.array([f for f, _ in nodes], dtype="<u4"), np.array(targets, dtype="<u4"),
             np.array(before, dtype="<u4"), out_at, np.array([i for x in ids for i in x], dtype="<u4"), np.frombuffer(bytes(labels), np.uint8)]
    guard = np.zeros(1 << GUARD_BITS, dtype=np.uint8)
    guard[[_guard(w) for w in words]] = 1
    parts.insert(6, np.packbits(guard, bitorder="little").view("<u4"))
    return MAGIC + np.array([len(p) for p in parts], dtype="<u4").tobytes() + b"".join(p.tobytes() for p in parts)


def _guard(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & ((1 << GUARD_BITS) - 1)


class Lexicon:
    """A compiled lexicon mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self._map[:4] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        view = memoryview(self._map)
        lengths, at, arrays = view[4:36].cast("I"), 36, []
        for n in lengths[:7]:
            arrays.append(view[at:at + 4 * n].cast("I"))
            at += 4 * n
        self._first, self._final, self._target, self._before, self._out_at, self._out, self._guard = arrays
        self._labels_at = at
        self._start = len(self._final) - 1

    def get(self, word: bytes) -> list[int] | None:
        """The ids of ``word``, or None if it is not in the lexicon."""
        bit = _guard(word)
        if not self._guard[bit >> 5] >> (bit & 31) & 1:
            return None
        first, find, base = self._first, self._map.find, self._labels_at
        state, number = self._start, 0
        for k in range(len(word)):
            edge = find(word[k:k + 1], base + first[state], base + first[state + 1]) - base
            if edge < 0:
                return None
            number += self._before[edge]
            state = self._target[edge]
        if not self._final[state]:
            return None
        return self._out[self._out_at[number]:self._out_at[number + 1]].tolist()
