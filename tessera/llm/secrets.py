"""Secrets: key patterns, and values judged by the cost of guessing them.

Three patterns give the base spans.  Beyond them, values that stand behind a
credential word (``pwd = ...``, ``client_secret: ...``, ``Bearer ...``; the
words of the base too) are judged, as far as no base span covers them, by a
guess-cost dynamic program: the cheapest way to cut the value into dictionary
words, dates, repeats, keyboard walks and brute-force stretches, counted in
guesses.  Values that would take many guesses are reported,
whatever characters they are made of.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.dictionary import WORDS
from tessera.llm.pii import spans_udf

# Fixed patterns of the base kinds; letters of the key words in either case (ASCII only).
_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_HINT = re.compile(r"(?ai:passw|secret|token|api_?key)")
_WORD = r"(?:(?<![A-Za-z0-9])(?ai:pwd|pass|passphrase|credentials?|private[_-]?key|access[_-]?key|auth(?:orization)?|bearer)" \
        r"|(?ai:password|passwd|secret(?:[_-]?key)?|token|api[_-]?key))"
_SEP = r"(?:[\"']?\x20*[:=]\x20*[\"']?|\x20+)"
#: Credential contexts, those of the base among them (the base cuts a value at its first punctuation); the value is group 1.
_CONTEXT = re.compile(rf"{_WORD}{_SEP}(?!{_WORD}{_SEP})([A-Za-z0-9!@#$%^&*+/_.=~-]{{8,}})")
_CONTEXT_HINT = re.compile(r"(?ai:pwd|pass|credential|key|auth|bearer|secret|token)")
#: No context word is longer; one that ends a value too cheap to report may have its own value behind it.
_LONGEST_CONTEXT = 16

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which on a context value counts as a secret.
MIN_LOG10_GUESSES = 10.0
#: Costs of values up to this length are remembered.
REMEMBERED = 64
#: Words that people build passwords from, commonest first (fixed values; a word's place is its number of guesses).
COMMON_WORDS = (
    "password", "admin", "user", "login", "welcome", "letmein", "secret", "token", "test", "example",
    "changeme", "default", "root", "guest", "master", "dragon", "monkey", "shadow", "sunshine", "princess",
    "football", "baseball", "summer", "winter", "spring", "autumn", "hello", "world", "love", "money",
    "your", "here", "my", "the", "key", "value", "string", "none", "null", "true",
    "false", "pass", "word", "demo", "sample", "dummy", "placeholder", "insert", "replace", "server",
    "database", "mysql", "oracle", "public", "private", "access", "service", "account", "company", "office",
)
#: Rows of a keyboard; a walk is three or more neighbours of one row, in either direction (fixed values).
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
#: Words of passwords come before those of ordinary text, which keep prose behind a context word cheap.
_RANK = {w: k + 1 for k, w in enumerate(dict.fromkeys((*COMMON_WORDS, *WORDS)))}
_LONGEST = max(map(len, _RANK))
_DATE = re.compile(r"(?:(?:19|20)[0-9]{2}(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12][0-9]|3[01]))?)?"
                   r"|(?:0[1-9]|[12][0-9]|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)[0-9]{2})")
_LEET = str.maketrans("@431!05$7", "aaeiiosst")


def _brute(c: str) -> float:
    """log10 of the characters that one unexplained character could be."""
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


class _Repeats:
    """The cheapest repeat of a unit of one width that ends at a position, as positions go by in order.

    Starts are kept apart by their place modulo the width.  A start whose cost
    is once beaten by an earlier one stays beaten, and one that is no cheaper at
    its start than a later one too; the few others are compared at each position.
    """

    def __init__(self, value: str, width: int, brute: list[float], best: list[float], pick: float):
        self.value, self.width, self.brute, self.best, self.pick = value, width, brute, best, pick
        self.run, self.starts = 0, [[] for _ in range(width)]

    def until(self, end: int) -> float:
        w = self.width
        self.run = self.run + 1 if end > w and self.value[end - 1] == self.value[end - 1 - w] else 0
        if self.run < w:
            return math.inf
        new, low = end - 2 * w, end - self.run - w
        fixed = self.best[new] + self.pick + sum(self.brute[new:new + w])
        kept, least = [], math.inf
        for start, cost in self.starts[end % w]:
            if start >= low and cost < fixed and (now := cost + math.log10((end - start) // w)) < least:
                kept.append((start, cost))
                least = now
        if (now := fixed + math.log10(2)) < least:
            kept.append((new, fixed))
            least = now
        self.starts[end % w] = kept
        return least


def _program(value: str) -> float:
    n, lower = len(value), value.lower()
    plain = lower.translate(_LEET)
    best = [0.0] + [math.inf] * n
    pick = math.log10(4)  # one of four kinds of pattern
    brute = list(map(_brute, value))
    repeats = [_Repeats(value, width, brute, best, pick) for width in (1, 2, 3, 4)]

    def offer(start: int, end: int, cost: float) -> None:
        if best[start] + cost < best[end]:
            best[end] = best[start] + cost

    for i in range(n + 1):
        best[i] = min(best[i], *[r.until(i) for r in repeats])
        if i == n:
            break
        offer(i, i + 1, brute[i])
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            rank = _RANK.get(lower[i:j]) or _RANK.get(plain[i:j], 0) * 2
            if rank:
                offer(i, j, pick + math.log10(rank * (2 if value[i:j] != lower[i:j] else 1)))
        if m := _DATE.match(value, i):
            offer(i, m.end(), pick + math.log10(200 if m.end() - i == 4 else 200 * 365))
        for row in KEYBOARD:
            at = row.find(lower[i])
            for step in (1, -1) if at >= 0 else ():
                j, k = i + 1, at + step
                while j < n and 0 <= k < len(row) and row[k] == lower[j]:
                    j, k = j + 1, k + step
                if j - i >= 3:
                    offer(i, j, pick + math.log10(2 * len(row) * (j - i)))
    return best[n]


_remembered = lru_cache(4096)(_program)


def guess_cost(value: str) -> float:
    """log10 of the guesses for ``value``: the minimum over all segmentations, by position.

    A segment costs the logarithm of its guesses (a word its rank, times two
    if its case or its letters are changed; a date its days; a repeat its unit and
    count; a walk its start, length and direction; a brute-force character its
    alphabet).  Each pattern segment also costs a factor for being chosen.
    The whole value counts, in time that grows with its length.
    """
    return _remembered(value) if len(value) <= REMEMBERED else _program(value)


def find_secrets(text: str, min_log10_guesses: float = MIN_LOG10_GUESSES) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by start, then kind; code points, end exclusive.

    The score is the guess cost of the value for ``assign`` and ``guess``,
    and the brute-force cost of the match for the key patterns.
    """
    found = []
    if _HINT.search(text):
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 8:
                found.append((m.start(), 0, m.end(), guess_cost(m.group(1))))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), (m.end() - m.start() - 4) * math.log10(36)) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), (m.end() - m.start()) * math.log10(16)) for m in _HEX.finditer(text)]
    if _CONTEXT_HINT.search(text):
        taken, k, at = sorted((s, e) for s, _, e, _ in found), 0, 0
        reach = 0  # the furthest end of the base spans so far
        while m := _CONTEXT.search(text, at):
            at = m.end(1)
            begin, left = max(m.start(1), reach), []  # what no base span covers
            while k < len(taken) and taken[k][0] < at:
                left.append(text[begin:taken[k][0]])
                reach, k = max(reach, taken[k][1]), k + 1
                begin = max(begin, reach)
            left.append(text[begin:at])
            if max(map(guess_cost, left)) >= min_log10_guesses:
                found.append((m.start(1), 3, at, guess_cost(m.group(1))))
            else:
                at = max(m.start(1), at - _LONGEST_CONTEXT)
    return [(KINDS[k], s, e, score) for s, k, e, score in sorted(found)]


def secret_spans(df: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """``df`` with ``out_col``: an array of (kind, start, end, score), by start, then kind in the order of ``KINDS``.

    Every whole text is scanned and every whole value judged, in time linear
    in its length; null and empty texts have no spans.  Rows are
    independent, so ties and repeated rows change nothing; an empty table
    gives an empty result; ``out_col`` replaces a column of that name.
    """
    find = spans_udf(find_secrets, ("kind", "start", "end", "score"))
    return df.withColumn(out_col, find(F.col(text_col).cast("string")))
