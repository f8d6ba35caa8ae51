"""Personal data: regular expressions propose, checksums confirm, context scores.

Patterns propose spans; what a checksum can judge (Luhn for cards, mod 97
for bank accounts) must pass it.  A span's score starts from its kind and is
raised when a word that belongs to the kind stands close before or after it.
Spans of kinds without a base rule (bank accounts, social security numbers)
count from a score threshold on.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns.  Quantifiers are possessive and starts guarded where that changes no match but saves rescans.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Characters of an account number by country (fixed values of the registry).
IBAN_LENGTH = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items() for c in countries.split()}
_DIGITS = re.compile(r"[0-9]")

#: Kinds in the order in which spans are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
#: Score of a confirmed match without context; context words close by; what they add; characters looked at on each side.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"), "ssn": ("ssn", "social", "security", "taxpayer"),
}
_CONTEXT_RE = {k: re.compile(r"(?<![a-z])(?:" + "|".join(v) + ")", re.ASCII | re.IGNORECASE) for k, v in CONTEXT.items()}
CONTEXT_GAIN = 0.3
CONTEXT_CHARS = 40
#: Spans of kinds beyond the base are reported from this score on.
THRESHOLD = 0.6


def luhn(digits: str) -> bool:
    """Checksum of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Checksum of international bank account numbers (letters and digits only, upper case)."""
    value = 0
    for c in account[4:] + account[:4]:
        n = int(c, 36)
        value = (value * (100 if n > 9 else 10) + n) % 97
    return value == 1


def _iban_length(match: str) -> int:
    """How much of the match is an account number (0: nothing): what its country's length says, or the longest run of whole words that passes."""
    ends = [k for k in range(len(match), 11, -1) if k == len(match) or match[k] == " "]
    if size := IBAN_LENGTH.get(match[:2]):
        ends = [k for k in ends if k - match.count(" ", 0, k) == size] + ends[:1]
    return next((k for k in ends if mod97(match[:k].replace(" ", ""))), 0)


def _ibans(text: str):
    """Account numbers; a match takes in words that follow the number, so it is cut, and the search goes on behind the cut or inside a match without one."""
    m = _IBAN.search(text)
    while m:
        n = _iban_length(m.group())
        if n:
            yield m.start(), m.start() + n
        m = _IBAN.search(text, m.start() + (n or 1))


def _emails(text: str):
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each ``@`` in linear time.

    A match can start anywhere in the run of name characters before an ``@``,
    and whether it succeeds depends on what follows the ``@`` only; so the
    leftmost one starts where the run starts, or where the last match ended.
    """
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _card_ok(match: str) -> bool:
    digits = match.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(match: str) -> bool:
    return 9 <= sum(map(str.isdigit, match)) <= 15


def _ip_ok(match: str) -> bool:
    return all(int(p) <= 255 if len(p) < 10 else not p[:-3].strip("0") and int(p[-3:]) <= 255 for p in match.split("."))


def _kept(pattern: re.Pattern, check, text: str):
    return ((m.start(), m.end()) for m in pattern.finditer(text) if check is None or check(m.group()))


def find_pii(text: str) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by kind, then start; code points, end exclusive."""
    found = []
    if "@" in text:
        found += [("email", *s) for s in _emails(text)]
    if _DIGITS.search(text):
        found += [("ip", *s) for s in _kept(_IP, _ip_ok, text)]
        found += [("card", *s) for s in _kept(_CARD, _card_ok, text)]
        if "+" in text:
            found += [("phone", *s) for s in _kept(_PHONE, _phone_ok, text)]
        found += [("iban", *s) for s in _ibans(text)]
        found += [("ssn", *s) for s in _kept(_SSN, None, text)]
    out = []
    for kind, start, end in found:
        near = _CONTEXT_RE[kind].search(text[max(0, start - CONTEXT_CHARS):start]) or _CONTEXT_RE[kind].search(text[end:end + CONTEXT_CHARS])
        score = min(1.0, SCORES[kind] + (CONTEXT_GAIN if near else 0.0))
        if kind in BASE_KINDS or score >= THRESHOLD:
            out.append((kind, start, end, score))
    return out


SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans_udf(find, fields: tuple[str, ...]):
    """Arrow UDF: text -> the spans that ``find`` gives (null text: none)."""
    kinds = {"kind": pa.string(), "start": pa.int32(), "end": pa.int32(), "score": pa.float64()}
    arrow = pa.list_(pa.struct([(f, kinds[f]) for f in fields]))

    @F.arrow_udf(SPAN_TYPE)
    def spans(column: pa.Array) -> pa.Array:
        rows = [[dict(zip(fields, s, strict=True)) for s in find(t)] if t else [] for t in column.to_pylist()]
        return pa.array(rows, arrow)

    return spans


def pii_spans(df: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``df`` with ``out_col``: an array of (kind, start, end, score), by kind in the order of ``KINDS``, then start.

    Every whole text is scanned; null and empty texts have no spans; texts of
    one endless run of name or digit characters are scanned in linear time.
    Rows are independent, so ties and repeated rows change nothing; an empty
    table gives an empty result; ``out_col`` replaces a column of that name.
    """
    find = spans_udf(find_pii, ("kind", "start", "end", "score"))
    return df.withColumn(out_col, find(F.col(text_col).cast("string")))


def spans_text(spans, kinds: tuple[str, ...] | None = None):
    """The spans joined as ``kind:start:end`` with commas, all or those of ``kinds``."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
