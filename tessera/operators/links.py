"""Links out of HTML: anchor scan (no folder structure) and link-export parsing.

``scan_anchors``: every ``<a ...>text</a>`` in document order, href from a
double-quoted, single-quoted or bare attribute value, title = visible text;
empty/missing href dropped, other schemes and relative links kept.

``parse_exports``: the link-export format (``<DL>`` lists of ``<DT>`` items
holding ``<H3>`` folder names or ``<A>`` links).  Comments go first, then the
text is tokenised with ``regexp_extract_all`` into DL-open, DL-close, H3, DT and
A tokens.  Where a token stands in the tree needs a stack, so one Arrow UDF
walks each file's token kinds (never its text) and returns the link tokens
with their folder paths: linear, no shuffle, any depth.  Only the first
top-level list counts; a nested list with no H3 right before it hides its
links.  A file without any list is scanned flat: every anchor is a link
without folder, date or icon.
"""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.html import COMMENT_RE, TAG_RE, decode_entities, pre_clean
from tessera.functions.text import normalize_ws

# Attributes are read as quoted values, bare values or names, so a '>' inside
# quotes does not end the tag.  An anchor's text ends at </a>, at the next <a
# or at the end of the page.  ANCHOR_RE states the rule for engines whose
# matching needs no stack; Java's does, so the scan cuts pages at their anchors.
ATTRS_RE2 = r"""(?:\s(?:"[^"]*"|'[^']*'|[^>"'])*)?"""
ANCHOR_RE = rf"(?is)<a({ATTRS_RE2})>([^<]*(?:<(?:[^a/]|a[^\s>]|/[^a]|/a[^\s>])[^<]*)*)"
ATTRS = r"""(?:\s(?:"[^"]*+"|'[^']*+'|[^>"']++)*+)?"""
OPEN_RE, CLOSE_RE = r"(?i)<a(?=[\s>])", r"(?i)</a(?=[\s>])"


def attr_re(name: str) -> str:
    """An attribute with a double-quoted, single-quoted or bare value (groups 1-3)."""
    return rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def attr_raw(attrs: Column, name: str) -> Column:
    """An attribute as written in a tag's attribute text ('' when absent)."""
    pat = attr_re(name)
    return F.concat(F.regexp_extract(attrs, pat, 1), F.regexp_extract(attrs, pat, 2), F.regexp_extract(attrs, pat, 3))


def attr_value(attrs: Column, name: str) -> Column:
    """Value of an attribute: ``attr_raw`` with its character references resolved."""
    return decode_entities(attr_raw(attrs, name))


def anchor_title(inner: Column) -> Column:
    """Visible text of an anchor; tags inside it leave no space behind."""
    return normalize_ws(decode_entities(F.regexp_replace(inner, TAG_RE, "")))


def scan_anchors(pages: DataFrame, key: str = "page_id", html_col: str = "html",
                 keep_empty: bool = False) -> DataFrame:
    """key, pos (0-based anchor position), url, title."""
    tag = rf"(?s)^({ATTRS})>"
    parts = F.split(pre_clean(F.col(html_col)), OPEN_RE)
    cut = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.rlike(tag))

    def anchor(x: Column) -> Column:
        attrs = F.regexp_extract(x, tag, 1)
        body = x.substr(F.length(attrs) + 2, F.length(x))
        return F.struct(attrs.alias("attrs"), F.element_at(F.split(body, CLOSE_RE, 2), 1).alias("inner"))

    out = (pages.select(key, F.posexplode(F.transform(cut, anchor)).alias("pos", "z"))
           .select(key, F.col("pos").cast("int").alias("pos"), attr_raw(F.col("z.attrs"), "href").alias("raw"), "z.inner"))
    out = out if keep_empty else out.where(F.length("raw") > 0)
    return out.select(key, "pos", decode_entities(F.col("raw")).alias("url"), anchor_title(F.col("inner")).alias("title"))


# --- link exports ----------------------------------------------------------

# Text of a link: up to a tag that is no inline markup.
INLINE = r"</?(?:b|i|u|em|strong|span|font|small|code|sub|sup)(?:\s[^>]*)?>"
LINK_RE = rf"(?is)^<a({ATTRS})>([^<]*(?:{INLINE}[^<]*)*)"
TOKEN_RE = (rf"(?is)(<dl\b[^>]*>|</dl\s*>|<h3\b[^>]*>[^<]*(?:{INLINE}[^<]*)*</h3\s*>|<dt\b[^>]*>"
            rf"|<a{ATTRS}>[^<]*(?:{INLINE}[^<]*)*)")
PLACES = T.ArrayType(T.StructType([T.StructField("tok", T.IntegerType()), T.StructField("folder", T.StringType()),
                                   T.StructField("listed", T.BooleanType())]))


def place_links(kinds: list[str], names: list[str]) -> list[tuple[int, str, bool]]:
    """(1-based token, folder path, True) of the links of one file, by a stack of list names; without any list
    all links, False.  Kinds: o(pen), c(lose), h(3), d(t), a."""
    if "o" not in kinds:
        return [(k, "", False) for k, kind in enumerate(kinds, 1) if kind == "a"]
    out, stack, hidden = [], [], 0
    before, heading = "", None  # the token before; (name, depth) if the last token but DTs was an H3
    for k, (kind, name) in enumerate(zip(kinds, names), 1):
        if kind == "o":
            named = heading is not None and heading[1] == len(stack)
            stack.append(heading[0] if named else None)
            hidden += len(stack) > 1 and not named
        elif kind == "c" and stack:
            if len(stack) == 1:
                break  # the first top-level list ends
            hidden -= stack.pop() is None
        elif kind == "a" and stack and before == "d" and not hidden:
            out.append((k, "/".join(stack[1:]), True))
        if kind != "d":
            heading = (name, len(stack)) if kind == "h" else None
        before = kind
    return out


@F.arrow_udf(PLACES)
def _places(kinds: pa.Array, names: pa.Array) -> pa.Array:
    fields = ("tok", "folder", "listed")
    shown = lambda n: " ".join(html.unescape(n).split()) if n else ""  # noqa: E731 (white space as normalize_ws has it)
    rows = [[dict(zip(fields, x)) for x in place_links(k or [], [shown(n) for n in names_of or []])]
            for k, names_of in zip(kinds.to_pylist(), names.to_pylist())]
    return pa.array(rows, pa.list_(pa.struct([("tok", pa.int32()), ("folder", pa.string()), ("listed", pa.bool_())])))


def parse_add_date(raw: Column, ingest_ts: Column) -> Column:
    """Epoch seconds (possibly fractional) -> timestamp; missing, empty,
    non-numeric or out of year range 1..9999 (e.g. milliseconds) -> ingest_ts."""
    number = raw.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")  # no type suffixes, no hex
    secs = F.when(number, F.trim(raw).try_cast("double"))
    ok = secs.isNotNull() & ~F.isnan(secs) & (secs >= -62135596800.0) & (secs < 253402300800.0)
    ts = F.timestamp_micros(F.round(secs * 1_000_000).cast("bigint"))
    return F.when(ok, ts).otherwise(ingest_ts)


def parse_exports(exports: DataFrame, ingest_ts: Column, file_col: str = "file_id",
                  content: str = "content") -> DataFrame:
    """file_id, pos, url, title, folder, date_added, icon: every link of every
    export in document order (duplicates kept; empty href dropped)."""
    kind = lambda t: (F.when(F.lower(t).startswith("<dl"), "o").when(F.lower(t).startswith("</dl"), "c")
                      .when(F.lower(t).startswith("<h3"), "h").when(F.lower(t).startswith("<dt"), "d").otherwise("a"))
    name = lambda t: F.when(F.lower(t).startswith("<h3"), F.regexp_replace(t, TAG_RE, "")).otherwise(F.lit(""))
    tok = exports.select(file_col, F.regexp_extract_all(
        F.regexp_replace(content, COMMENT_RE, " "), F.lit(TOKEN_RE), 1).alias("_toks"))
    tok = tok.select(file_col, "_toks", F.transform("_toks", kind).alias("_kinds"), F.transform("_toks", name).alias("_names"))
    tok = tok.select(file_col, "_toks", _places("_kinds", "_names").alias("_places"))

    def link(p: Column) -> Column:
        t = F.element_at("_toks", p["tok"])
        return F.struct(p["folder"].alias("folder"), p["listed"].alias("listed"), F.regexp_extract(t, LINK_RE, 1).alias("attrs"),
                        F.regexp_extract(t, LINK_RE, 2).alias("inner"))

    links = F.filter(F.transform("_places", link), lambda x: F.length(attr_raw(x["attrs"], "href")) > 0)
    out = tok.select(file_col, F.posexplode(links).alias("pos", "x"))
    icon = attr_value(F.col("x.attrs"), "icon")
    return out.select(
        file_col, F.col("pos").cast("int").alias("pos"), attr_value(F.col("x.attrs"), "href").alias("url"),
        anchor_title(F.col("x.inner")).alias("title"), F.col("x.folder").alias("folder"),
        F.when(F.col("x.listed"), parse_add_date(attr_value(F.col("x.attrs"), "add_date"), ingest_ts)).otherwise(ingest_ts).alias("date_added"),
        F.when(F.col("x.listed") & (icon != ""), icon).alias("icon"))
