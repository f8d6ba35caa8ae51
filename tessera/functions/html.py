"""HTML to main text: native tokenising, one small Arrow walk over tag codes.

Rule (our own, in place of an article-scoring library):
  1. drop comments, then ``<script>`` and ``<style>`` blocks (scripts first:
     their bodies may hold markup such as ``"</p>"``); a block that never ends
     takes the rest of the page with it;
  2. keep the inside of the first ``<article>`` .. last ``</article>`` if any,
     else ``<main>``, else ``<body>``, else the whole page;
  3. drop ``nav``, ``footer``, ``aside`` elements, and elements of any tag whose
     ``class`` or ``id`` value *contains* nav / footer / ads / sidebar /
     header, case-insensitively, with all that is nested inside; an element
     that is not closed ends with its parent;
  4. every tag becomes a space, entities are decoded, whitespace normalised;
  5. text shorter than 100 characters (or blank) -> null.
Tokens (tags with quoted attributes, text) are cut and coded by the JVM, once
for each page; one Arrow batch walk then goes over them in time linear in
their number, keeps the visible text and resolves all character references
(named and numeric, longest match) in one pass.  ``walked_text`` has a switch
for each step, so a query that shows one step runs the same walk as ingest.
"""

from __future__ import annotations

import html as stdlib_html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import normalize_ws

MIN_TEXT_CHARS = 100

# Tags removed with their content, and the attribute words that mark noise.
NOISE_TAGS = ("script", "style", "nav", "footer", "aside")
NOISE_WORDS = "nav|footer|ads|sidebar|header"
COMMENT_RE = r"(?s)<!--.*?-->"
TAG_RE = r"<[^>]*>"


@F.arrow_udf(T.StringType())
def decode_entities(texts: pa.Array) -> pa.Array:
    """All character references resolved: named, decimal and hexadecimal, by the longest name that fits."""
    return pa.array([t if t is None or "&" not in t else stdlib_html.unescape(t) for t in texts.to_pylist()], pa.string())


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, TAG_RE, " ")


def pre_clean(html: Column) -> Column:
    """Comments, scripts and styles removed (step 1)."""
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", " "), r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)", " ")


def visible_text(fragment: Column) -> Column:
    """Tags -> spaces, entities decoded, whitespace normalised (step 4 alone)."""
    return normalize_ws(decode_entities(strip_tags(fragment)))


# Elements without content.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
_ATTRS = r"""(?:\s(?:"[^"]*+"|'[^']*+'|[^>"'])*+)?+"""
TOKEN_RE = rf"(</?[A-Za-z][A-Za-z0-9:-]*+{_ATTRS}/?>|<[!?][^>]*+>|[^<]++|<)"
MARKED_RE = (rf"""(?is)\s(?:class|id)\s*=\s*(?:"[^"]*(?:{NOISE_WORDS})[^"]*"|'[^']*(?:{NOISE_WORDS})[^']*'"""
             rf"""|[^\s"'>]*(?:{NOISE_WORDS}))""")
REGIONS = ("article", "main", "body")


def _code(token: Column, tags: bool, attrs: bool) -> Column:
    """'' for text; '+name', '!name' (noise) or '-name' for an opening, noise or closing tag; '.' for what has no content."""
    name = F.lower(F.regexp_extract(token, "^</?([A-Za-z][A-Za-z0-9:-]*)", 1))
    noise = (name.isin(*NOISE_TAGS) if tags else F.lit(False)) | (token.rlike(MARKED_RE) if attrs else F.lit(False))
    return (F.when(~token.startswith("<") | (token == "<"), "").when((name == "") | name.isin(*VOID_TAGS) | token.endswith("/>"), ".")
            .when(token.startswith("</"), F.concat(F.lit("-"), name))
            .otherwise(F.concat(F.when(noise, "!").otherwise("+"), name)))


def text_tokens(codes: list[str], regions: bool = True) -> list[int]:
    """Numbers (from 0) of the text tokens in the page's region and outside noise."""
    begin, end = 0, len(codes)
    for region in REGIONS if regions else ():
        opens = [k for k, c in enumerate(codes) if c[1:] == region and c[0] in "+!"]
        last = max((k for k, c in enumerate(codes) if c == "-" + region), default=-1)
        if opens and opens[0] < last:
            begin, end = opens[0] + 1, last
            break
    out, stack, noise, depth = [], [], 0, {}
    for k in range(begin, end):
        c = codes[k]
        if not c:
            if not noise:
                out.append(k)
        elif c[0] == "-":
            name = c[1:]
            if depth.get(name):  # closes the innermost such element and all that is open inside it
                while True:
                    top, is_noise = stack.pop()
                    noise -= is_noise
                    depth[top] -= 1
                    if top == name:
                        break
        elif c != ".":
            stack.append((c[1:], c[0] == "!"))
            noise += c[0] == "!"
            depth[c[1:]] = depth.get(c[1:], 0) + 1
    return out


def _page_text(page: pa.Scalar, regions: bool) -> str | None:
    if not page.is_valid:
        return None
    token, code = (page.values.field(k).to_pylist() for k in (0, 1))
    return stdlib_html.unescape(" ".join([token[k] for k in text_tokens(code, regions)]))


def _walk(regions: bool):
    @F.arrow_udf(T.StringType())
    def walk(pages: pa.Array) -> pa.Array:
        return pa.array([_page_text(page, regions) for page in pages], pa.string())
    return walk


GUARDED_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "error", "message")])


@F.arrow_udf(GUARDED_TEXT)
def _guarded_walk(pages: pa.Array) -> pa.Array:
    rows = []
    for page in pages:
        try:
            rows.append({"text": _page_text(page, True)})
        except Exception as fault:  # the page's own fault: it becomes a row
            rows.append({"error": type(fault).__name__, "message": str(fault)})
    return pa.array(rows, pa.struct([(c, pa.string()) for c in GUARDED_TEXT.names]))


def _page_tokens(html: Column, tags: bool = True, attrs: bool = True) -> Column:
    tokens = F.regexp_extract_all(pre_clean(html), F.lit(TOKEN_RE), 1)
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), _code(t, tags, attrs).alias("code")))


def walked_text(html: Column, regions: bool = True, tags: bool = True, attrs: bool = True) -> Column:
    """Visible text of a page (null for null), with steps 2 and 3 (tags, attributes) as wanted."""
    return normalize_ws(_walk(regions)(_page_tokens(html, tags, attrs)))


def main_text(html: Column) -> Column:
    """Text of a page by steps 1 to 4 (null for null)."""
    return walked_text(html)


def clean_html(html: Column) -> Column:
    """Main text of a page or null (the whole rule above); the text is bound once, so it is computed once."""
    return F.get(F.filter(F.array(main_text(html)), lambda t: F.length(t) >= MIN_TEXT_CHARS), F.lit(0))


def clean_html_guarded(html: Column) -> Column:
    """struct(text, error, message): the main text or null as ``clean_html`` has it; where a page's walk raises
    (a numeric reference too long to read, say), the exception's type and message, and the job goes on."""
    page = F.array(_guarded_walk(_page_tokens(html)))

    def judged(p: Column) -> Column:
        text = normalize_ws(p["text"])
        return F.struct(F.when(F.length(text) >= MIN_TEXT_CHARS, text).alias("text"), p["error"].alias("error"), p["message"].alias("message"))

    return F.get(F.transform(page, judged), F.lit(0))


def page_title(html: Column) -> Column:
    t = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return normalize_ws(decode_entities(t))
