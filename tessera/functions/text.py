"""Text column expressions: whitespace, sentences, tokens, hashing.

Every function here returns a ``Column`` built from Spark built-ins, so it
stays inside whole-stage codegen (or the JVM expression evaluator for the
higher-order functions).  The regular expressions use only the subset that
Java regex and RE2 read alike, so the DuckDB oracle can reuse them verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode whitespace that Python's ``\s`` matches in str
# patterns (Java's and RE2's ``\s`` are ASCII only, so the class is spelled
# out).  ``\x{..}`` is understood by both Java regex and RE2.
WS_CLASS = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
WS_RUN = WS_CLASS + "+"
# The same set for Java regex, spelled as the Unicode White_Space property
# plus U+001C..U+001F: one property test per character instead of a chain of
# eleven ranges (about 3x faster).  RE2 has no White_Space property, so the
# SQL twin keeps WS_RUN.
WS_JAVA = r"[\p{IsWhite_Space}\x{1C}-\x{1F}]+"

# Sentence rule: a sentence ends after '.', '!' or '?' followed by a space
# (applied to whitespace-normalised text).
SENTENCE_END = r"([.!?]) "

# Word tokens for the hash embedder: runs of letters and digits.
WORD_TOKEN = r"[\p{L}\p{N}]+"


def normalize_ws(col: Column) -> Column:
    """Runs of (Unicode) whitespace become one space; ends trimmed."""
    return F.trim(F.regexp_replace(col, WS_JAVA, " "))


def split_sentences(norm_text: Column) -> Column:
    """array<string> of sentences of a normalised text; empty text -> []."""
    marked = F.regexp_replace(norm_text, SENTENCE_END, "$1\n")
    return F.filter(F.split(marked, "\n"), lambda s: s != "")


def word_count(col: Column) -> Column:
    """Whitespace-separated word count of a normalised string."""
    return F.when(col == "", F.lit(0)).otherwise(F.size(F.split(col, " ")))


def word_tokens(col: Column) -> Column:
    """Lower-cased letter/digit runs, in order, duplicates kept."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD_TOKEN), 0)


def token_hash(tok: Column) -> Column:
    """First 32 bits of md5(token) as a non-negative bigint."""
    return F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint")


def token_hash_codes(text: Column) -> Column:
    """array<bigint>: the distinct ``token_hash`` values of the word tokens of ``text``."""
    return F.array_distinct(F.transform(word_tokens(text), token_hash))


def flatten_newlines(col: Column) -> Column:
    """'\\n' -> ' ' (what a hosted embedding API is sent)."""
    return F.translate(col, "\n", " ")
