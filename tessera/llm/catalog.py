"""Registered queries of this subpackage: ``name -> fn(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_round_trip
from tessera.llm.common import documents, prepare, scratch_path
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.filter_audit import audit_orders, failure_masks
from tessera.llm.mixing import mix_sources, word_count
from tessera.llm.pii import BASE_KINDS as PII_BASE
from tessera.llm.pii import count_kind, pii_spans, spans_text
from tessera.llm.prefix_trie import prefix_trie
from tessera.llm.quality_classifier import CUT, fit_quality, fold, score_quality
from tessera.llm.quality_rules import BASE, RULES, quality_cascade, text_metrics
from tessera.llm.recompression import repeated_words
from tessera.llm.secrets import secret_spans
from tessera.llm.simhash import simhash_groups
from tessera.llm.suffix_dedup import repeated_bytes
from tessera.llm.token_files import read_token_files, write_token_files

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(documents(prepare(spark), sf_dir), sf_dir)
        REGISTRY[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_exact_dedup", """
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                      sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256,
                      regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
               FROM documents),
    g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
          FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id))
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""")
def op1_exact_dedup(docs, sf_dir):
    return exact_dedup(docs)


OP10_METRICS_SQL = r"""
    t AS (SELECT doc_id, coalesce(text, '') AS text,
                 list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
          FROM documents),
    w AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS p,
                 unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS s FROM t),
    again AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM w) WHERE c > 1),
    r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + 5)) AS q FROM again) GROUP BY doc_id),
    m AS (SELECT t.doc_id, len(words)::BIGINT AS n_words,
                 length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                 length(regexp_replace(text, '\P{Lu}+', '', 'g'))::BIGINT AS n_upper,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
                 coalesce(r.n, 0)::BIGINT AS n_repeat_words
          FROM t LEFT JOIN r ON t.doc_id = r.doc_id)"""


@query("op10_quality_rules", f"""WITH {OP10_METRICS_SQL}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 4 * n_symbols > n_words OR n_upper > 2 * n_words
                OR (n_lines > 0 AND 100 * n_dup_lines // n_lines > 50)
                OR word_chars > 40 * n_words OR 2 * word_chars < 3 * n_words) AS kept
    FROM m""")
def op10_quality_rules(docs, sf_dir):
    judged = quality_cascade(text_metrics(docs.select("doc_id", "text")), measured=True)
    base = [r.rejects(F.col(r.metric), F.col("n_words")) for r in RULES if r.name in BASE]
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         (base[0] | base[1]).alias("base_failed"), F.col("failed_rule").isNull().alias("kept"))


@query("op9_mix_sources")
def op9_mix_sources(docs, sf_dir):
    sized = docs.select("doc_id", "source", word_count("text").alias("words"))
    mixed = mix_sources(sized, size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def tokenizer_file() -> str:
    """The vocabulary file of the BPE query; its place is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_bpe")
def op5_bpe(docs, sf_dir):
    path = tokenizer_file()
    coded = bpe_round_trip(docs.select("doc_id", "text"), path)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


#: Contract of the near-duplicate query and of the pipeline's stage.
SHINGLE_WORDS, MAX_BITS = 3, 2


@query("op2_simhash")
def op2_simhash(docs, sf_dir):
    return simhash_groups(docs.select("doc_id", "text"), shingle_words=SHINGLE_WORDS, max_bits=MAX_BITS)


@query("op7_pii")
def op7_pii(docs, sf_dir):
    found = pii_spans(docs.select("doc_id", "text"))
    return found.select("doc_id", *[count_kind(F.col("pii"), k).alias(f"n_{k}") for k in PII_BASE],
                        F.sha2(spans_text(F.col("pii"), PII_BASE), 256).alias("base_sha256"),
                        spans_text(F.col("pii")).alias("spans"))


SECRET_BASE = ("assign", "access", "hex")


@query("op8_secrets")
def op8_secrets(docs, sf_dir):
    found = secret_spans(docs.select("doc_id", "text"))
    return found.select("doc_id", *[count_kind(F.col("secrets"), k).alias(f"n_{k}") for k in SECRET_BASE],
                        F.sha2(spans_text(F.col("secrets"), SECRET_BASE), 256).alias("base_sha256"),
                        spans_text(F.col("secrets")).alias("spans"))


@query("op3_quality_classifier")
def op3_quality_classifier(docs, sf_dir):
    labels = docs.sparkSession.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = fit_quality(docs, labels)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))


@query("op6_substring_dedup")
def op6_substring_dedup(docs, sf_dir):
    kept = repeated_words(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_suffix_dedup")
def op4_suffix_dedup(docs, sf_dir):
    kept = repeated_bytes(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
    WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                      list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                      min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END)
                 || (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END)
                 || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END)
                 || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
                 || (CASE WHEN t.doc_id > least THEN 'E' ELSE '' END) AS fails
          FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
    m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
    orders AS (SELECT '' AS o, 0 AS n UNION ALL
               SELECT o || x, n + 1 FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE n < 5 AND NOT contains(o, x)),
    cell AS (SELECT part, o AS filter_order, s::INT AS step, substr(o, s, 1) AS x, substr(o, 1, s) AS head, substr(o, 1, s - 1) AS before
             FROM (SELECT DISTINCT part FROM m), orders, range(1, 6) r(s) WHERE n = 5),
    c AS (SELECT cell.part, filter_order, step, x,
                 sum(CASE WHEN translate(fails, head, '') = fails THEN n ELSE 0 END)::BIGINT AS kept,
                 sum(CASE WHEN contains(fails, x) AND translate(fails, before, '') = fails THEN n ELSE 0 END)::BIGINT AS removed,
                 sum(CASE WHEN contains(fails, x) AND translate(fails, before, '') <> fails THEN n ELSE 0 END)::BIGINT AS redundant,
                 sum(CASE WHEN fails = x THEN n ELSE 0 END)::BIGINT AS unique_fails,
                 sum(CASE WHEN contains(fails, x) AND translate(fails, before, '') = fails THEN good ELSE 0 END)::BIGINT AS good_lost,
                 sum(CASE WHEN contains(fails, x) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
          FROM cell JOIN m ON m.part = cell.part GROUP BY cell.part, filter_order, step, x)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM c"""


@query("op11_filter_audit", OP11_SQL)
def op11_filter_audit(docs, sf_dir):
    labels = docs.sparkSession.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return audit_orders(failure_masks(docs, labels))


def word_tokenizer_file() -> str:
    """The vocabulary file of the token file query; its place is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Contract of the token file query: the id that ends each document.
END_ID = 2


@query("op12_token_files")
def op12_token_files(docs, sf_dir):
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, word_tokenizer_file(), end_id=END_ID)
    return read_token_files(spark, path)


#: Contract of the trie query: conversations share the head of the first of each hundred, five turns at most.
CONV_GROUP, HEAD_MOD = 100, 6


@query("op13_prefix_trie")
def op13_prefix_trie(docs, sf_dir):
    conversations = docs.sparkSession.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    return prefix_trie(conversations, group=CONV_GROUP, head_mod=HEAD_MOD)
