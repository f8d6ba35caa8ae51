"""``ORACLES``: registered query name -> DuckDB SQL computing the same rows."""

from __future__ import annotations

from tessera.operators.chunk import DEFAULT_OVERLAP, DEFAULT_STRATEGIES, DEFAULT_CHUNK_SIZE
from tessera.plans.oracle_sql import (
    chunk_ctes, compare_chunking_sql, doc_url, hash_ctes, rank_score, sentence_ctes,
)

ORACLES: dict[str, str] = {}

SENT = "WITH RECURSIVE " + sentence_ctes("documents", "doc_id", "text")

ORACLES["sentences"] = SENT + """
SELECT doc_id, CAST(b AS INTEGER) AS sent_index, sentence FROM srows"""

ORACLES["sentence_tokens"] = SENT + """
SELECT doc_id, CAST(b AS INTEGER) AS sent_index, CAST(tok AS INTEGER) AS n_tokens FROM srows"""

ORACLES["sentence_offsets"] = SENT + """
SELECT doc_id, CAST(b AS INTEGER) AS sent_index, CAST(c AS INTEGER) AS start,
       CAST(c + len AS INTEGER) AS "end" FROM sp"""

DEF = SENT + "," + chunk_ctes("doc_id", DEFAULT_CHUNK_SIZE, DEFAULT_OVERLAP, "d4")
DEF_CHUNKS = DEF + f""",
dch AS (
  SELECT x.*, {doc_url('d.source', 'd.doc_id')} AS url,
         substr(s.t, x.c_start + 1, x.c_end - x.c_start) AS chunk_text
  FROM d4_chunks x JOIN sents s ON s.doc_id = x.doc_id JOIN documents d ON d.doc_id = x.doc_id
)"""

ORACLES["chunk_sentences"] = DEF_CHUNKS + """
SELECT doc_id, chunk_index, s_from, s_to, n_tokens FROM dch"""

ORACLES["chunk_text"] = DEF_CHUNKS + """
SELECT doc_id, chunk_index, chunk_text, c_start AS start, c_end AS "end" FROM dch"""

ORACLES["chunk_ids"] = DEF_CHUNKS + """
SELECT sha256(concat_ws(chr(1), url, CAST(chunk_index AS VARCHAR))) AS chunk_id, url, chunk_index FROM dch"""

ORACLES["chunk_empty"] = DEF_CHUNKS + """
SELECT d.doc_id, CAST(count(c.doc_id) AS BIGINT) AS n_chunks
FROM documents d LEFT JOIN dch c ON c.doc_id = d.doc_id GROUP BY d.doc_id"""

ORACLES["embed_hash"] = DEF_CHUNKS + """,
ek AS (SELECT doc_id || '/' || chunk_index AS ck, doc_id, chunk_index, chunk_text FROM dch),
""" + hash_ctes("ek", "ck", "chunk_text", 384, "e").lstrip() + """
SELECT ek.doc_id, ek.chunk_index, CAST(v.bucket AS INTEGER) AS bucket,
       round(CAST(v.w AS DOUBLE), 6) AS weight
FROM e_wv v JOIN ek ON ek.ck = v.ck WHERE v.w <> 0"""

ORACLES["compare_chunking"] = compare_chunking_sql()

_IX = "WITH RECURSIVE " + sentence_ctes("documents", "doc_id", "text") + "," + ",".join(
    chunk_ctes("doc_id", s, o, f"s{i}") for i, (_, s, o) in enumerate(DEFAULT_STRATEGIES))
ORACLES["index_size_by_strategy"] = _IX + "\n" + " UNION ALL ".join(
    f"SELECT '{n}' AS strategy, {s} AS chunk_size, {o} AS overlap, CAST(count(*) AS BIGINT) AS total_chunks, "
    f"CAST(count(DISTINCT doc_id) AS BIGINT) AS n_documents FROM s{i}_chunks"
    for i, (n, s, o) in enumerate(DEFAULT_STRATEGIES)).replace(
    "AS chunk_size", "::INTEGER AS chunk_size").replace("AS overlap,", "::INTEGER AS overlap,")


def _cos(a: str, b: str) -> str:
    da, db = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    den = f"(sqrt(list_dot_product({da}, {da})) * sqrt(list_dot_product({db}, {db})))"
    return f"(CASE WHEN {den} = 0 THEN 'NaN'::DOUBLE ELSE list_dot_product({da}, {db}) / {den} END)"


ORACLES["cosine_score"] = f"""
SELECT a.vec_id, b.vec_id AS next_vec_id, round({_cos('a.embedding', 'b.embedding')}, 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""

ORACLES["topk"] = f"""
WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT e.vec_id, {_cos('e.embedding', 'q.embedding')} AS score FROM embeddings e, q)
SELECT CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM (
  SELECT vec_id, score, row_number() OVER (ORDER BY {rank_score('score')} DESC, vec_id) AS rank FROM s)
WHERE rank <= 5"""

LOO = f"""
pairs AS (
  SELECT q.vec_id AS query_id, q.label AS q_label, e.vec_id, e.label,
         {_cos('e.embedding', 'q.embedding')} AS score
  FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {rank_score('score')} DESC, vec_id) AS rank
  FROM pairs
)"""

ORACLES["topk_batch"] = f"""WITH {LOO}
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM ranked WHERE rank <= 5"""

# same-label search: rank within label
ORACLES["no_score_floor"] = f"""WITH
pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id, {_cos('e.embedding', 'q.embedding')} AS score
  FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id AND e.label = q.label
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {rank_score('score')} DESC, vec_id) AS rank
  FROM pairs
)
SELECT q.vec_id AS query_id, CAST(count(r.vec_id) AS BIGINT) AS n_hits
FROM embeddings q LEFT JOIN ranked r ON r.query_id = q.vec_id AND r.rank <= 50
GROUP BY q.vec_id"""

LABEL_METRICS = f"""WITH {LOO},
hits AS (SELECT query_id, rank, vec_id, (label = q_label) AS is_rel FROM ranked WHERE rank <= 5),
agg AS (
  SELECT query_id, count(*) FILTER (WHERE rank <= 5 AND is_rel) AS hk,
         count(*) FILTER (WHERE is_rel) AS ha,
         count(DISTINCT CASE WHEN is_rel THEN vec_id END) AS hd,
         min(CASE WHEN is_rel THEN rank END) AS fr
  FROM hits GROUP BY query_id
),
nt AS (SELECT label, count(*) - 1 AS n_truth FROM embeddings GROUP BY label),
perq AS (
  SELECT e.vec_id AS query_id,
         coalesce(a.hk, 0) / 5.0 AS precision_at_k,
         CASE WHEN n.n_truth > 0 THEN coalesce(a.ha, 0) / n.n_truth ELSE 0.0 END AS recall,
         CASE WHEN n.n_truth > 0 THEN coalesce(a.hd, 0) / n.n_truth ELSE 0.0 END AS recall_distinct,
         coalesce(1.0 / a.fr, 0.0) AS mrr
  FROM embeddings e JOIN nt n ON n.label = e.label LEFT JOIN agg a ON a.query_id = e.vec_id
)"""

ORACLES["precision_at_k"] = LABEL_METRICS + "\nSELECT query_id, round(precision_at_k, 6) AS precision_at_k FROM perq"
ORACLES["recall"] = LABEL_METRICS + ("\nSELECT query_id, round(recall, 6) AS recall, "
                                     "round(recall_distinct, 6) AS recall_distinct FROM perq")
ORACLES["mrr"] = LABEL_METRICS + "\nSELECT query_id, round(mrr, 6) AS mrr FROM perq"
ORACLES["eval_means"] = LABEL_METRICS + """
SELECT CAST(count(*) AS BIGINT) AS n_questions, round(avg(precision_at_k), 6) AS mean_precision_at_k,
       round(avg(recall), 6) AS mean_recall, round(avg(recall_distinct), 6) AS mean_recall_distinct,
       round(avg(mrr), 6) AS mean_mrr FROM perq"""


# --- pages -------------------------------------------------------------------

from tessera.plans import oracle_sql as O  # noqa: E402
from tessera.plans import pages as PG  # noqa: E402

FETCH = "WITH " + O.fetched_ctes(0, "f")

ORACLES["read_crawl"] = FETCH + """
SELECT page_id, url, origin, http_status, content_type, transport_error, CAST(length(body) AS INTEGER) AS body_chars
FROM f_log"""

ORACLES["url_origin"] = f"SELECT page_id, {O.url_origin('url')} AS origin FROM pages"

ORACLES["robots_gate"] = FETCH + "\nSELECT page_id, url, allowed FROM f"

ORACLES["fetch_outcome"] = FETCH + "\nSELECT page_id, status_code, error, (content IS NOT NULL) AS has_content FROM f"

ORACLES["fetch_failed"] = FETCH + "\nSELECT page_id, fetch_failed, fail_reason FROM f"

_PC = f"(SELECT page_id, html, {O.pre_clean('html')} AS pc FROM pages)"

ORACLES["main_text"] = f"""
SELECT page_id, CASE WHEN length(b) >= {O.MIN_TEXT_CHARS} THEN b END AS text
FROM (SELECT page_id, {O.clean_body('pc')} AS b FROM {_PC})"""

ORACLES["drop_noise_tags"] = f"""
SELECT page_id, CAST(length(html) AS INTEGER) AS html_chars, {O.visible_text(O.drop_blocks('pc'))} AS text
FROM {_PC}"""

ORACLES["drop_noise_attrs"] = f"SELECT page_id, {O.visible_text(O.drop_noise_attrs('pc'))} AS text FROM {_PC}"

ORACLES["normalize_ws"] = f"SELECT page_id, {O.visible_text('pc')} AS text FROM {_PC}"

ORACLES["min_text_length"] = f"""
SELECT page_id, CAST(length(b) AS INTEGER) AS n_chars, (length(b) >= {O.MIN_TEXT_CHARS}) AS kept
FROM (SELECT page_id, {O.clean_body('pc')} AS b FROM {_PC})"""

ORACLES["scan_anchors"] = "WITH " + O.anchors_cte("an") + "\nSELECT page_id, pos, url, title FROM an"

ORACLES["drop_empty_href"] = "WITH " + O.anchors_cte("an", keep_empty=True) + """
SELECT page_id, count(*) AS n_anchors, count(*) FILTER (WHERE length(url) > 0) AS n_kept FROM an GROUP BY page_id"""

ORACLES["url_domain"] = "WITH " + O.anchors_cte("an") + f""",
u AS (SELECT page_id, -1 AS pos, url FROM pages UNION ALL SELECT page_id, pos, url FROM an)
SELECT page_id, CAST(pos AS INTEGER) AS pos, url, {O.url_domain('url')} AS domain FROM u"""

LINKS0 = O.links_ctes(0, "k0")
LINKS1 = O.links_ctes(1, "k1")

ORACLES["ingest_outcome"] = "WITH " + LINKS0 + "\nSELECT page_id, url, outcome, reason FROM k0"

ORACLES["last_wins"] = "WITH " + O.anchors_cte("an") + """
SELECT url, arg_max(title, (page_id, pos)) AS title, arg_max(page_id, (page_id, pos)) AS file_id,
       arg_max(pos, (page_id, pos)) AS pos
FROM an GROUP BY url"""

_SNAP = "WITH RECURSIVE " + LINKS0 + "," + LINKS1 + """,
r0 AS (SELECT * FROM k0 WHERE outcome IN ('indexed', 'failed')),
r1 AS (SELECT * FROM k1 WHERE outcome IN ('indexed', 'failed')),
s0 AS (SELECT url, title, folder, date_added, domain, outcome AS status,
              TIMESTAMP '2024-06-01 00:00:00' AS created_at, TIMESTAMP '2024-06-01 00:00:00' AS updated_at FROM r0),
snap AS (
  SELECT coalesce(n.url, o.url) AS url,
         CASE WHEN n.url IS NOT NULL THEN n.title ELSE o.title END AS title,
         CASE WHEN n.url IS NOT NULL THEN n.folder ELSE o.folder END AS folder,
         CASE WHEN n.url IS NOT NULL THEN n.date_added ELSE o.date_added END AS date_added,
         CASE WHEN n.url IS NOT NULL THEN n.domain ELSE o.domain END AS domain,
         CASE WHEN n.url IS NOT NULL THEN n.outcome ELSE o.status END AS status,
         coalesce(o.created_at, TIMESTAMP '2024-07-01 00:00:00') AS created_at,
         CASE WHEN n.url IS NOT NULL THEN TIMESTAMP '2024-07-01 00:00:00' ELSE o.updated_at END AS updated_at
  FROM s0 o FULL OUTER JOIN r1 n ON n.url = o.url
)"""

ORACLES["upsert_links"] = _SNAP + "\nSELECT url, title, folder, date_added, domain, status, created_at, updated_at FROM snap"
ORACLES["list_urls"] = _SNAP + "\nSELECT url FROM snap"
ORACLES["get_by_url"] = _SNAP + """
SELECT p.url, s.title, s.folder, s.date_added, s.domain, s.status, s.created_at, s.updated_at
FROM pages p LEFT JOIN snap s ON s.url = p.url"""

_CH = (O.sentence_ctes("(SELECT url, text FROM r0 WHERE outcome = 'indexed')", "url", "text", "a_")
       + "," + O.chunk_ctes("url", 400, 50, "c0", "a_") + ","
       + O.sentence_ctes("(SELECT url, text FROM r1 WHERE outcome = 'indexed')", "url", "text", "b_")
       + "," + O.chunk_ctes("url", 400, 50, "c1", "b_") + """,
ch0 AS (SELECT url, chunk_index, sha256(concat_ws(chr(1), url, CAST(chunk_index AS VARCHAR))) AS chunk_id, 0 AS run FROM c0_chunks),
ch1 AS (SELECT url, chunk_index, sha256(concat_ws(chr(1), url, CAST(chunk_index AS VARCHAR))) AS chunk_id, 1 AS run FROM c1_chunks),
chs AS (SELECT * FROM ch0 WHERE url NOT IN (SELECT url FROM ch1) UNION ALL SELECT * FROM ch1)""")

ORACLES["replace_chunks"] = _SNAP + "," + _CH + "\nSELECT url, chunk_index, chunk_id, CAST(run AS INTEGER) AS run FROM chs"

ORACLES["index_stats"] = _SNAP + "," + _CH + """
SELECT (SELECT count(*) FROM snap) AS total_links,
       (SELECT count(*) FROM snap WHERE status = 'failed') AS failed_links,
       (SELECT count(*) FROM chs) AS total_chunks"""

ORACLES["ingest_progress"] = """
SELECT url, CAST(floor(page_id / 50) AS BIGINT) AS file_id,
       CAST(row_number() OVER (PARTITION BY floor(page_id / 50) ORDER BY page_id) AS BIGINT) AS current,
       CAST(count(*) OVER (PARTITION BY floor(page_id / 50)) AS BIGINT) AS total
FROM pages"""

ORACLES["ingest_summary"] = "WITH " + LINKS0 + """
SELECT CAST(floor(page_id / 50) AS BIGINT) AS file_id,
       CAST(count(*) FILTER (WHERE outcome = 'indexed') AS BIGINT) AS success,
       CAST(count(*) FILTER (WHERE outcome <> 'indexed') AS BIGINT) AS failed
FROM k0 GROUP BY ALL"""


# --- retrieval with link metadata (pages index) -------------------------------

from tessera.operators import answer as AN  # noqa: E402

_PIDX = "WITH RECURSIVE " + LINKS0 + """,
r0 AS (SELECT * FROM k0 WHERE outcome IN ('indexed', 'failed')),
""" + O.sentence_ctes("(SELECT url, text FROM r0 WHERE outcome = 'indexed')", "url", "text", "a_") + "," + \
    O.chunk_ctes("url", 400, 50, "c0", "a_") + """,
pix AS (
  SELECT sha256(concat_ws(chr(1), c.url, CAST(c.chunk_index AS VARCHAR))) AS chunk_id, c.url, c.chunk_index,
         substr(s.t, c.c_start + 1, c.c_end - c.c_start) AS chunk_text,
         r.title, r.folder, r.domain, r.date_added
  FROM c0_chunks c JOIN a_sents s ON s.url = c.url JOIN r0 r ON r.url = c.url
),
""" + O.hash_ctes("pix", "chunk_id", "chunk_text", 384, "pv") + """,
pq AS (
  SELECT page_id AS query_id, """ + O.page_title("html") + """ AS question,
         """ + O.first_segment("url") + """ AS folder, """ + O.url_domain("url") + """ AS domain,
         make_timestamp(CAST((""" + str(PG.DATE_BASE_EPOCH) + """ + page_id * 86400) AS BIGINT) * 1000000) AS date_added
  FROM pages
),
""" + O.hash_ctes("pq", "query_id", "question", 384, "qv")


def _page_pairs(cond: str) -> str:
    return f""",
pdots AS (
  SELECT c.chunk_id, q.query_id, sum(CAST(c.w AS DOUBLE) * CAST(q.w AS DOUBLE)) AS dot
  FROM pv_wv c JOIN qv_wv q ON c.bucket = q.bucket GROUP BY ALL
),
ppairs AS (
  SELECT q.query_id, i.chunk_id, i.url,
         CASE WHEN cn.nn = 0 OR qn.nn = 0 THEN 'NaN'::DOUBLE ELSE coalesce(d.dot, 0) / (cn.nn * qn.nn) END AS score
  FROM pix i JOIN pv_nrm cn ON cn.chunk_id = i.chunk_id
  JOIN pq q ON {cond}
  JOIN qv_nrm qn ON qn.query_id = q.query_id
  LEFT JOIN pdots d ON d.chunk_id = i.chunk_id AND d.query_id = q.query_id
),
phits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {O.rank_score('score')} DESC, chunk_id) AS rank
                 FROM ppairs) WHERE rank <= 5
)"""


_HOUT = "\nSELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, url, round(score, 6) AS score FROM phits"
_WIN = "INTERVAL 30 DAYS"
ORACLES["chunk_link_join"] = _PIDX + "\nSELECT chunk_id, url, chunk_index, title, folder, domain, date_added FROM pix"
ORACLES["filter_folder"] = _PIDX + _page_pairs("q.folder = i.folder") + _HOUT
ORACLES["filter_domain"] = _PIDX + _page_pairs("q.domain = i.domain") + _HOUT
ORACLES["filter_date_range"] = _PIDX + _page_pairs(
    f"i.date_added >= q.date_added - {_WIN} AND i.date_added <= q.date_added + {_WIN}") + _HOUT
ORACLES["topk_batch_filtered"] = _PIDX + _page_pairs(
    f"q.folder = i.folder AND i.date_added >= q.date_added - {_WIN} AND i.date_added <= q.date_added + {_WIN}") + _HOUT
ORACLES["filter_combine"] = _PIDX + _page_pairs(
    "q.query_id = (SELECT min(page_id) FROM pages) AND q.folder = i.folder "
    "AND i.date_added <= q.date_added + INTERVAL 365 DAYS") + """
SELECT CAST(rank AS INTEGER) AS rank, chunk_id, url, round(score, 6) AS score FROM phits"""

ORACLES["blank_query_guard"] = _PIDX + """,
cq AS (SELECT conv_id, turn FROM conversations WHERE role = 'user' AND trim(coalesce(text, '')) <> ''),
cnt AS (SELECT count(*) AS n FROM pix)
SELECT conv_id, turn, CAST(least(5, (SELECT n FROM cnt)) AS BIGINT) AS n_hits FROM cq"""

# answers: hits restricted to the question page's domain
_ANS = _PIDX + _page_pairs("q.domain = i.domain") + """,
fh AS (SELECT h.query_id, h.rank, h.url, h.score, i.chunk_text, i.title, i.folder, i.domain, i.date_added
       FROM phits h JOIN pix i ON i.chunk_id = h.chunk_id),
blocks AS (
  SELECT query_id, rank, '[Source ' || rank || ' (' || coalesce(title, 'Unknown') || ' - ' || coalesce(url, '') || ')]:' || chr(10) || chunk_text AS block,
         title, url, score
  FROM fh
)"""

ORACLES["format_sources"] = _ANS + "\nSELECT query_id, CAST(rank AS INTEGER) AS rank, block FROM blocks"

_head, _rest = AN.PROMPT_TEMPLATE.split("{system}")
_mid, _rest = _rest.split("{context}")
_mid2, _tail = _rest.split("{question}")
ORACLES["build_prompt"] = _ANS + f""",
ctx AS (SELECT query_id, count(*) AS n, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM blocks GROUP BY query_id)
SELECT q.query_id, CAST(coalesce(c.n, 0) AS INTEGER) AS n_sources,
       CASE WHEN c.n > 0 THEN {O.q(_head)} || {O.q(AN.SYSTEM_PROMPT)} || {O.q(_mid)} || c.context || {O.q(_mid2)} || q.question || {O.q(_tail)} END AS prompt
FROM pq q LEFT JOIN ctx c ON c.query_id = q.query_id"""

_ANSWERS = _ANS + f""",
ag AS (SELECT query_id, count(*) AS n, string_agg(coalesce(title, 'Unknown'), '; ' ORDER BY rank) AS titles,
              string_agg(rank || '|' || url || '|' || printf('%.6f', score), ',' ORDER BY rank) AS sources
       FROM blocks GROUP BY query_id),
answers AS (
  SELECT q.query_id, CASE WHEN a.n IS NULL THEN {O.q(AN.NO_HITS_ANSWER)} ELSE a.n || ' sources: ' || a.titles END AS answer,
         CAST(coalesce(a.n, 0) AS INTEGER) AS n_sources, coalesce(a.sources, '') AS sources
  FROM pq q LEFT JOIN ag a ON a.query_id = q.query_id
)"""
ORACLES["no_hits_answer"] = _ANSWERS + f"\nSELECT query_id, answer FROM answers WHERE answer = {O.q(AN.NO_HITS_ANSWER)}"
ORACLES["answers_with_sources"] = _ANSWERS + "\nSELECT query_id, answer, n_sources, sources FROM answers"


# --- evaluation extras -----------------------------------------------------------

_DEF_STRAT = (("default", 400, 50),)
_EVAL1 = "WITH RECURSIVE " + O.eval_hits_ctes(5, 384, _DEF_STRAT) + """,
qall AS (SELECT 'default' AS strategy, item_id AS query_id FROM benchmark),
truth_g AS (SELECT 'default' AS strategy, query_id, url FROM truth),
""" + O.metrics_ctes(5)

ORACLES["eval_details"] = _EVAL1 + """,
ret AS (SELECT query_id, string_agg(url, ',' ORDER BY rank) AS r, count(*) || ' sources: ' || string_agg(url, '; ' ORDER BY rank) AS answer
        FROM hits GROUP BY query_id),
tru AS (SELECT query_id, string_agg(url, ',' ORDER BY url) AS t FROM (SELECT DISTINCT query_id, url FROM truth) GROUP BY query_id)
SELECT p.query_id, coalesce(r.answer, @NO_HITS@) AS answer, coalesce(t.t, '') AS truth_urls, coalesce(r.r, '') AS retrieved_urls,
       round(precision_at_k, 6) AS precision_at_k, round(recall, 6) AS recall,
       round(recall_distinct, 6) AS recall_distinct, round(mrr, 6) AS mrr
FROM perq p LEFT JOIN ret r ON r.query_id = p.query_id LEFT JOIN tru t ON t.query_id = p.query_id"""

ORACLES["eval_details"] = ORACLES["eval_details"].replace("@NO_HITS@", O.q(AN.NO_HITS_ANSWER))

ORACLES["eval_errors_excluded"] = _EVAL1 + f"""
SELECT CAST(count(*) AS BIGINT) AS n_questions,
       CAST((SELECT count(*) FROM benchmark WHERE len(regexp_extract_all(lower(text), {O.q(O.WORD_TOKEN)})) = 0) AS BIGINT) AS n_errors,
       round(avg(precision_at_k), 6) AS mean_precision_at_k, round(avg(recall), 6) AS mean_recall,
       round(avg(recall_distinct), 6) AS mean_recall_distinct, round(avg(mrr), 6) AS mean_mrr
FROM perq"""

ORACLES["eval_documents"] = f"""
SELECT DISTINCT {doc_url('d.source', 'd.doc_id')} AS url, CAST(length({O.norm('d.text')}) AS INTEGER) AS n_chars
FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE length(b.text) > 0 AND contains(d.text, b.text))"""

_QA = f"""
tr AS (
  SELECT DISTINCT b.item_id, {doc_url('d.source', 'd.doc_id')} AS url
  FROM benchmark b JOIN documents d ON length(b.text) > 0 AND contains(d.text, b.text)
),
qa AS (
  SELECT b.item_id AS query_id, b.text AS question, coalesce(n.n, 0) AS n_truth, n.bad,
         CASE WHEN coalesce(n.n, 0) = 0 THEN 'hard' WHEN n.n = 1 THEN 'medium' ELSE 'easy' END AS difficulty
  FROM benchmark b LEFT JOIN (
    SELECT item_id, count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(url, '^https?://[^/?#]+')) AS bad
    FROM tr GROUP BY item_id) n ON n.item_id = b.item_id
)"""

ORACLES["check_qa_set"] = "WITH " + _QA + """
SELECT CAST(count(*) AS BIGINT) AS n_questions, count(*) < 15 AS too_few_questions,
       CAST(count(*) FILTER (WHERE question IS NULL OR trim(question) = '') AS BIGINT) AS missing_fields,
       CAST(0 AS BIGINT) AS bad_difficulty,
       CAST(count(*) FILTER (WHERE n_truth = 0) AS BIGINT) AS no_truth_url,
       CAST(count(*) FILTER (WHERE coalesce(bad, 0) > 0) AS BIGINT) AS bad_truth_url,
       count(*) FILTER (WHERE difficulty = 'hard') < 3 AS too_few_hard,
       CAST(count(*) - count(DISTINCT lower(trim(question))) AS BIGINT) AS duplicate_questions
FROM qa"""

ORACLES["eval_by_difficulty"] = _EVAL1 + "," + _QA.strip() + """
SELECT q.difficulty, CAST(count(*) AS BIGINT) AS n_questions, round(avg(p.precision_at_k), 6) AS mean_precision_at_k,
       round(avg(p.recall), 6) AS mean_recall, round(avg(p.mrr), 6) AS mean_mrr
FROM perq p JOIN qa q ON q.query_id = p.query_id GROUP BY ROLLUP (q.difficulty)"""

ORACLES["eval_gate"] = f"""
SELECT strategy, mean_precision_at_k, mean_recall, (mean_precision_at_k >= 0.75 AND mean_recall >= 0.75) AS passed
FROM ({ORACLES['compare_chunking']})"""

ORACLES["index_storage"] = "WITH RECURSIVE " + O.eval_chunks_ctes().split(",\nix_tok AS")[0] + f"""
SELECT strategy, CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(octet_length(encode(chunk_text))) AS BIGINT) AS text_bytes,
       CAST(count(*) * 4 * 384 AS BIGINT) AS vector_bytes
FROM ix GROUP BY strategy"""


# --- link exports ------------------------------------------------------------------

from tessera.plans import exports as XP  # noqa: E402

_EXP = f"""WITH el AS (
  SELECT CAST(floor(page_id / {XP.PAGES_PER_FILE}) AS BIGINT) AS file_id, page_id, url, {O.page_title('html')} AS title,
         {O.url_domain('url')} AS domain, {O.first_segment('url')} AS lang, page_id % {XP.ROOT_EVERY} = 0 AS is_root
  FROM pages
),
xl AS (
  SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY is_root,
              CASE WHEN is_root THEN '' ELSE domain END, CASE WHEN is_root THEN '' ELSE lang END, page_id) - 1 AS INTEGER) AS pos,
         url, title, CASE WHEN is_root THEN '' ELSE domain || '/' || lang END AS folder,
         CASE WHEN page_id % {XP.DATE_SHAPES} IN (0, 1, 2, 3) THEN TIMESTAMP '{XP.EXPORT_INGEST_TS}'
              WHEN page_id % {XP.DATE_SHAPES} = 4 THEN make_timestamp(CAST(({XP.DATE_BASE_EPOCH} + page_id * 86400) AS BIGINT) * 1000000 + 250000)
              ELSE make_timestamp(CAST(({XP.DATE_BASE_EPOCH} + page_id * 86400) AS BIGINT) * 1000000) END AS date_added,
         CASE WHEN page_id % {XP.ICON_EVERY} = 0 THEN 'data:image/png;base64,AAAA' || page_id END AS icon
  FROM el
)"""

ORACLES["parse_links"] = _EXP + "\nSELECT file_id, pos, url, title, folder, date_added, icon FROM xl"
ORACLES["parse_add_date"] = _EXP + "\nSELECT file_id, pos, date_added FROM xl"
ORACLES["link_icon"] = _EXP + "\nSELECT file_id, pos, icon FROM xl"
ORACLES["dedup_links"] = _EXP + """
SELECT url, arg_max(title, (file_id, pos)) AS title, arg_max(folder, (file_id, pos)) AS folder,
       arg_max(file_id, (file_id, pos)) AS file_id, arg_max(pos, (file_id, pos)) AS pos
FROM xl GROUP BY url"""
ORACLES["read_exports"] = _EXP + "\nSELECT file_id, count(*) AS n_links FROM xl GROUP BY file_id"


# Broken references stand as a word of their own here: a page that shows it is one that cannot be decoded.
_BROKEN = f"CASE WHEN page_id % {XP.BROKEN_EVERY} = 5 THEN replace(html, '<p>', '<p>zzbrokenref ') ELSE html END"
_INGEST = _EXP + ",\n" + O.fetched_ctes(0, "f0") + ",\n" + O.fetched_ctes(1, "f1") + f""",
lk AS (
  SELECT url, arg_max(title, (file_id, pos)) AS title, arg_max(folder, (file_id, pos)) AS folder,
         arg_max(date_added, (file_id, pos)) AS date_added, coalesce(arg_max(coalesce(icon, ''), (file_id, pos)), '') AS ic,
         (arg_max(file_id, (file_id, pos)) + 2) % 3 AS as_of
  FROM xl GROUP BY url
),
known AS (
  SELECT url, 0 AS run, page_id, fetch_failed FROM f0 UNION ALL SELECT url, 1, page_id, fetch_failed FROM f1
),
latest AS (
  SELECT lk.url, arg_max(k.page_id, (k.run, k.page_id)) AS page_id, arg_max(k.fetch_failed, (k.run, k.page_id)) AS fetch_failed
  FROM lk JOIN known k ON k.url = lk.url AND k.run < lk.as_of GROUP BY lk.url
),
shown AS (
  SELECT page_id, {O.clean_body('pc')} AS body FROM (SELECT page_id, {O.pre_clean(_BROKEN)} AS pc FROM pages)
),
judged AS (
  SELECT lk.*, CASE WHEN l.url IS NULL OR l.fetch_failed THEN 'failed' WHEN contains(s.body, 'zzbrokenref') THEN 'error'
                    WHEN s.body IS NULL OR length(s.body) < {O.MIN_TEXT_CHARS} THEN 'skipped' ELSE 'indexed' END AS outcome
  FROM lk LEFT JOIN latest l ON l.url = lk.url LEFT JOIN shown s ON s.page_id = l.page_id
)"""
ORACLES["ingest_exports"] = _INGEST + f"""
SELECT url, title, folder, {O.url_domain('url')} AS domain, date_added, nullif(ic, '') AS icon, outcome AS status,
       outcome = 'indexed' AS has_chunks
FROM judged WHERE outcome IN ('indexed', 'failed')"""
ORACLES["ingest_errors"] = _INGEST + "\nSELECT url, 'clean' AS stage, 'ValueError' AS error FROM judged WHERE outcome = 'error'"


# --- embedding hooks, sources, sinks, documented extras --------------------------

ORACLES["embed_batch"] = ORACLES["embed_hash"]
ORACLES["embed_query"] = "WITH " + O.hash_ctes("(SELECT item_id AS query_id, text FROM benchmark)", "query_id", "text", 384, "e").replace(
    "FROM (SELECT item_id AS query_id, text FROM benchmark) s LEFT JOIN", "FROM (SELECT item_id AS query_id, text FROM benchmark) AS s LEFT JOIN") + """
SELECT query_id, CAST(bucket AS INTEGER) AS bucket, round(CAST(w AS DOUBLE), 6) AS weight FROM e_wv WHERE w <> 0"""

ORACLES["flatten_newlines"] = """
SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS n_newlines,
       CAST(instr(replace(text, chr(10), ' '), chr(10)) AS INTEGER) AS newline_at, CAST(length(text) AS INTEGER) AS n_chars
FROM documents"""

ORACLES["check_dims"] = "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, coalesce(len(embedding) = 64, false) AS dim_ok FROM embeddings"

ORACLES["read_qa"] = "WITH " + _QA + """
SELECT question, CAST(n_truth AS INTEGER) AS n_truth, difficulty,
       CAST(len(list_distinct_ordered) AS INTEGER) AS n_keywords
FROM (SELECT *, list_filter(regexp_extract_all(lower(question), """ + O.q(O.WORD_TOKEN) + """), lambda w: length(w) >= 6) AS kw FROM qa) x,
     LATERAL (SELECT list(DISTINCT w) AS list_distinct_ordered FROM unnest(x.kw) AS t(w))"""

ORACLES["write_index"] = "WITH " + LINKS0 + """
SELECT CAST(count(*) FILTER (WHERE outcome IN ('indexed', 'failed')) AS BIGINT) AS n, 'links' AS "table" FROM k0"""

ORACLES["incremental_ingest"] = "WITH " + LINKS0 + "\nSELECT url FROM pages WHERE url NOT IN (SELECT url FROM k0 WHERE outcome = 'indexed')"

ORACLES["stale_links"] = "WITH " + LINKS0 + "," + LINKS1 + """,
runs AS (SELECT url, outcome, TIMESTAMP '2024-06-01 00:00:00' AS run_ts FROM k0
         UNION ALL SELECT url, outcome, TIMESTAMP '2024-07-01 00:00:00' FROM k1),
last AS (SELECT url, max(CASE WHEN outcome = 'indexed' THEN run_ts END) AS last_ok_at FROM runs GROUP BY url)
SELECT url, last_ok_at, coalesce(last_ok_at < TIMESTAMP '2024-07-01 00:00:00', true) AS stale FROM last"""

ORACLES["conversation_context"] = """
SELECT u.conv_id, u.turn, coalesce(concat_ws(chr(10), p2.role || ': ' || p2.text, p1.role || ': ' || p1.text), '') AS context
FROM conversations u
LEFT JOIN conversations p1 ON p1.conv_id = u.conv_id AND p1.turn = u.turn - 1
LEFT JOIN conversations p2 ON p2.conv_id = u.conv_id AND p2.turn = u.turn - 2
WHERE u.role = 'user'"""

ORACLES["write_index"] = _PIDX + """
SELECT CAST(count(*) AS BIGINT) AS n, 'links' AS "table" FROM r0
UNION ALL SELECT CAST(count(*) AS BIGINT), 'chunks' FROM c0_chunks"""

ORACLES["stream_progress"] = "SELECT event_type AS status, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type"
ORACLES["stream_ingest"] = _PIDX + """
SELECT (SELECT count(*) FROM r0) AS total_links, (SELECT count(*) FROM r0 WHERE outcome = 'failed') AS failed_links,
       (SELECT count(*) FROM c0_chunks) AS total_chunks"""


def _pidx_run(attempt: int, p: str) -> str:
    """Page index CTEs of one crawl run, every name prefixed with ``p``."""
    links = O.links_ctes(attempt, f"{p}k")
    return links + f""",
{p}r AS (SELECT * FROM {p}k WHERE outcome = 'indexed'),
""" + O.sentence_ctes(f"(SELECT url, text FROM {p}r)", "url", "text", f"{p}s_") + "," + \
        O.chunk_ctes("url", 400, 50, f"{p}c", f"{p}s_") + f""",
{p}pix AS (
  SELECT sha256(concat_ws(chr(1), c.url, CAST(c.chunk_index AS VARCHAR))) AS chunk_id, c.url,
         substr(s.t, c.c_start + 1, c.c_end - c.c_start) AS chunk_text
  FROM {p}c_chunks c JOIN {p}s_sents s ON s.url = c.url
),
""" + O.hash_ctes(f"{p}pix", "chunk_id", "chunk_text", 384, f"{p}pv") + f""",
{p}dots AS (
  SELECT c.chunk_id, q.query_id, sum(CAST(c.w AS DOUBLE) * CAST(q.w AS DOUBLE)) AS dot
  FROM {p}pv_wv c JOIN qv_wv q ON c.bucket = q.bucket GROUP BY ALL
),
{p}pairs AS (
  SELECT q.query_id, i.chunk_id, i.url,
         CASE WHEN cn.nn = 0 OR qn.nn = 0 THEN 'NaN'::DOUBLE ELSE coalesce(d.dot, 0) / (cn.nn * qn.nn) END AS score
  FROM {p}pix i JOIN {p}pv_nrm cn ON cn.chunk_id = i.chunk_id CROSS JOIN qv_nrm qn JOIN pq q ON q.query_id = qn.query_id
  LEFT JOIN {p}dots d ON d.chunk_id = i.chunk_id AND d.query_id = q.query_id
),
{p}hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {O.rank_score('score')} DESC, chunk_id) AS rank
                 FROM {p}pairs) WHERE rank <= 5
),
{p}perq AS (
  SELECT q.query_id,
         coalesce(count(h.url) FILTER (WHERE h.url = p.url), 0) / 5.0 AS precision_at_k,
         coalesce(1.0 / min(h.rank) FILTER (WHERE h.url = p.url), 0.0) AS mrr
  FROM pq q JOIN pages p ON p.page_id = q.query_id LEFT JOIN {p}hits h ON h.query_id = q.query_id
  GROUP BY q.query_id
)"""


ORACLES["eval_regression"] = "WITH RECURSIVE " + f"""
pq AS (SELECT page_id AS query_id, {O.page_title('html')} AS question FROM pages),
""" + O.hash_ctes("pq", "query_id", "question", 384, "qv") + "," + _pidx_run(0, "x0") + "," + _pidx_run(1, "x1") + """,
m AS (
  SELECT TIMESTAMP '2024-06-01 00:00:00' AS run_ts, count(*) AS n, avg(precision_at_k) AS p, avg(mrr) AS r FROM x0perq
  UNION ALL
  SELECT TIMESTAMP '2024-07-01 00:00:00', count(*), avg(precision_at_k), avg(mrr) FROM x1perq
)
SELECT run_ts, CAST(n AS BIGINT) AS n_questions, round(p, 6) AS mean_precision_at_k, round(r, 6) AS mean_mrr,
       round(p - lag(p) OVER (ORDER BY run_ts), 6) AS delta_precision_at_k,
       round(r - lag(r) OVER (ORDER BY run_ts), 6) AS delta_mrr
FROM m"""

ORACLES["keyword_coverage"] = _EVAL1 + f""",
kwt AS (
  SELECT item_id AS query_id, w, min(pos) AS first_pos
  FROM (SELECT item_id, unnest(toks) AS w, unnest(range(len(toks))) AS pos
        FROM (SELECT item_id, regexp_extract_all(lower(text), {O.q(O.WORD_TOKEN)}) AS toks FROM benchmark))
  WHERE length(w) >= 6 GROUP BY ALL
),
kw AS (
  SELECT b.item_id AS query_id,
         coalesce(list(k.w ORDER BY k.first_pos) FILTER (WHERE k.w IS NOT NULL), []) AS kws
  FROM benchmark b LEFT JOIN kwt k ON k.query_id = b.item_id GROUP BY b.item_id
),
top AS (SELECT h.query_id, i.chunk_text FROM hits h JOIN ix i ON i.chunk_id = h.chunk_id WHERE h.rank = 1),
cov AS (
  SELECT kw.query_id, len(kws) AS n,
         len(list_filter(kws, lambda x: list_contains(regexp_extract_all(lower(coalesce(t.chunk_text, '')), {O.q(O.WORD_TOKEN)}), x))) AS f
  FROM kw LEFT JOIN top t ON t.query_id = kw.query_id
)
SELECT query_id, CAST(n AS INTEGER) AS n_keywords, CAST(f AS INTEGER) AS n_found,
       CASE WHEN n > 0 THEN round(f / n, 6) END AS coverage
FROM cov"""


# --- generation and judge hooks with their deterministic defaults ---------------

ORACLES["generate_answers"] = _ANSWERS + "\nSELECT query_id, answer FROM answers"

_W = O.q(O.WORD_TOKEN)
_JUDGED = _ANSWERS + f""",
aw AS (SELECT query_id, answer, list_distinct(regexp_extract_all(lower(answer), {_W})) AS a FROM answers),
cw AS (SELECT query_id, list_distinct(flatten(list(regexp_extract_all(lower(chunk_text), {_W})))) AS c
       FROM fh GROUP BY query_id),
qw AS (SELECT query_id, list_distinct(regexp_extract_all(lower(question), {_W})) AS qq FROM pq),
judged AS (
  SELECT aw.query_id,
         CASE WHEN cw.c IS NULL OR coalesce(aw.answer, '') = '' THEN NULL
              WHEN len(aw.a) = 0 THEN 0.0
              ELSE len(list_filter(aw.a, lambda x: list_contains(cw.c, x))) / len(aw.a) END AS faithfulness,
         CASE WHEN cw.c IS NULL OR coalesce(aw.answer, '') = '' THEN NULL
              WHEN len(qw.qq) = 0 THEN 0.0
              ELSE len(list_filter(qw.qq, lambda x: list_contains(aw.a, x))) / len(qw.qq) END AS answer_relevance
  FROM aw LEFT JOIN cw ON cw.query_id = aw.query_id JOIN qw ON qw.query_id = aw.query_id
)"""

ORACLES["answer_quality"] = _JUDGED + """
SELECT query_id, round(faithfulness, 6) AS faithfulness, round(answer_relevance, 6) AS answer_relevance FROM judged"""

ORACLES["quality_mean_policy"] = _JUDGED + """
SELECT 'count_missing' AS policy, round(avg(coalesce(faithfulness, 0)), 6) AS mean_faithfulness,
       round(avg(coalesce(answer_relevance, 0)), 6) AS mean_answer_relevance FROM judged
UNION ALL
SELECT 'skip_missing', round(coalesce(avg(faithfulness), 0), 6), round(coalesce(avg(answer_relevance), 0), 6) FROM judged"""

ORACLES["write_eval_report"] = _EVAL1 + """
SELECT query_id, round(precision_at_k, 6) AS precision_at_k, round(recall, 6) AS recall, round(mrr, 6) AS mrr,
       '2024-09-01 00:00:00' AS run_ts
FROM perq"""
