"""DuckDB twins of the registered queries (the correctness oracle).

Each builder returns SQL text over the pre-registered views.  The regular
expressions are the engine's own constants (Java regex and RE2 read them
alike); DuckDB's ``list_filter`` takes ``lambda x: ...`` lambdas.
"""

from __future__ import annotations

from tessera.functions.text import SENTENCE_END, WORD_TOKEN, WS_RUN
from tessera.operators.chunk import DEFAULT_STRATEGIES

E_SPLIT = r"e'\\1\n'"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def norm(expr: str) -> str:
    return f"trim(regexp_replace({expr}, {q(WS_RUN)}, ' ', 'g'))"  # Spark spells the same set as WS_JAVA


def doc_url(source: str, doc_id: str) -> str:
    return f"('https://' || {source} || '.docs.example/doc/' || CAST({doc_id} AS VARCHAR))"


def sentence_ctes(src: str, key: str, text: str, prefix: str = "") -> str:
    """CTEs ``{p}sents`` (key, t, ss) , ``{p}srows`` (key, b, sentence, tok, len)
    and ``{p}bounds`` (key, b, p, c, n) with the sentinel boundary b = n."""
    p = prefix
    return f"""
{p}sents AS (
  SELECT {key}, t,
         list_filter(string_split(regexp_replace(t, {q(SENTENCE_END)}, {E_SPLIT}, 'g'), e'\\n'),
                     lambda x: x <> '') AS ss
  FROM (SELECT {key}, {norm(text)} AS t FROM {src})
),
{p}srows AS (
  SELECT {key}, b, sentence, len(string_split(sentence, ' ')) AS tok, length(sentence) AS len
  FROM (SELECT {key}, unnest(ss) AS sentence, unnest(range(len(ss))) AS b FROM {p}sents)
),
{p}sp AS (
  SELECT {key}, b, tok, len,
         coalesce(sum(tok) OVER (PARTITION BY {key} ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p,
         coalesce(sum(len + 1) OVER (PARTITION BY {key} ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
         count(*) OVER (PARTITION BY {key}) AS n
  FROM {p}srows
),
{p}bounds AS (
  SELECT {key}, b, p, c, n FROM {p}sp
  UNION ALL
  SELECT {key}, n AS b, p + tok AS p, c + len + 1 AS c, n FROM {p}sp WHERE b = n - 1
)"""


def chunk_ctes(key: str, size: int, overlap: int, tag: str, prefix: str = "") -> str:
    """CTE ``{tag}_chunks`` (key, chunk_index, s_from, s_to, c_start, c_end,
    n_tokens) for one strategy; needs ``sentence_ctes`` first."""
    p = prefix
    return f"""
{tag}_w AS (
  SELECT {key}, b, p, c, n,
         greatest(b + 1, max(b) OVER (PARTITION BY {key} ORDER BY p RANGE BETWEEN CURRENT ROW AND {size} FOLLOWING)) AS en,
         coalesce(max(b) OVER (PARTITION BY {key} ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND {overlap} PRECEDING), -1) AS bk
  FROM {p}bounds
),
{tag}_nodes AS (
  SELECT a.{key}, a.b, a.en, a.n, a.p, a.c, e.p AS pe, e.c AS ce,
         greatest(CASE WHEN least(e.bk, a.en - 1) >= a.b THEN least(e.bk, a.en - 1) ELSE a.en END, a.b + 1) AS nxt
  FROM {tag}_w a JOIN {tag}_w e ON e.{key} = a.{key} AND e.b = a.en
  WHERE a.b < a.n
),
{tag}_walk({key}, i, idx) AS (
  SELECT {key}, 0, 0 FROM {tag}_nodes WHERE b = 0
  UNION ALL
  SELECT w.{key}, x.nxt, w.idx + 1
  FROM {tag}_walk w JOIN {tag}_nodes x ON x.{key} = w.{key} AND x.b = w.i
  WHERE x.en < x.n
),
{tag}_chunks AS (
  SELECT x.{key}, CAST(w.idx AS INTEGER) AS chunk_index, CAST(x.b AS INTEGER) AS s_from,
         CAST(x.en AS INTEGER) AS s_to, CAST(x.c AS INTEGER) AS c_start,
         CAST(x.ce - 1 AS INTEGER) AS c_end, CAST(x.pe - x.p AS INTEGER) AS n_tokens
  FROM {tag}_walk w JOIN {tag}_nodes x ON x.{key} = w.{key} AND x.b = w.i
)"""


def hash_ctes(src: str, key: str, text: str, dim: int, tag: str) -> str:
    """CTEs ``{tag}_wv`` (key, bucket, w FLOAT) and ``{tag}_nrm`` (key, nn):
    the hash embedding in sparse form, plus its float norm (0 for no tokens)."""
    return f"""
{tag}_tok AS (
  SELECT {key}, unnest(regexp_extract_all(lower({text}), {q(WORD_TOKEN)})) AS w FROM {src}
),
{tag}_hv AS (
  SELECT DISTINCT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM {tag}_tok
),
{tag}_cnt AS (
  SELECT {key}, h % {dim} AS bucket,
         sum(CASE WHEN (h // {dim}) % 2 = 0 THEN 1 ELSE -1 END) AS cnt
  FROM {tag}_hv GROUP BY ALL
),
{tag}_n0 AS (SELECT {key}, sqrt(sum(cnt * cnt)) AS nn FROM {tag}_cnt GROUP BY {key}),
{tag}_wv AS (
  SELECT c.{key}, c.bucket, CAST(c.cnt / n.nn AS FLOAT) AS w
  FROM {tag}_cnt c JOIN {tag}_n0 n ON c.{key} = n.{key} WHERE n.nn > 0
),
{tag}_nrm AS (
  SELECT s.{key}, coalesce(sqrt(sum(CAST(v.w AS DOUBLE) * CAST(v.w AS DOUBLE))), 0) AS nn
  FROM {src} s LEFT JOIN {tag}_wv v ON s.{key} = v.{key} GROUP BY s.{key}
)"""


def rank_score(score: str) -> str:
    return f"(CASE WHEN isnan({score}) THEN 'inf'::DOUBLE ELSE round({score}, 9) END)"


def strategies_values(strategies=DEFAULT_STRATEGIES) -> str:
    rows = ", ".join(f"({q(n)}, {s}, {o})" for n, s, o in strategies)
    return f"(VALUES {rows}) AS t(strategy, chunk_size, overlap)"


def eval_chunks_ctes(strategies=DEFAULT_STRATEGIES, dim: int = 384) -> str:
    """``ix`` (strategy, doc_id, url, chunk_index, chunk_id, chunk_text) plus
    its sparse hash vectors ``ix_wv`` / ``ix_nrm`` keyed by chunk_id."""
    parts = [sentence_ctes("documents", "doc_id", "text")]
    for i, (name, size, ov) in enumerate(strategies):
        parts.append(chunk_ctes("doc_id", size, ov, f"s{i}"))
    union = " UNION ALL ".join(
        f"SELECT {q(name)} AS strategy, doc_id, chunk_index, c_start, c_end FROM s{i}_chunks"
        for i, (name, _, _) in enumerate(strategies))
    parts.append(f"""
ixc AS ({union}),
ix AS (
  SELECT x.strategy, x.doc_id, {doc_url('d.source', 'd.doc_id')} AS url, x.chunk_index,
         substr(s.t, x.c_start + 1, x.c_end - x.c_start) AS chunk_text,
         sha256(concat_ws(chr(1), x.strategy, {doc_url('d.source', 'd.doc_id')}, CAST(x.chunk_index AS VARCHAR))) AS chunk_id
  FROM ixc x JOIN sents s ON s.doc_id = x.doc_id JOIN documents d ON d.doc_id = x.doc_id
)""")
    parts.append(hash_ctes("ix", "chunk_id", "chunk_text", dim, "ix"))
    return ",".join(parts)


def eval_hits_ctes(k: int = 5, dim: int = 384, strategies=DEFAULT_STRATEGIES) -> str:
    """``hits`` (strategy, query_id, rank, chunk_id, url, score) for the
    benchmark passages against each strategy's index; ``truth`` (query_id, url)."""
    return eval_chunks_ctes(strategies, dim) + "," + f"""
qs AS (SELECT item_id AS query_id, text AS question FROM benchmark WHERE trim(text) <> ''),
{hash_ctes("qs", "query_id", "question", dim, "qv")},
dots AS (
  SELECT c.chunk_id, q.query_id, sum(CAST(c.w AS DOUBLE) * CAST(q.w AS DOUBLE)) AS dot
  FROM ix_wv c JOIN qv_wv q ON c.bucket = q.bucket GROUP BY ALL
),
pairs AS (
  SELECT i.strategy, qn.query_id, i.chunk_id, i.url,
         CASE WHEN cn.nn = 0 OR qn.nn = 0 THEN 'NaN'::DOUBLE
              ELSE coalesce(d.dot, 0) / (cn.nn * qn.nn) END AS score
  FROM ix i JOIN ix_nrm cn ON cn.chunk_id = i.chunk_id
  CROSS JOIN qv_nrm qn
  LEFT JOIN dots d ON d.chunk_id = i.chunk_id AND d.query_id = qn.query_id
),
hits AS (
  SELECT * FROM (
    SELECT strategy, query_id, chunk_id, url, score,
           row_number() OVER (PARTITION BY strategy, query_id ORDER BY {rank_score('score')} DESC, chunk_id) AS rank
    FROM pairs) WHERE rank <= {k}
),
truth AS (
  SELECT DISTINCT b.item_id AS query_id, {doc_url('d.source', 'd.doc_id')} AS url
  FROM benchmark b JOIN documents d ON length(b.text) > 0 AND contains(d.text, b.text)
)"""


def metrics_ctes(k: int, group: str = "strategy", questions: str = "qall") -> str:
    """``perq`` per (group, question) metrics from ``hits`` and ``truth_g``."""
    return f"""
rel AS (
  SELECT h.*, (t.url IS NOT NULL) AS is_rel
  FROM hits h LEFT JOIN (SELECT DISTINCT {group}, query_id, url FROM truth_g) t
    ON t.{group} = h.{group} AND t.query_id = h.query_id AND t.url = h.url
),
agg AS (
  SELECT {group}, query_id, count(*) AS n_retrieved,
         count(*) FILTER (WHERE rank <= {k} AND is_rel) AS hits_at_k,
         count(*) FILTER (WHERE is_rel) AS hits_all,
         count(DISTINCT CASE WHEN is_rel THEN url END) AS hits_distinct,
         min(CASE WHEN is_rel THEN rank END) AS first_rel
  FROM rel GROUP BY {group}, query_id
),
nt AS (SELECT {group}, query_id, count(DISTINCT url) AS n_truth FROM truth_g GROUP BY ALL),
perq AS (
  SELECT g.{group}, g.query_id,
         coalesce(a.n_retrieved, 0) AS n_retrieved, coalesce(n.n_truth, 0) AS n_truth,
         coalesce(a.hits_at_k, 0) / {float(k)} AS precision_at_k,
         CASE WHEN coalesce(n.n_truth, 0) > 0 THEN coalesce(a.hits_all, 0) / n.n_truth ELSE 0.0 END AS recall,
         CASE WHEN coalesce(n.n_truth, 0) > 0 THEN coalesce(a.hits_distinct, 0) / n.n_truth ELSE 0.0 END AS recall_distinct,
         coalesce(1.0 / a.first_rel, 0.0) AS mrr
  FROM (SELECT DISTINCT {group}, query_id FROM {questions}) g
  LEFT JOIN agg a ON a.{group} = g.{group} AND a.query_id = g.query_id
  LEFT JOIN nt n ON n.{group} = g.{group} AND n.query_id = g.query_id
)"""


def compare_chunking_sql(k: int = 5, dim: int = 384, strategies=DEFAULT_STRATEGIES) -> str:
    return "WITH RECURSIVE " + eval_hits_ctes(k, dim, strategies) + "," + f"""
strat AS (SELECT * FROM {strategies_values(strategies)}),
qall AS (SELECT s.strategy, b.item_id AS query_id FROM benchmark b CROSS JOIN strat s),
truth_g AS (SELECT s.strategy, t.query_id, t.url FROM truth t CROSS JOIN strat s),
{metrics_ctes(k)},
means AS (
  SELECT strategy, avg(precision_at_k) AS p, avg(recall) AS r, avg(recall_distinct) AS rd, avg(mrr) AS m
  FROM perq GROUP BY strategy
),
sizes AS (SELECT strategy, count(*) AS total_chunks FROM ix GROUP BY strategy)
SELECT s.strategy, CAST(s.chunk_size AS INTEGER) AS chunk_size, CAST(s.overlap AS INTEGER) AS overlap,
       CAST(coalesce(z.total_chunks, 0) AS BIGINT) AS total_chunks,
       round(coalesce(m.p, 0), 6) AS mean_precision_at_k, round(coalesce(m.r, 0), 6) AS mean_recall,
       round(coalesce(m.rd, 0), 6) AS mean_recall_distinct, round(coalesce(m.m, 0), 6) AS mean_mrr
FROM strat s LEFT JOIN sizes z ON z.strategy = s.strategy LEFT JOIN means m ON m.strategy = s.strategy
"""


# --- pages -------------------------------------------------------------------

from tessera.functions import url as U  # noqa: E402
from tessera.plans import pages as PG  # noqa: E402
from tessera.operators import links as LK  # noqa: E402
from tessera.operators.crawl import AGENT_TOKEN  # noqa: E402


def rx(expr: str, pattern: str, repl: str = " ") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


# The cleaning rule restated for flat markup (what the test pages have), with patterns of its own.
COMMENT_RE, TAG_RE = r"(?s)<!--.*?-->", r"<[^>]*>"
# the references that the test pages have; the old ones count without their semicolon too; '&' last
ENTITIES = (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;", "'"), ("&nbsp;?", "\u00a0"), ("&copy;?", "\u00a9"), ("&middot;?", "\u00b7"),
            ("&mdash;", "\u2014"), ("&ndash;", "\u2013"), ("&hellip;", "\u2026"), ("&amp;?", "&"))
MIN_TEXT_CHARS = 100


def block_re(tag: str, attrs: str = "") -> str:
    return rf"(?is)<{tag}\b[^>]*{attrs}>.*?</{tag}\s*>"


def region_re(tag: str) -> str:
    return rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>"


def drop_blocks(expr: str, tags=("script", "style", "nav", "footer", "aside")) -> str:
    for t in tags:
        expr = rx(expr, block_re(t))
    return expr


def drop_noise_attrs(expr: str) -> str:
    for t in ("div", "section", "ul", "p", "span", "header"):
        expr = rx(expr, block_re(t, r"""\b(?:class|id)\s*=\s*["'][^"']*(?:nav|footer|ads|sidebar|header)[^"']*["'][^>]*"""))
    return expr


def decode_entities(expr: str) -> str:
    for ent, ch in ENTITIES:
        expr = rx(expr, ent, ch)
    return expr


def pre_clean(expr: str) -> str:
    return drop_blocks(rx(expr, COMMENT_RE), ("script", "style"))


def visible_text(expr: str) -> str:
    return norm(decode_entities(rx(expr, TAG_RE)))


def main_region_inline(expr: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({expr}, {q(region_re(t))}) THEN regexp_extract({expr}, {q(region_re(t))}, 1)"
                     for t in ("article", "main", "body"))
    return f"(CASE {cases} ELSE {expr} END)"


def clean_body(expr: str) -> str:
    """text before the length rule (needs ``pc`` = pre_clean(html) column)."""
    return visible_text(drop_noise_attrs(drop_blocks(main_region_inline(expr))))


def page_title(expr: str) -> str:
    return norm(decode_entities(f"regexp_extract({expr}, {q(r'(?is)<title\b[^>]*>(.*?)</title\s*>')}, 1)"))


def url_domain(expr: str) -> str:
    return f"regexp_extract({expr}, {q(U.NETLOC_RE)}, 1)"


def url_origin(expr: str) -> str:
    return f"(lower(regexp_extract({expr}, {q(U.SCHEME_RE)}, 1)) || '://' || {url_domain(expr)})"


def url_path(expr: str) -> str:
    return f"(CASE WHEN regexp_extract({expr}, {q(U.PATH_RE)}, 1) = '' THEN '/' ELSE regexp_extract({expr}, {q(U.PATH_RE)}, 1) END)"


def first_segment(expr: str) -> str:
    return f"regexp_extract({url_path(expr)}, '^/([^/?#]*)', 1)"


def case_mod(expr: str, pairs, default) -> str:
    whens = " ".join(f"WHEN {expr} = {k} THEN {q(v) if isinstance(v, str) else v}" for k, v in pairs)
    d = "NULL" if default is None else (q(default) if isinstance(default, str) else default)
    return f"(CASE {whens} ELSE {d} END)"


def fetched_ctes(attempt: int = 0, tag: str = "f") -> str:
    """``{tag}`` : page_id, url, origin, http_status, content_type,
    transport_error, body, allowed, status_code, error, content, fetch_failed,
    fail_reason."""
    pid = f"(page_id + {7 * attempt})"
    return f"""
{tag}_log AS (
  SELECT page_id, url, {url_origin('url')} AS origin, {url_path('url')} AS path,
         CAST({case_mod(f'{pid} % {PG.STATUS_MOD}', PG.STATUS_CODES, 200)} AS INTEGER) AS http_status,
         {case_mod(f'{pid} % {PG.CTYPE_MOD}', PG.CTYPES, PG.CTYPE_DEFAULT)} AS content_type,
         CAST({case_mod(f'{pid} % {PG.TRANSPORT_MOD}', PG.TRANSPORTS, None)} AS VARCHAR) AS transport_error,
         html AS body
  FROM pages
),
{tag}_hosts AS (SELECT DISTINCT origin, {url_domain('url')} AS host FROM {tag}_log),
{tag}_rules AS (
  SELECT origin, 0 AS entry, '*' AS ua, 0 AS ord, false AS allow, '/fr/' AS prefix FROM {tag}_hosts WHERE starts_with(host, 'm.')
  UNION ALL SELECT origin, 0, '*', 1, true, '/' FROM {tag}_hosts WHERE starts_with(host, 'm.')
  UNION ALL SELECT origin, 0, 'TesseraBot', 0, false, '/en/' FROM {tag}_hosts WHERE starts_with(host, 'www.') AND NOT starts_with(host, 'm.')
  UNION ALL SELECT origin, 1, '*', 0, false, '/' FROM {tag}_hosts WHERE starts_with(host, 'www.') AND NOT starts_with(host, 'm.')
  UNION ALL SELECT origin, 0, 'otherbot', 0, false, '/' FROM {tag}_hosts WHERE ends_with(host, '.net') AND NOT starts_with(host, 'm.') AND NOT starts_with(host, 'www.')
  UNION ALL SELECT origin, 1, '*', 0, true, '' FROM {tag}_hosts WHERE ends_with(host, '.net') AND NOT starts_with(host, 'm.') AND NOT starts_with(host, 'www.')
),
{tag}_grp AS (
  SELECT origin, coalesce(min(entry) FILTER (WHERE ua <> '*' AND contains('{AGENT_TOKEN}', lower(ua))),
                          min(entry) FILTER (WHERE ua = '*')) AS dentry
  FROM {tag}_rules GROUP BY origin
),
{tag}_dec AS (SELECT r.* FROM {tag}_rules r JOIN {tag}_grp g ON g.origin = r.origin AND g.dentry = r.entry
              WHERE r.ua = '*' OR contains('{AGENT_TOKEN}', lower(r.ua))),
{tag}_allow AS (
  SELECT l.url, arg_min(d.allow, d.ord) AS allow
  FROM (SELECT DISTINCT url, origin, path FROM {tag}_log) l JOIN {tag}_dec d ON d.origin = l.origin AND starts_with(l.path, d.prefix)
  GROUP BY l.url
),
{tag}_g AS (
  SELECT l.*, coalesce(a.allow, true) AS allowed FROM {tag}_log l LEFT JOIN {tag}_allow a ON a.url = l.url
),
{tag}_o AS (
  SELECT *,
    CASE WHEN NOT allowed THEN 'Blocked by robots.txt'
         WHEN transport_error = 'timeout' THEN 'Timeout'
         WHEN transport_error IS NOT NULL THEN 'Request Error: ' || transport_error
         WHEN http_status IN (401, 403) THEN 'Access Denied (HTTP ' || http_status || ')'
         WHEN http_status = 429 THEN 'Rate Limited (HTTP 429)'
         WHEN http_status >= 400 THEN 'HTTP Error ' || http_status
         WHEN NOT (contains(lower(coalesce(content_type, '')), 'text/html') OR contains(lower(coalesce(content_type, '')), 'application/xhtml+xml'))
              THEN 'Non-HTML content'
    END AS error,
    CAST(CASE WHEN NOT allowed OR transport_error IS NOT NULL THEN 0 ELSE http_status END AS INTEGER) AS status_code
  FROM {tag}_g
),
{tag} AS (
  SELECT *, CASE WHEN error IS NULL THEN body END AS content,
         (status_code >= 400 OR error IS NOT NULL OR body IS NULL OR body = '') AS fetch_failed,
         CASE WHEN (status_code >= 400 OR error IS NOT NULL OR body IS NULL OR body = '')
              THEN coalesce(error, 'Fetch failed') END AS fail_reason
  FROM {tag}_o
)"""


def links_ctes(attempt: int = 0, tag: str = "k") -> str:
    """``{tag}`` : page_id, url, title, folder, domain, date_added, text,
    outcome, reason (one row per page)."""
    f = f"{tag}f"
    return fetched_ctes(attempt, f) + f""",
{tag}_pc AS (
  SELECT x.page_id, x.url, x.fetch_failed, x.fail_reason, {page_title('p.html')} AS title,
         CASE WHEN NOT x.fetch_failed THEN {pre_clean('x.content')} END AS pc
  FROM {f} x JOIN pages p ON p.page_id = x.page_id
),
{tag}_t AS (
  SELECT *, CASE WHEN pc IS NOT NULL THEN {clean_body('pc')} END AS body FROM {tag}_pc
),
{tag} AS (
  SELECT page_id, url, title, {first_segment('url')} AS folder, {url_domain('url')} AS domain,
         make_timestamp(CAST(({PG.DATE_BASE_EPOCH} + page_id * 86400) AS BIGINT) * 1000000) AS date_added,
         CASE WHEN length(body) >= {MIN_TEXT_CHARS} THEN body END AS text,
         CASE WHEN fetch_failed THEN 'failed'
              WHEN body IS NULL OR length(body) < {MIN_TEXT_CHARS} THEN 'skipped'
              ELSE 'indexed' END AS outcome,
         CASE WHEN fetch_failed THEN fail_reason
              WHEN body IS NULL OR length(body) < {MIN_TEXT_CHARS} THEN 'No content after cleaning' END AS reason
  FROM {tag}_t
)"""


def anchors_cte(tag: str = "an", keep_empty: bool = False) -> str:
    pat = q(LK.ANCHOR_RE)
    href = LK.attr_re("href")
    url = decode_entities(" || ".join(f"regexp_extract(attrs, {q(href)}, {i})" for i in (1, 2, 3)))
    where = "" if keep_empty else f"WHERE length({url}) > 0"
    return f"""
{tag}_raw AS (
  SELECT page_id, regexp_extract_all(h, {pat}, 1) AS a1, regexp_extract_all(h, {pat}, 2) AS a2
  FROM (SELECT page_id, {pre_clean("html")} AS h FROM pages)
),
{tag}_x AS (
  SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, a1[i] AS attrs, a2[i] AS inr
  FROM (SELECT page_id, a1, a2, unnest(range(1, len(a1) + 1)) AS i FROM {tag}_raw)
),
{tag} AS (
  SELECT page_id, pos, {url} AS url, {norm(decode_entities(rx("inr", TAG_RE, "")))} AS title FROM {tag}_x {where}
)"""
