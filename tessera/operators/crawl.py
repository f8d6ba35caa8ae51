"""Crawl gating and outcome over a crawl log (no network access in jobs).

A crawl log row is what one fetch returned: ``url, status_code,
content_type, body, transport_error``.  ``robots_gate`` decides, per url,
whether the site's rules file lets our agent fetch it; ``fetch_outcome`` turns
both into the ``(status_code, error, content)`` triple a fetcher reports, and
``fetch_failed`` is the ingest's failure test.

Robots rules are a table ``(origin, entry, ua, ord, allow, prefix)``: one row
per Allow/Disallow line, ``entry`` numbering the User-agent groups of the
file in order.  Matching follows the standard-library parser: the first
group whose agent name occurs (case-insensitively) in our product token
decides; if none, the ``*`` group; within the group the first rule, in file
order, whose path is a prefix of the url's path decides; no matching rule,
no group or no rules file -> allowed (unreachable rules files are fail-open).
An empty Disallow line is stored as ``allow = true, prefix = ''``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.url import url_origin, url_path

# Our crawler's product token (what rule agents are matched
# against) and the error texts a fetch reports.
AGENT_TOKEN = "tesserabot"
ERR_BLOCKED = "Blocked by robots.txt"
ERR_TIMEOUT = "Timeout"
ERR_NON_HTML = "Non-HTML content"
ERR_RATE = "Rate Limited (HTTP 429)"
ERR_FAILED = "Fetch failed"
# The urls of an origin are dealt to so many tasks.
ORIGIN_SHARES = 32
# A transport error that begins so came from outside the request layer (a decoder, our own code).
INTERNAL = "internal: "


def robots_gate(urls: DataFrame, rules: DataFrame, agent: str = AGENT_TOKEN) -> DataFrame:
    """urls + ``origin`` + ``allowed`` (boolean, never null).

    Plan: the rules table is reduced to *one row per origin* holding the
    deciding group's rules in file order (a robots file is small and bounded,
    so this list is too); the url rows are joined to it on ``origin`` and the
    first rule whose prefix matches is read with a higher-order ``filter`` --
    no per-url aggregation and no join back.  The per-origin table is what a
    crawler caches per site; Spark broadcasts it when it is under the
    broadcast threshold (its measured size decides), so the url side, which
    may carry page bodies, is not shuffled; otherwise the join is shuffled by
    origin and a share of its urls (``ORIGIN_SHARES``, the rules repeated for
    each), as a hot origin would be one task: Spark does not split a partition
    whose other side was grouped by the same key.
    """
    agent = agent.lower()
    specific = (F.col("ua") != "*") & F.lit(agent).contains(F.lower(F.col("ua")))
    r = (rules.withColumn("_specific", specific).withColumn("_default", F.col("ua") == "*")
         .where(F.col("_specific") | F.col("_default")))
    # the deciding group per origin: first matching specific group, else '*'
    groups = r.groupBy("origin").agg(
        F.coalesce(F.min(F.when(F.col("_specific"), F.col("entry"))),
                   F.min(F.when(F.col("_default"), F.col("entry")))).alias("_entry"))
    packed = (r.join(groups, "origin").where(F.col("entry") == F.col("_entry"))
              .groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("ord", "allow", "prefix")))
                                     .alias("_rules")))
    packed = packed.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(ORIGIN_SHARES - 1))))
    share = F.pmod(F.xxhash64("url"), F.lit(ORIGIN_SHARES)).cast("int")
    u = (urls.withColumn("origin", url_origin(F.col("url"))).withColumn("_path", url_path(F.col("url")))
         .withColumn("_share", share))
    first_match = F.try_element_at(F.filter("_rules", lambda x: F.col("_path").startswith(x["prefix"])), F.lit(1))
    return (u.join(packed, ["origin", "_share"], "left")
            .withColumn("allowed", F.coalesce(first_match["allow"], F.lit(True)))
            .drop("_rules", "_path", "_share"))


def fetch_outcome(log: DataFrame) -> DataFrame:
    """Adds ``status_code`` (reported), ``error`` and ``content``.

    Needs ``allowed``, ``http_status``, ``content_type``, ``body``,
    ``transport_error`` ('timeout', 'internal: ...', other text, or null).  First match wins.
    """
    st = F.col("http_status")
    ct = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    te = F.col("transport_error")
    html_ok = ct.contains("text/html") | ct.contains("application/xhtml+xml")
    error = (F.when(~F.col("allowed"), F.lit(ERR_BLOCKED))
             .when(te == "timeout", F.lit(ERR_TIMEOUT))
             .when(te.startswith(INTERNAL), F.concat(F.lit("Unknown Error: "), F.substring(te, len(INTERNAL) + 1, 1 << 30)))
             .when(te.isNotNull(), F.concat(F.lit("Request Error: "), te))
             .when(st.isin(401, 403), F.format_string("Access Denied (HTTP %d)", st))
             .when(st == 429, F.lit(ERR_RATE))
             .when(st >= 400, F.format_string("HTTP Error %d", st))
             .when(~html_ok, F.lit(ERR_NON_HTML)))
    reported = F.when(~F.col("allowed") | te.isNotNull(), F.lit(0)).otherwise(st)
    return (log.withColumn("error", error)
            .withColumn("status_code", reported.cast("int"))
            .withColumn("content", F.when(error.isNull(), F.col("body"))))


def fetch_failed(outcome: DataFrame) -> DataFrame:
    """failed iff status >= 400 or no content; reason = error or 'Fetch failed'."""
    failed = (F.col("status_code") >= 400) | F.col("content").isNull() | (F.col("content") == "")
    return (outcome.withColumn("fetch_failed", failed)
            .withColumn("fail_reason", F.when(failed, F.coalesce("error", F.lit(ERR_FAILED)))))
