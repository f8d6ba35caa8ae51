"""Robots gating and fetch outcomes."""

from tessera.operators.crawl import fetch_failed, fetch_outcome, robots_gate

RULES = "origin string, entry int, ua string, ord int, allow boolean, prefix string"


def _gate(spark, urls, rules):
    u = spark.createDataFrame([(x,) for x in urls], "url string")
    r = spark.createDataFrame(rules, RULES)
    return {row.url: row.allowed for row in robots_gate(u, r).collect()}


def test_disallow_and_fail_open(spark):
    rules = [("https://a.example", 0, "*", 0, False, "/private/")]
    got = _gate(spark, ["https://a.example/private/x", "https://a.example/public", "https://nofile.example/x"], rules)
    assert got == {"https://a.example/private/x": False, "https://a.example/public": True,
                   "https://nofile.example/x": True}


def test_specific_group_beats_star_and_first_rule_wins(spark):
    rules = [("https://b.example", 0, "*", 0, False, "/"),
             ("https://b.example", 1, "TesseraBot", 0, True, "/docs/"),
             ("https://b.example", 1, "TesseraBot", 1, False, "/"),
             ("https://c.example", 0, "otherbot", 0, False, "/"),
             ("https://c.example", 1, "*", 0, True, "")]
    got = _gate(spark, ["https://b.example/docs/a", "https://b.example/blog", "https://c.example/x"], rules)
    assert got == {"https://b.example/docs/a": True, "https://b.example/blog": False, "https://c.example/x": True}


def test_outcomes(spark):
    rows = [
        (1, True, 200, "text/html; charset=utf-8", None, "<p>ok</p>"),
        (2, True, 404, "text/html", None, "missing"),
        (3, True, 403, "text/html", None, "no"),
        (4, True, 429, "text/html", None, "slow"),
        (5, True, 200, "application/pdf", None, "%PDF"),
        (6, True, 0, None, "timeout", None),
        (7, False, 200, "text/html", None, "<p>blocked</p>"),
        (8, True, 200, "Application/XHTML+XML", None, "<p>x</p>"),
        (9, True, 200, "text/html", "connection reset", None),
    ]
    df = spark.createDataFrame(rows, "id int, allowed boolean, http_status int, content_type string, "
                                     "transport_error string, body string")
    out = {r.id: r for r in fetch_failed(fetch_outcome(df)).collect()}
    assert (out[1].status_code, out[1].error, out[1].fetch_failed) == (200, None, False)
    assert (out[2].error, out[2].fetch_failed) == ("HTTP Error 404", True)
    assert out[3].error == "Access Denied (HTTP 403)"
    assert out[4].error == "Rate Limited (HTTP 429)"
    assert (out[5].status_code, out[5].error, out[5].content) == (200, "Non-HTML content", None)
    assert (out[6].status_code, out[6].error) == (0, "Timeout")
    assert (out[7].status_code, out[7].error, out[7].fail_reason) == (0, "Blocked by robots.txt", "Blocked by robots.txt")
    assert out[8].error is None
    assert out[9].error == "Request Error: connection reset"


def test_gate_agrees_with_stdlib_robot_parser(spark):
    """Brute force: the derived rules files, rendered as robots.txt text and
    read by Python's own parser, allow exactly what the gate allows."""
    from urllib.parse import urlparse
    from urllib.robotparser import RobotFileParser

    from tessera.plans import pages as pg
    from tessera.sources.tables import read_table

    pages = read_table(spark, "/root/testdata/sf0.001", "pages")
    files: dict = {}
    for r in pg.robots_rules(pages).collect():
        ent = files.setdefault(r.origin, {}).setdefault(r.entry, {"ua": r.ua, "lines": []})
        ent["lines"].append((r.ord, r.allow, r.prefix))
    parsers = {}
    for origin, entries in files.items():
        text = []
        for e in sorted(entries):
            text.append(f"User-agent: {entries[e]['ua']}")
            text += [f"{'Allow' if a else 'Disallow'}: {p}" for _, a, p in sorted(entries[e]["lines"])]
            text.append("")
        rp = RobotFileParser()
        rp.parse(text)
        parsers[origin] = rp
    rows = pg.fetched(pages).select("url", "allowed").collect()
    for r in rows:
        u = urlparse(r.url)
        rp = parsers.get(f"{u.scheme}://{u.netloc}")
        want = rp.can_fetch("TesseraBot/1.0", r.url) if rp else True
        assert r.allowed == want, r.url
    assert any(not r.allowed for r in rows)


def test_a_hot_origin_is_no_single_task(spark):
    """The join that is shuffled (no broadcast) deals one origin's urls to many partitions, with the same verdicts."""
    from pyspark.sql import functions as F
    urls = spark.range(3200).select(F.concat(F.lit("https://hot.example/"), F.when(F.col("id") % 5 == 0, "no/").otherwise("yes/"), "id").alias("url"))
    rules = spark.createDataFrame([("https://hot.example", 0, "*", 0, False, "/no/")], RULES)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for key, value in zip(kept, ("-1", "false", "32"), strict=True):
            spark.conf.set(key, value)
        got = robots_gate(urls, rules).withColumn("_part", F.spark_partition_id())
        assert got.columns == ["origin", "url", "allowed", "_part"]
        rows = got.select("_part", "allowed").collect()  # no aggregate: Spark would leave the join out
        assert len(rows) == 3200 and sum(not r.allowed for r in rows) == 640
        parts = [r._part for r in rows]
        assert max(map(parts.count, set(parts))) <= 800  # 3,200 when the origin alone was the key
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
