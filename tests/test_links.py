"""Link exports and anchor scans."""

from pyspark.sql import functions as F

from tessera.functions.url import url_domain, url_origin
from tessera.operators.links import parse_exports, scan_anchors

TS = "2030-01-01 00:00:00"

# A gardener's list: two top folders, one of them with a folder inside, a loose link between them.
GARDEN = """<!DOCTYPE NETSCAPE-Bookmark-file-1>
<DL><p>
<DT><H3>Seeds</H3>
<DL><p>
<DT><A HREF="https://seeds.example/beans?row=2&amp;col=3" ADD_DATE="1500000000.5">Beans &amp; peas</A>
<DT><H3>Herbs</H3>
<DL><p>
<DT><A HREF="https://herbs.example/" ICON="data:image/gif;base64,R0lG">Herbs at <B>home</B></A>
</DL><p>
<DT><A HREF="https://seeds.example/swap">Swaps</A>
</DL><p>
<DT><A HREF="ftp://soil.example/map">Soil map</A>
<DT><H3>Tools</H3>
<DL><p>
<DT><A HREF="https://tools.example/rake" ADD_DATE="1500000600">Rake</A>
</DL><p>
</DL><p>
"""


def _parse(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_id int, content string")
    return parse_exports(df, F.to_timestamp(F.lit(TS))).orderBy("file_id", "pos").collect()


def test_folders_dates_icons(spark):
    rows = _parse(spark, GARDEN)
    assert [(r.pos, r.folder, r.title) for r in rows] == [
        (0, "Seeds", "Beans & peas"), (1, "Seeds/Herbs", "Herbs at home"), (2, "Seeds", "Swaps"), (3, "", "Soil map"), (4, "Tools", "Rake")]
    assert rows[0].url == "https://seeds.example/beans?row=2&col=3"
    assert [r.icon for r in rows] == [None, "data:image/gif;base64,R0lG", None, None, None]
    assert [rows[0].date_added.timestamp(), rows[4].date_added.timestamp()] == [1500000000.5, 1500000600]


def test_dates_that_are_no_seconds_fall_back(spark):
    shapes = ["", "never", "123d", "12f", "0x1p3", "1500000000000", "NaN", "Infinity", "1_5"]
    text = "<DL>" + "".join(f'<DT><A HREF="https://d.example/{k}" ADD_DATE="{v}">x</A>' for k, v in enumerate(shapes)) + "</DL>"
    good = "<DL>" + "".join(f'<DT><A HREF="https://g.example/{v}" ADD_DATE=" {v} ">x</A>' for v in ("0", "-1", "1.5e9", "+7")) + "</DL>"
    rows = _parse(spark, text, good, "", " \n")
    assert {r.date_added.strftime("%Y") for r in rows if r.file_id == 0} == {"2030"} and len(rows) == len(shapes) + 4
    assert [r.date_added.timestamp() for r in rows if r.file_id == 1] == [0, -1, 1.5e9, 7]


def test_same_link_twice_is_listed_twice_and_links_without_target_never(spark):
    text = "<DL><DT><A HREF='https://t.example'>one</A><DT><A HREF='https://t.example'>two</A><DT><A HREF=''>x</A><DT><A ID=k>y</A></DL>"
    assert [(r.url, r.title) for r in _parse(spark, text)] == [("https://t.example", "one"), ("https://t.example", "two")]


def test_only_first_top_list_and_unnamed_lists(spark):
    text = """<DL><p><DT><A HREF="https://k.example/a">Kept</A>
      <DL><p><DT><A HREF="https://k.example/hidden">In an unnamed list</A></DL><p>
    </DL><p>
    <DL><p><DT><A HREF="https://k.example/b">Second list</A></DL>"""
    rows = _parse(spark, text)
    assert [r.url for r in rows] == ["https://k.example/a"]


def test_anchor_scan(spark):
    html = """<p><a href="/rel">Rel</a> <a href='javascript:void(0)'> JS </a>
      <a href=bare.html>Bare</a><a name="x">no href</a><a href="">empty</a>
      <a href="https://u:p@Host.Example:8080/p?q#f">Full &amp; more</a></p>"""
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    rows = scan_anchors(df).orderBy("pos").collect()
    assert [(r.url, r.title) for r in rows] == [
        ("/rel", "Rel"), ("javascript:void(0)", "JS"), ("bare.html", "Bare"),
        ("https://u:p@Host.Example:8080/p?q#f", "Full & more")]


def test_anchors_that_trip_simple_patterns(spark):
    html = ('<a data-href="/wrong" href="/right">attribute names end in href</a>'
            '<a title="a > b" href="/quoted">quotes may hold a bracket</a>'
            '<!-- <a href="/comment">c</a> --><script>"<a href=/script>s</a>"</script>'
            '<a href="/open">never closed <a href="/next">next</a>'
            '<abbr href="/abbr">no anchor</abbr><a\nhref=/line>foo<b>bar</b></a><a href="/last">end of page')
    rows = scan_anchors(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("pos").collect()
    assert [(r.url, r.title) for r in rows] == [
        ("/right", "attribute names end in href"), ("/quoted", "quotes may hold a bracket"), ("/open", "never closed"),
        ("/next", "next"), ("/line", "foobar"), ("/last", "end of page")]


def test_many_unclosed_anchors_and_tags(spark):
    html = "<a href=/x>" + "<i>t</i>" * 3000 + "<a href=/y>" * 500
    rows = scan_anchors(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert len(rows) == 501


def test_netloc_and_origin(spark):
    df = spark.createDataFrame([("https://u:p@Host.Example:8080/p?q#f",), ("/relative",), ("mailto:a@b.c",),
                                ("//cdn.example/x",), ("HTTP://www.Site.example",)], "url string")
    rows = df.select(url_domain(F.col("url")).alias("d"), url_origin(F.col("url")).alias("o")).collect()
    assert [r.d for r in rows] == ["u:p@Host.Example:8080", "", "", "cdn.example", "www.Site.example"]
    assert rows[0].o == "https://u:p@Host.Example:8080" and rows[4].o == "http://www.Site.example"


def test_files_without_lists_and_commented_lists(spark):
    flat = '<p>Saved: <A HREF="https://f.example/1" ADD_DATE="1500000000" ICON="x">One</A> and <a href=https://f.example/2>Two</a>'
    comment = '<!-- <DL><DT><A HREF="https://no.example">no</A></DL> --><DL><DT><A HREF="https://yes.example">Yes</A></DL>'
    rows = _parse(spark, flat, comment)
    assert [(r.file_id, r.pos, r.url, r.title, r.folder, r.icon) for r in rows] == [
        (0, 0, "https://f.example/1", "One", "", None), (0, 1, "https://f.example/2", "Two", "", None), (1, 0, "https://yes.example", "Yes", "", None)]
    assert {r.date_added.strftime("%Y") for r in rows} == {"2030"}


def test_deep_nesting_has_no_cap(spark):
    depth = 3000
    text = "<DL><p>" + "".join(f"<DT><H3>f{i}</H3><DL><p>" for i in range(depth)) + \
        '<DT><A HREF="https://deep.example/">Deep</A>' + "</DL><p>" * (depth + 1)
    rows = _parse(spark, text)
    assert rows[0].folder == "/".join(f"f{i}" for i in range(depth))


def test_netloc_agrees_with_urlparse(spark):
    from urllib.parse import urlparse

    from tessera.sources.tables import read_table
    pages = read_table(spark, "/root/testdata/sf0.001", "pages")
    a = scan_anchors(pages).select("url").unionByName(pages.select("url"))
    extra = spark.createDataFrame([("HTTP://User:pw@Example.COM:81/x?y#z",), ("//cdn.example/a",), ("mailto:x@y.z",),
                                   ("javascript:void(0)",), ("relative/path",), ("?q=1",), ("#frag",)], "url string")
    rows = a.unionByName(extra).select("url", url_domain(F.col("url")).alias("d")).collect()
    for r in rows:
        assert r.d == urlparse(r.url).netloc, r.url
