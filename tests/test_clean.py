"""HTML cleaning on pages of our own: a recipe site, a changelog, a French notice."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.html import clean_html, page_title

STEP = "Whisk the eggs, fold in the flour and rest the batter for an hour in the cold before frying it slowly."
NOTE = "Release 4 drops the old wire protocol; clients older than March must upgrade before the switch-over date."


@pytest.fixture(scope="module")
def clean(spark):
    def run(*pages):
        df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
        return [r.t for r in df.select("i", clean_html(F.col("html")).alias("t")).orderBy("i").collect()]
    return run


def test_recipe_page_keeps_steps_only(clean):
    page = ("<main><ol><li>" + STEP + "</li><li>Serve warm.</li></ol><aside>More pancakes</aside></main>"
            "<ul id='nav-bottom'><li>Home</li></ul>")
    assert clean(page) == [STEP + " Serve warm."]


@pytest.mark.parametrize("noise", [
    "<div class='site-header wide'>Jump to</div>", '<section id="ads_top">Sale</section>',
    "<span class=\"Footer\">terms</span>", "<ul class='x sidebar y'><li>tags</li></ul>",
])
def test_marked_blocks_go(clean, noise):
    assert clean(f"<body>{noise}<pre>{NOTE}</pre>{noise}</body>") == [NOTE]


def test_length_rule_counts_characters_of_the_clean_text(clean):
    exact = "é" * 100
    assert clean(f"<body>{exact}</body>", f"<body>{exact[:-1]}</body>", "<body>" + "<i></i>" * 90 + "</body>", None) == [exact, None, None, None]


def test_code_and_comments_never_show(clean):
    page = f"<body><!-- draft <p>old</p> --><style>b > i {{}}</style><script>if (a < b) document.write('<p>x</p>')</script>{NOTE}</body>"
    assert clean(page) == [NOTE]


def test_blanks_fold_and_entities_resolve(clean):
    assert clean(f"<body>Prix&nbsp;: 3 &lt; 4 &amp; 5\t\n\n&quot;{STEP}&quot;</body>") == [f'Prix : 3 < 4 & 5 "{STEP}"']


def test_titles(spark):
    df = spark.createDataFrame([("<head><TITLE lang=fr>Avis\n de  tempête &amp; houle</TITLE></head>",), ("<p>none</p>",)], "html string")
    assert [r.t for r in df.select(page_title(F.col("html")).alias("t")).collect()] == ["Avis de tempête & houle", ""]


@pytest.mark.parametrize("noise", [
    '<div class="ads">x <div>inner</div> tail</div>', "<table class=nav><tr><td>cell</td></tr></table>", "<header id=Header-1>h</header>",
    '<aside>a <aside>b</aside> c</aside>', '<p title="a > b" class="my-sidebar">quoted</p>', "<div class=footer>never closed",
])
def test_noise_of_any_element_goes_with_all_inside(clean, noise):
    assert clean(f"<body><section>{noise}</section><p>{NOTE}</p></body>") == [NOTE]


def test_words_in_other_attributes_are_no_noise(clean):
    page = f'<body><p data-id="header" title="ads" onclick="go(\'nav\')">{NOTE}</p><br class="ads">{STEP}</body>'
    assert clean(page) == [f"{NOTE} {STEP}"]


def test_unclosed_openers_take_linear_time(clean):
    import time
    took = []
    for n in (20_000, 40_000):
        began = time.time()
        assert clean("<body>" + NOTE + "<div class='ads'>" * n) == [NOTE]
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 2


def test_character_references_of_every_kind(clean):
    body = "&#8212; &eacute; &#x41; &rsquo; &notin; &notit; &amp;lt; &copy 2020 &#0; &unknown; & &am; AT&T &CounterClockwiseContourIntegral; " + NOTE
    assert clean(f"<body>{body}</body>") == [f"\u2014 \u00e9 A \u2019 \u2209 \u00acit; &lt; \u00a9 2020 \ufffd &unknown; & &am; AT&T \u2233 {NOTE}"]


def test_nested_markup_takes_linear_time(spark):
    """Doubling the number of tags at most doubles the time (with room for a slow machine), and the page is walked once."""
    import time
    took = {}
    for n in (1_000, 32_000, 64_000):
        page = "<body>" + "<div><p>some text &amp; more</p></div>" * (n // 4) + "</body>"
        df = spark.createDataFrame([(page,)], "html string").select(clean_html(F.col("html")).alias("t"))
        began = time.time()
        assert df.first().t.count("more") == n // 4
        took[n] = time.time() - began
    assert took[64_000] < 2.5 * took[32_000] + 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("ArrowEvalPython") == 1


def test_steps_by_the_same_walk(spark):
    from tessera.functions.html import walked_text
    page = f"<p>out</p><article><nav>menu</nav><div class='my-ads'>buy <b>now</b></div>{NOTE}</article>"
    steps = [walked_text(F.col("html"), **how).alias(f"c{k}") for k, how in enumerate((
        {}, {"regions": False, "attrs": False}, {"regions": False, "tags": False}, {"tags": False, "attrs": False}))]
    assert list(spark.createDataFrame([(page,)], "html string").select(*steps).first()) == [
        NOTE, f"out buy now {NOTE}", f"out menu {NOTE}", f"menu buy now {NOTE}"]
