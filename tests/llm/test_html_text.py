import html
import re
import time

import pytest
from pyspark.sql import functions as F

from ratingloom.llm import html_text as H
from ratingloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
LONG = "The first of the paragraphs is long enough and it has many of the words that are in the list of them, "


def test_whole_articles(spark):
    """The driver's pages mark their article; its blocks and nothing else must come back."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    found = QUERIES["op10_html_text"](spark, DATA).collect()
    assert len(found) == len(pages)
    for r in found:
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1|br|div|ul|li)\b[^>]*>", inside)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_page_without_article_element():
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body><header><h1>Site</h1></header>
    <ul class="menu"><li><a href=1>One</a><li><a href=2>Two</a></ul>
    <div id="cookie-notice"><p>{LONG}{LONG}</p></div>
    <h1>A  headline</h1><p>{LONG}&amp; more&nbsp;of it.<p>Short &#233;.<script>var x = "</p><p>{LONG}";</script>
    <p>{LONG}<a href="x">link</a></p>
    <aside>{LONG}</aside><div class='sidebar'><p>{LONG}</div><form>{LONG}<input></form>
    <section class="comments"><p>{LONG}{LONG}</p></section><p><a href=3>Next page of all the pages that there are</a>
    <footer>&copy; me <!-- {LONG} --></footer>"""
    assert H.extract(page).split("\n\n") == ["A headline", f"{LONG}& more of it.", "Short é.", f"{LONG}link"]


def test_second_pass_goes_to_the_nearest():
    params = H.BlockParams()
    marks = ["bad", "open", "open", "open", "good", "open", "good", "open"]
    blocks = [H.Block("x", 0, False, False, False, m) for m in marks]
    H.settle(blocks, params)
    assert [b.label for b in blocks] == ["bad", "bad", "good", "good", "good", "good", "good", "good"]


def test_odd_rows(spark):
    bad = ["<", "<p", "a < b & c > d", "<!-- never closed", "<script>never closed", "</p></div>" * 3, "<a>" * 2000, "&#xFFFFFFF;"]
    rows = [(i, "u", x) for i, x in enumerate([None, "", *bad])] + [(1, "u", ""), (None, None, f"<p>{LONG}")]
    rows += [(99, "u", "<div>" * 3000 + f"<p>{LONG}</p>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    found = {}
    for r in H.main_text(pages).collect():
        found.setdefault(r["page_id"], []).append(r["text"])
    assert found[0] == [""] and found[1] == ["", ""] and found[None] == [LONG.strip()]
    assert found[99][0].count(LONG.strip()) == 3000
    assert H.main_text(pages.limit(0)).count() == 0


def test_names_do_not_lose_articles():
    text = LONG.strip()
    for name in ("post tag-news", "with-sidebar", "no-sidebar", "nav-open", "has-comments", "comments-open"):
        assert H.extract(f"<body><div class='{name}'><p>{LONG}</p></div></body>") == text, name
    for name in ("no-sidebar", "sidebar", "menu"):
        assert H.extract(f"<body class='{name}'><div id={name}><article class='{name}'><p>{LONG}</p></article></div>") == text
    for name in ("sidebar", "menu", "related-posts", "main-nav", "site_header", "share-buttons", "cookie-notice"):
        assert H.extract(f"<body><div class='x {name}'><p>{LONG}</p></div></body>") == "", name


def test_skipped_elements_end_at_their_own_tag():
    text = LONG.strip()
    for before in ("<svg a='b'/>", "<svg><svg></svg>no</svg>", "<script>'</style>'</script>", "<select-box>", "<svg>", "<object>"):
        assert H.extract(f"{before}<p>{LONG}</p><p>{LONG}</p>") == f"{text}\n\n{text}", before
    assert H.extract(f"<p>{LONG}<math><mi>x</mi></math> is</p>") == f"{text} x is"
    many = "<svg>" * 20_000 + "</svg>" * 10_000
    assert H.extract(f"{many}<p>{LONG}</p>") == text


def test_text_after_the_last_tag():
    text = LONG.strip()
    assert H.extract(f"<p></p>< 5 {LONG}") == f"< 5 {text}"
    assert H.extract(f"<p></p>{LONG}<p class='y") == text
    assert H.extract(f"<p></p><a href=\"z>{LONG}") == text


PROSE = "The quick fox was in the garden and it had been there for a long time, as they said to all of us near the house."


@pytest.mark.parametrize(
    "page",
    ["<b" * 100_000, "<p '" * 50_000, "<!" * 100_000, "<a " * 70_000, "<" + "a" * 200_000, "<svg " * 40_000]
    + ["<div>" * 30_000 + "</p>" * 30_000, "<script>" + "</script " * 20_000, "<!-- " * 40_000, '<p "' * 50_000 + ">"]
    + ["<div class='" + "advert_" * 20_000 + "!'>x</div>", "<svg>" * 40_000, "<b '" * 50_000 + ">"],
    ids=lambda page: page[:12],
)
def test_odd_markup_takes_time_in_proportion(page):
    start = time.perf_counter()
    H.extract(page)
    assert time.perf_counter() - start < 5  # 200 KB; a quadratic search takes minutes


@pytest.mark.parametrize("around", ["{}", "<article>{}</article>"])
@pytest.mark.parametrize(
    "name",
    "comment-body comments-section ad-container sidebar-widget-area site-nav-wrapper advertisement-block user-comments"
    " commentBody related-articles reply-item".split(),
)
def test_side_boxes_go(around, name):
    side = f'<div class="{name}"><p>SIDE {PROSE}</p></div>'
    body = f"<div><p>{PROSE}</p><p>{PROSE}</p></div>{side}<div><p>{PROSE}</p></div>"
    assert H.extract(f"<html><body>{around.format(body)}</body></html>") == "\n\n".join([PROSE] * 3)


@pytest.mark.parametrize("name", "no-sidebar with-sidebar has-comments comments-open main-content article-body".split())
def test_names_of_the_article_stay(name):
    assert H.extract(f'<div class="{name}"><p>{PROSE}</p></div>') == PROSE


def test_pages_without_article_in_any_language():
    russian = "Быстрая лиса сидела в саду и долго смотрела на дом, пока хозяева не вышли на крыльцо. " * 5
    menu = "<ul><li><a href=x>Home</a></li><li><a href=y>More</a></li></ul>"
    assert H.extract(f"<div>{menu}<p>{russian}</p></div>") == russian.strip()
    foods = "Salt, water, flour, sugar, butter, eggs, milk, vanilla, cinnamon, nutmeg, cloves, ginger, honey, oats."
    assert H.extract(f"{menu}<p>{foods}</p>") == foods
    assert H.extract(f"{menu}<p>Short one.</p><p>Another short.</p>") == "Short one.\n\nAnother short."


def test_paragraph_of_links_in_an_article():
    linked = f"<p><a href=x>{PROSE}</a></p>"
    assert H.extract(f"<article><p>{PROSE}</p>{linked}<p>{PROSE}</p></article>") == "\n\n".join([PROSE] * 3)
