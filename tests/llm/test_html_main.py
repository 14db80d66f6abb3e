import html as html_library
import re

import pytest

from plantfuse.llm import html_main
from plantfuse.llm.html_main import main_text

PROSE = "The first sentence, of some length, stands here. It goes on, and on, for a while."


def test_side_parts_are_left_out():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies, <button>ok</button></div>
    <div id="page"><div class="post"><h1>Head&nbsp;line &amp;  more</h1>
    <p>{PROSE}<p>Two<br>lines <b>bold</b><i>er</i></p><div class="ad">Buy, buy, buy</div>
    <ul><li>one<li>two <a href="#">link</a></ul><script>var t="</p>";</script><form>Name <input></form>
    <table><tr><td>a<td>b</table></div>
    <div class="comments"><p>{PROSE} {PROSE}</p></div></div>
    <aside>{PROSE}</aside><footer>&copy; all</footer></body></html>"""
    assert main_text(page).split("\n") == [
        "Head line & more", PROSE, "Two lines bolder", "one", "two link", "a", "b",
    ]


def test_the_article_around_the_best_container():
    page = (
        f"<body><div class='sidebar'><article><h1>A</h1><section><p>{PROSE}</section>"
        f"<section><p>Short.</section><article class='comment'><p>{PROSE}{PROSE}</article>"
        "</article></div><p>Outside</p>"
    )
    assert main_text(page) == f"A\n{PROSE}\nShort."


def test_siblings_of_the_best_container():
    page = (
        f"<div><h2>Title</h2><div><p>{PROSE}</p><p>{PROSE}</p></div><div><p>{PROSE}</p></div>"
        "<div><p><a href='x'>More links</a></p></div><p>A closing line.</p></div>"
    )
    assert main_text(page) == f"Title\n{PROSE}\n{PROSE}\n{PROSE}\nA closing line."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("  \n ", ""),
        ("<nav>only a menu</nav>", ""),
        ("<script>x</script><!-- note -->", ""),
        ("plain, without markup", "plain, without markup"),
        ("<article><h1>Only a head</h1></article>", "Only a head"),
        ("<p>cut off <a href='x", "cut off"),
        ("<p>1 < 2 &lt; 3 &#x41;&bogus; &am", "1 < 2 < 3 A&bogus; &am"),
    ],
)
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + "<p>deep text" + "</div>" * 20_000) == "deep text"
    assert main_text("<article>" + f"<p>{PROSE}" * 5_000).count("\n") == 4_999


def brute(page: str) -> str:
    """What a reader of these pages' one template takes from them."""
    article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    article = re.sub(r"<[/!a-zA-Z][^<>]*\Z", "", article)
    blocks = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
    texts = (" ".join(html_library.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in blocks)
    return "\n".join(filter(None, texts))


def test_query_over_the_pages(spark, sf_dir):
    from plantfuse.llm.queries import op8_main_text

    pages = {row.page_id: row for row in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op8_main_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for row in rows:
        assert row.text == brute(pages[row.page_id].html)
        assert (row.url, row.n_chars) == (pages[row.page_id].url, len(row.text))


def test_other_columns_and_no_rows(spark):
    pages = spark.createDataFrame(
        [(None, "u", None, "x"), (1, None, "<p>a, b", "y"), (1, None, "<p>a, b", "y")],
        "page_id long, url string, html string, text string",
    )
    rows = html_main.extract_pages(pages).collect()
    assert sorted((row.page_id or 0, row.text) for row in rows) == [(0, ""), (1, "a, b"), (1, "a, b")]
    assert html_main.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "names",
    ["page has-sidebar", "no-sidebar", "share-enabled", "content-with-ads", "hasSidebar", "widget", "search layout"],
)
def test_a_wrapper_with_the_text_stays_whatever_its_class(names):
    page = f"<div class='{names}'><h1>Head</h1><p>{PROSE}</p><div class='ad'>Buy, now</div></div>"
    assert main_text(page) == f"Head\n{PROSE}"
    assert main_text(f"{page}<div class='sidebar'><p>Short, aside.</p></div>") == f"Head\n{PROSE}"


@pytest.mark.parametrize(
    "header",
    ["<div class='entry-header'><h1>Head</h1></div>", "<header class='entry-header'><h1>Head</h1></header>"],
)
def test_the_header_of_an_article_stays(header):
    assert main_text(f"<article>{header}<p>{PROSE}</article>") == f"Head\n{PROSE}"
    site = "<header class='header'><h1>Site</h1></header>"
    assert main_text(f"{site}<div>{header}<div><p>{PROSE}</div></div>") == f"Head\n{PROSE}"
    page = f"<article><div class='header'><p>No heading</div><div class='nav header'><h2>N</h2></div><p>{PROSE}"
    assert main_text(page) == PROSE


def test_all_blocks_of_a_page_without_article_and_main():
    links = "<div><a href='a'>One link</a> | <a href='b'>Another link</a></div>"
    page = (
        f"<div>{links}<h1>Head</h1><div><div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div>"
        "<section><p>Short part.</p></section></div><ul><li>one</li><li>two</li></ul>"
        f"<table><tr><td>a</td></tr></table>Loose <a href='c'>end</a> of the text. {links}"
        "<aside>Aside</aside></div>"
    )
    assert main_text(page).split("\n") == [
        "Head", PROSE, PROSE, PROSE, "Short part.", "one", "two", "a", "Loose end of the text.",
    ]


def test_all_articles_of_a_page():
    page = (
        f"<div><article><h2>A</h2><p>{PROSE}{PROSE}</article></div><article><h2>B</h2><p>{PROSE}</article>"
        f"<div class='related'><article><p>{PROSE}</article></div><article class='comment'><p>{PROSE}</article>"
        "<article><h3><a href='x'>Only a teaser</a></h3></article>"
    )
    assert main_text(page) == f"A\n{PROSE}{PROSE}\nB\n{PROSE}"
