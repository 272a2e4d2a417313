import html
import re

import pytest

from bytestrata.llm.html_text import extract, main_text

P = "This is a paragraph of the story, with commas, and quite some words in it so that it counts."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>never closed", "never closed"), ("<script>only()</script>", ""), ("a < b &amp; 1 <3", "a < b & 1 <3"),
        (f"<body><nav><a href=x>Home</a></nav><div id=content><h1>T</h1><p>{P}</p><p>{P}</p></div><aside>More</aside><footer>(c)</footer>", f"T {P} {P}"),
        (f"<div class='post'><p>{P}</p><div class='comments'><p>{P} first!</p></div></div>", P),
        (f"<article><p>{P}<form><input><button>Send</button></form><p>&Eacute;t&eacute; &#233;&nbsp;x</article><div class=cookie-notice>{P}</div>", f"{P} Été é x"),
        (f"<main><p>one<b>two</b> three<br>four</p><ul><li>a<li>b</ul><p>{P}</p></main>", f"onetwo three four a b {P}"),
        (f"<div><p>{P}</p></div><div><p>{P}, again</p></div>", f"{P} {P}, again"),
        (f"<style>p{{}}</style><script>var t='</p>';</script><!-- {P} --><div hidden><p>{P}</p></div><article>{P}</article>", P),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        (f"<ARTICLE><P>{P}</P><SCRIPT>x</SCRIPT></ARTICLE>", P),
        (f"<article><p>{P}</p><p>{P}</p", f"{P} {P}"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_deep_and_long():
    assert main_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert main_text("<article><p>" + "word, " * 200_000 + "</article>").count("word,") == 200_000
    assert main_text("<" * 50_000 + "end") == "<" * 49_999  # a tag that never ends is dropped


def test_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages.withColumn("text", pages["url"])).collect():
        body = source[r.page_id].split("<article>")[1].split("</article>")[0]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body)).split())
        assert r.text == want and r.n_chars == len(want)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>x"), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string")
    assert sorted((tuple(r) for r in extract(df).collect()), key=str) == sorted([(1, None, "", 0), (None, "u", "x", 1), (2, "u", "", 0), (2, "u", "", 0)], key=str)
    assert extract(df.limit(0)).count() == 0


LONG = "A long paragraph, with commas, of some length, goes on and on until it is long enough. " * 3


def test_short_parts_beside_a_long_one():
    many = f"<p>{LONG}</p>" * 30
    for tag in ("article", "main"):
        assert main_text(f"<{tag}>Lead in. <b>Bold</b>.<section>{many}</section><section>{f'<p>{P}</p>' * 3}</section></{tag}>").count(P) == 3
    page = f"<body><div><p>Lead, first.</p></div><div>Bare <i>text</i>, too.<div>{many}</div><section><p>{P}</p></section> The end.</div><div><p>Closing words.</p></div><div><a href=x>Home, all.</a></div>"
    got = main_text(page)
    assert got.startswith("Lead, first. Bare text, too. A long") and got.endswith(f"{P} The end. Closing words.") and got.count("A long") == 90


@pytest.mark.parametrize("wrapper", ["id=content class=has-sidebar", "class='content-with-sidebar wrapper'", "class='header-fixed layout'", "class=no-comments"])
def test_layout_wrappers(wrapper):
    body = f"<h1>T</h1><p>{P}</p><p>{P}</p>"
    side = f"<div class=sidebar><p>{P} aside</p></div><div class=comments><p>{P} first!</p></div>"
    assert main_text(f"<body><div {wrapper}><div>{body}</div>{side}</div>") == f"T {P} {P}"
    assert main_text(f"<body><div {wrapper}><main>{body}</main>{side}</div>") == f"T {P} {P}"
    assert main_text(f"<body><div {wrapper}><article>{body}</article>{side}</div>") == f"T {P} {P}"


@pytest.mark.parametrize("wrapper", ["div class='no-sidebar'", "div class='post has-sidebar'", "div class='post hentry comments-open'", "div id=page class='sidebar-right search-active'"])
def test_layout_states_are_no_names(wrapper):
    body = f"<h1>T</h1><p>{P}</p>"
    page = f"<body><{wrapper}>{body}<div class=comments><p>{P} {P} {P} first!</p></div></div><div class=sidebar><p>{P}</p></div>"
    assert main_text(page) == f"T {P}"


def test_sections_of_either_kind():
    section = f"<section id=discussion><h2>Discussion</h2><p>{P}</p></section>"
    links = "<section id=related><h2>Related</h2><p><a href=x>One, more.</a></p></section>"
    comments = f"<div class=comments><h2>Comments</h2><p>{P} first!</p></div>"
    assert main_text(f"<article><p>{P}</p>{section}{links}{comments}</article>") == f"{P} Discussion {P}"
    assert main_text(f"<body><div class=cookie-notice><p>{P}</p></div>") == P  # nothing else is there


def test_attributes_and_formulas():
    assert main_text('<p class=x">Hello, you.</p>') == "Hello, you."
    assert main_text("<p title='a > b' data-x=1\">one</p><p \"odd>two</p>") == "one two"
    assert main_text(f"<article><p>{P} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math></p></article>") == f"{P} x=2"


def test_points_reach_the_root():
    page = f"<body>{'<div>' * 40}{f'<div><div><div><p>{LONG}</p></div></div></div>' * 12}{'</div>' * 40}<div><a href=x>a, b, c, d</a></div>"
    assert main_text(page).count("A long") == 36


@pytest.mark.parametrize("article", ["div", "td", "section"])
def test_pages_without_article(article):
    """The container with the prose is found by its points among menus, lists of links and adverts."""
    noise = "<ul>" + "".join(f"<li><a href=/{i}>Link, number {i}, here</a></li>" for i in range(60)) + "</ul>"
    inner = f"<h1>T</h1>{f'<p>{P}</p>' * 4}<ul><li>One, point.</li></ul><blockquote>{P}</blockquote>"
    box = f"<table><tr><td>{inner}</td></tr></table>" if article == "td" else f"<{article}>{inner}</{article}>"
    page = f"<body><div>{noise}</div><div class=advert>{P * 9}</div><div>{box}</div><div>{noise}</div><div id=footer>{P}</div>"
    assert main_text(page) == f"T {P} {P} {P} {P} One, point. {P}"
