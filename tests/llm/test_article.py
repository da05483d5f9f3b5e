"""Main text of pages whose parts are known."""

import html as markup
import random
import re

import pytest

from grapevine.llm import queries
from grapevine.llm.article import Page, extract, main_text

LOREM = [
    "The river rose overnight, and by morning the lower fields were under water, as they are in most years.",
    "Farmers moved the cattle uphill, checked the fences, and waited for the gauge at the old bridge to fall.",
    "Nobody was hurt. The council, which met at noon, thanked everyone who had carried sand &amp; boards.",
]
PLAIN = [markup.unescape(x) for x in LOREM]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in LOREM)
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News, today</a></li></ul></nav>'
FOOT = "<footer><p>Copyright, all rights reserved, by the long and winding name of the publisher, in town.</p></footer>"
SIDE = '<aside><p>Most read: a long teaser, with commas, and with many words that say little, but go on.</p></aside>'


def text_of(page: str) -> list[str]:
    return main_text(page)[0]


def test_article_element_without_its_surroundings():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var x = '</p><p>no';</script></head><body>"
        f"<header><a href='/'>The Site</a><h1>Site name</h1></header>{NAV}<div class='ad'>Buy now, cheap, today, only here, and hurry.</div>"
        f"<div id='cookie-banner'><p>We use cookies, and ask for consent, on every page, again.</p></div>"
        f"<article><header><h1>Flood</h1><span>By someone</span></header>{PARAGRAPHS}<form><p>Subscribe, please.</p><input></form></article>{SIDE}"
        "<section class='comments'><h2>Comments</h2><article class='comment'><p>First, of all, I think, that this, is long, enough.</p></article></section>"
        f"{FOOT}</body></html>"
    )
    assert text_of(page) == ["Flood", *PLAIN]


def test_comments_longer_than_the_text():
    comments = "".join(f"<div class='comment-body'><p>I, too, have much to say, {i}, and I say it at length, as ever, here.</p></div>" for i in range(40))
    page = f"<body>{NAV}<div id='content'><h1>Flood</h1>{PARAGRAPHS}</div><div id='disqus_thread'>{comments}</div>{FOOT}</body>"
    assert text_of(page) == ["Flood", *PLAIN]


def test_scored_container_among_plain_divisions():
    links = "".join(f"<li><a href='/{i}'>A headline, which is long enough to look like a text {i}</a></li>" for i in range(12))
    page = (
        f"<body class='has-sidebar'><div class='top'><ul>{links}</ul></div><div class='wrap'><div class='left'><ul>{links}</ul></div>"
        f"<div class='mid'><h2>Flood</h2>{PARAGRAPHS}<blockquote>It was high, they said, very high.</blockquote></div></div>"
        "<div>All contents, unless stated.</div></body>"
    )
    assert text_of(page) == ["Flood", *PLAIN, "It was high, they said, very high."]


def test_siblings_of_the_best_container_are_kept():
    page = (
        f"<body>{NAV}<h1>Flood</h1><div><p>{LOREM[0]}</p><p>{LOREM[1]}</p><p>{LOREM[2]}</p></div>"
        f"<div><p>{LOREM[1]}</p><p>{LOREM[0]}</p></div><p>{LOREM[2]}</p><div><a href='/x'>More, more, more, of everything, here and there</a></div></body>"
    )
    assert text_of(page) == ["Flood", *PLAIN, PLAIN[1], PLAIN[0], PLAIN[2]]


def test_main_element_and_sections():
    page = f"<body><main><h1>Flood</h1><section><h2>One</h2><p>{LOREM[0]}</p></section><section><h2>Two</h2><p>{LOREM[1]}</p></section></main>{SIDE}</body>"
    assert text_of(page) == ["Flood", "One", PLAIN[0], "Two", PLAIN[1]]


def test_text_without_paragraph_elements():
    page = f"<body>{NAV}<div id='content'>{LOREM[0]}<br><br>{LOREM[1]}<br/>{LOREM[2]}</div>{FOOT}</body>"
    assert text_of(page) == [" ".join(PLAIN)]
    assert text_of("only words, no markup") == ["only words, no markup"]


def test_page_wrapped_in_a_form_and_in_a_named_layout():
    page = f"<body><form id='aspnet'><div class='layout sidebar-left'><div class='main'>{PARAGRAPHS}</div></div></form>{FOOT}</body>"
    assert text_of(page) == PLAIN


def test_layout_names_that_sound_like_other_parts():
    parts = "".join(f"<div class='elementor-widget'><p>{x}</p></div>" for x in LOREM)
    page = f"<body><article class='post'><div class='with-header cookie-free'>{parts}</div></article><ins class='adsbygoogle'>Buy, buy, buy.</ins></body>"
    assert text_of(page) == PLAIN
    assert text_of(f"<article>{PARAGRAPHS}<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></article>") == [*PLAIN, "so x=1"]


def test_tables_lists_and_definitions_inside_a_text():
    page = f"<article>{PARAGRAPHS}<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><th>c</table><dl><dt>t<dd>d</dl><pre>x\n  y</pre></article>"
    assert text_of(page) == [*PLAIN, "one", "two", "a", "b", "c", "t", "d", "x y"]


def test_menus_inside_the_article_go():
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Other story {i}</a></li>" for i in range(5)) + "</ul>"
    page = f"<article>{PARAGRAPHS}{menu}<p>See <a href='/x'>this link</a>.</p><div class='social-share'>Share, now</div></article>"
    assert text_of(page) == [*PLAIN, "See this link."]


@pytest.mark.parametrize(("page", "blocks"), [
    (None, []), ("", []), (" \n", []), ("<", ["<"]), ("a < b &lt; c", ["a < b < c"]), ("<p>a&nbsp;&nbsp;b\n\tc</p>", ["a b c"]),
    ("<p>&eacute;&#233;&#xE9;&notit; &amp</p>", ["ééé¬it; &"]), ("<p>one<p>two<b>three<p>four", ["one", "twothree", "four"]),
    ("<p>x<!-- <p>no --><!-->y<!--- z", ["xy"]), ("<p>x<script>no</p>", ["x"]), ("<article><p>a</article></div></body><p>b", ["a"]),
    ("<p title='a>b'>c</p><p title=\"d", ["c"]), ("<nav>a</nav>", []), ("<p hidden>a</p><p style='display: none'>b</p><p>c</p>", ["c"]),
    ("<h1>a</b></h2>b", ["a", "b"]), ("<![CDATA[x]]>y", ["y"]), ("</>z</ q>", ["z"]), ("<br>" * 3, []), ("<div>" * 3000 + "deep", ["deep"]),
    ("<table><tr><td>a<table><tr><td>b</table>c</table>", ["a", "b", "c"]), ("<a b='", []), ("<p don't>it's</p><p>x's</p>", ["it's", "x's"]),
])
def test_odd_pages(page, blocks):
    assert text_of(page) == blocks


def test_every_start_has_its_end():
    dice = random.Random(2)
    for _ in range(300):
        page = Page("".join(dice.choice(["<p>", "</p>", "<li>", "<td>", "<b>", "</b>", "<div>", "</div>", "x", "<br>", "</li>", "<table>", "</table>", "<!--", "<h1>", "</h2>"])
                            for _ in range(dice.randint(0, 60))))
        stack = []
        for event in page.events:
            if isinstance(event, int):
                if event >= 0:
                    assert page.parents[event] == (stack[-1] if stack else 0)
                    stack.append(event)
                else:
                    assert stack.pop() == ~event
        assert not stack


def test_query_over_the_given_pages(spark):
    got = {r.page_id: r for r in queries.op13_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:  # plainly: these pages have one article element of h1, p and br
        inner = re.search(r"<article>(.*)</article>", page.html, re.DOTALL)[1]
        blocks = [" ".join(markup.unescape(re.sub("<[^>]*>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", inner)]
        assert got[page.page_id].text == "\n\n".join(filter(None, blocks))
        assert got[page.page_id].n_chars == len(got[page.page_id].text) and got[page.page_id].url == page.url


def test_rows_of_all_kinds(spark):
    rows = [(1, f"<article>{PARAGRAPHS}</article>", "x", 1.0), (1, f"<article>{PARAGRAPHS}</article>", "x", 1.0), (None, None, None, None)]
    rows.append((2, "<article>" + PARAGRAPHS * 4000 + "</article>", "long", 2.0))
    pages = spark.createDataFrame(rows, "page_id bigint, html string, blocks string, score double").withColumnRenamed("blocks", "text")
    got = extract(pages, "html", ["page_id", "text"]).collect()
    assert sorted((r.page_id or 0, r.text or "", len(r.blocks)) for r in got) == [(0, "", 0), (1, "x", 3), (1, "x", 3), (2, "long", 12_000)]
    assert extract(pages.limit(0), "html", ["page_id"]).count() == 0
