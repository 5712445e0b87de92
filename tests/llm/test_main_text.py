"""Main text of pages: hand-made pages of many layouts, broken markup, edge rows, and the
registered query against a reading of its one layout by patterns."""

import html
import re

import pytest

from weft.llm.main_text import extract_pages, main_text

SF = "/root/testdata/sf0.01"
P = [f"Paragraph {k}, with some words, commas, and an end that is long enough to be read as prose." for k in range(4)]
ARTICLE = "".join(f"<p>{p}</p>" for p in P)
TEXT = "\n".join(P)


@pytest.mark.parametrize("page", [
    f"<nav><a href=/>Home</a></nav><article>{ARTICLE}</article><footer>(c)</footer>",
    f"<header><h1>Site</h1></header><main>{ARTICLE}<aside>Side, box, text, with, commas.</aside></main>",
    f"<div class=menu><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div id=content>{ARTICLE}</div>"
    "<div class='sidebar-right'>Some, words, in, a, bar, of, the, page, that, are, many, many, more, than, few.</div>",
    f"<div id=wrap><div class='cookie-notice'><p>We use cookies, really.</p></div><div class=x>{ARTICLE}</div></div>",
    f"<div class='post has-sidebar'>{ARTICLE}</div><section id=comments><article class=comment><p>{'I, say. ' * 90}</p></article></section>",
    f"<body class='with-ads sidebar-left'><article>{ARTICLE}<form><p>Mail, please</p><input></form></article></body>",
    f"<div><div class=ad>Buy, now, this, thing, and, more, {'very ' * 50}</div><div>{ARTICLE}</div></div>",
    f"<article>{ARTICLE}<ul><li><a href=1>More one</a><li><a href=2>More two</a><li><a href=3>More 3</a></ul></article>",
    f"<article><header class=entry-header></header>{ARTICLE}<footer>Share, like</footer></article>",
    f"<article>{ARTICLE}<div style='display: none'>hidden, text</div><p hidden>more, hidden</p></article>",
    f"<form id=page>{ARTICLE}<input type=hidden></form>",
    f"<div class=content><div>{''.join(f'<p>{p}</p>' for p in P[:3])}</div><div><p>{P[3]}</p></div></div>",
    f"<article>{ARTICLE.replace('</p>', '')}</article>",
    f"<article>{ARTICLE}<script>var x='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --></article>",
    f"<article>{ARTICLE}<span class='ad'>advert</span></article>",
    f"<title>x</title><p>{'</p><p>'.join(P)}",
    f"<article>{ARTICLE}<div role=alert>A notice, here.</div><template><p>t, t</p></template></article>",
    f"<div class=newsletter-signup>{ARTICLE[:0]}Join, us, now, please, today.</div>{ARTICLE}",
])
def test_layouts(page):
    assert main_text(f"<!DOCTYPE html><html><head><meta charset=utf-8></head><body>{page}</body></html>") == TEXT
    assert main_text(page) == TEXT


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("   \n ", ""), ("plain  text\n here", "plain text here"), ("<p>a < b &amp; c &lt;d&gt; &copy;&#8364;&nbsp;x</p>", "a < b & c <d> ©€ x"),
    ("<article><h1>Title</h1><p>One<br>two</p>loose <b>bold</b> end<div>inner</div>tail</article>", "Title\nOne two\nloose bold end\ninner\ntail"),
    ("<article><p><b>one.<br><p>two.</p><p>th<i>re</i>e.</p></article>", "one.\ntwo.\nthree."),
    ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
    ("<article><p>never closed", "never closed"), ("<article><p>x</p><!-- never closed <p>y</p>", "x"),
    ("<article><p>x</p><script>never closed <p>y</p>", "x"), ("<article><p title='a > b'>x</p></article>", "x"),
    ("<article><p title=\"never closed>x</p></article>", "x"), ("<nav>only, a, menu</nav>", ""), ("<script>x</script>", ""),
    ("<article><ul><li>one, two<li>three</ul></article>", "one, two\nthree"),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"), ("<article><a href=x><p>linked block</p></a><p>text, text</p></article>", "linked block\ntext, text"),
    ("<article><pre>a\n  b</pre><blockquote><p>q</p></blockquote><figure><img><figcaption>cap</figcaption></figure></article>", "a b\nq\ncap"),
    ("<article></p>a</div></b>b</article>", "ab"), ("<p>日本語、テキスト。", "日本語、テキスト。"), ("a\x00b", "a\x00b"),
])
def test_markup(page, text):
    assert main_text(page) == text


def test_time_is_in_proportion():
    import time
    for page in ("<b>" * 200_000 + "x", "<div>" * 100_000 + "x, y" + "</div>" * 100_000, "<p title=\"" * 100_000,
                 "<" * 300_000, "</b>" * 200_000, "<!--" * 200_000, "<ul><li>" * 50_000 + "x", "<a href='" * 100_000,
                 "<div class=x><p>a, b" * 50_000, "&" * 300_000, "<script>" * 50_000):
        t = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - t < 6, page[:30]


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    page = f"<article>{ARTICLE}</article>"
    rows = [(1, "u", page, "x", 1), (1, "u", page, "x", 1), (None, None, page, None, None), (2, "v", None, "x", 1),
            (3, "w", "", "", 0), (4, "x", "<article>" + "<p>😀 many words, here.</p>" * 20_000 + "</article>", "", 0)]
    got = sorted(extract_pages(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [tuple(r) for r in got[:4]] == [(1, "u", TEXT, len(TEXT))] * 2 + [(2, "v", "", 0), (3, "w", "", 0)]
    assert got[4].text == "\n".join(["😀 many words, here."] * 20_000) and got[4].n_chars == len(got[4].text)
    assert tuple(got[5]) == (None, None, TEXT, len(TEXT))
    assert extract_pages(spark.createDataFrame([], schema)).count() == 0


def test_registered_query_against_patterns(spark):
    from weft.llm.queries import QUERIES
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        lines = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inside)]
        text = "\n".join(x for x in lines if x)
        want[r.page_id] = (r.page_id, r.url, text, len(text))
    got = QUERIES["op13_main_text"](spark, SF).collect()
    assert len(got) == len(want) and all(tuple(r) == want[r.page_id] for r in got)
