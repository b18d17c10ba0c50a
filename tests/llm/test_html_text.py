"""Main text of pages with and without telling names, broken pages, awkward rows."""

import pytest

from lotgrid.llm.html_text import extract, extract_pages

PROSE = "A first sentence, with words in it. And another one, which is longer than that; it goes on."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- <p>not this, at all.</p> --><div class="ad">Buy this now, please.</div>
<article><h1>Heading &amp; more</h1><p><b>{PROSE}<br><p>x &lt; y&nbsp;and &#233;,
 {PROSE}</p><ul><li>item</li></ul></article><div class="comments"><p>{PROSE}</p></div><footer>&copy; us</footer></body></html>"""


def test_marked_page():
    assert extract(PAGE) == f"Heading & more\n\n{PROSE}\n\nx < y and é, {PROSE}\n\nitem"


def test_ratios_without_names():
    links = "".join(f'<div><a href="/{k}">Link {k}</a></div>' for k in range(12))
    page = f"<body><div><div>{links}</div><div><h2>Title</h2><p>{PROSE}</p><p>{PROSE}</p></div><div><span>Terms</span></div></div></body>"
    assert extract(page) == f"Title\n\n{PROSE}\n\n{PROSE}"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words, no tags.", "plain words, no tags."),
        ("a < b and c > d, right.", "a < b and c > d, right."),
        ("<p>open <b>bold", "open bold"),
        ("<script>var x = '<p>';", ""),
        ("<p>cut off &am", "cut off &am"),
        ("<p>cut</p><div cla", "cut"),
        ('<p title="a > b">kept</p>', "kept"),
        ("<p title='open>text", "text"),
    ],
)
def test_fragments(source, text):
    assert extract(source) == text


def test_deep_and_long():
    assert extract("<div>" * 3000 + "deep, down." + "</div>" * 3000) == "deep, down."
    long = f"<article>{''.join(f'<p>{PROSE}</p>' for _ in range(5000))}</article>"
    assert extract(long) == "\n\n".join([PROSE] * 5000)


def test_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = extract_pages(df).collect()
    assert sorted((str(r.page_id), r.n_chars, len(r.text)) for r in got) == sorted([("1", len(extract(PAGE)), len(extract(PAGE)))] * 2 + [("None", 0, 0), ("2", 0, 0)])
    assert extract_pages(df.limit(0)).collect() == []
