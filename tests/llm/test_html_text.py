import time

import pytest
from tidemark.llm.html_text import extract, main_text

P = "This is a sentence, with a comma, long enough to count as real text of an article."
MENU = '<ul class="menu"><li><a href="/a">Home page</a><li><a href="/b">News and more</a></ul>'

CASES = {
    "article": (f"<html><head><title>T</title></head><body><header>Site</header><nav>{MENU}</nav><article><h1>Head &amp; line</h1><p>{P}<p><b>Bold\n  part.<br><p>Short.</article><footer>(c)</footer>", f"Head & line\n{P}\nBold part.\nShort."),
    "divs": (f'<body><div id="top-nav">{MENU}</div><div id="content"><h2>Title</h2><div><p>{P}</p><p>{P}</p><ul><li>one</li><li>two</li></ul></div></div><div class="sidebar"><p>{P}</p></div><div id="comments"><p>{P}, really</p></div>', f"Title\n{P}\n{P}\none\ntwo"),
    "notice": (f'<main><div class="cookie-notice"><p>We use cookies, you know, and more of them than you think.</p></div><p>{P}</p><form><p>{P}</p></form><aside>{P}</aside><p>end</p></main>', f"{P}\nend"),
    "script": (f"<body><script>var t='</p><p>x, y, z';</script><style>p{{}}</style><p>{P}</p><!-- <p>gone</p> --><p>a &lt; b &#233; &nbsp; c</p></body>", f"{P}\na < b é c"),
    "table": (f"<article><table><tr><td>{P}<td>cell</table><p>after</p></article>", f"{P}\ncell\nafter"),
    "no paragraphs": ("just <b>some</b> text", "just some text"),
    "two articles": (f"<body><article><p>{P}</p><p>{P}</p><p>{P}</p></article><div class='related'><article><p>{P}</p></article></div>", f"{P}\n{P}\n{P}"),
    "hidden": (f"<article><p>{P}</p><p hidden>no</p><div style='display: none'>no</div></article>", P),
    "header in article": (f"<article><header><h1>Name</h1></header><p>{P}</p><footer>by</footer></article>", f"Name\n{P}"),
    "cut off": (f"<body><article><p>{P}</p><p>open <i>end", f"{P}\nopen end"),
    "stray": (f"</div></p><article><p>{P}</b></span></p></article></article>", P),
    "form around the page": (f'<body><form id="aspnetForm" action="x"><input type="hidden"><nav>{MENU}</nav><div id="content"><h2>Title</h2><p>{P}</p><p>{P}</p></div><button>Go</button></form></body>', f"Title\n{P}\n{P}"),
    "form in the page": (f"<body><article><p>{P}</p><p>{P}</p></article><form><p>{P}</p><label>Name</label><input></form></body>", f"{P}\n{P}"),
    "references": (f'<article><p>{P}</p><ul><li><a href="/r1">A work on stones, by Li</a></li><li><a href="/r2">A work on rain</a></li></ul></article>', f"{P}\nA work on stones, by Li\nA work on rain"),
    "doubtful names": (f'<article><p class="byline">By Ann Lee</p><p class="search-tips">{P}</p><div class="promo-text"><p>{P}</p></div><div class="share"><a href="/f">Post</a> <a href="/t">Send</a></div><p class="tags-explained">{P}</p></article>', f"By Ann Lee\n{P}\n{P}\n{P}"),
    "open quote": (f'<article><p title="it>{P}</p><p class="x">second one</p></article>', f"{P}\nsecond one"),
    "open quote, no other": (f"<article><p title='it>{P}</p><p>second one</p></article>", f"{P}\nsecond one"),
    "markup in attribute": (f"""<article><p data-x='<b class="y">z</b>' title="a > b">{P}</p></article>""", P),
    "definitions": (f"<article><p>{P}</p><dl><dt>one<dd>first<dt>two<dd>second</dl></article>", f"{P}\none\nfirst\ntwo\nsecond"),
    "nested lists": (f"<article><p>{P}</p><ul><li>a<ul><li>b<li>c</ul><li>d</ul></article>", f"{P}\na\nb\nc\nd"),
    "wrappers": (f"<body><div><div><p>{P}1<p>{P}2</div></div><div><div><p>{P}3<p>{P}4</div></div></body>", f"{P}1\n{P}2\n{P}3\n{P}4"),
    "sections": (f'<body><nav>{MENU}</nav><section><div><h2>One</h2><p>{P}</div></section><section><div><h2>Two</h2><p>{P}<p>{P}</div></section><section><div><h2>Three</h2><p>{P}</div></section><div class="sidebar"><div><p>{P}</div></div></body>', f"One\n{P}\nTwo\n{P}\n{P}\nThree\n{P}"),
    "short blocks between": (f'<div id="c"><div><p>{P}</p><p>{P}</p></div><h2>Next</h2><div>Short.</div><div>{P} Z</div></div>', f"{P}\n{P}\nNext\nShort.\n{P} Z"),
    "wrappers round a menu": (f"<body><div><div><p>{P}<p>{P}</div></div>{MENU}<div><div><p>{P}</div></div><div>(c)</div></body>", f"{P}\n{P}\n{P}"),
    "names in an article": (f'<article><p>{P}</p><p class="comment-on-law">{P}</p><div class="comments-list-box"><p>{P}</p></div><p class="advert">{P}</p></article>', f"{P}\n{P}"),
    "text beside wrappers": (f"<body><div>{P} <div><p>{P}<p>{P}</div></div></body>", f"{P}\n{P}\n{P}"),
    "attribute": (f'<article><p title="a > b">{P}</p></article>', P),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    html, want = CASES[name]
    assert main_text(html) == want


def test_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", CASES["article"][0], "x"), (3, "u", CASES["article"][0], "x"), (4, "u", "<" * 1000 + "<p>" * 3000 + "deep", "x"), (5, "u", "<article>" + f"<p>{P}</p>" * 20000, "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == by[2].text == "" and by[3].text == CASES["article"][1]
    assert "deep" in by[4].text and by[5].text.count("\n") == 19999 and all(r.n_chars == len(r.text) for r in got)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 90_000 + "</span>" * 75_000,
        "<div>" * 50_000 + "<table><tr><td>" + "<b>" * 50_000 + "</div>" * 75_000,
        "<div>" * 60_000 + "<dt></dt>" * 70_000,
        "<div>" * 90_000 + "<body>" * 90_000,
        "<li><ul>" + "<b>" * 60_000 + "<li></li>" * 60_000,
        "<a href='" * 100_000,
        "<form>" * 80_000 + f"<p>{P}</p>" + "</p>" * 100_000,
        f"<article><p>{P}</p>" + "<li><i>" * 60_000 + "</ul>" * 60_000,
        f"<div><p>{P}</p></div>" * 12_000,
        "<div>" * 40_000 + f"<div><p>{P}</p></div>" * 4_000,
        ("<div>" * 20_000 + f"<p>{P}</p>" * 3 + "</div>" * 20_000) * 4,
    ],
)
def test_a_megabyte_of_broken_markup_takes_linear_time(html):
    began = time.process_time()
    main_text(html)
    assert time.process_time() - began < 6
