import html
import re
import time

from concord.llm.html_text import extract, main_text, op10_html_text

LONG = "A sentence, with marks; and words enough to look like text. " * 4


def test_pages():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header class="site"><h2>Site</h2></header><nav><ul><li><a href="/x">Menu</a></ul></nav><div class="ad">Buy, now. {LONG}</div>
    <div class="wrap"><aside>{LONG}</aside><article><header><h1>Title &amp; more</h1></header><p>{LONG}<br>after<p>Short.<ul><li>one <a href=q>two</a><li>three</ul>
    <div class="comments"><p>{LONG}</p></div><form>{LONG}</form><p data-x="a>b">Last   line\n here &lt;3 &copy; 5 < 6</p></article></div>
    <div id="cookie-notice">{LONG}</div><footer>{LONG}</footer>"""
    own = " ".join(LONG.split())
    assert main_text(page).split("\n") == ["Title & more", f"{own} after", "Short.", "one two", "three", "Last line here <3 © 5 < 6"]


def test_without_article():
    page = f"<body><div class=top><a href=1>Home</a> <a href=2>News</a></div><div id=content><h2>Head</h2><p>{LONG}</p><p>x</p><p>{LONG}</p></div><div class=sidebar>{LONG}</div><div class=end>(c)</div>"
    own = " ".join(LONG.split())
    assert main_text(page).split("\n") == ["Head", own, "x", own]


def test_odd():
    for t in (None, "", "   ", "<", "<p", "<script>x", "<!-- x", "<nav>a</nav>", "</p></div>", "<p></p>"):
        assert "x" not in main_text(t), t
    assert main_text("just text, no tags.") == "just text, no tags."
    began = time.time()
    assert len(main_text("<p>" * 20_000 + "word " * 200_000)) == 999_999
    main_text('<a "' * 3000 + "<div " * 20_000 + "<!--" * 2000)
    main_text("<div>" * 3000 + "text" + "<b " * 20_000)
    assert time.time() - began < 30


def expected(page):
    """For the generated pages: headings and paragraphs of the article."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [html.unescape(re.sub(r"<[^>]+>", " ", x)) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in (" ".join(x.split()) for x in parts) if x)


def test_query(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = op10_html_text(spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == expected(pages[r.page_id]) and r.n_chars == len(r.text)


def test_frame(spark):
    d = spark.createDataFrame([(1, None), (2, "<p>a, b.</p>"), (2, "<p>a, b.</p>")], "page_id long, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    assert [(r.text, r.n_chars) for r in extract(d).orderBy("page_id").collect()] == [("", 0), ("a, b.", 5), ("a, b.", 5)]
    assert extract(d.limit(0)).count() == 0


def test_article_with_body():
    own = " ".join(LONG.split())
    page = f"<body><article><h1>T</h1><p class=lead>lead</p><div class=body><p>{LONG * 3}</p><p>{LONG * 3}</p></div></article></body>"
    assert main_text(page).split("\n") == ["T", "lead", *[" ".join([own] * 3)] * 2]


def test_sections():
    own = " ".join(LONG.split())
    for tag in ("main", "article", "div"):
        page = f"<body><{tag}><section id=a><p>{LONG}</p></section><section id=b>{f'<p>{LONG}</p>' * 13}</section></{tag}></body>"
        assert main_text(page).split("\n") == [own] * 14, tag
    # Content beside the article stays too.
    page = f"<body><div class=intro><p>{LONG}</p></div><article>{f'<p>{LONG}</p>' * 13}</article></body>"
    assert main_text(page).split("\n") == [own] * 14


def test_class_names():
    own = " ".join(LONG.split())
    for name in ("elementor-widget elementor-widget-text", "content-area no-sidebar", "has-sidebar", "page-with-sidebar", "search-results", "sidebar-page-container"):
        assert main_text(f"<body><div class='{name}'><p>{LONG}</p></div></body>") == own, name
    for name in ("widget", "x sidebar", "site-footer", "main-navigation", "comment-list", "ad-box", "cookie-notice", "share_buttons", "related-posts"):
        assert main_text(f"<body><div><p>{LONG}</p></div><div class='{name}'><p>{LONG}</p></div></body>") == own, name


OWN = " ".join(LONG.split())


def test_no_text_is_lost():
    """Closed in themselves, never closed, or shown by a browser."""
    inside = lambda x: main_text(f"<body><article><p>{LONG}</p>{x}<p>{LONG}</p></article><div class=ad>{LONG}</div></body>").split("\n")
    for x, want in (
        ("<p><svg class='i'/>Second.</p>", ["Second."]), ("<p>Second <svg><path d=x><title>icon</title></svg>here.</p>", ["Second here."]), ("<p>Second.<svg><path></p>", ["Second."]),
        ("<p>Second.<script>var x</p>", ["Second."]), ("<p><iframe src='/x'/>Second.</p>", ["Second."]), ("<p>Energy is <math><mi>E</mi>=m</math>.</p>", ["Energy is E=m."]),
        ("<p>Press <button>OK</button> now.</p>", ["Press OK now."]), ("<p><canvas>a</canvas> <object>b</object></p>", ["a b"]), ("<noscript><p>Second.</p></noscript>", ["Second."]),
        ("<noscript>Please enable JavaScript.</noscript>", []), ("<div><button>Share</button> <button>Print</button></div>", []), ("<p>Go <button type=submit>Send</button></p>", ["Go"]),
        ("<select><option>a<option>b</select>", []), ("<template><p>x</p></template>", []), ("<xmp>a <b> &amp; c</xmp>", ["a <b> &amp; c"]), ("<p title=it's>one</p><p class='x'>two</p>", ["one", "two"]),
        ("<div class='ad'/><p>Second.</p>", ["Second."]), ("<p>a<!-->b<!-- c -->d</p>", ["abd"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("<p>one<hr>two</p>", ["one", "two"]),
    ):
        assert inside(x) == [OWN, *want, OWN], x
    # Nothing around the script ends: the rest is script.
    assert main_text(f"<p>{LONG}<script>x") == OWN


def test_deep():
    """Work is linear in the nesting."""
    began = time.time()
    for page in ("<div>text here, and more." * 20_000, "<ul><li>a, b." * 20_000, "<div>" * 20_000 + "<li>a, b c." * 20_000 + "<script>" * 20_000 + "<svg>" * 20_000 + "<p>x" * 20_000):
        main_text(page)
    assert main_text("<div>" * 20_000 + f"<p>{LONG}") == OWN
    assert time.time() - began < 8


def test_ratios_decide():
    """No class, id or helpful tag: links, short lines and a footer of the same tag path as the paragraphs go."""
    menu = "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(8))
    foot = "<div><p>All rights reserved</p></div>"
    page = f"<body><div><ul>{menu}</ul></div><div><h2>Head</h2><p>{LONG * 2}</p><p>Short.</p><p>{LONG * 3}</p><ul><li>one</li></ul></div><div><ul>{menu}</ul></div>{foot}</body>"
    assert main_text(page).split("\n") == ["Head", " ".join([OWN] * 2), "Short.", " ".join([OWN] * 3), "one"]
    page = f"<body><ul>{menu}</ul><h1>Head</h1><p>{LONG}</p><ul><li>one</li></ul><p>{LONG}</p><div>All rights reserved</div></body>"
    assert main_text(page).split("\n") == ["Head", OWN, "one", OWN]
