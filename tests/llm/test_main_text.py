"""Main texts against a plain cut of the article, made pages, broken markup."""

import html
import re

import pytest

from traffic_risk.llm import main_text, registry

SF = "/root/testdata/sf0.001"
LEARNED = main_text.Weights({"div": 24.0, "li": 24.0, "ul": 24.0, "a": 8.0, "p": 0.1, "b": 0.1, "h1": 0.1, "article": 0.1, "section": 0.1, "br": 0.1, "h2": 0.1, "em": 0.1})


def plain(page):
    """The blocks of the only article of the given pages."""
    inside = re.search(r"<article>(.*)</article>", page or "", re.S)
    parts = re.split(r"</?(?:h1|p)>", inside[1]) if inside else []
    texts = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = registry.QUERIES["op2_main_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text) == (pages[r.page_id].url, plain(pages[r.page_id].html))
        assert r.n_chars == len(r.text)


BODY = "<p>One two three four five six seven eight nine ten.</p><p>And more words of the same article here, quite some.</p>"


@pytest.mark.parametrize("page, want", [
    (f"<html><head><title>t</title></head><body><nav>Home About</nav><article><h1>Head &amp; line</h1>{BODY}</article></body>", 3),
    (f"<body><header>Site name</header><div id='sidebar'>Links and links</div><main>{BODY}</main><footer>c 2024</footer>", 2),
    (f"<article>{BODY}<div class='ad-box'>Buy now</div><p>After the advert there is more to read, and it stays.</p></article>", 3),
    (f"<article>{BODY}<section class='comments'><p>First!</p><p>I disagree with all of it.</p></section></article>", 2),
    (f"<article>{BODY}<form><label>Name</label><input><button>Send</button></form><p>Last words of this article to be read.</p></article>", 3),
    (f"<div class='cookie-notice'>We use cookies on this page.</div><script>var a = '<p>no</p>';</script><article>{BODY}</article>", 2),
    (f"<body class='has-sidebar'><article class='post related'><aside>Note</aside>{BODY}</article></body>", 2),
    (f"<article><header><h1>Title in a header</h1></header>{BODY}</article><p class='notice'>closed<div>x</div>", 3),
])
def test_made_pages(page, want):
    text = main_text.extract(page, LEARNED)
    lines = text.split("\n")
    assert len(lines) == want, text
    assert "One two three four five six seven eight nine ten." in lines
    for word in ("Home", "Site", "Links", "Buy", "First", "Name", "Send", "cookies", "no", "Note", "2024", "closed"):
        assert word not in text.split()


LINKS = "".join(f"<li><a href='/{i}'>Home entry {i}</a></li>" for i in range(6))


@pytest.mark.parametrize("page", [
    f"<div class='layout has-sidebar'><article>{BODY}</article><div class='sidebar'>Home</div></div>",
    f"<div class='page with-header'><header>Site</header><main>{BODY}</main></div>",
    f"<section class='social-science'><article>{BODY}</article></section>",
    f"<div class='no-sidebar'><article>{BODY}</article></div>",
    f"<div class='content-sidebar'><div class='post-body'>{BODY}</div><div id='sidebar-left'>Links</div></div>",
    f"<div class='hasSidebar'><article>{BODY}</article></div>",
    f"<form action='/'><nav><ul>{LINKS}</ul></nav><article>{BODY}</article><input><footer>c 2024</footer></form>",
    f"<form action='/'><div class='menu'>Home</div><div>{BODY}</div><input></form>",
    f"<body><nav><ul>{LINKS}</ul><article>{BODY}</article></body>",
    f"<body><nav><ul>{LINKS}</ul><div>{BODY}</div><footer>c 2024</footer></body>",
    f"<div class='header'><div class='menu'>Home<main>{BODY}</main></div>",
    f"<article>{BODY}</article><section class='comments'><article class='comment'><p>First! I disagree with every single word of it.</p></article></section>",
    f"<aside><article class='teaser'><p>Links to another story that is quite long to read.</p></article></aside><main>{BODY}</main>",
    f"<div class='comment-free widget-area-main'><article>{BODY}</article></div>".replace("comment-free ", ""),
])
def test_layouts_keep_their_article(page):
    assert main_text.extract(page, LEARNED).split("\n") == re.sub("</?p>", "\n", BODY).strip("\n").split("\n\n")


def test_title_in_a_post_header_stays():
    page = f"<div class='post'><div class='post-header'><h1>The title of this</h1></div>{BODY}</div>"
    weights = main_text.Weights({**LEARNED.tags, "div": 0.1})
    assert main_text.extract(page, weights).startswith("The title of this\nOne two")


@pytest.mark.parametrize("names, side", [
    ("sidebar", True), ("left-sidebar", True), ("sidebar-left", True), ("has-sidebar", False), ("noSidebar", False), ("content-sidebar", False), ("ad-box", True),
    ("ad", True), ("advanced", False), ("header", True), ("site-header", True), ("article-header", False), ("headered", False), ("with-header", False), ("social", True),
    ("social-science", False), ("share-buttons", True), ("share-price", False), ("comment-body", True), ("comments-42", True), ("cookie-notice", True), ("post related", True),
    ("related-posts-page", False), ("widget-area-main", False), ("widget_area", True), ("menu-item-7", True), ("search-engines", False), ("", False), ("primaryNav", True),
])
def test_class_names(names, side):
    assert bool(main_text.hint_of(names)) is side


def test_many_unclosed_parts_take_linear_time():
    import time

    page = "<nav><p>a</p>" * 40_000 + "<form>" * 10_000
    start = time.perf_counter()
    main_text.extract(page, LEARNED)
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("page, want", [
    ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a&nbsp;b &lt;i&gt; &#233;&#x41; &copy &bogus;</p>", "a b <i> éA © &bogus;"),
    ("<p>in<b>li</b>ne <em>x</em>\n\t y<br>z</p>", "inline x y z"), ("<p>a<p>b<p>c", "a\nb\nc"),
    ("<p>cut <b", "cut"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<p title='a>b'>q</p>", "q"),
    ("<p>x<!-- <p>no</p> -->y</p>", "xy"), ("<style>p{}</style><p>z", "z"), ("<p>open <script>never closed", "open"), ("<nav>a b</nav>", ""),
])
def test_markup(page, want):
    assert main_text.extract(page, main_text.Weights({}, other=0.1)) == want


@pytest.mark.parametrize("unit", ["<a ", "<", "<a href=\"", "<!-- ", "&", "<p class=\"x", "<div class='ad'>", "</p>", "<a b='\" c=\"'", "word "])
def test_long_broken_pages(unit):
    main_text.extract(unit * 40000, LEARNED)


@pytest.mark.parametrize("scores", [[], [-1.0], [1.0, -2.0, 3.0, -1.0, 2.0, -5.0, 4.0], [0.0, 1.0, 0.0], [2.0, -2.0, 2.0]])
def test_best_stretch(scores):
    first, stop = main_text.best_stretch(scores)
    sums = [sum(scores[a:b]) for a in range(len(scores) + 1) for b in range(a, len(scores) + 1)]
    assert sum(scores[first:stop]) == max([0.0, *sums])


def test_weights_and_odd_rows(spark):
    page = f"<body><div>Menu of the day</div><article>{BODY}</article><div>End of the page</div></body>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    weights = main_text.fit(pages, "html")
    assert weights.tags["div"] > 5 > 1 > weights.tags["p"] > 0
    got = main_text.main_texts(pages, weights).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got)[:1] == [(0, 0)]
    assert [r.text for r in got if r.page_id == 1] == [main_text.extract(page, weights)] * 2
    assert main_text.fit(pages.where("page_id = 2"), "html") == main_text.Weights({"article": 0.1, "main": 0.1})
    assert main_text.main_texts(pages.limit(0), weights).collect() == []
