"""Main text against hand-made pages whose article is known, and against a plain cut on the table's own pages."""

import html
import re
import time

import pytest

from tensorloom.llm import queries
from tensorloom.llm.html_extract import extract, main_text

SEMANTIC = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{margin:0}}</style><script>var t="</p><article>";</script></head><body>
<header class="masthead"><a href="/">Site</a> daily</header><nav><ul><li><a href="/a">Alpha {i}</a></li></ul></nav>
<div class="cookie-notice">We use cookies {i}</div><div class="ad">Buy {i}</div>
<article><h1>Head &amp; line {i}</h1><p>First   <b>bold</b>
text {i} &lt;x&gt; a < b.<br>second line</p><aside>Aside {i}</aside><ul><li>item one</li><li>item two</li></ul><p>Last<p>unclosed {i}
<section class="comments"><p>Reader says {i}</p></section></article><aside class="sidebar"><p>Also read</p></aside>
<form><label>Mail</label><input name=x><button>Send</button></form><footer>&copy; me {i}</footer></body></html>"""
DIVS = """<html><body><div id="top-menu"><a href=/>Home</a></div><div class="content"><div class="post-body"><h2>Title {i}</h2><p>{body}</p></div>
<div class="share">Share this</div></div><div id="footer">Imprint {i}</div>"""


def test_semantic_page():
    expected = "Head & line 7\n\nFirst bold text 7 <x> a < b. second line\n\nitem one\n\nitem two\n\nLast\n\nunclosed 7"
    assert main_text(SEMANTIC.format(i=7)) == expected


def test_hosts_and_odd_rows(spark):
    rows = [(i, f"http://a.example/{i}", SEMANTIC.format(i=i), "old") for i in range(6)]
    rows += [(10 + i, f"http://b.example/{i}", DIVS.format(i=i, body=f"Long running text of page number {i}. " * 9), "old") for i in range(6)]
    rows += [(20, None, None, None), (21, "http://b.example/x", "", None), (22, "nonsense", "<p>plain &eacute; text</p", "x"), (22, "nonsense", "<p>plain &eacute; text</p", "x"), (23, "http://c.example/", "x " * 50_000, None), (24, "http://d.example", "<article><p>cut <a href='", None)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "html", "text"]
    text = [(r["page_id"], r["text"]) for r in got.collect()]
    seen = dict(text)
    assert len(text) == len(rows) and seen[3] == main_text(SEMANTIC.format(i=3))
    assert seen[12] == "Title 2\n\n" + ("Long running text of page number 2. " * 9).strip()
    assert (seen[20], seen[21], seen[22], seen[24]) == ("", "", "plain é text", "cut") and len(seen[23]) == 99_999
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_whole_table(spark, sf_dir):
    for r in queries.op9_html_extraction(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in plain if b) and r["n_chars"] == len(r["text"])


def test_siblings_and_several_articles():
    lead, body = "The lead tells it in short. " * 3, "The body tells it at length. " * 9
    for a, b in (('<div class="lead">', '<div class="text">'), ('<article class="first">', '<article class="second">'), ("<div>", '<article class="teaser">')):
        end = "</" + b[1:].split()[0].rstrip(">") + ">"
        page = f'<body><nav>Menu</nav><div class="content">{a}<p>{lead}</p></{a[1:].split()[0].rstrip(">")}>{b}<p>{body}</p>{end}</div><div><a href="/">Home</a></div></body>'
        assert main_text(page) == lead.strip() + "\n\n" + body.strip()
        assert main_text(page.replace(lead, "#").replace(body, lead).replace("#", body)) == body.strip() + "\n\n" + lead.strip()


def test_classes_decide_the_template(spark):
    # The notice and the boxes' label stand wherever their containers do; the scene break stands on as many pages as the notice, but by itself.
    def page(i):
        notice = f'<div class="x1"><p>Sent to you by the editors</p><p>No. {i}</p></div>' if i % 3 else ""
        boxes = '<section class="q7"><p>Read on</p></section>' * (1 + i % 4)
        parts = [f"<p>Story {i} begins here.</p>", *["<p>* * *</p>"] * (i % 5 and 1 + i % 2), f"<p>Story {i} ends here.</p>"]
        return f'<body><div class="z9">{notice}<div class="k3">{"".join(parts)}</div>{boxes}</div></body>'

    rows = [(i, f"http://n.example/{i}", page(i)) for i in range(30)] + [(100 + i, "http://same.example/", "<p>one text</p>") for i in range(40)] + [(200 + i, f"http://few.example/{i}", f"<p>kept</p><p>{i}</p>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        number = [f"No. {i}"] if i % 3 else []
        assert got[i].split("\n\n") == [*number, f"Story {i} begins here.", *["* * *"] * (i % 5 and 1 + i % 2), f"Story {i} ends here."]
    assert all(got[100 + i] == "one text" for i in range(40)) and all(got[200 + i] == f"kept\n\n{i}" for i in range(6))


STORY = "<h1>Head</h1><p>The story goes on for quite a while here.</p><p>And then it ends.</p>"
TOLD = "Head\n\nThe story goes on for quite a while here.\n\nAnd then it ends."


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="layout has-sidebar"><article>{STORY}</article></div><div class="sidebar"><p>Also of note here</p></div></body>',
        f'<body><div class="sidebar-layout"><article>{STORY}</article></div></body>',
        f'<body><form id="aspnetForm" action="x"><nav>Menu</nav><article>{STORY}</article></form></body>',
        f'<body><form id="aspnetForm"><div class="content">{STORY}</div><footer>Imprint</footer></form><div id="footer"><p>(c) us</p></div></body>',
        f'<article><div class="post comments-open">{STORY}</div></article>',
        f'<article><div class="table-responsive alert-free">{STORY}</div></article>',
        f'<article>{STORY}</article><section class="comments">' + "<article class='comment'><p>I say no to all of this, at length.</p></article>" * 20 + "</section>",
        f'<div class="text">{STORY}</div><div id="comments">' + "<p>I say no to all of this, at length.</p>" * 20 + "</div>",
        f"<article>{STORY}</article><form><p>Send us your mail address, please, and wait.</p></form>",
    ],
)
def test_wrappers_and_what_they_hold(page):
    assert main_text(page) == TOLD


def test_nothing_else_is_dropped():
    assert main_text("<p>a <math><mi>x</mi>=1</math></p><object data=f><p>in place</p></object>") == "a x=1\n\nin place"
    for tag in ("svg width=1", "iframe", "object", "canvas", "noscript", "select"):
        assert main_text(f"<p>a</p><{tag}><p>b</p>") == "a\n\nb"
    assert main_text("<p>a</p><svg><text>no</text></svg><script>no</script><p>b</p><style>no") == "a\n\nb"
    assert main_text("<p title='<b>x</b>'>a</p><p title=\"1 > 0\">b</p>") == "a\n\nb"


@pytest.mark.parametrize("part", ["<x '", "<x '\">", "<svg>", "<button>", "<", "<!--", "</", "<a b='c\" ", "<div>", "</div>", "&#", "<p class="])
def test_hostile_pages_are_read_once(part):
    began = time.monotonic()
    main_text(part * (3_000 if part == "<div>" else 60_000))
    assert time.monotonic() - began < 20


def test_clashing_columns(spark):
    names = "row page host h template token role text _host _h _template _page _main".split()
    out = extract(spark.createDataFrame([(1, "http://a.b/", "<p>x y</p>", *names)], "page_id int, url string, html string, " + ", ".join(f"{c} string" for c in names)))
    r = out.first()
    assert [r[c] for c in names if c != "text"] == [c for c in names if c != "text"] and r["text"] == "x y" and out.columns[-1] == "text"
