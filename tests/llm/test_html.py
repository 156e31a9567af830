import html
import random
import re
from itertools import product

import numpy as np
import pytest
from quern.llm.html_blocks import blocks_of
from quern.llm.html_cut import main_text, min_cut
from quern.llm.html_train import labelled
from quern.llm.html_weights import WEIGHTS
from quern.llm.queries_html import extract_main_text, op8_html

ARTICLE = "<article><h1>Title &amp; more</h1><p>First   paragraph\n of <b>bold</b> words, with some length to it.<br>Next line here.<p>Second &eacute; paragraph goes on and on, too.</article>"
WANT = "Title & more\nFirst paragraph of bold words, with some length to it. Next line here.\nSecond é paragraph goes on and on, too."


def test_article_without_what_stands_around_it():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
        <header><p>Site name</p></header><nav><ul><li><a href="/">Home</a></li><li><a href='>'>News</a></li></ul></nav><!-- <p>no</p> -->
        <div class="ad">Buy our excellent things today. They are very good.</div><div class="cookie-notice"><p>We use cookies. You agree to that.</p></div>
        {ARTICLE}<aside><h3>Related</h3><p>Another story that you may like to read now.</p></aside><form><label>Search</label><input></form>
        <section id="comments"><div class="comment"><p>I do not agree with this at all. It is wrong.</p></div></section><footer>&copy; 2020 Site. All rights reserved.</footer></body></html>"""
    assert main_text(page) == WANT


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "   "), (4, "u", "<"), (5, "u", "<script>x"), (6, "u", ARTICLE), (6, "u", ARTICLE), (7, "u", ARTICLE[:-10]), (8, "u", "<article>" + "<p>Some words stand in this paragraph.</p>" * 3000), (None, "u", "<!-- open <p>text</p>"), (9, "u", "<article><p>a &am <p>b &lt;p&gt; c</article>")]
    out = extract_main_text(spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, text int")).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and got[6] == WANT and got[7].startswith("Title & more\nFirst") and got[8].count("\n") == 2999
    assert got[1] == got[2] == got[3] == got[5] == got[None] == "" and got[9] == "a &am\nb <p> c"


def test_pages_of_the_table(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op8_html(spark, sf_dir).collect():
        inside = re.search("<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


PLAIN = "<h1>A title of it</h1><p>The first paragraph has some words in it, and they go on for a while until it ends.</p><p>The second one follows it and says a little more about the same.</p>"
LINES = "A title of it\nThe first paragraph has some words in it, and they go on for a while until it ends.\nThe second one follows it and says a little more about the same."


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="page right-sidebar"><article>{PLAIN}</article><div class="sidebar"><p>Buy more of it. It is good.</p></div></body>',
        f'<body class="page right-sidebar">{PLAIN}</body>',
        f'<body><article class="post category-tags has-comments">{PLAIN}</article></body>',
        f'<body><main class="with-share">{PLAIN}</main><footer>Foot of the page.</footer></body>',
        f'<body><div class="right-sidebar"><div class="wrap"><div class="content">{PLAIN}</div></div></div></body>',
        f'<body><form action="/all"><div class="content">{PLAIN}</div><label>Your name</label></form></body>',
        f"<body><button>Menu<article>{PLAIN}</article><button>Top</button></body>",
        f"<body><select><option>one<article>{PLAIN}</article></body>",
        f'<body><article>{PLAIN}</article><section class="comments"><article class="comment"><div class="comment-body"><p>I see it in another way. It is quite wrong, as far as I can tell.</p></div></article></section></body>',
        f'<body><article>{PLAIN}</article><div class="comments-area"><div class="entry"><div class="text"><p>I see it in another way. It is quite wrong.</p></div></div></div></body>',
        f"<body><noscript><p>Please turn on scripts to see this page.</p></noscript><article>{PLAIN}</article><template><p>Never shown to anyone.</p></template></body>",
    ],
)
def test_messy_pages(page):
    assert main_text(page) == LINES


@pytest.mark.parametrize(
    ("inside", "line"),
    [
        ('<p><a href="/x">All of this paragraph leads to another page of the site.</a></p>', "All of this paragraph leads to another page of the site."),
        ('<p>See <a href="/x">this linked story about the thing that happened</a></p>', "See this linked story about the thing that happened"),
        ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for all of them.</p>", "So x=2 holds for all of them."),
        ("<p>Look: <svg><text>a label</text></svg> stands here.</p>", "Look: a label stands here."),
        ("<object data=x><p>What is shown where the object cannot be.</p></object>", "What is shown where the object cannot be."),
        ("<xmp>if (a < b) <b>not bold</b> &amp; so</xmp>", "if (a < b) <b>not bold</b> &amp; so"),
    ],
)
def test_nothing_of_the_article_is_left_out(inside, line):
    assert main_text(f"<body><article>{PLAIN}{inside}</article></body>") == f"{LINES}\n{line}"


def test_cut_is_minimal():
    pick = random.Random(1)
    for _ in range(300):
        n = pick.randint(1, 8)
        gains = [pick.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(n)]
        edges = [(pick.randrange(n), pick.randrange(n), pick.choice([0.25, 0.5, 1.0, 2.0])) for _ in range(pick.randint(0, 12))]

        def cost(labels):
            return sum(abs(g) for g, keep in zip(gains, labels) if (g > 0) != keep and g) + sum(c for a, b, c in edges if labels[a] != labels[b])

        assert abs(cost(min_cut(gains, edges)) - min(map(cost, product([False, True], repeat=n)))) < 1e-9


def test_classifier_holds_out():
    rows, labels = labelled(9, 150)
    assert np.mean((rows @ np.array(WEIGHTS) > 0) == (labels > 0)) > 0.97


def test_unclosed_tags_do_not_join_blocks():
    assert [b.text for b in blocks_of("<div>a<p>b<p>c<ul><li>d<li>e</ul>f<table><tr><td>g<td>h</table>i")] == list("abcdefghi")
