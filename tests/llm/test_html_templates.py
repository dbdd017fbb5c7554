"""Whole articles from page templates that the labeller isn't trained on, however deep, long or oddly tagged."""

from __future__ import annotations

import os
import time

import numpy as np
import pytest

from tidegrid.llm import op5_html_lstm as op5

PAGES = "/root/testdata/sf0.01/pages.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(PAGES), reason="needs the driver's tables")

RNG = np.random.default_rng(12)
WORDS = "the river of stone and cloud walks over green hills while old bridges keep their quiet watch against rain for every traveller who came".split()


def sentence(n=14):
    w = RNG.choice(WORDS, n).tolist()
    return " ".join([w[0].capitalize(), *w[1:]]) + "."


S = [sentence(int(RNG.integers(6, 30))) for _ in range(40)]
MENU = "".join(f"<li><a href='/{w}'>{w.capitalize()}</a></li>" for w in ("home", "news", "sports", "about"))
COMMENT = "<div class='comment'><p>Nice piece, thank you for writing it.</p></div><div class='comment'><p>I do not agree with this at all.</p></div>"

#: name -> (page, blocks of its article in order)
TEMPLATES = {
    "blog": (
        f"<body class='home page'><div id='page'><header class='site-header'><p>My blog</p><nav class='main-navigation'><ul>{MENU}</ul></nav></header><div id='content' class='site-content'><main role='main'><article class='post type-post'>"
        f"<h1 class='entry-title'>Old bridges</h1><div class='entry-content'><p>{S[0]}</p><ul><li>{S[1]}</li><li>Short item</li><li><a href='x'>Linked item</a></li></ul><h2>Why they stand</h2><p>{S[2]}</p></div></article></main>"
        f"<aside class='widget-area'><h2>Recent</h2><ul>{MENU}</ul></aside></div><footer class='site-footer'><p>Powered by nothing.</p></footer></div></body>",
        ["Old bridges", S[0], S[1], "Short item", "Linked item", "Why they stand", S[2]],
    ),
    "news": (
        f"<html><body><div class='cookie-consent'>We use cookies on this site. <button>Accept</button></div><div class='wrapper'><nav><ul>{MENU}</ul></nav><section class='story'><h1>River rises</h1><p>{S[3]}</p><div class='advert'><p>{S[4]}</p></div>"
        f"<p>{S[5]}</p><blockquote><p>{S[6]}</p></blockquote><h3>What next</h3><p>{S[7]}</p></section><div class='related'><h3>More news</h3><ul>{MENU}</ul></div><section class='comments'>{COMMENT}</section><footer>&copy; News</footer></div></body></html>",
        ["River rises", S[3], S[5], S[6], "What next", S[7]],
    ),
    "handbook": (
        f"<html><body><header><a href='/'>Docs</a></header><div class='sidebar'><ul>{MENU}</ul></div><main><h1>Settings</h1><p>{S[8]}</p><dl><dt>depth</dt><dd>{S[9]}</dd><dt>width<dd>{S[10]}</dl><table><thead><tr><th>Name</th><th>Value</th></tr></thead>"
        f"<tbody><tr><td>depth</td><td>3</td></tr><tr><td><a href='w'>width</a></td><td>{S[11]}</td></tr></tbody></table><ol><li>{S[12]}<li>{S[13]}</ol></main><footer><ul>{MENU}</ul></footer></body></html>",
        ["Settings", S[8], "depth", S[9], "width", S[10], "Name", "Value", "depth", "3", "width", S[11], S[12], S[13]],
    ),
    "unclosed": (f"<nav><ul>{MENU.replace('</li>', '')}</ul></nav><article><h1>Rain</h1><p>{S[14]}<p>{S[15]}<ul><li>{S[16]}<li>{S[17]}</ul><p>{S[18]}</article><footer>End", ["Rain", S[14], S[15], S[16], S[17], S[18]]),
    "layout table": (
        f"<html><body><table><tr><td><div class='menu'><ul>{MENU}</ul></div></td><td><div class='content'><h1>Hills</h1><p>{S[19]}</p><table><tr><td>{S[20]}</td><td>{S[21]}</td></tr></table><p>{S[22]}</p></div></td></tr></table><div class='footer'>Imprint</div></body></html>",
        ["Hills", S[19], S[20], S[21], S[22]],
    ),
    "plain": (f"<html><body><ul>{MENU}</ul><h1>Quiet watch</h1><p>{S[23]}</p><p>{S[24]}</p><p>{S[25]}</p></body></html>", ["Quiet watch", S[23], S[24], S[25]]),
    "plain at once": (f"<html><head><title>Title</title></head><body><p>{S[26]}</p><p>{S[27]}</p><p>{S[28]}</p></body></html>", [S[26], S[27], S[28]]),
    "shop talk": (
        f"<html><body><div class='newsletter'><form><label>Your mail</label><input><button>Go</button></form></div><div class='breadcrumbs'><a href='/'>Home</a> / <a href='/x'>Stories</a></div><article id='main-story'><h1>Bridge</h1><div class='share'><ul><li>Send</li><li>Post</li></ul></div><p>{S[29]}</p>"
        f"<figure><img src=x><figcaption>A photo</figcaption></figure><p>{S[30]}</p><aside><p>{S[31]}</p></aside><p>{S[32]}</p><ul><li><a href=1>{S[33]}</a></li><li><a href=2>Second link</a></li></ul></article><ol class='comments'><li><p>{S[34]}</p></li></ol></body></html>",
        ["Bridge", S[29], "A photo", S[30], S[32], S[33], "Second link"],
    ),
    "sections": (
        f"<html><body><div class='promo'><p>{S[35]}</p></div><main><section><h2>One</h2><p>{S[36]}</p></section><section><h2>Two</h2><div><p>{S[37]}</p></div><h4>Two and a half</h4><pre>x = 1</pre></section></main><div class='social'><a href=x>Follow us</a></div></body></html>",
        ["One", S[36], "Two", S[37], "Two and a half", "x = 1"],
    ),
    "tail in script": (
        f"<html><body><nav><a href=x>Home</a></nav><article><p>{S[38]}</p><script>var a = '<p>no</p>';</script data-x='{'y' * 300}'><p>{S[39]}</p><style>p{{}}</style {'z' * 100}><p>{S[0]}</p></article></body></html>",
        [S[38], S[39], S[0]],
    ),
}


@pytest.fixture(scope="module")
def net(spark):
    return op5.fit_labeller(spark.read.parquet(PAGES))


def main_text(net, html):
    blocks = op5.read_blocks(html)
    return [b.text for b, keep in zip(blocks, net.label([op5.block_vectors(blocks)])[0]) if keep]


@pytest.mark.parametrize("name", TEMPLATES)
def test_whole_article(net, name):
    html, want = TEMPLATES[name]
    assert main_text(net, html) == want


@pytest.mark.parametrize("depth", [5, 10, 40, 300, 5000])
def test_depth_changes_nothing(net, depth):
    for name, (html, want) in TEMPLATES.items():
        if "<body" not in html:
            continue
        at = html.index(">", html.index("<body")) + 1
        end = html.rindex("</body>")
        names = ("row", "col-8", "inner", "wrap")
        deep = html[:at] + "".join(f"<div class='{names[k % 4]}'>" for k in range(depth)) + html[at:end] + "</div>" * depth + html[end:]
        assert main_text(net, deep) == want, name
    inside = f"<html><body><nav><ul>{MENU}</ul></nav><article>{'<div>' * depth}<p>{S[1]}</p><p>{S[2]}</p>{'</div>' * depth}<h2>End</h2></article><footer>x</footer></body></html>"
    assert main_text(net, inside) == [S[1], S[2], "End"]


def test_end_tags_reach_any_depth():
    deep = f"<div class='sidebar'>{'<section>' * 400}<p>in</div><p>out"
    assert [("sidebar" in b.path, b.text) for b in op5.read_blocks(deep)] == [(True, "in"), (False, "out")]
    many = "<p>" + "".join(f"<x{k}>" for k in range(50)) + "one<p>two"
    assert [b.text for b in op5.read_blocks(many)] == ["one", "two"]


def test_a_page_of_many_blocks_is_linear_and_whole(net):
    took = {}
    for n in (10_000, 100_000):
        html = "<html><body><nav><ul><li><a href=x>Menu</a></ul></nav><article>" + "".join(f"<p>Paragraph {k} goes on for a while here." for k in range(n)) + "</article><footer>end</footer></body></html>"
        began = time.process_time()
        got = main_text(net, html)
        took[n] = time.process_time() - began
        assert len(got) == n and got[0] == "Paragraph 0 goes on for a while here." and got[-1] == f"Paragraph {n - 1} goes on for a while here."
    assert took[100_000] < 20 * took[10_000]


@pytest.mark.parametrize("piece", ["</script", "</script x", "<div class=a1><p>x", "<b1><b2>y", "<li>", "</div>", "<svg></svg "])
def test_reading_odd_pages_is_linear(piece):
    took = []
    for n in (100_000, 1_000_000):
        began = time.process_time()
        op5.read_blocks(piece * (n // len(piece)))
        took.append(time.process_time() - began)
    assert took[1] < 60 * max(took[0], 0.02)


def test_held_out_variants_are_labelled_right(spark, net):
    """Made-up pages of texts that the network hasn't seen, under other seeds."""
    rng = np.random.default_rng(99)
    pages = spark.read.parquet(PAGES.replace("sf0.01", "sf0.1")).where("page_id > 2000").limit(60).toPandas() if os.path.exists(PAGES.replace("sf0.01", "sf0.1")) else spark.read.parquet(PAGES).limit(60).toPandas()
    wrong = blocks = 0
    for html in pages.html:
        own = op5.read_blocks(html)
        made, marks = op5.variants(own, [op5.teacher(b) for b in own], rng)
        wrong += int((net.label([op5.block_vectors(made)])[0] != np.array(marks)).sum())
        blocks += len(marks)
    assert wrong <= 0.005 * blocks


def test_every_part_inside_every_article(net):
    """One sentence of each kind of other part, inside each kind of article: 420 pages, and one in a hundred may go wrong."""

    def wrapped(names, inner):
        for x in reversed(names.split()):
            inner = f"<{x}>{inner}</{x}>" if x in op5.PATH_TAGS else f"<div class='site-{x}'>{inner}</div>"
        return inner

    wrong = 0
    for a in op5.ARTICLES:
        for part in op5.OTHERS:
            leaf = "li" if part.split()[-1] in ("ul", "ol") else "p"
            inner = f"<h1>Head</h1><p>{S[1]}</p>{wrapped(part, f'<{leaf}>{S[2]}</{leaf}>')}<p>{S[3]}</p><ul><li>Short one</li><li><a href=y>Linked</a></li></ul><p>{S[4]}</p>"
            got = main_text(net, f"<html><body><nav><ul>{MENU}</ul></nav>{wrapped(a, inner)}<footer>x</footer></body></html>")
            wrong += got != ["Head", S[1], S[3], "Short one", "Linked", S[4]]
    assert wrong <= 0.01 * len(op5.ARTICLES) * len(op5.OTHERS)
