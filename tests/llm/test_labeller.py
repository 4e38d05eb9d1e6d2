from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import functions as F

from lodeflow.llm import labeller as L
from lodeflow.llm.blocks import Block, blocks


def said(page: str) -> list[str]:
    return [b.text for b in blocks(page)]


def test_blocks():
    assert said("") == [] and said("a  b\n c") == ["a b c"] and said("<p>a<p>b</p>c") == ["a", "b", "c"]
    assert said("<p><b>x &amp; y<br>z</b>w</p>") == ["x & y zw"] and said("<p>&lt;i&gt; &am &#8364; &nbsp;") == ["<i> &am €"]
    assert said("a<script>var t='</p>';<p>no</p></script>b<style>p{}</style><!-- <p>no --><textarea><p>x</textarea>c") == ["abc"]
    assert said("<head><title>no</title><p>yes") == ["yes"] and said("<head><title>t</title></head><body>x<svg><text>no</text></svg>y") == ["x", "y"]
    assert said("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"] and said("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert said('<p title="a>b" class=\'x\'>t</p><p data-x="unclosed>q') == ["t", "q"] and said("1 < 2 <3 </ p>x") == ["1 < 2 <3 x"] and said("a<!-- open") == ["a"]
    assert [b.path for b in blocks('<div class="Main-col a2" id=x><p>t')] == [("<div", ".main", ".col", ".a", ".x", "<p")]
    assert blocks("<p><a href=x>ab</a>cd")[0].linked == 2
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000
    assert said(deep) == ["x"] and said("<p>" + "y " * 200_000) == [("y " * 200_000).strip()]
    assert said('<a "' * 20_000) == [] and len(said("<" * 20_000)) == 1


def test_blocks_after_many_skipped_children():
    assert said(f"<div>a<svg>{'<path d=x/>' * 500}<text>no</text></svg>b</div><p>c") == ["a", "b", "c"]
    assert said(f"<div>a<svg>{'<g>' * 500}<circle></svg>b</div><p>c") == ["a", "b", "c"]
    assert said(f"<div>a<select>{'<optgroup><option>no<option>no' * 500}</select>b</div><p>c") == ["a", "b", "c"]
    assert said(f"<div>a<canvas>{'<span><section>no' * 500}</canvas>b</div><p>c") == ["a", "b", "c"]
    assert said(f"<div>a<svg><foreignobject><div/>{'<path/>' * 300}</div></foreignobject></svg>b</div>c") == ["a", "b", "c"]


def test_gradients():
    model = L.fresh(4)
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1])
    x = np.where((np.arange(3) < lengths[:, None])[:, :, None], rng.normal(size=(2, 3, L.INPUT)), 0)
    y = np.array([[1.0, 0, 1], [0, 0, 0]])
    _, g, dx = model.gradients(x, lengths, y)
    for key in ("wf", "wb", "bf", "bb", "wo", "bo"):
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in model.p[key].shape)
            held = model.p[key][at].copy()
            ends = []
            for e in (1e-5, -1e-5):
                model.p[key] = model.p[key].copy()
                model.p[key][at] = held + e
                ends.append(model.gradients(x, lengths, y)[0])
            model.p[key][at] = held
            assert np.isclose((ends[0] - ends[1]) / 2e-5, g[key][at], atol=1e-7)
    for at in ((0, 1, 2), (1, 0, 30 % L.INPUT)):
        ends = [model.gradients(x + e * (np.indices(x.shape) == np.array(at)[:, None, None, None]).all(axis=0), lengths, y)[0] for e in (1e-5, -1e-5)]
        assert np.isclose((ends[0] - ends[1]) / 2e-5, dx[at], atol=1e-7)


def test_generated_pages_held_out():
    made = L.Pages(7)
    pages = [made.marked() for _ in range(300)]
    wrong = sum(((p >= 0.5) != [y for _, y in page]).sum() for page, p in zip(pages, L.trained().main([[b for b, _ in page] for page in pages]), strict=True))
    assert wrong < 0.01 * sum(map(len, pages))


LAYOUTS = [
    '<body><header><h1>The Daily Site</h1></header><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><main><article><h1>KEEP title</h1><p>KEEP first words of it.<p>KEEP more of it.</article></main><aside><h3>Related</h3><ul><li><a href=x>Some link</a></ul></aside><footer><p>© all rights reserved</p></footer>',
    '<body><div id="wrapper"><div class="navbar"><a href=/>Home</a> | <a href=/b>Blog</a></div><div class="cookie-notice">We use cookies <button>ok</button></div><div class="entry-content"><h2>KEEP heading</h2><p>KEEP one two three four.</p><div class="ad">Buy now, sale ends today</div><ul><li>KEEP item one</li><li>KEEP item two</li></ul><blockquote>KEEP quoted words here.</blockquote></div><div id="comments"><h3>2 comments</h3><div class="comment"><p>I liked this one a lot, thanks for it.</p></div></div><div class="footer">Contact | Privacy</div></div>',
]


def test_layouts_and_pages(spark):
    rows = [(i, "u", p) for i, p in enumerate(LAYOUTS)] + [(10, None, None), (11, "u", ""), (12, "u", "KEEP bare words."), (12, "u", "KEEP bare words.")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in L.extracted(df).collect())
    want = sorted((i, t := "\n\n".join(x for x in said(p or "") if x.startswith("KEEP")), len(t)) for i, _, p in rows)
    assert got == want
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in L.extracted(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)
    assert L.extracted(pages.limit(0)).withColumn("x", F.lit(1)).count() == 0
    assert L.main_text([Block((), "a", 0)], np.array([0.4])) == ""


def test_names_of_all_open_elements_count_at_any_depth():
    page = "<article>" + "<div>" * 300 + "<p>in</p></article><p>out</p>"
    assert [(b.path, b.text) for b in blocks(page)] == [(("<article", "<div", "<p"), "in"), (("<p",), "out")]
    many = " ".join(f"n{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    assert len(blocks(f'<div class="{many}">x</div>')[0].path) == 61


def test_a_deeply_nested_comment_is_still_a_comment():
    said = "The river rose again over the night and the old bridge was closed to all traffic until the morning."
    wrap = lambda x, n: "<div>" * n + x + "</div>" * n
    page = wrap(f"<article><h1>Title of it</h1>{wrap(f'<p>{said}</p>', 25)}<p>{said}</p></article>", 25) + f'<section class="comments">{wrap(f"<p>{said} reply</p>", 25)}</section>'
    found = blocks(page)
    assert L.main_text(found, L.trained().main([found])[0]) == f"Title of it\n\n{said}\n\n{said}"
