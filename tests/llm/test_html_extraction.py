"""Extraction against the articles that the pages were made of, and the two passes against a plain version."""

import random
import re
import time
from html import unescape

import pytest

from parchment.llm import html_extraction as H

PROSE = "the report was on the table and all of them had been there for more than an hour when it was read to the people who came in from the cold "
LONG = (PROSE * 2).strip()


def page(body):
    return f"<!DOCTYPE html><html><head><title>No text</title><style>p{{}}</style></head><body class='single has-sidebar'>{body}</body></html>"


CASES = {
    "structure": (
        f"<header><a href='/'>Home</a><p>{LONG}</p></header><nav><ul><li><a href='/a'>one</a><li><a href='/b'>two</a></ul></nav><article><h1>A title</h1><p>{LONG}</p>"
        f"<p>Short end.</p></article><aside><p>{LONG}</p></aside><footer>&copy; us</footer>",
        f"A title\n{LONG}\nShort end.",
    ),
    "no article element": (
        f"<div id='menu'><a href='/a'>one</a> <a href='/b'>two</a></div><div><h2>A title</h2><p>{LONG}</p><p>Short between.</p><p>{LONG}</p></div><div>&copy; 2020 us</div>",
        f"A title\n{LONG}\nShort between.\n{LONG}",
    ),
    "notices, adverts, forms and comments": (
        f"<div class='cookie-banner'><p>{LONG}</p></div><main><article><header><h1>Title</h1><p class='byline'>by us</p></header><p>{LONG}</p><div class='ad'>{LONG}</div>"
        f"<form><label>Mail for the news</label><input><button>Go</button></form><p>So it is.</p></article><section id='comments'><article class='comment'><p>{LONG}</p></article></section></main>",
        f"Title\n{LONG}\nSo it is.",
    ),
    "comments as articles in the article": (f"<article><h1>Title</h1><p>{LONG}</p><article><p>{LONG} I say</p></article></article>", f"Title\n{LONG}"),
    "hidden and scripts": (
        f"<article><p>{LONG}</p><p style='display: none'>{LONG}</p><div hidden><p>{LONG}</p></div><script>var a = '<p>{LONG}</p>';</script><!-- <p>{LONG}</p> --><noscript>{LONG}</noscript></article>",
        LONG,
    ),
    "white space and references": (
        f"<article><p>  {LONG}\n\t &nbsp; Tom &amp; J&eacute;r&#244;me<br>&lt;b&gt; &#x1F600; </p></article>",
        f"{LONG} Tom & Jérôme <b> 😀",
    ),
    "a form around the page": (f"<form><div><p>{LONG}</p><p>{LONG}</p></div><label>Search here</label></form>", f"{LONG}\n{LONG}"),
    "two line breaks part blocks": (f"<article>{LONG}<br><br>{LONG}<br>{LONG}</article>", f"{LONG}\n{LONG} {LONG}"),
    "a teaser doesn't hide the text": (f"<article><p>Short teaser of the day and of the week that was here for you all.</p></article><div>{f'<p>{LONG}</p>' * 4}</div>", "\n".join([LONG] * 4)),
    "only menus": ("<nav><a href='/'>x</a></nav><ul><li><a href='/a'>one</a><li><a href='/b'>two</a></ul>", ""),
    "article without stop words": ("<article><h1>tion</h1><p>tion | anse | lyou | ndre</p><p>a <a href='/'>b</a> c d e f g h i j k</p></article>", "tion\ntion | anse | lyou | ndre\na b c d e f g h i j k"),
    "unclosed list items and cells": (f"<ul><li class='ad'>{LONG}<li>{LONG}</ul><table><tr><td class='ads'>{LONG}<td>{LONG}</table>", f"{LONG}\n{LONG}"),
    "Chinese": ("<div><p>" + "这是我们的报告，它在桌子上，也是他们的了。" * 12 + "</p></div>", "这是我们的报告，它在桌子上，也是他们的了。" * 12),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    body, want = CASES[name]
    assert H.main_text(page(body)) == want


def test_driver_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = {r.page_id: r for r in H.extract_text(pages).collect()}
    assert len(out) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(x).split()) for x in re.split(r"</?(?:h1|p|b|br)>", article)]
        assert out[r.page_id].text == "\n".join(x for x in parts if x)
        assert out[r.page_id].n_chars == len(out[r.page_id].text) and out[r.page_id].url == r.url


def plain_second_pass(blocks):
    """The rule stated in H._second_pass, looking at all blocks for each."""
    keep = []
    for i, b in enumerate(blocks):
        if b.label in ("good", "bad", "none"):
            keep.append(b.label == "good")
            continue
        decided = [(j, x.label == "good") for j, x in enumerate(blocks) if x.label in ("good", "bad") and x.main == b.main]
        if not b.main:
            decided += [(-1, False)] * (not any(j < i for j, _ in decided)) + [(len(blocks), False)] * (not any(j > i for j, _ in decided))
        if not decided or not b.main and b.label == "near" and not any(x.label == "good" for x in blocks):
            keep.append(True)
            continue
        if b.heading and any(j > i for j, _ in decided):
            decided = [x for x in decided if x[0] > i]
        least = min(abs(j - i) for j, _ in decided)
        nearest = [good for j, good in decided if abs(j - i) == least]
        keep.append(any(nearest) if b.main or b.label == "near" else all(nearest))
    return keep


def test_second_pass_equals_plain_version():
    rng = random.Random(5)
    for _ in range(600):
        blocks = [H.Block("", 0.0, 0.0, False, False, rng.choice((0, 0, 1, 2)), 0, rng.random() < 0.2, rng.choice(("good", "bad", "short", "near", "short", "none"))) for _ in range(rng.randrange(1, 25))]
        assert H._second_pass(blocks) == plain_second_pass(blocks)


@pytest.mark.parametrize(
    "unit", ["<a \"", "<!--", "<script>", "<div>", "</div>", "<a href=\"", "< ", "= ", "&", "<p>x", "<a><p>", "<li>x", "<b a = ", "<article>", "<p class='ad'>x ", "</", "<br>x"]
)
def test_time_is_linear(unit):
    began = time.perf_counter()
    H.main_text(unit * (600_000 // len(unit)))
    assert time.perf_counter() - began < 12


def test_awkward_pages(spark):
    rows = [(1, "u", page(f"<p>{LONG}</p>"), "t", 5), (1, "u", page(f"<p>{LONG}</p>"), "t", 5), (None, None, None, None, None), (2, None, "", "t", 1), (3, "v", f"<article><p>{LONG}</p>" + "<p>x y</p>" * 50_000, "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in H.extract_text(pages).collect()}
    assert got[(1, "u")] == (LONG, len(LONG)) and got[(None, None)] == ("", 0) and got[(2, None)] == ("", 0)
    assert got[(3, "v")][0] == LONG + "\nx y" * 50_000
    assert H.extract_text(pages).count() == 5 and H.extract_text(pages.where("false")).count() == 0
    blocks = H.page_blocks(pages.where("page_id = 1")).collect()
    assert [(b.block, b.text, b.label, b.kept) for b in blocks] == [(0, LONG, "good", True)] * 2
