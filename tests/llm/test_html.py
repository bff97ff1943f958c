"""Page extraction against truth that does not come from the training pages."""

import html
import os
import re
import time

import pytest

from stratalens.llm import html_extract

SF = "/root/testdata/sf0.01"

WRITTEN = [
    (
        """<html><head><title>Harbour news</title><meta name=x></head><body><header><a href="/">The Harbour Post</a><form><input name=q><button>Search</button></form></header>
        <nav class="main-nav"><ul><li><a href="/a">World</a></li><li><a href="/b">Sport</a></li><li><a href="/c">Weather</a></li></ul></nav>
        <main><article class="story"><h1>Ferry line reopens after repairs</h1><p>The ferry between the two islands sails again from Monday, the harbour office said.</p>
        <p>Tickets bought last month stay valid &ndash; <a href="/t">see the timetable</a>.</p><h2>What changes</h2><ul><li>Boats leave every forty minutes.</li><li>Bicycles travel free.</li></ul></article></main>
        <aside class="sidebar"><h3>Most read</h3><ol><li><a href="/1">Storm closes road</a></li></ol></aside><section id="comments"><h3>Comments</h3><div class="comment"><p>Great news, thank you!</p></div></section>
        <footer><p>&copy; 2020 Harbour Post. All rights reserved.</p></footer></body></html>""",
        "Ferry line reopens after repairs\nThe ferry between the two islands sails again from Monday, the harbour office said.\nTickets bought last month stay valid – see the timetable.\nWhat changes\nBoats leave every forty minutes.\nBicycles travel free.",
    ),
    (
        """<body><div id="consent" class="cookie-notice"><p>We use cookies to make this site work.</p><button>Accept</button></div><div class="nav"><a href=/>Home</a> <a href=/x>Archive</a></div>
        <div class="content"><h1>Growing beans</h1><p>Sow the beans in late spring, when the soil is warm.</p><p>Water them well in dry weeks, and tie them to poles.</p></div>
        <div class="ad"><p>Buy seeds now</p></div><div class="footer">Imprint</div></body>""",
        "Growing beans\nSow the beans in late spring, when the soil is warm.\nWater them well in dry weeks, and tie them to poles.",
    ),
]


@pytest.mark.parametrize("page, text", WRITTEN)
def test_written_pages(page, text):
    assert html_extract.main_texts([page]) == [text]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_given_pages(spark):
    """The article of every page of the table, cut at its own block tags."""
    got = {r.page_id: r for r in html_extract.extract_main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        want = "\n".join(t for p in parts if (t := " ".join(html.unescape(p).split())))
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a " ' * 200_000, "<p '" * 200_000 + ">", "<div>x" * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<!-- " * 200_000, "<" * 500_000, "<" + "p" * 1_000_000])
def test_malformed_pages_take_linear_time(page):
    began = time.process_time()
    html_extract.blocks(page)
    assert time.process_time() - began < 20


def test_long_page_is_labelled_in_stretches(monkeypatch):
    """A page of many blocks gives the same labels whole and in stretches."""
    article = "".join(f"<p>Paragraph {k} of a long article, with some words.</p>" for k in range(500))
    page = f"<html><body><nav><ul><li><a href=/>Menu</a></li></ul></nav><article>{article}</article><footer>&copy; me</footer></body></html>"
    whole = html_extract.main_texts([page, WRITTEN[0][0]])
    monkeypatch.setattr(html_extract, "CELLS", 64)
    assert html_extract.main_texts([page, WRITTEN[0][0]]) == whole
    assert whole[0].count("\n") == 499


def test_page_of_very_many_blocks():
    page = "<article>" + "".join(f"<p>Block {k} of the text.</p>" for k in range(100_000)) + "</article>"
    assert len(html_extract.main_texts([page])[0].split("\n")) > 99_000


def test_words_beyond_the_first_count():
    """All words of a block reach the labeller."""
    found = html_extract.blocks("<p>" + "one " * 300 + "two " * 300 + "</p>")
    x = html_extract.features(found)[0, html_extract.PATH_DIM : html_extract.PATH_DIM + html_extract.WORD_DIM]
    assert sorted(round(float(v), 3) for v in x if v) == [round(300 / 600**0.5, 3)] * 2
