import itertools
import random
import re
from html import unescape

import duckdb
import pytest

from arealis.llm.mincut import extract, fit, main_text, minimum_cut


def cost(labels, content, boilerplate, ties):
    return sum(content[i] if x else boilerplate[i] for i, x in enumerate(labels)) + sum(c for i, j, c in ties if labels[i] != labels[j])


def test_cut_is_least():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 8)
        content, boilerplate = ([rng.random() * 3 for _ in range(n)] for _ in range(2))
        ties = [(*rng.sample(range(n), 2), rng.random()) for _ in range(rng.randint(0, 12))] if n > 1 else []
        best = min(cost(x, content, boilerplate, ties) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(minimum_cut(content, boilerplate, ties), content, boilerplate, ties) - best) < 1e-9


@pytest.fixture(scope="module")
def weights():
    return fit()


def article(html):
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_whole_articles_of_the_pages_and_nothing_else(weights):
    pages = duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    assert all(main_text(h, weights) == article(h) for _, h in pages)


LAYOUT = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) document.write("<p>no</p>");</script></head><body>
<header class="site-header"><a href="/">Home</a> <a href="/a">About us</a></header>
<div id="cookie-banner"><p>We use cookies, as everyone does. Accept them.</p></div>
<div class="layout"><div class="main-content"><h1>A title</h1><p>First paragraph with <b>bold</b>&nbsp;text,
 and a <a href="x">link</a>.</p><div class="ad-slot">Buy now, cheap.</div><p>Second &lt;one&gt; of them, a bit longer, with commas, and so on.</p>
<ul><li>An item that belongs here, indeed.</li><li>Another.</li></ul></div>
<div class="sidebar"><h3>Related</h3><ul><li><a href="1">One thing</a></li><li><a href="2">Other thing</a></li></ul></div></div>
<form action="/s"><label>Search</label><textarea>typed</textarea></form>
<section id="comments"><p>I liked this article, it is long and good, and full of commas.</p><p>So did I, thank you.</p></section>
<footer>&copy; 2024 Someone. All rights reserved.</footer></body></html>"""


def test_parts_that_are_no_article_go(weights):
    assert main_text(LAYOUT, weights) == "A title\nFirst paragraph with bold text, and a link.\nSecond <one> of them, a bit longer, with commas, and so on.\nAn item that belongs here, indeed.\nAnother."


def test_odd_pages(spark, weights):
    long = "<article><p>" + "word, " * 60000 + "</p></article>"
    html = [None, "", "   ", "just text, no tags.", "<p>Some words here, a<p>and more of them, b.", "<div><p>open", "<<<>><p", "<!-- never closed <p>x", "<script>x", long, "<article><h1>&#x41;&amp;&bogus;</h1><p> \n </p></article>", "<nav><a>x</a></nav>"]
    pages = spark.createDataFrame([(i, f"u{i}", h, "t") for i, h in enumerate([*html, html[4]])], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in extract(pages, weights).collect()}
    assert len(rows) == len(html) + 1 and extract(pages, weights).columns == ["page_id", "url", "text", "n_chars"]
    assert [rows[i].text for i in (0, 1, 2, 7, 8, 11)] == [""] * 6
    assert rows[3].text == html[3] and rows[4].text == "Some words here, a\nand more of them, b." == rows[12].text and rows[9].text == ("word, " * 60000).strip()
    assert rows[10].text == "A&&bogus;" and all(r.n_chars == len(r.text) for r in rows.values())
    assert extract(pages.where("page_id < 0"), weights).count() == 0


def test_deep_and_unclosed_pages_take_time_in_proportion():
    import time

    from arealis.llm.mincut import fit, main_text

    w = fit()
    for page in (lambda n: "".join(f"<div>text {i}" for i in range(n)), lambda n: "".join(f"<svg>word {i} " for i in range(n)), lambda n: "<b>" * n + "</i>" * n):
        took = []
        for n in (2000, 8000):
            began = time.process_time()
            main_text(page(n), w)
            took.append(time.process_time() - began)
        assert took[1] < 10 * max(took[0], 0.02)


PROSE = "<p>Some prose here, which is long enough to be an article, with commas, and so on. It goes on for a while, too.</p>"


@pytest.mark.parametrize("html,kept", [
    (f"<body class='has-sidebar'><div id='content'>{PROSE * 6}</div></body>", ["P"] * 6), (f"<main><form id='aspnetForm'><div class='content'>{PROSE * 4}</div></form></main>", ["P"] * 4),
    (f"<article>{PROSE * 2}<p class='advert'>Buy this now, cheap.</p>{PROSE}</article>", ["P"] * 3), (f"<article><h1>T</h1>{PROSE * 3}<p><a href=x>Share</a> <a href=y>Tweet</a></p></article>", ["T", "P", "P", "P"]),
    (f"<article>{PROSE * 2}<table><tr><td>Paris</td><td>12</td></tr></table>{PROSE * 2}</article>", ["P", "P", "Paris", "12", "P", "P"]), (f"<article>{PROSE}<div style='display: none'>{PROSE}unseen</div><p hidden>unseen</p>{PROSE}</article>", ["P", "P"]),
    (f"<div class='content'>{PROSE * 2}<p><a href=x>Read the whole study at this place, it is worth it.</a></p>{PROSE}</div>", ["P", "P", "Read the whole study at this place, it is worth it.", "P"]), ("<p>short</p>", ["short"]),
])
def test_odd_layouts(weights, html, kept):
    assert main_text(html, weights).replace(PROSE[3:-4], "P").split("\n") == kept
