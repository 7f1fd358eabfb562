"""Main text of written and given pages."""

from quire.llm import htmltext, queries

PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p {color: red}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h1>My site</h1><nav><ul><li><a href="/">Home</a></li><li><a href="/about">About us</a></li></ul></nav></header>
<div class="cookie-banner">We use cookies to improve your visit. <button>Accept</button></div>
<main><article><h1>A long &amp; winding&nbsp;road</h1>
<p>The first paragraph of the article tells   what it
is about, with a <a href="/x">link</a> in it &lt;here&gt;.</p><p>A second paragraph, left open, goes on for a while so that it counts.
<ul><li>First point of the list in the article</li><li>Second point of the list in the article</li></ul>
<div class="advert">Buy now! Cheap things for sale.</div>
<p>The last paragraph closes the article &#8212; at last.</p></article></main>
<aside><h3>Related</h3><p>Another story that you may like to read today.</p></aside>
<section class="comments"><div class="comment"><p>I think that this was a very good article indeed.</p></div></section>
<form><label>Your mail</label><input name=m></form>
<footer><p>&copy; 2024 My site. All rights reserved.</p></footer></body></html>"""
TEXT = """A long & winding road
The first paragraph of the article tells what it is about, with a link in it <here>.
A second paragraph, left open, goes on for a while so that it counts.
First point of the list in the article
Second point of the list in the article
The last paragraph closes the article — at last."""


def test_a_page():
    assert htmltext.Extractor(htmltext.model())(PAGE) == TEXT


def test_blocks():
    found = htmltext.blocks("<p>a <b>b</b><br>c<p>d</p>e<script>x</script><!-- y --><table><tr><td>1<td>2</table><ul><li>f<li>g</ul>h &#65;&amp;lt;")
    assert [b[0] for b in found] == ["a b c", "d", "e", "1", "2", "f", "g", "h A&lt;"]
    assert htmltext.blocks(None) == htmltext.blocks("") == htmltext.blocks("<div></div>") == []
    assert [b[0] for b in htmltext.blocks("plain text, a < b and c")] == ["plain text, a < b and c"]
    assert [b[0] for b in htmltext.blocks("<p>open <a href='x'")] in ([["open"], ["open <a href='x'"]])


def test_held_out_pages():
    extract = htmltext.Extractor(htmltext.model())
    right = total = 0
    for page, labels in htmltext.labelled_pages(120, seed=99):
        found = htmltext.blocks(page)
        want = "\n".join(b[0] for b, label in zip(found, labels) if label)
        total += 1
        right += extract(page) == want
    assert right >= 0.95 * total


def test_viterbi_finds_the_best_labelling():
    import itertools
    import random

    chain = htmltext.model()
    rng = random.Random(8)
    for _ in range(40):
        scores = [rng.uniform(-4, 4) for _ in range(rng.randint(1, 8))]

        def value(labels):
            return sum(s for s, l in zip(scores, labels) if l) + sum(chain.moves[a][b] for a, b in zip(labels, labels[1:]))

        assert abs(value(chain.decode(scores)) - max(map(value, itertools.product((0, 1), repeat=len(scores))))) < 1e-9


def test_tables(spark, sf_dir):
    got = queries.op9_html_extraction(spark, sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == pages.count()
    assert got.where("text is null or n_chars <> length(text)").count() == 0
    assert got.where("text rlike '(?i)<(p|div|script)|we use cookies|&copy;'").count() == 0
    odd = spark.createDataFrame([(1, None, None, 0), (1, None, None, 0), (None, "u", "", 0), (2, "u", PAGE, 0), (3, "u", "<nav><a>x</a></nav>", 0)], "page_id long, url string, html string, text int")
    rows = htmltext.main_text(odd).collect()
    assert sorted(len(r["text"]) for r in rows) == [0, 0, 0, 0, len(TEXT)] and htmltext.main_text(odd.where("false")).count() == 0


def test_names_count_in_full_and_open_elements_hide_nothing():
    def texts(page):
        return [b[0] for b in htmltext.blocks(page)]

    assert texts("<p>a</p><svg-icon name=x></svg-icon><article><p>main</p></article>") == ["a", "main"]
    assert texts("<p>a</p><title-bar>t</title-bar><template-x><p>main</p></template-x>") == ["a", "t", "main"]
    assert texts("<p>a</p><svg viewBox='0 0'/><article><p>main</p></article><svg><text>no</text></svg>b") == ["a", "main", "b"]
    assert texts("<p>a</p><svg><p>b</p><iframe src=x><p>c</p><noscript>d") == ["a", "b", "c", "d"]
    assert texts("<p>a</p><script>if (a</b>c) '</scripty>'</script ><p>b</p><SCRIPT>c</script\n><p>d") == ["a", "b", "d"]
    assert texts("<p>a</p><script>x<p>b</p>") == ["a"]
    extract = htmltext.Extractor(htmltext.model())
    body = "<p>The main text of this page is a sentence of good length, and it stays.</p>"
    for inside in ("<svg-icon name=x></svg-icon>", "<svg class=i />", "<canvas-chart></canvas-chart>", "<object data=x>"):
        assert extract(f"<body><nav><a href=x>Home</a></nav>{inside}<article>{body}</article></body>") == body[3:-4]


def test_long_pages(spark):
    import time

    para = "<p>A paragraph of the article, as long as such paragraphs are.</p>"
    n = 5_000_000 // len(para)
    began = time.perf_counter()
    text = htmltext.Extractor(htmltext.model())("<article>" + para * n + "</article>")
    assert text.count("\n") == n - 1
    # Adversarial stretches are read once, not once for every element.
    for piece in ("<canvas>", "<!", "<svg>", "<a <", "&", "<"):
        htmltext.blocks(piece * 300_000)
    assert time.perf_counter() - began < 60
    rows = spark.createDataFrame([(1, "u", para * 100_000, "x", 1)], "page_id long, url string, html string, text string, n_chars int")
    assert htmltext.main_text(rows).first()["n_chars"] == 100_000 * (len(para) - 7) + 99_999


def test_gradient():
    """Forward-backward against all labellings, and the gradient against differences."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    on = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    flat, y = rng.integers(0, 2, (7, 5)).astype(float), rng.integers(0, 2, (3, 4)) * on
    theta = rng.normal(size=10)

    def slow(theta):
        moves, scores, at, total = theta[-4:].reshape(2, 2), flat @ theta[:5] + theta[5], 0, 0.0
        for row, n in zip(y, on.sum(axis=1)):
            s = scores[at : at + n]
            at += n

            def value(labels):
                return sum(x for x, l in zip(s, labels) if l) + sum(moves[a, b] for a, b in zip(labels, labels[1:]))

            total += value(row[:n]) - np.log(sum(np.exp(value(l)) for l in itertools.product((0, 1), repeat=int(n))))
        return total

    value, gradient = htmltext.likelihood(theta, flat, y, on)
    assert abs(value - slow(theta)) < 1e-9
    steps = np.eye(10) * 1e-5
    assert np.allclose(gradient, [(slow(theta + h) - slow(theta - h)) / 2e-5 for h in steps], atol=1e-6)
