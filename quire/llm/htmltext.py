"""Main text of web pages: a linear-chain CRF over DOM leaf blocks.

A page is read tag by tag into its leaf blocks: stretches of text between
block-level tags, each with the open elements around it.  Every block gets
features of its ancestors (tags, words of class, id and role attributes, the
innermost telling one once more) and of its text (length, link share,
punctuation, telling words, place on the page).  A two-label chain (main text
or not) is trained on labelled pages and decoded by Viterbi.

The labelled pages are written here from page templates with the usual parts
(menus, headers, sidebars, adverts, notices, forms, comments, footers around
and inside articles), so training needs no table and always gives the same
weights.

Null, empty and tagless html: a page without a main block has the empty text.
Unclosed, misnested and unknown tags are read as browsers do in the main;
scripts, styles, comments, titles and the like never count.  A frame, drawing or
template that is never closed hides nothing; one in its own right is skipped
whole.  Names count in full: ``<svg-icon>`` is an unknown element like others.  Repeated rows are
extracted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^<>]*>", re.S)
#: Elements whose inside is no text; the first four have no elements inside either, and run to the page's end if left open.
RAW = ("script", "style", "title", "textarea")
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in (*RAW, "template", "noscript", "svg", "iframe", "object", "canvas")}
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
#: Elements that opening the first of a kind closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()}
_SCOPE = frozenset("table ul ol dl div article section main body aside nav header footer form td th blockquote".split())

TAGS = "a article aside blockquote body button details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header label legend li main menu nav ol option p pre section select summary table td th tr ul".split()
TELLING = frozenset("nav menu header footer aside form dialog button select fieldset article main".split())
BAD = (
    "ad ads advert advertisement adverts alert author banner bar bio bottom box breadcrumb breadcrumbs button byline card category categories caption comment comments consent cookie cookies copyright credit disqus disclaimer "
    "discussion feedback foot footer form gdpr head header hidden icon legal links list login masthead meta menu modal more nav navbar navigation newsletter notice notification pager pagination paywall popular "
    "popup privacy promo promotion rail recommended related remark replies reply respond search share sharing sidebar side signup skip social sponsor sponsored subscribe tags teaser terms toc toolbar top trending user warning widget".split()
)
GOOD = "article body content copy entry hentry main page post prose single story text".split()
WORDS = {w: i for i, w in enumerate(dict.fromkeys(BAD + GOOD))}
LEAD = "advertisement all also by comments cookie cookies copyright follow home login menu posted read related reply rights search share sign skip sponsored subscribe tags we".split()
_N_TEXT = 18
_BASE = {"tag": 0, "near": len(TAGS), "word": len(TAGS) + len(TELLING) + 1, "inner": len(TAGS) + len(TELLING) + 1 + len(WORDS)}
_TELL = {t: i for i, t in enumerate(sorted(TELLING))}
_TAG = {t: i for i, t in enumerate(TAGS)}
_LEADS = {w: i for i, w in enumerate(LEAD)}
N_FRAME = _BASE["inner"] + len(WORDS)
N_FEATURES = N_FRAME + _N_TEXT + len(LEAD)


def blocks(page: str | None) -> list[tuple[str, tuple, int]]:
    """(text, open elements as (tag, attribute words), characters in links) of each leaf block."""
    if not page:
        return []
    out, stack, buffer, links, at, depth_a = [], [], [], 0, 0, 0
    open_ended = set()  # elements that are not closed any more from here on

    def flush():
        nonlocal links
        if buffer:
            text = "".join(buffer)
            buffer.clear()
            if "&" in text:
                text = html.unescape(text)
            if text := " ".join(text.split()):
                out.append((text, tuple(stack), links))
        links = 0

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            buffer.append(piece)
            if depth_a:
                links += len(piece)
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _CLOSE and not m[1] and not (tag == "svg" and m[3].endswith("/")):
            end = None if tag in open_ended else _CLOSE[tag].search(page, at)
            if end:
                at = end.end()
                continue
            open_ended.add(tag)
            if tag in RAW:
                at = len(page)
                break
            continue
        if tag in INLINE:
            if tag == "a":
                depth_a = 0 if m[1] else 1
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        depth_a = 0
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if shut := CLOSES.get(tag):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    del stack[i:]
                    break
                if stack[i][0] in _SCOPE and not (tag == "tr" and stack[i][0] in shut):
                    break
        attributes = m[3]
        words = ()
        if attributes and "=" in attributes:
            words = tuple(sorted({w.lower() for a in _ATTRIBUTE.findall(attributes) for w in _PART.findall(a)}))
        stack.append((tag, words))
    if at < len(page):
        buffer.append(page[at:])
    flush()
    return out


def frame_features(stack: tuple) -> list[int]:
    """Features of the open elements around a block."""
    found, near, inner = set(), None, ()
    for tag, words in stack:
        if tag in _TAG:
            found.add(_TAG[tag])
        if tag in TELLING:
            near = tag
        known = [WORDS[w] for w in words if w in WORDS]
        found.update(_BASE["word"] + w for w in known)
        if known:
            inner = known
            if tag not in TELLING:
                near = None
    found.add(_BASE["near"] + (_TELL[near] if near else len(TELLING)))
    found.update(_BASE["inner"] + w for w in inner)
    return sorted(found)


def text_features(text: str, links: int, place: float) -> list[int]:
    """Features of a block's own text and its place on the page."""
    n = len(text)
    spaces = text.count(" ")
    share = links / n
    out = [
        0 if n < 20 else 1 if n < 60 else 2 if n < 150 else 3 if n < 400 else 4,
        5 if share < 0.1 else 6 if share < 0.5 else 7,
        8 if text[-1] in ".!?\"”»…。" else 9,
        10 if spaces < 3 else 11 if spaces < 12 else 12,
        13 if place < 0.15 else 14 if place > 0.85 else 15,
    ]
    if "©" in text or "(c)" in text[:40].lower():
        out.append(16)
    if "|" in text or "›" in text or "»" in text:
        out.append(17)
    lead = _LEADS.get(text[:24].split(" ", 1)[0].strip(".,:;!?").lower())
    if lead is not None:
        out.append(_N_TEXT + lead)
    return out


def labelled_pages(n: int = 300, seed: int = 7):
    """(html, [label of each leaf block]) of ``n`` written pages."""
    rng = random.Random(seed)
    syllables = "an be con der el fi gra ho in jo ka lo mi nor op pra qui re sta tu un ver wo za ble ing tion".split()

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(a, b):
        return " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + rng.choice("...!?")

    def prose(short=0.15):
        return word().capitalize() if rng.random() < short / 3 else sentence(1, 6) if rng.random() < short else " ".join(sentence(4, 18) for _ in range(rng.randint(1, 9)))

    def name(*parts):
        w = rng.choice(parts)
        w = rng.choice((w, f"{w}-{rng.choice(('wrap', 'inner', 'block', 'area'))}", f"site-{w}", f"page_{w}"))
        return rng.choice((f' class="{w}"', f" id='{w}'", f' class="x {w} y"'))

    def build():
        page, labels = [], []

        def block(markup, label):
            page.append(markup)
            labels.append(label)

        def menu(tag, attributes):
            page.append(f"<{tag}{attributes}><ul>")
            for _ in range(rng.randint(2, 8)):
                block(f'<li><a href="/{word()}">{sentence(1, 2)[:-1]}</a></li>', 0)
            page.append(f"</ul></{tag}>")

        def box(tag, attributes, a, b, texts=None):
            page.append(f"<{tag}{attributes}>")
            for _ in range(rng.randint(a, b)):
                block(f"<{(t := rng.choice(('p', 'div', 'h3', 'span')))}>{texts() if texts else prose(0.4)}</{t}>" if (tag != "p") else prose(0.4), 0)
                if page[-1].startswith("<span"):
                    page.append("<br><hr>")
            page.append(f"</{tag}>")

        def noise(places):
            for what in rng.sample(places, rng.randint(0, min(4, len(places)))):
                if what == "nav":
                    menu("nav", rng.choice(("", name("menu", "nav", "navbar"))))
                elif what == "menu":
                    menu("div", name("menu", "nav", "navigation", "breadcrumb", "toc", "links", "pagination", "tags", "social", "share"))
                elif what == "header":
                    page.append(f"<header{rng.choice(('', name('header', 'masthead', 'top')))}>")
                    block(f"<{(t := rng.choice(('h1', 'h2', 'div', 'p')))}>{sentence(1, 8)}</{t}>", 0)
                    if rng.random() < 0.5:
                        menu("nav", "")
                    page.append("</header>")
                elif what == "aside":
                    box("aside", rng.choice(("", name("sidebar", "widget", "rail", "related"))), 1, 4)
                elif what == "side":
                    box("div", name("sidebar", "widget", "related", "recommended", "popular", "trending", "teaser"), 1, 4)
                elif what == "ad":
                    if rng.random() < 0.5:
                        block(f"<div{name('ad', 'ads', 'advert', 'advertisement', 'sponsor', 'sponsored', 'promo', 'banner')}>{prose(0.3)}</div>", 0)
                    else:
                        box("div", name("ad", "ads", "advert", "sponsored", "promo", "promotion"), 1, 2)
                elif what == "notice":
                    block(f"<div{name('cookie', 'consent', 'notice', 'gdpr', 'alert', 'banner', 'popup', 'modal', 'privacy', 'warning', 'newsletter', 'paywall')}>{rng.choice(('We use cookies. ', 'Subscribe to ', ''))}{prose(0.3)}</div>", 0)
                elif what == "form":
                    page.append(f"<form{rng.choice(('', name('search', 'login', 'signup', 'subscribe')))}>")
                    for _ in range(rng.randint(1, 3)):
                        block(f"<{(t := rng.choice(('p', 'div')))}><label>{sentence(1, 6)}</label><input name=q></{t}>", 0)
                    if rng.random() < 0.6:
                        block(f"<button>{sentence(1, 2)[:-1]}</button>", 0)
                    page.append("</form>")
                elif what == "comments":
                    page.append(f"<{(t := rng.choice(('section', 'div', 'ol')))}{name('comments', 'comment', 'discussion', 'replies', 'respond', 'disqus')}>")
                    for _ in range(rng.randint(1, 5)):
                        block(f"<{(u := rng.choice(('p', 'div', 'li', 'article')))}{rng.choice(('', name('comment', 'reply')))}>{prose()}</{u}>", 0)
                    page.append(f"</{t}>")
                elif what == "footer":
                    page.append(f"<footer{rng.choice(('', name('footer', 'bottom', 'legal')))}>")
                    for _ in range(rng.randint(1, 3)):
                        block(f"<p>{rng.choice(('&copy; ', '', 'Copyright '))}{prose(0.4)}</p>" if rng.random() < 0.6 else f"<div>&copy; {sentence(2, 8)}</div>", 0)
                    page.append("</footer>")
                elif what == "foot":
                    box("div", name("footer", "foot", "copyright", "legal", "disclaimer"), 1, 3)

        page.append("<body>")
        noise(["nav", "menu", "header", "aside", "ad", "notice", "form", "side"])
        if rng.random() < 0.95:
            outer = rng.choice(("", "", "<main>", f"<div{name('main', 'page', 'content')}>", "<section>"))
            inner = rng.choice(("<article>", "<article>", f"<article{name('post', 'hentry', 'story', 'article')}>", f"<div{name('content', 'article', 'post', 'entry', 'story', 'text', 'prose', 'copy', 'single')}>", "<main>" if outer != "<main>" else "<div>"))
            page.append(outer + inner)
            if rng.random() < 0.8:
                block(f"<h1>{sentence(1, 12)}</h1>", 1)
            for _ in range(rng.randint(1, 14)):
                r = rng.random()
                if r < 0.7:
                    body = prose()
                    if rng.random() < 0.2:
                        body = f"<b>{body}<br>"
                    elif rng.random() < 0.15:
                        body += f' <a href="/{word()}">{sentence(1, 4)}</a>'
                    block(f"<p>{body}" + rng.choice(("</p>", "</p>", "")), 1)
                elif r < 0.78:
                    block(f"<h2>{sentence(1, 6)}</h2>", 1)
                elif r < 0.84:
                    page.append("<ul>")
                    for _ in range(rng.randint(1, 4)):
                        block(f"<li>{prose(0.5)}</li>", 1)
                    page.append("</ul>")
                elif r < 0.88:
                    block(f"<blockquote>{prose()}</blockquote>", 1)
                elif r < 0.91:
                    block(f"<pre>{prose()}</pre>", 1)
                elif r < 0.94:
                    page.append("<table><tr>")
                    for _ in range(rng.randint(1, 4)):
                        block(f"<td>{sentence(1, 5)}</td>", 1)
                    page.append("</tr></table>")
                else:
                    noise(["aside", "ad", "notice", "menu", "form", "side"])
            if rng.random() < 0.25:
                noise(["comments", "footer", "menu", "aside"])
            page.append({"<": "", "a": "</article>", "d": "</div>", "m": "</main>"}[inner[1]])
            page.append({"": "", "<m": "</main>", "<d": "</div>", "<s": "</section>"}[outer[:2]])
        noise(["comments", "aside", "side", "form", "ad", "menu", "notice"])
        noise(["footer", "foot", "nav", "notice"])
        return "".join(page), labels

    made = 0
    while made < n:
        page, labels = build()
        if len(blocks(page)) == len(labels):
            made += 1
            yield page, labels


def likelihood(theta: np.ndarray, flat: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[float, np.ndarray]:
    """(log likelihood, its gradient) of labels ``y`` of pages by forward-backward.

    ``theta``: feature weights, bias and the four transitions.  ``on`` marks the
    blocks that a page has, ``flat`` holds their features in that order."""
    w, bias, moves = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
    n, longest = on.shape
    e = np.zeros((n, longest, 2))
    e[..., 1][on] = flat @ w + bias
    a, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    a[:, 0] = e[:, 0]
    for t in range(1, longest):
        a[:, t] = np.where(on[:, t, None], np.logaddexp(a[:, t - 1, :1] + moves[0], a[:, t - 1, 1:] + moves[1]) + e[:, t], a[:, t - 1])
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    for t in range(longest - 2, -1, -1):
        nxt = e[:, t + 1] + b[:, t + 1]
        b[:, t] = np.where(on[:, t + 1, None], np.logaddexp(moves[:, 0] + nxt[:, :1], moves[:, 1] + nxt[:, 1:]), b[:, t + 1])
    pairs = on[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    miss = (y - np.exp(a[..., 1] + b[..., 1] - z[:, None]))[on]
    joint = np.exp(a[:, :-1, :, None] + moves + (e + b)[:, 1:, None, :] - z[:, None, None, None])[pairs].sum(axis=0)
    value = (e[..., 1] * y)[on].sum() + (seen * moves).sum() - z.sum()
    return float(value), np.concatenate((flat.T @ miss, [miss.sum()], (seen - joint).ravel()))


class Chain:
    """Two-label linear-chain CRF: feature weights for label 1 and transitions."""

    def __init__(self, weights: np.ndarray, bias: float, moves: np.ndarray):
        self.weights, self.bias, self.moves = weights, bias, moves

    @staticmethod
    def fit(sequences: list[list[list[int]]], labels: list[list[int]], rounds: int = 300, rate: float = 0.1, l2: float = 1e-5):
        """Maximum likelihood by Adam on exact forward-backward gradients, all pages at once."""
        n, longest = len(sequences), max(map(len, sequences))
        x = np.zeros((n, longest, N_FEATURES), np.float32)
        y, on = np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, (s, l) in enumerate(zip(sequences, labels)):
            for t, (features, label) in enumerate(zip(s, l)):
                x[i, t, features] = 1
                y[i, t], on[i, t] = label, True
        flat = x[on]
        theta = np.zeros(N_FEATURES + 1 + 4)
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            g = likelihood(theta, flat, y, on)[1] / len(flat) - l2 * theta
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        return Chain(theta[:N_FEATURES], float(theta[N_FEATURES]), theta[N_FEATURES + 1 :].reshape(2, 2))

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi labels from each block's score for label 1."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        zero, one, back = 0.0, scores[0], []
        for s in scores[1:]:
            a, b, c, d = zero + m00, one + m10, zero + m01, one + m11
            back.append((b > a, d > c))
            zero, one = max(a, b), max(c, d) + s
        label = one > zero
        out = [int(label)]
        for step in reversed(back):
            label = step[1] if label else step[0]
            out.append(int(label))
        return out[::-1]


def features(found) -> list[list[int]]:
    last = max(1, len(found) - 1)
    return [frame_features(stack) + [N_FRAME + i for i in text_features(text, links, t / last)] for t, (text, stack, links) in enumerate(found)]


@functools.lru_cache(maxsize=1)
def model() -> Chain:
    """The chain trained on the written pages (a few kilobytes)."""
    pages, labels = zip(*labelled_pages())
    return Chain.fit([features(blocks(p)) for p in pages], list(labels))


class Extractor:
    """Main text by a chain, with scores of element frames kept."""

    def __init__(self, chain: Chain):
        self.chain, self.frames, self.weights = chain, {}, chain.weights.tolist()

    def __call__(self, page: str | None) -> str:
        found = blocks(page)
        if not found:
            return ""
        if len(self.frames) > 50_000:
            self.frames.clear()
        last, scores = max(1, len(found) - 1), []
        for t, (text, stack, links) in enumerate(found):
            if (frame := self.frames.get(stack)) is None:
                frame = self.frames[stack] = self.chain.bias + sum(self.weights[i] for i in frame_features(stack))
            scores.append(frame + sum(self.weights[N_FRAME + i] for i in text_features(text, links, t / last)))
        return "\n".join(b[0] for b, label in zip(found, self.chain.decode(scores)) if label)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``."""
    chain = model()

    def rows(batches):
        extract = Extractor(chain)
        for b in batches:
            texts = [extract(page) for page in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    chosen = pages.select(pages["page_id"].cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
