"""HTML extraction (operator 7): a recurrent block labeller.

A page becomes its sequence of leaf blocks; a numpy bidirectional LSTM reads each block's hashed tag path and hashed
words and labels it with the whole page as context. The labelled main blocks, joined by line ends, are the page's text.

The labeller is trained on about ``SAMPLE`` pages, at most twice as many (those of the least hashes among pages up to ``SAMPLE_CHARS`` characters).
Semantic elements label their blocks: article and main are text, unless a menu, footer, advert, form or comment element lies
within. Each sampled page is also rebuilt in random layouts, with its paragraphs in containers of many names between boilerplate
built from other pages, so that the labeller learns names and context and not one site's markup. All pages are extracted, whole.

Defined results: null html gives an empty text, like a page without main blocks; equal rows give equal results; the sample may be
empty, then built-in sentences stand in for it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lstm
from .html_blocks import Block, blocks, features
from .session import in_batches, sampled

SAMPLE = 160
SAMPLE_CHARS = 60_000
#: Blocks of a training page at most; longer ones are cut for training alone.
TRAIN_BLOCKS = 60
LAYOUTS = 4

# Names of containers, by what they hold.
MAIN_NAMES = ["article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'section class="article-body"', 'div class="story"', 'div id="main"', 'div class="text"', 'div role="main"', 'div class="post-body"']
OTHER_NAMES = ['div class="promo-box"', 'div class="promo"', 'div class="bottom"', 'div class="top-bar"', 'div class="site-info"', 'div id="colophon"', 'div class="banner-box"', 'div class="popup modal"', 'div class="toolbar"', 'div class="author-box"', 'div class="tags"', 'ul class="pagination"', 'div class="recommended"', 'div class="trending popular"', 'div class="alert"', 'div role="navigation"', 'div role="contentinfo"', "nav", "header", "footer", "aside", "form", 'div class="ad"', 'div class="ads banner"', 'div class="advert"', 'div class="sponsored promo"', 'div class="menu"', 'ul class="nav"', 'div id="menu"', 'div class="navbar"', 'div class="breadcrumb"', 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'div class="related"', 'div class="share social"', 'div class="footer"', 'div id="footer"', 'div id="header"', 'div class="header masthead"', 'div class="cookie notice"', 'div class="notice"', 'div class="newsletter subscribe"', 'form class="search"', 'form class="login"', 'div class="legal copyright"']
COMMENT_NAMES = ['div id="disqus_thread"', 'section class="comment-section"', 'div id="comments-area"', 'div class="discussion"', 'div class="responses"', 'div id="respond"', 'section class="reactions"', 'div class="feedback thread"', 'div class="comments"', 'section id="comments"', 'section class="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'div class="reader-comments"', 'div class="replies"']
MAIN_TAGS = {"article", "main"}
OTHER_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
OTHER_WORDS = {f".{w}" for w in "disqus respond reactions responses discussion promobox ad ads advert banner sponsored promo menu nav navbar breadcrumb sidebar widget related share social footer masthead cookie notice newsletter subscribe login legal comments comment commentlist replies".split()}
PHRASES = ["Subscribe to our newsletter", "Sign up for free", "Log in", "All rights reserved", "Privacy policy", "Terms of use", "We use cookies to improve this site", "Accept cookies", "Share this article", "Follow us", "Advertisement", "Sponsored", "Buy now", "Special offer: save 20 percent today", "Related articles", "Read more", "Most popular", "Back to top", "Contact us", "About us", "Leave a reply", "Reply", "Report this comment", "Your email address will not be published", "Search this site", "Skip to content", "Download our app", "Copyright 2021 by the publisher", "Tags", "Next page", "Home", "Order now and get one for free", "Imprint", "Imprint: published by the society, 12 High Street", "Publisher and editor: The Society Ltd", "Also interesting", "You may also like", "Read more: more stories of this kind", "See also: all stories of the week", "Terms and conditions apply", "This site uses cookies", "Contact: office, 3 Market Square"]
#: How a reader's comment begins or ends.
COMMENT_FRAMES = ["{x}", "{n} says: {x}", "{n} wrote: {x}", "{n} wrote on {d}: {x}", "Posted by {n}: {x}", "By {n} on {d}: {x}", "{x} Reply", "{x} Reply Report", "I agree. {x}", "So do I, {n}. {x}", "Great article! {x}", "Great article, thanks for this. {x}", "Thanks for this. {x}", "Well said. {x}", "{n}, 3 days ago: {x}", "{n}, 2 hours ago: {x}", "@{n} {x}", "{n} commented: {x}", "{n} ({d}): {x}"]
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "1 May", "March 3", "12 June 2020"]
SPARE_TEXTS = ["The first paragraph of a story tells what happened, and when.", "A second one adds who was there; it is longer, as it must name them all.", "It ends with what comes next."]


def _semantic(block: Block) -> bool | None:
    """Label that semantic elements give a block; None on pages without them is for the caller to see."""
    inner = None
    for t in block.path:
        if t in MAIN_TAGS:
            inner = True
        elif inner and (t in OTHER_TAGS or t in OTHER_WORDS):
            return False
    return bool(inner)


def _unknown(rng: np.random.Generator) -> str:
    """A container whose name tells nothing."""
    word = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 8))))
    return f'{("div", "section")[rng.integers(2)]} {("class", "id")[rng.integers(2)]}="{word}"'


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def _layout(rng: np.random.Generator, main: list[str], others: list[str], menu: list[str]) -> tuple[list[Block], np.ndarray]:
    """A page in a random layout, and its labels: pieces give one block each, in order."""
    labels: list[int] = []
    pick = lambda xs: xs[rng.integers(len(xs))]

    def box(name: str, inner: str) -> str:
        return f"<{name}>{inner}</{name.split()[0]}>"

    def named(names: list[str], share: float = 0.15) -> str:
        return _unknown(rng) if rng.random() < share else pick(names)

    def comments() -> str:
        n = int(rng.integers(1, 5))
        labels.extend([0] * n)
        # Where the container's name tells nothing, the words do, at least those of the first comment.
        told = rng.random() < 0.5
        frames = [pick(COMMENT_FRAMES[1:]) if told and (k == 0 or rng.random() < 0.8) else pick(COMMENT_FRAMES) for k in range(n)]
        each = [f.format(x=pick(others), n=pick(menu).title(), d=pick(DAYS)) for f in frames]
        return box(_unknown(rng) if told else pick(COMMENT_NAMES), "".join(box(pick(["p", 'div class="comment"', "li", 'div class="reply"']), _escape(x)) for x in each))

    def boilerplate() -> str:
        kind = rng.integers(5)
        if kind == 4:  # told by its words alone, as often as by its container's name
            labels.append(0)
            return box(named(OTHER_NAMES, 0.5), f"<p>{_escape(pick(PHRASES))}{pick(['', '.', '!'])}</p>")
        if kind == 0:
            items = [_escape(pick(menu)) for _ in range(rng.integers(2, 8))]
            labels.extend([0] * len(items))
            return box(named(OTHER_NAMES, 0.5), "<ul>" + "".join(f'<li><a href="/{k}">{x}</a></li>' for k, x in enumerate(items)) + "</ul>")
        if kind == 1:
            labels.append(0)
            return box(pick(OTHER_NAMES), _escape(pick(others)))
        if kind == 2:
            labels.append(0)
            return box(named(["footer", 'div class="footer"', 'div id="footer"', 'div class="bottom"', 'div class="legal"'], 0.5), f"{pick(['&copy;', 'Copyright', '&copy; 2020'])} {_escape(pick(menu))} &middot; {_escape(pick(others))}")
        n = rng.integers(1, 4)
        labels.extend([0] * n)
        return box(pick(OTHER_NAMES), "".join(f"<p>{_escape(pick(others))}</p>" for _ in range(n)))

    def text() -> str:
        inner = ""
        for k, x in enumerate(main):
            labels.append(1)
            tag = "h1" if k == 0 and rng.random() < 0.6 else pick(["p"] * 8 + ["h2", "li", "blockquote", "div"])
            inner += f"<{tag}>{_escape(x)}</{tag}>"
            if rng.random() < 0.08:
                inner += boilerplate()
        if rng.random() < 0.3:
            inner += comments()
        return inner

    page = "".join(boilerplate() for _ in range(rng.integers(0, 4)))
    wrap = rng.random() < 0.3
    kind = rng.random()
    if kind < 0.2:  # laid out by tables
        page += "<table><tr>" + (box("td", boilerplate()) if rng.random() < 0.6 else "") + box(pick(["td", 'td width="70%"', 'td valign="top"']), text()) + "</tr></table>"
    else:
        page += ('<div class="page wrapper">' if wrap else "") + (text() if kind < 0.26 else box(named(MAIN_NAMES, 0.5), text())) + ("</div>" if wrap else "")
    if rng.random() < 0.4:
        page += comments()
    page += "".join(boilerplate() for _ in range(rng.integers(0, 3)))
    found = blocks(f"<html><body>{page}</body></html>")
    return found, np.array(labels, np.float32)


def fit(pages: list[str], seed: int = 7) -> dict[str, np.ndarray]:
    """Weights of the labeller from sampled pages."""
    rng = np.random.default_rng(seed)
    parsed = [blocks(p) for p in pages]
    marked = [p for p in parsed if any(_semantic(b) for b in p)]
    kept: list[tuple[list[Block], np.ndarray]] = [(p, np.array([_semantic(b) for b in p], np.float32)) for p in marked]
    mains = [[b.text for b in p if _semantic(b)] for p in marked] or [SPARE_TEXTS]
    short = [" ".join(x.split()[: rng.integers(1, 4)]) for m in mains for x in m]
    prose = [x for m in mains for x in m] + SPARE_TEXTS
    rest = [b.text for p in marked for b in p if not _semantic(b)]
    words = [w for x in prose[:400] for w in x.split()[:4]]
    sentences = [s for x in prose for s in [x.split(". ")[0]] if s]
    menu = [x for x in rest if len(x) < 40] + words
    for m in mains * max(1, LAYOUTS, 240 // len(mains)):
        first = int(rng.integers(0, max(1, len(m) - 25)))
        part = m[first : first + 25]
        if rng.random() < 0.35:  # short and repeated paragraphs are text as well
            at = int(rng.integers(len(part) + 1))
            part = part[:at] + [short[rng.integers(len(short))]] * int(rng.integers(1, 16)) + part[at:]
        found, labels = _layout(rng, part, sentences + rest, menu)
        if len(found) == len(labels):
            kept.append((found, labels))
    kept = [(p[:TRAIN_BLOCKS], y[:TRAIN_BLOCKS]) for p, y in kept]
    return lstm.train(features([p for p, _ in kept]), [y for _, y in kept], seed=seed)


def _extract(weights, names: list[str], at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                pages = [blocks(h or "") for h in part.column(at).to_pylist()]
                scores = lstm.predict(w, features(pages))
                texts = ["\n".join(b.text for b, s in zip(p, y, strict=True) if s >= 0.5) for p, y in zip(pages, scores, strict=True)]
                columns = [part.column(k) for k in range(len(names)) if k != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*[n for n in names if n != "html"], "text", "n_chars"])

    return run


def weights_of(pages: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The labeller trained on a bounded sample of the pages."""
    short = pages.select("html").where((F.length("html") <= SAMPLE_CHARS) & F.col("html").isNotNull())
    return fit(sampled(short, "html", sample, pages.count()))


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """pages without html but with text and n_chars (code points); columns of these names are replaced."""
    base = pages.drop("text", "n_chars")
    weights = base.sparkSession.sparkContext.broadcast(weights_of(base, sample))
    schema = T.StructType([*[f for f in base.schema.fields if f.name != "html"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return in_batches(base, _extract(weights, base.columns, base.columns.index("html")), schema)
