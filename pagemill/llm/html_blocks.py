"""Leaf blocks of an HTML page, and their features for the block labeller."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape
from zlib import crc32

import numpy as np

from . import textarrays as ta

# Elements that do not end a block, elements whose content is not text, elements without content.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
# Formulas stand inside sentences: their elements end no block.
INLINE |= set("math mrow mi mo mn ms mtext mspace mfrac msqrt mroot mstyle mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics".split())
# Raw text up to their end tag, or to the end of the page, as browsers read it; and elements that show no text of the page, up to their end tag if they have one.
RAW = "script|style|title|textarea|iframe|noscript|noembed|noframes|xmp"
HIDDEN = set("svg select template annotation annotation-xml".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements that end an open element of the same kind.
SELF_CLOSING = set("p li dt dd tr td th option".split())

#: Attributes up to the end of the tag; a quote opens a value only after an equals sign.
ATTRS = r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+"""
#: A tag's name ends at white space, a slash or the tag's end: svg-icon is no svg.
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>]){ATTRS}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>{ATTRS})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in HIDDEN}
#: Of a block's open elements the outermost and the innermost so many make its path, each with so many words of its names.
OUTER, INNER, NAME_WORDS = 6, 10, 8
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PARTS = re.compile(r"[a-z]+")

PATH_DIMS, WORD_DIMS, DENSE_DIMS = 128, 96, 12
DIMS = PATH_DIMS + WORD_DIMS + DENSE_DIMS


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    link_chars: int


def blocks(html: str) -> list[Block]:
    """Non-empty blocks in page order: text between block-level tags, character references decoded, white space as one space.

    Elements that are not closed hide nothing but where browsers read raw text. Of a block's path, OUTER + INNER open elements and NAME_WORDS words of each one's names
    are kept; that bounds features, not texts.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = depth = 0
    opened: dict[str, int] = {}

    def flush():
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            path = stack if len(stack) <= OUTER + INNER else stack[:OUTER] + stack[-INNER:]
            out.append(Block(tuple(t for _, names in path for t in names), text, linked))
        parts.clear()
        linked = 0

    last = 0
    without_end: set[str] = set()
    for m in TOKEN.finditer(html):
        if m.start() < last:  # inside of a hidden element
            continue
        if m.start() > last:
            piece = html[last : m.start()]
            parts.append(piece)
            linked += len(piece) if depth else 0
        last = m.end()
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if tag in HIDDEN:
            if not m["end"] and not m["attrs"].endswith("/") and tag not in without_end:
                if closed := ENDS[tag].search(html, last):
                    last = closed.end()
                else:
                    without_end.add(tag)
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                depth = 0 if m["end"] else 1
            continue
        flush()
        depth = 0
        if m["end"]:
            if opened.get(tag):
                while True:
                    last_open = stack.pop()[0]
                    opened[last_open] -= 1
                    if last_open == tag:
                        break
        elif tag not in VOID and not m["attrs"].endswith("/"):
            if tag in SELF_CLOSING and stack and stack[-1][0] == tag:
                stack.pop()
                opened[tag] -= 1
            words = [w for n in NAMES.findall(m["attrs"]) for w in PARTS.findall("".join(n).lower())] if m["attrs"] else []
            stack.append((tag, (tag, *(f".{w}" for w in words[:NAME_WORDS]))))
            opened[tag] = opened.get(tag, 0) + 1
    if len(html) > last:
        parts.append(html[last:])
    flush()
    return out


_path_cache: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _path_cache:
        if len(_path_cache) > 20_000:
            _path_cache.clear()
        v = np.zeros(PATH_DIMS, np.float32)
        for t in path:
            h = crc32(t.encode())
            v[h % PATH_DIMS] += 1 if h >> 31 else -1
        if path:
            h = crc32(("leaf:" + path[-1]).encode())
            v[h % PATH_DIMS] += 1 if h >> 31 else -1
        _path_cache[path] = np.clip(v, -2, 2)
    return _path_cache[path]


def features(pages: list[list[Block]]) -> list[np.ndarray]:
    """Per page an array [blocks, DIMS]: hashed tag path, hashed words of the whole text, and a few ratios."""
    flat = [b for p in pages for b in p]
    n = len(flat)
    out = np.zeros((n, DIMS), np.float32)
    if n:
        out[:, :PATH_DIMS] = [_path_vector(b.path) for b in flat]
        texts = [b.text.encode() for b in flat]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        counts = np.zeros((n, WORD_DIMS), np.float32)
        n_words = np.zeros(n, np.float32)
        marks = np.zeros(n, np.float32)
        for a, b in ta.chunks(offsets):
            part = raw[offsets[a] : offsets[b]]
            words = ta.split(ta.LOWER[part], offsets[a : b + 1] - offsets[a], ~ta.WHITE[part])
            slot = (words.hashes() % np.uint64(WORD_DIMS)).astype(np.int64)
            counts[a:b] = np.bincount(words.row * WORD_DIMS + slot, minlength=(b - a) * WORD_DIMS).reshape(b - a, WORD_DIMS)
            n_words[a:b] = np.diff(words.first)
            sums = np.concatenate([[0], np.cumsum(np.isin(part, np.frombuffer(b".,;!?", np.uint8)))])
            marks[a:b] = np.diff(sums[offsets[a : b + 1] - offsets[a]])
        out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / np.sqrt(np.maximum(1, (counts**2).sum(axis=1, keepdims=True)))
        size = np.diff(offsets).astype(np.float32)
        dense = out[:, PATH_DIMS + WORD_DIMS :]
        dense[:, 0] = np.log1p(size) / 6
        dense[:, 1] = np.log1p(n_words) / 5
        dense[:, 2] = np.minimum(1, np.array([b.link_chars for b in flat]) / np.maximum(1, size))
        dense[:, 3] = marks / np.maximum(1, n_words)
        dense[:, 4] = n_words < 8
        dense[:, 5] = [b.text[-1] in ".!?" for b in flat]
        dense[:, 6] = ["©" in b.text for b in flat]
        dense[:, 7] = [min(len(b.path), 40) / 10 for b in flat]
        dense[:, 8] = [b.link_chars > 0 for b in flat]
        dense[:, 9] = [bool(b.path) and b.path[-1] in ("h1", "h2", "h3") for b in flat]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(int)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            out[a:b, -2] = np.linspace(0, 1, b - a)
            out[a:b, -1] = 1
    return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
