"""Language identification (operator 12) by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed against each automaton into phrases: each is the longest match that begins where the one before
ended, or a single byte that the language's text does not hold. Few phrases mean that the language explains the text well. Phrases cost log2 of the size of the language's
text in bits; the language with the fewest bits wins, of equals the first by name.

*Texts* are composed (NFC), lower-cased, and every run of characters that are no letters becomes one space. They are parsed as UTF-8 bytes in stretches of ``STRETCH``
bytes, each on its own, so that a batch's stretches advance together as numpy lanes, one byte a step, and a very long text is nothing special.

*Fitting* takes pieces of ``PIECE`` characters from everywhere in the labelled texts: those of the smallest hashes, at most ``PIECES`` of a language and ``ALL_PIECES``
in all (of which each language then has an equal part, at least one piece). Equal pieces count once. Only chosen pieces leave their tasks.

Defined results: a text that is null or has no letter gets ``und`` and score 0, as does every text if nothing was learned; score is 1 - bits of the winner / bits of the next
(1 if there is one language only); a label that is null teaches nothing; equal texts get equal answers; columns other than the text pass through.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import in_batches

PIECE, PIECES, ALL_PIECES = 256, 256, 4096
STRETCH = 512
#: Stretches that advance together.
LANES = 4096
UNKNOWN = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")
LETTER = regex.compile(r"\p{L}")


def fold(text: str | None) -> bytes:
    """Words of letters in UTF-8, a space before, between and behind them; empty if there is no letter."""
    folded = NO_LETTERS.sub(" ", unicodedata.normalize("NFC", text or "").lower()).strip(" ")
    return f" {folded} ".encode() if LETTER.search(folded) else b""


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, state 0 being the start: a byte string leads somewhere if and only if the text holds it."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for byte in text:
        now = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and byte not in edges[p]:
            edges[p][byte] = now
            p = link[p]
        if p >= 0:
            q = edges[p][byte]
            if length[q] == length[p] + 1:
                link[now] = q
            else:  # q stands for longer strings as well: its shorter ones get a state of their own
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(byte) == q:
                    edges[p][byte] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return edges


@dataclass
class Model:
    """Automata of all languages in one table. Most states have one way on: ``only`` (a symbol) and ``target``; the others have a row of ``table``, row 0 being empty."""

    langs: list[str]
    bits: np.ndarray  # of a phrase, by language
    root: np.ndarray  # start state of each language
    symbol: np.ndarray  # of each byte; 0 for bytes that no language has
    only: np.ndarray
    target: np.ndarray
    row: np.ndarray
    table: np.ndarray

    @staticmethod
    def of(texts: dict[str, list[bytes]]) -> Model:
        """From each language's pieces; a zero byte, which no folded text holds, keeps them apart."""
        langs = sorted(x for x in texts if any(texts[x]))
        joined = {x: b"\0".join(p for p in texts[x] if p) for x in langs}
        symbol = np.zeros(256, np.int16)
        for k, b in enumerate(sorted(set().union(*joined.values()) - {0}), 1):
            symbol[b] = k
        only, target, row, rows, root = [], [], [], [np.full(symbol.max() + 1, -1, np.int32)], []
        for x in langs:
            base = len(only)
            root.append(base)
            for out in automaton(joined[x]):
                ways = [(symbol[b], s + base) for b, s in out.items() if b]
                single = ways[0] if len(ways) == 1 else (-1, -1)
                only.append(single[0])
                target.append(single[1])
                row.append(len(rows) if len(ways) > 1 else 0)
                if len(ways) > 1:
                    full = rows[0].copy()
                    for s, t in ways:
                        full[s] = t
                    rows.append(full)
        bits = np.array([math.log2(1 + len(joined[x])) for x in langs])
        return Model(langs, bits, np.array(root, np.int32), symbol, np.array(only, np.int16), np.array(target, np.int32), np.array(row, np.int32), np.stack(rows))

    def phrases(self, stretches: list[bytes]) -> np.ndarray:
        """[stretches, languages]: numbers of phrases."""
        out = np.zeros((len(stretches), len(self.langs)), np.int64)
        sizes = np.array([len(s) for s in stretches])
        order = np.argsort(-sizes, kind="stable")
        for at in range(0, len(order), LANES):
            part = order[at : at + LANES]
            out[part] = self._lanes([stretches[k] for k in part], sizes[part]).T
        return out

    def _lanes(self, stretches: list[bytes], sizes: np.ndarray) -> np.ndarray:
        steps, n = int(sizes[0]), len(stretches)
        symbols = np.zeros((n, steps), np.int16)
        symbols[np.arange(steps) < sizes[:, None]] = self.symbol[np.frombuffer(b"".join(stretches), np.uint8)]
        symbols = symbols.T.copy()
        root = self.root[:, None]
        state = np.repeat(root, n, axis=1)
        count = np.zeros(state.shape, np.int64)
        alive = np.searchsorted(-sizes, -np.arange(steps), "left")  # lanes are in order of falling size
        for step in range(steps):
            m = alive[step]
            s, b = state[:, :m], symbols[step, :m]
            to = np.where(self.only[s] == b, self.target[s], self.table[self.row[s], b])
            lang, lane = np.nonzero(to < 0)
            if len(lang):
                begin = self.root[lang]
                again = self.table[self.row[begin], b[lane]]
                single = self.only[begin] == b[lane]
                again = np.where(single, self.target[begin], again)
                # The match ends before this byte, which begins the next phrase, or is one itself.
                count[lang, lane] += (s[lang, lane] != begin).astype(np.int64) + (again < 0)
                to[lang, lane] = np.where(again < 0, begin, again)
            state[:, :m] = to
        return count + (state != root)

    def identify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        folded = [fold(t) for t in texts]
        stretches, of = [], []
        for k, t in enumerate(folded):
            for a in range(0, len(t), STRETCH):
                stretches.append(t[a : a + STRETCH])
                of.append(k)
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.langs and stretches:
            total = np.zeros((len(texts), len(self.langs)))
            np.add.at(total, np.array(of), self.phrases(stretches))
            bits = total * self.bits
            best = bits.argmin(axis=1)
            two = np.sort(bits, axis=1)[:, :2]
            for k in sorted(set(of)):
                names[k] = self.langs[best[k]]
                scores[k] = 1 - two[k, 0] / two[k, 1] if len(self.langs) > 1 else 1.0
        return names, scores


def _pieces(edges, names: tuple[str, str, str] = ("lang", "h", "piece")):
    """Pieces whose hash is below their language's edge."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                below = edges.value[lang]
                for a in range(0, len(text), PIECE):
                    piece = text[a : a + PIECE]
                    h = xxhash.xxh3_64_intdigest(piece.encode()) >> 1
                    if h < below:
                        out.append((lang, h, piece))
            kinds = (pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in range(3)], names)

    return run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", pieces: int = PIECES, all_pieces: int = ALL_PIECES) -> Model:
    """The model of the languages named in docs. The driver holds a row a language and the chosen pieces."""
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    n = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.sum(F.ceil(F.length("text") / PIECE)).alias("n")).collect()}
    each = max(1, min(pieces, all_pieces // max(1, len(n))))
    # Twice as many as asked for are to be expected below the edge, or all if there are few.
    edges = docs.sparkSession.sparkContext.broadcast({x: 1 << 63 if k <= 2 * each else int((1 << 63) * 2 * each / k) for x, k in n.items()})
    found = in_batches(labelled, _pieces(edges), "lang string, h long, piece string").groupBy("lang", "h").agg(F.min("piece").alias("piece")).collect()
    texts: dict[str, list] = {x: [] for x in n}
    for r in sorted(found, key=lambda r: (r.lang, r.h, r.piece)):
        if len(texts[r.lang]) < each and (folded := fold(r.piece)):
            texts[r.lang].append(folded)
    return Model.of(texts)


def _identify(model, names: list[str], at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score = model.value.identify(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, learn_from: Column | str, text: str = "text", lang: str = "lang", pieces: int = PIECES) -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced), learned from the rows for which the condition holds. Only the text decides."""
    base = docs.drop("lang_pred", "score")
    model = docs.sparkSession.sparkContext.broadcast(fit(base.where(learn_from), text, lang, pieces))
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return in_batches(base, _identify(model, base.columns, base.columns.index(text)), schema)
