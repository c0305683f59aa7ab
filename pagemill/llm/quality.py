"""Quality classifier (operator 3): a weak-label model over heuristic labellers, and a hashed linear scorer.

1. *Labellers.* Overlapping heuristics vote good, bad or nothing on each text (symbols, capitals, repeats, tables, ...).
2. *Weak-label model.* Texts with equal votes count as one pattern, so all documents fit in a table of
   at most 3**labellers patterns, summed in Spark. Expectation-maximisation over the pattern counts estimates each labeller's
   accuracy and the share of good texts, and gives every pattern its posterior.
3. *Scorer.* On a bounded sample (about ``SAMPLE`` distinct texts of up to ``SAMPLE_CHARS`` characters, at most twice as many, of the least text hashes), posterior labels train a logistic
   regression on hashed shapes of words and of their neighbourhoods. It scores every document over its whole text.

A document is kept if the scorer gives at least ``KEEP``.

Defined results: null and empty texts have no votes and are kept with the prior as their score (there is nothing bad in them); equal texts have
equal scores; columns other than the text pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .session import in_batches, sampled, whole_text

SAMPLE = 6000
SAMPLE_CHARS = 100_000
DIMS = 1024
#: Texts measured at a time at most.
PART_ROWS = 250
KEEP = 0.5
#: Words by which a text's evidence is thinned, so that a few odd words do not condemn a short text.
SHORT = 4
ROUNDS = 60

GOOD, BAD, NONE = 1, 0, 2
#: Largest share of alarms (votes bad, of votes) of a labeller in each class. There are several kinds of bad text and the labellers overlap: without
#: these bounds, EM learns the commonest kind as the bad class and the others as kinds of good.
MOST_ALARMS = {GOOD: 0.005, BAD: 0.4}

KIND = np.zeros(256, np.int64)  # 0 white, 1 lower, 2 upper, 3 digit, 4 mild mark, 5 symbol, 6 non-ASCII
KIND[:] = 5
KIND[ta.WHITE] = 0
KIND[ord("a") : ord("z") + 1] = 1
KIND[ord("A") : ord("Z") + 1] = 2
KIND[ord("0") : ord("9") + 1] = 3
KIND[[ord(c) for c in ".,;:'\"?-()/"]] = 4
KIND[128:] = 6

#: Labellers in order: what each measures, at or below which value it votes good, from which value bad.
LABELLERS = (
    ("symbols per word", 0.05, 0.30),
    ("share of upper-case letters", 0.12, 0.50),
    ("share of words equal to the one before", 0.02, 0.20),
    ("share of table bars among words", 0.01, 0.10),
    ("exclamation marks per word", 0.05, 0.40),
    ("share of words of marks alone", 0.03, 0.25),
    ("share of words with letters and symbols mixed", 0.04, 0.30),
    ("words to the power of 0.7 per distinct word", 0.41, 0.82),
)


def _measures(words: ta.Words, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(measures [rows, labellers], hashed shape counts [rows, DIMS])."""
    rows = len(offsets) - 1
    kind = KIND[raw]
    n = len(words.start)
    n_words = np.maximum(1, np.diff(words.first)).astype(float)
    out = np.zeros((rows, len(LABELLERS)))
    per_kind = {}
    for k in (1, 2, 3, 4, 5, 6):
        sums = np.concatenate([[0], np.cumsum(kind == k)])
        per_kind[k] = (sums[words.end] - sums[words.start], np.diff(sums[offsets]))
    bang = np.concatenate([[0], np.cumsum(raw == ord("!"))])
    hashes = words.hashes()
    same = np.zeros(n, bool)
    if n:
        same[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    size = words.end - words.start
    letters = per_kind[1][0] + per_kind[2][0] + per_kind[6][0]
    bar = (size == 1) & (raw[words.start] == ord("|")) if n else np.zeros(0, bool)
    marks = letters + per_kind[3][0] == 0
    mixed = (per_kind[5][0] > 0) & (letters > 0)
    count = lambda flag: np.bincount(words.row, weights=flag, minlength=rows)
    out[:, 0] = per_kind[5][1] / n_words
    out[:, 1] = per_kind[2][1] / np.maximum(1, per_kind[1][1] + per_kind[2][1])
    out[:, 2] = count(same) / n_words
    out[:, 3] = count(bar) / n_words
    out[:, 4] = np.diff(bang[offsets]) / n_words
    out[:, 5] = count(marks) / n_words
    out[:, 6] = count(mixed) / n_words
    # Distinct words grow with a power of the words, so that the quotient tells about texts of any length; of a few words it tells nothing.
    _, once = np.unique(ta.mix(hashes ^ ta.mix(words.row.astype(np.uint64))), return_index=True)
    distinct = np.bincount(words.row[once], minlength=rows)
    out[:, 7] = np.where(n_words >= 40, n_words**0.7 / np.maximum(1, distinct), 0)
    # Shape of a word: its kinds, capped counts, and whether it repeats the one before; with its neighbour's.
    cap = lambda x, m: np.minimum(x, m)
    shape = cap(per_kind[1][0], 2) + 3 * (cap(per_kind[2][0], 2) + 3 * (cap(per_kind[3][0], 1) + 2 * (cap(per_kind[4][0], 1) + 2 * (cap(per_kind[5][0], 2) + 3 * (cap(per_kind[6][0], 1) + 2 * (same + 2 * bar))))))
    before = np.concatenate([[0], shape[:-1]])[:n]
    before[words.first[:-1][np.diff(words.first) > 0]] = 9999
    slots = [(ta.mix(x.astype(np.uint64) + np.uint64(s)) % np.uint64(DIMS)).astype(np.int64) for x, s in ((shape, 1), (shape * 10_000 + before, 1 << 40))]
    counts = np.zeros(rows * DIMS)
    for s in slots:
        counts += np.bincount(words.row * DIMS + s, minlength=rows * DIMS)
    return out, counts.reshape(rows, DIMS) / (n_words + SHORT)[:, None]


def votes(measures: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Votes [rows, labellers] as small integers."""
    good, bad = np.array([x[1] for x in LABELLERS]), np.array([x[2] for x in LABELLERS])
    out = np.where(measures >= bad, BAD, np.where(measures <= good, GOOD, NONE))
    out[empty] = NONE
    return out


def _chunks(text: pa.Array):
    raw, offsets = ta.buffers(text)
    for a, b in ta.chunks(offsets):
        # DIMS counts a row: short texts go in parts of bounded row counts.
        for c in range(a, b, PART_ROWS):
            d = min(b, c + PART_ROWS)
            part = raw[offsets[c] : offsets[d]]
            yield ta.split(part, offsets[c : d + 1] - offsets[c], ~ta.WHITE[part]), part, offsets[c : d + 1] - offsets[c]


def _pattern(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


def _vote_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, raw, offsets in _chunks(batch.column(0)):
            measures, _ = _measures(words, raw, offsets)
            pattern, n = np.unique(_pattern(votes(measures, np.diff(words.first) == 0)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n)], ["pattern", "n"])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Dawid-Skene with two classes over vote patterns [patterns, labellers]: prior of good, and P(vote | class) of each labeller."""
    k = patterns.shape[1]
    prior = 0.8
    table = np.zeros((2, k, 3))  # starts from labellers that seldom cry wolf and each see a part of what is bad
    table[GOOD] = [0.01, 0.69, 0.3]
    table[BAD] = [0.3, 0.4, 0.3]
    for _ in range(rounds):
        post = posterior(patterns, prior, table)
        prior = float(np.clip((post @ counts) / max(1, counts.sum()), 0.01, 0.99))
        for c, weight in ((GOOD, post * counts), (BAD, (1 - post) * counts)):
            for vote in range(3):
                table[c, :, vote] = ((patterns == vote) * weight[:, None]).sum(axis=0) + 1
            table[c] /= table[c].sum(axis=1, keepdims=True)
            told = table[c][:, GOOD] + table[c][:, BAD]
            table[c][:, BAD] = np.minimum(table[c][:, BAD], MOST_ALARMS[c] * told)
            table[c][:, GOOD] = told - table[c][:, BAD]
    return {"prior": prior, "table": table}


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """P(good | votes). Votes of none tell nothing."""
    at = np.arange(patterns.shape[1])
    told = patterns != NONE
    good = np.log(prior) + (np.log(table[GOOD][at, patterns]) * told).sum(axis=1)
    bad = np.log(1 - prior) + (np.log(table[BAD][at, patterns]) * told).sum(axis=1)
    return 1 / (1 + np.exp(np.clip(bad - good, -50, 50)))


def _unpack(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 600, rate: float = 1.0, decay: float = 1e-5) -> np.ndarray:
    """Weights of a logistic regression (bias last), by gradient descent with momentum on soft labels."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - rate * (x.T @ (p - y) / len(y) + decay * w)
        w += speed
    return w


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The weak-label model over all docs, and the scorer fitted on a sample of at most so many texts."""
    text = docs.select(whole_text().alias("text"))
    found = in_batches(text, _vote_rows, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # at most 3**labellers rows
    patterns = _unpack(np.array([r.pattern for r in found], np.int64)) if found else np.zeros((0, len(LABELLERS)), np.int64)
    model = expectation_maximisation(patterns, np.array([r.n for r in found], float))
    short = text.where((F.length("text") <= SAMPLE_CHARS) & (F.length("text") > 0))
    chosen = sampled(short, "text", sample, sum(r.n for r in found))
    xs, ys = [np.zeros((0, DIMS))], [np.zeros(0)]
    for words, raw, offsets in _chunks(pa.array(chosen, pa.string())):
        measures, counts = _measures(words, raw, offsets)
        xs.append(counts)
        ys.append(posterior(votes(measures, np.diff(words.first) == 0), model["prior"], model["table"]))
    model["weights"] = fit_scorer(np.concatenate(xs), np.concatenate(ys))
    return model


FIELDS = [("weak_label", T.DoubleType()), ("score", T.DoubleType()), ("keep", T.BooleanType())]


def _score(model, names: list[str], at: int, keep: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            weak, score = [np.zeros(0)], [np.zeros(0)]
            for words, raw, offsets in _chunks(batch.column(at)):
                measures, counts = _measures(words, raw, offsets)
                empty = np.diff(words.first) == 0
                weak.append(posterior(votes(measures, empty), m["prior"], m["table"]))
                p = 1 / (1 + np.exp(-np.clip(counts @ m["weights"][:-1] + m["weights"][-1], -30, 30)))
                score.append(np.where(empty, m["prior"], p))
            w, s = np.concatenate(weak), np.concatenate(score)
            empty = np.diff(ta.buffers(batch.column(at))[1]) == 0
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], pa.array(w), pa.array(s), pa.array((s >= keep) | empty)], [*names, "weak_label", "score", "keep"])

    return run


def classify(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """docs with weak_label (the posterior), score and keep; columns of these names are replaced."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    base = docs.drop(*[n for n, _ in FIELDS])
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, kind) for n, kind in FIELDS]])
    return in_batches(base, _score(model, base.columns, base.columns.index("text"), keep), schema)
