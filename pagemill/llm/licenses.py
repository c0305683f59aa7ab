"""License scans (operator 9): Aho-Corasick over notice phrases and identifier tags, shunting-yard over expressions.

Texts are lower-cased (A-Z), cut into words of letters and digits (every non-ASCII character counts as a letter) and
searched once with one automaton for all phrases; a phrase matches where its words stand consecutively. After an
identifier tag, the expression that follows in the original text is parsed with the operators WITH, AND, OR
(strongest first) and parentheses, and evaluated to a score between 0 and 1: OR takes the better side, AND the worse one, and an
exception (WITH) lifts a licence half way to 1.

Defined results: null and empty texts have no words, no labels and score 0; an expression that cannot be parsed gives the
label "unparsed" and no score; columns other than text pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .session import in_batches

# Phrases of the base contract and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases and their labels.
NOTICE_PHRASES = {
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons": "cc",
    "all rights reserved": "reserved",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "gnu gpl": "gpl",
    "gplv2": "gpl",
    "gplv3": "gpl",
    "gnu lgpl": "lgpl",
    "lgplv3": "lgpl",
    "gnu agpl": "agpl",
    "agplv3": "agpl",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "open font license": "ofl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
}
# Fixed value: words of an identifier tag; an expression follows it.
TAG = "spdx license identifier"
# How freely text under a label may be reused.
FREEDOM = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "cc-by": 0.9, "cc": 0.5, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.2, "cc-by-nc": 0.1, "reserved": 0.0, "zlib": 1.0, "bsl": 1.0, "permissive": 1.0, "artistic": 0.8, "ofl": 0.7, "cddl": 0.7, "cpl": 0.7, "eupl": 0.5, "osl": 0.4, "cecill": 0.4, "gfdl": 0.4, "source-available": 0.1, "unknown": 0.0}
# How the published short identifiers of each label are built; a whole token has to match.
IDENTIFIERS = {
    "mit": r"mit(-0|-advertising|-cmu|-enna|-feh|-festival|-khronos-old|-modern-variant|-open-group|-testregex|-wu)?|x11|expat",
    "apache": r"apache-(1\.0|1\.1|2\.0)",
    "bsd": r"0bsd|bsd-[1-4]-clause(-[a-z0-9]+)*|bsd-(protection|source-code|systemics)",
    "isc": r"isc(-veillard)?",
    "cc0": r"cc0-1\.0|unlicense|cc-pddc",
    "cc-by-nc": r"cc-by-nc(-sa|-nd)?-[1-4]\.[05](-[a-z]{2,3})?",
    "cc-by-sa": r"cc-by-sa-[1-4]\.[05](-[a-z]{2,3})?",
    "cc-by": r"cc-by(-nd)?-[1-4]\.[05](-[a-z]{2,3})?",
    "agpl": r"agpl-[13]\.0(\+|-only|-or-later)?",
    "lgpl": r"lgpl-(2\.0|2\.1|3\.0)(\+|-only|-or-later)?|lgpllr",
    "gpl": r"gpl-[1-3]\.0(\+|-only|-or-later)?",
    "mpl": r"mpl-(1\.0|1\.1|2\.0)(-no-copyleft-exception)?",
    "epl": r"epl-[12]\.0",
    "zlib": r"zlib(-acknowledgement)?|libpng(-2\.0)?",
    "bsl": r"bsl-1\.0",
    "artistic": r"artistic-(1\.0(-cl8|-perl)?|2\.0)|clartistic",
    "ofl": r"ofl-1\.[01](-rfn|-no-rfn)?",
    "cddl": r"cddl-1\.[01]",
    "cpl": r"cpl-1\.0|ipl-1\.0|ms-rl|apsl-(1\.[0-2]|2\.0)|nposl-3\.0|spl-1\.0",
    "eupl": r"eupl-1\.[0-2]",
    "osl": r"osl-(1\.0|1\.1|2\.0|2\.1|3\.0)",
    "cecill": r"cecill-(1\.0|1\.1|2\.0|2\.1|b|c)",
    "gfdl": r"gfdl-1\.[1-3](-invariants|-no-invariants)?(-only|-or-later)?",
    "source-available": r"busl-1\.1|sspl-1\.0|elastic-2\.0|polyform-[a-z-]+-1\.0\.0",
    "permissive": r"afl-(1\.[12]|2\.[01]|3\.0)|beerware|blueoak-1\.0\.0|curl|ecl-[12]\.0|fsfap|fsful(lr)?|hpnd(-[a-z0-9-]+)?|icu|ijg|intel|json|miros|ms-pl|mulanpsl-[12]\.0|naist-2003|ncsa|ntp(-0)?|openssl|php-3\.0(1)?|postgresql|psf-2\.0|python-2\.0(\.1)?|ruby|tcl|unicode-(3\.0|dfs-201[56]|tou)|upl-1\.0|vim|w3c(-19980720|-20150513)?|wtfpl|xnet|zpl-(1\.1|2\.[01])",
}
IDENTIFIER_RE = re.compile("|".join(f"(?P<{label.replace('-', '_')}>{pattern})" for label, pattern in IDENTIFIERS.items()), re.I)
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

LOWER_SPACED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
APART = r"[^0-9a-z\u0080-\U0010ffff]"  # no letter or digit, as between words
TAG_RE = re.compile(rf"(?i)(?:(?<={APART})|(?<![\s\S]))spdx{APART}+license{APART}+identifier(?:(?!\()(?!\n\s*\n){APART})*([^\n]*)")
TOKEN_RE = re.compile(r"[()]|[0-9A-Za-z.+-]+")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICE_PHRASES, TAG}:
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


def label_of(identifier: str) -> str | None:
    found = IDENTIFIER_RE.fullmatch(identifier)
    return found.lastgroup.replace("_", "-") if found else None


def parse(expression: str) -> list[str] | None:
    """Postfix form of the longest readable expression at the start of a text; None if there is none."""
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether the last token completes an operand
    for token in TOKEN_RE.findall(expression):
        low = token.lower()
        if low in PRECEDENCE:
            if not operand:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif token == "(":
            if operand:
                break
            stack.append(token)
        elif token == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if operand:
                break
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """Score and labels of a parsed expression; an identifier of no known label is ``unknown`` and scores 0, as nothing is known to be allowed."""
    values: list[tuple[float, set[str]]] = []
    for token in postfix:
        if token in PRECEDENCE:
            (right, theirs), (left, ours) = values.pop(), values.pop()
            # What stands after WITH is an exception, no licence: it gives no label.
            values.append(((1 + left) / 2, ours) if token == "with" else (max(left, right) if token == "or" else min(left, right), ours | theirs))
        else:
            label = label_of(token) or "unknown"
            values.append((FREEDOM[label], {label}))
    return values[-1]


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    words = text.translate(LOWER_SPACED).split()
    line = f" {b' '.join(words).decode()} "
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    tagged = False
    for end, phrase in automaton().iter(line):
        if phrase == TAG:
            tagged = True
        elif phrase in BASE_PHRASES:
            base.append(end - len(phrase) - 1)
            base_labels.add(BASE_PHRASES[phrase])
        else:
            labels.add(NOTICE_PHRASES[phrase])
    # Word numbers from places in the line, counting blanks onwards from the place before.
    at = blanks = 0
    for k, place in enumerate(sorted(base)):
        blanks += line.count(" ", at, place)
        base[k], at = blanks, place
    scores = [FREEDOM[x] for x in labels | base_labels]
    if tagged:
        tags = list(TAG_RE.finditer(text.decode()))
        labels |= set() if tags else {"unparsed"}
        for m in tags:
            if (postfix := parse(m[1])) is None:
                labels.add("unparsed")
            else:
                score, named = evaluate(postfix)
                scores.append(score)
                labels |= named
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | labels)), min(scores, default=0.0)


FIELDS = [("n_words", T.LongType(), pa.int64()), ("n_base", T.LongType(), pa.int64()), ("first_word", T.LongType(), pa.int64()), ("last_word", T.LongType(), pa.int64()), ("base_labels", T.StringType(), pa.string()), ("labels", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64())]


def _scan(names: list[str], at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan((t or "").encode()) for t in batch.column(at).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], *[pa.array(list(c), kind) for c, (_, _, kind) in zip(columns, FIELDS, strict=True)]], [*names, *[n for n, _, _ in FIELDS]])

    return run


def scan_licenses(docs: DataFrame, column: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score; columns of these names are replaced."""
    base = docs.drop(*[n for n, _, _ in FIELDS])
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, kind) for n, kind, _ in FIELDS]])
    out = in_batches(base, _scan(base.columns, base.columns.index(column)), schema)
    return out if keep_text else out.drop(column)
