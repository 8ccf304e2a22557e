"""Licence scans: identifier tags and notice phrases by Aho-Corasick, licence expressions by shunting-yard."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The contract's phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Phrases that this scanner adds, and the tag that an expression follows.
ADDED = {
    "apache license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "public domain": "public-domain",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
}
TAG, TAG_TEXT = "spdx license identifier", b"spdx-license-identifier:"
# How restrictive a label is, 0 (none) to 1; an identifier has that of the longest label that it begins with.
RESTRICTS = {
    "public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "mit": 0.1, "bsd": 0.1, "isc": 0.1, "apache": 0.15, "cc-by": 0.2,
    "mpl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.6, "cc-by-nc": 0.7, "gpl": 0.8, "agpl": 0.9, "reserved": 1.0,
}
UNKNOWN = 0.6
#: An exception (WITH) takes so much of a licence's restriction.
EXCEPTION = 0.75
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: Separators of words become spaces, A-Z lower case; what isn't ASCII stays.
_TABLE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


@cache
def automaton() -> ahocorasick.Automaton:
    """Over words joined by single spaces, read as Latin-1 so that a character is a byte."""
    a = ahocorasick.Automaton()
    for phrase, label in (BASE | ADDED | {TAG: ""}).items():
        a.add_word(f" {phrase} ", (len(phrase) + 2, phrase, label))
    a.make_automaton()
    return a


def restriction(identifier: str) -> float:
    known = [k for k in RESTRICTS if identifier.startswith(k)]
    return RESTRICTS[max(known, key=len)] if known else UNKNOWN


def parse(expression: str) -> list[str] | None:
    """Reverse Polish form of an expression, lower-cased; None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether one is due
    for token in re.findall(r"\(|\)|[^\s()]+", expression.lower()):
        if token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token in PRECEDENCE:
            if operand:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        else:
            if not operand or not re.fullmatch(r"[a-z0-9.+:-]+", token):
                return None
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(rpn: list[str]) -> tuple[float, set[str]]:
    """(restriction, identifiers): the user of an OR takes the milder side, of an AND the stricter one."""
    stack: list[tuple[float, set[str]]] = []
    for token in rpn:
        if token not in PRECEDENCE:
            stack.append((restriction(token), {token}))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((a * EXCEPTION, left))
        else:
            if len(left) < len(right):
                left, right = right, left
            left |= right  # the smaller into the larger
            stack.append(((min if token == "or" else max)(a, b), left))
    return stack[0]


def expressions(raw: bytes) -> Iterator[str]:
    """What follows each tag, up to the next tag, the end of its line or of a comment."""
    low = raw.lower()
    at = low.find(TAG_TEXT)
    while at >= 0:
        at, after = at + len(TAG_TEXT), low.find(TAG_TEXT, at + len(TAG_TEXT))
        end = min(x if x >= 0 else len(raw) for x in (after, raw.find(b"\n", at, after if after >= 0 else len(raw))))
        yield re.split(r"\*/|-->|[\"',;]", raw[at:end].decode("utf-8", "replace"), maxsplit=1)[0].strip()
        at = after


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_TABLE).split(b" ")
    words = [w for w in words if w]
    joined = b" %b " % b" ".join(words)
    n_base, low, high, base, labels, score, tagged = 0, None, None, set(), set(), 0.0, False
    for end, (length, phrase, label) in automaton().iter(joined.decode("latin-1")):
        start = end - length + 1
        if phrase == TAG:
            tagged = True
            continue
        labels.add(label)
        if phrase in BASE:
            n_base += 1
            base.add(label)
            low, high = start if low is None else min(low, start), start if high is None else max(high, start)
    score = max((RESTRICTS[x] for x in labels), default=0.0)
    if tagged:
        for e in expressions(raw):
            rpn = parse(e)
            got, names = evaluate(rpn) if rpn else (UNKNOWN, {"unparsed"})
            score = max(score, got)
            labels |= names
    at = lambda x: None if x is None else joined.count(b" ", 0, x)
    return len(words), n_base, at(low), at(high), ",".join(sorted(base)), ",".join(sorted(labels)), float(score)


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each input row.

    score: how restrictive all that was found is together, 0 where nothing was. Null text counts as
    empty; null ids are kept; repeated rows get equal results; an empty table gives an empty
    result; further columns are ignored. A malformed expression gets the label ``unparsed``.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*map(scan_text, b.column(1).to_pylist()), strict=True)) or [()] * len(names)
            yield pa.record_batch([b.column(0), *map(pa.array, rows, kinds)], ["id", *names])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, {COLUMNS}").withColumnRenamed("id", id_col)


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs)
