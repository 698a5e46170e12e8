"""Licence detection: Aho-Corasick over phrases and tags, shunting-yard over licence expressions.

One automaton holds all notice phrases (as words of the lower-cased text,
joined by single spaces) and finds every place, overlapping ones included.
A second one finds identifier tags in the text itself; the expression after a
tag is split into tokens and turned into postfix order by a shunting-yard
parser (WITH binds closer than AND, AND closer than OR), then evaluated to the
set of licences and to a verdict: OR takes the freer side, AND the stricter.

Rows: a null or empty text has no words, no labels and score 0; a malformed
expression still gives the licences that stand in it (verdict unknown); words
after a tag that are no identifiers give nothing.
Repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import in_arrow

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases (words after the same normalisation), their labels and how much they say.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd license": ("bsd", 0.8),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "boost software license": ("bsl", 0.9),
    "isc license": ("isc", 0.8),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
    "creative commons": ("cc", 0.6),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc by": ("cc-by", 0.7),
    "cc0 1 0 universal": ("cc0", 0.8),
    "released into the public domain": ("public-domain", 0.7),
    "all rights reserved": ("all-rights-reserved", 0.6),
}
BASE_WEIGHT, TAG_WEIGHT = 0.8, 0.95
# Identifier tags, lower-cased.
TAGS = ("spdx-license-identifier:", "license-expression:", "@license ")
# Label and freedom (2 permissive, 1 copyleft, 0 restricted) by the start of an identifier.
FAMILIES = {
    "mit": ("mit", 2), "apache": ("apache", 2), "gpl": ("gpl", 1), "lgpl": ("lgpl", 1), "agpl": ("agpl", 1), "bsd": ("bsd", 2), "0bsd": ("bsd", 2),
    "mpl": ("mpl", 1), "epl": ("epl", 1), "bsl": ("bsl", 2), "isc": ("isc", 2), "unlicense": ("unlicense", 2), "cc0": ("cc0", 2), "zlib": ("zlib", 2),
    "cc-by-nc": ("cc-by-nc", 0), "cc-by-nd": ("cc-by-nd", 0), "cc-by-sa": ("cc-by-sa", 1), "cc-by": ("cc-by", 2), "proprietary": ("proprietary", 0),
}
# Identifiers of SPDX without a version, lower-cased, that stand for themselves.
UNVERSIONED = frozenset("beerware blessing curl fair ftl hpnd icu ijg imagemagick jasper json libpng libtiff mulanpsl-1 ncsa net-snmp ntp openssl php-3 postgresql psf qhull ruby sleepycat tcl vim wtfpl x11 xnet".split())
VERDICTS = ("restricted", "copyleft", "permissive")

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:_-]*")
_VERSIONED = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+|[a-z][a-z0-9]*(?:-[a-z][a-z0-9]*)*-v?[0-9]+(?:\.[0-9]+)*(?:-[a-z0-9.]+)*")
_BINDS = {"or": 1, "and": 2, "with": 3}


class Malformed(ValueError):
    """An expression that does not parse."""


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: infix licence expression to postfix; operators in lower case."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for t in tokens:
        low = t.lower()
        if low in _BINDS:
            if operand_next:
                raise Malformed(t)
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        elif t == "(":
            if not operand_next:
                raise Malformed(t)
            stack.append(t)
        elif t == ")":
            if operand_next:
                raise Malformed(t)
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise Malformed(t)
            stack.pop()
            operand_next = False
        else:
            if not operand_next:
                raise Malformed(t)
            out.append(t)
            operand_next = False
    if operand_next or "(" in stack:
        raise Malformed("unfinished")
    return out + stack[::-1]


def family(identifier: str) -> tuple[str | None, int | None]:
    """Label and freedom of one identifier.

    Unknown ones are their own label if they have the shape of an SPDX identifier (a
    name with a version) or a ``LicenseRef-``; other words are no identifiers (None).
    """
    low = identifier.lower().rstrip("+")
    for length in range(low.count("-") + 1, 0, -1):
        name = "-".join(low.split("-")[:length])
        if name in FAMILIES:
            return FAMILIES[name]
    return (low if low in UNVERSIONED or _VERSIONED.fullmatch(low) else None), None


def evaluate(tokens: list[str]) -> tuple[set[str], int | None]:
    """Labels of an expression and its freedom (None: unknown)."""
    stack: list[tuple[set[str], int | None]] = []
    for t in postfix(tokens):
        if t in _BINDS:
            (rl, rf), (ll, lf) = stack.pop(), stack.pop()
            if t == "with":  # an exception only widens what its licence allows
                stack.append((ll, lf))
            elif t == "or":
                known = [f for f in (lf, rf) if f is not None]
                stack.append((ll | rl, max(known) if known else None))
            else:
                stack.append((ll | rl, None if lf is None or rf is None else min(lf, rf)))
        else:
            label, freedom = family(t)
            stack.append(({label} - {None}, freedom))
    return stack[0]


def expression_after(line: str) -> list[str]:
    """Tokens of the expression at the start of a line: operands joined by operators, up to the first other word or mark."""
    tokens, depth, operand_next, at = [], 0, True, 0
    for m in _TOKEN.finditer(line):
        t = m.group()
        if line[at : m.start()].strip(" \t"):
            break
        at = m.end()
        low = t.lower()
        if t == "(" and operand_next:
            depth += 1
        elif t == ")" and depth and not operand_next:
            depth -= 1
        elif low in _BINDS and not operand_next:
            operand_next = True
        elif operand_next and t not in "()":
            operand_next = False
        else:
            break
        tokens.append(t)
    if tokens and not operand_next and depth == 0:  # an identifier does not end with the sentence's mark
        while tokens[-1] != ")" and tokens[-1][-1] in ".:" and len(tokens[-1]) > 1:
            tokens[-1] = tokens[-1][:-1]
    return tokens


@dataclass
class Scan:
    n_words: int = 0
    starts: list[int] = field(default_factory=list)
    base: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    doubt: float = 1.0
    freedom: int | None = None
    expressions: list[str] = field(default_factory=list)


class Scanner:
    """Both automata, built once per task."""

    def __init__(self) -> None:
        self.phrases = ahocorasick.Automaton()
        for p, label in BASE.items():
            self.phrases.add_word(f" {p} ", (True, label, BASE_WEIGHT, len(p) + 1))
        for p, (label, weight) in NOTICES.items():
            self.phrases.add_word(f" {p} ", (False, label, weight, len(p) + 1))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for t in TAGS:
            self.tags.add_word(t, len(t))
        self.tags.make_automaton()

    def scan(self, text: str) -> Scan:
        low = text.translate(_LOWER) if not text.islower() else text
        words = WORD.findall(low)
        out, seen = Scan(len(words)), {}
        flat = f" {' '.join(words)} "
        count, upto = 0, 0
        for end, (is_base, label, weight, length) in self.phrases.iter(flat):
            if is_base:
                start = end - length
                count += flat.count(" ", upto, start + 1) if start + 1 > upto else -flat.count(" ", start + 1, upto)
                upto = start + 1
                out.starts.append(count - 1)
                out.base.add(label)
            seen[label] = max(seen.get(label, 0), weight)
        for end, _ in self.tags.iter(low):
            stop = low.find("\n", end + 1)
            tokens = expression_after(text[end + 1 : stop if stop >= 0 else len(text)])
            if not tokens:
                continue
            try:
                labels, freedom = evaluate(tokens)
            except Malformed:
                labels, freedom = {family(t)[0] for t in tokens if t not in "()" and t.lower() not in _BINDS}, None
            labels.discard(None)
            if not labels:
                continue
            out.expressions.append(" ".join(tokens))
            seen.update(dict.fromkeys(labels, TAG_WEIGHT))
            if freedom is not None:
                out.freedom = freedom if out.freedom is None else min(out.freedom, freedom)
        out.labels = set(seen)
        for weight in seen.values():
            out.doubt *= 1 - weight
        return out


def scans(documents: DataFrame) -> DataFrame:
    """Per document the counts, places, labels, score, expressions found and their joint verdict."""
    names = "doc_id n_words n_base first_word last_word base_labels labels score expressions verdict".split()

    def run(batches):
        scanner = Scanner()
        joined = lambda labels: ",".join(sorted(labels))
        for b in batches:
            found = [scanner.scan(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([s.n_words for s in found], pa.int64()),
                    pa.array([len(s.starts) for s in found], pa.int64()),
                    pa.array([min(s.starts, default=None) for s in found], pa.int64()),
                    pa.array([max(s.starts, default=None) for s in found], pa.int64()),
                    pa.array([joined(s.base) for s in found], pa.string()),
                    pa.array([joined(s.labels) for s in found], pa.string()),
                    pa.array([1 - s.doubt if s.labels else 0.0 for s in found], pa.float64()),
                    pa.array([s.expressions for s in found], pa.list_(pa.string())),
                    pa.array([VERDICTS[s.freedom] if s.freedom is not None else "unknown" for s in found], pa.string()),
                ],
                names=names,
            )

    kind = dict(documents.dtypes)["doc_id"]
    return in_arrow(
        documents.select("doc_id", "text"),
        run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "expressions array<string>, verdict string",
    )
