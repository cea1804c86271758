"""Licence scans: Aho-Corasick for tags and notice phrases, a shunting-yard for expressions.

A text is lower-cased (A-Z) and reduced to its words, joined by single blanks;
one automaton finds every place of the base phrases and of longer notices.  An
identifier tag (``spdx-license-identifier:``) is followed by a licence
expression over ``and``, ``or`` and ``with``, which a shunting-yard turns into
postfix order; its identifiers become labels and its value tells whether the
text may be used under an allowed set.  The longest well-formed start of a line
counts, found in one pass; a word that is no identifier by name or form ends it.

Cases: null and empty texts have no words, null positions, empty labels, score
0; a malformed expression contributes the identifiers before the error; repeated
rows give repeated results; texts are scanned whole, other columns not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import map_docs, texts

BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "all rights reserved": "proprietary",
    "dedicated to the public domain": "public-domain",
}
ALLOWED = frozenset({"apache-2.0", "apache", "mit", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "cc-by", "cc-by-4.0", "cc0-1.0", "public-domain"})
# Identifiers without a digit; others are told by their form
SHORT_IDENTIFIERS = frozenset({
    "apache", "mit", "bsd", "isc", "zlib", "x11", "0bsd", "gpl", "lgpl", "agpl", "mpl", "epl", "cddl", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc0",
    "unlicense", "wtfpl", "ncsa", "openssl", "postgresql", "python", "ruby", "php", "perl", "beerware", "libpng", "curl", "ntp", "public-domain", "proprietary",
})
TAG_WORDS = "spdx license identifier"
TAG = re.compile(rb"spdx-license-identifier:[\x20\x09]*([^\n]*)")
TOKEN = re.compile(rb"[()]|[a-z0-9][a-z0-9.+-]*")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
# bytes that are not part of words become blanks
BLANKS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def is_identifier(token: str) -> bool:
    """A known short name, or by form: a digit behind a letter's name, or a reference of one's own."""
    return token in SHORT_IDENTIFIERS or token.startswith("licenseref-") or ("-" in token or "." in token) and any(c.isdigit() for c in token) and token[0].isalpha()


def to_postfix(tokens: Iterator[str]) -> tuple[list[str], set[int]]:
    """Shunting-yard over the longest well-formed start, in one pass: (postfix, places of exceptions in it).

    Whenever the tokens so far are complete, the output's length and the at most
    three waiting operators are noted; the last note is the result.
    """
    out: list[str] = []
    stack: list[str] = []
    exceptions: set[int] = set()
    best: tuple[int, list[str]] = (0, [])
    operand, depth, last = False, 0, ""
    for t in tokens:
        if t in PRECEDENCE:
            if not operand:
                break
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
        elif t == "(":
            if operand:
                break
            stack.append(t)
            depth += 1
        elif t == ")":
            if not operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            if operand or not (last == "with" and "exception" in t or is_identifier(t)):
                break
            if last == "with":
                exceptions.add(len(out))
            out.append(t)
            operand = True
        last = t
        if operand and not depth:
            best = len(out), stack[::-1]
    return out[: best[0]] + best[1], exceptions


def evaluate(postfix: list[str], allowed: frozenset[str] = ALLOWED) -> bool:
    """Whether the expression can be met by allowed licences; ``with`` keeps its licence's value."""
    stack: list[bool] = []
    for t in postfix:
        if t in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append(left or right if t == "or" else left and right if t == "and" else left)
        else:
            stack.append(t in allowed)
    return stack[0]


def parse_expression(text: bytes) -> tuple[list[str], bool | None]:
    """(licence identifiers, allowed) of the longest well-formed start; exceptions after ``with`` are no licences."""
    postfix, exceptions = to_postfix(m[0].decode() for m in TOKEN.finditer(text))
    if not postfix:
        return [], None
    return [t for i, t in enumerate(postfix) if t not in PRECEDENCE and i not in exceptions], evaluate(postfix)


class LicenseScanner:
    """Scans one text; build once a task.  More phrases come from parameters."""

    def __init__(self, base: dict[str, str] | None = None, notices: dict[str, str] | None = None, allowed: frozenset[str] = ALLOWED):
        self.base = BASE_PHRASES if base is None else base
        self.notices = NOTICE_PHRASES if notices is None else notices
        self.allowed = allowed
        self.automaton = ahocorasick.Automaton()
        for phrase in {*self.base, *self.notices, TAG_WORDS}:
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> dict:
        low = text.lower()
        words = low.translate(BLANKS).split()
        # latin-1 keeps one character a byte, so that places are byte places
        joined = " " + b" ".join(words).decode("latin-1") + " "
        hits = [(end - len(p) - 1, p) for end, p in self.automaton.iter(joined)]
        base_at = sorted(at for at, p in hits if p in self.base)
        word_of = lambda at: joined.count(" ", 0, at)
        base_labels = {self.base[p] for _, p in hits if p in self.base}
        labels = base_labels | {self.notices[p] for _, p in hits if p in self.notices}
        allowed = None
        n_tags = 0
        if any(p == TAG_WORDS for _, p in hits):
            for m in TAG.finditer(low):
                found, value = parse_expression(m[1])
                n_tags += 1
                labels |= set(found)
                if value is not None:
                    allowed = value if allowed is None else allowed and value
        n_notices = sum(p in self.notices for _, p in hits)
        n_base = len(base_at)
        # every kind of evidence leaves a part of the doubt: tags most, notices next, bare names least
        score = 1.0 - 0.1 ** min(n_tags, 1) * 0.3 ** min(n_notices, 2) * 0.5 ** min(n_base, 3)
        return {
            "n_words": len(words),
            "n_base": n_base,
            "first_word": word_of(base_at[0] + 1) - 1 if base_at else None,
            "last_word": word_of(base_at[-1] + 1) - 1 if base_at else None,
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(labels)),
            "score": score,
            "n_tags": n_tags,
            "allowed": allowed,
        }


FIELDS = [
    pa.field("n_words", pa.int64()), pa.field("n_base", pa.int64()), pa.field("first_word", pa.int64()), pa.field("last_word", pa.int64()),
    pa.field("base_labels", pa.string()), pa.field("labels", pa.string()), pa.field("score", pa.float64()), pa.field("n_tags", pa.int64()), pa.field("allowed", pa.bool_()),
]
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_tags long, allowed boolean"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None, allowed: frozenset[str] = ALLOWED) -> DataFrame:
    """One row for each row of ``docs``; columns as in ``SCHEMA``."""

    def build():
        scanner, names = LicenseScanner(base, notices, allowed), [f.name for f in FIELDS]

        def one(text: bytes):
            found = scanner.scan(text)
            return tuple(found[n] for n in names)

        return one

    return map_docs(texts(docs, id_col, text_col), build, FIELDS, SCHEMA).select("doc_id", *(F.col(f.name) for f in FIELDS))
