"""Quality rules: counted base rules, then a line CRF decoded by Viterbi.

Every line with a word gets a vector of features; a linear-chain conditional
random field labels the lines as content or boilerplate, and the share of the
words that stand in content lines decides whether a document stays.  The CRF is
fitted in numpy on a bounded sample of labelled documents (``max_labelled``:
a documented bound, taken by smallest hash of the id, so that it does not
depend on partitioning); counts and decoding cover every row and whole texts.

Cases: null and empty texts have no words and fail the base rules; a text
whose lines are all blank too; labels of absent documents, null labels and
repeated labels are harmless; without any labelled row, or with one class only,
a fixed prior weight vector is used.  Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import map_docs, texts

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
FEATURES = ("bias", "symbols", "marks", "capitals", "bars", "repeats", "digits", "short", "long_words", "seen", "ends_sentence", "few_letters")
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes]) -> int:
    """Words inside ``WINDOW``-word windows that occur at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    known = ids.setdefault
    seq = np.array([known(w, len(ids)) for w in words], np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h *= _MULTIPLIER
        h += seq[k : k + n]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


@dataclass
class Counts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > REPEAT_PERCENT * self.n_words


def count(text: bytes) -> tuple[Counts, list[bytes]]:
    """The base counts and the lines that have a word."""
    words = text.split()
    blanks = len(text) - sum(map(len, words))
    chars = len(text.decode("utf-8", "replace")) - blanks
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return Counts(len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)), lines


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(lines x FEATURES, words of each line); every feature within 0 and 1."""
    out = np.zeros((len(lines), len(FEATURES)), np.float64)
    weights = np.zeros(len(lines))
    seen: set[bytes] = set()
    for row, line in enumerate(lines):
        words = line.split()
        n, raw = len(words), np.frombuffer(line, np.uint8)
        size = len(raw)
        letters = max(1, int(_LETTERS[raw].sum()))
        ends = sum(w[-1] in b"#*$%&!" for w in words)
        out[row] = (
            1.0,
            min(1.0, 8 * sum(line.count(c) for c in SYMBOLS) / size),
            ends / n,
            min(1.0, 2 * _UPPER[raw].sum() / letters),
            min(1.0, 4 * line.count(b"|") / n),
            1.0 - len(set(words)) / n if n >= 6 else 0.0,
            min(1.0, 4 * _DIGIT[raw].sum() / size),
            1.0 if n < 4 else 0.0,
            min(1.0, max(0.0, size / n - 12) / 20),
            1.0 if line in seen else 0.0,
            1.0 if line.rstrip()[-1:] in b".?!" else 0.0,
            1.0 - letters / size,
        )
        weights[row] = n
        seen.add(line)
    return out, weights


class LineCrf:
    """Linear chain over two labels: 0 boilerplate, 1 content."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair  # FEATURES x 2, 2 x 2

    @classmethod
    def prior(cls) -> LineCrf:
        """Weights used where nothing is labelled."""
        content = dict(bias=2.0, symbols=-3.0, marks=-4.0, capitals=-2.0, bars=-4.0, repeats=-5.0, seen=-1.0, ends_sentence=0.5)
        w = np.array([content.get(f, 0.0) for f in FEATURES])
        return cls(np.stack([-w / 2, w / 2], 1), np.array([[0.5, 0.0], [0.0, 0.5]]))

    @classmethod
    def fit(cls, chains: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.5, l2: float = 1e-3) -> LineCrf:
        """``chains``: features of a document's lines and its label.

        Documents are labelled, lines are not: a good document's lines are all
        content; of a bad one, those lines are boilerplate that the current
        weights find least content-like, at least one (multiple instances).
        """
        if len({y for _, y in chains}) < 2:
            return cls.prior()
        model = cls.prior()
        share = sum(y for _, y in chains) / len(chains)
        balance = {1: 0.5 / share, 0: 0.5 / (1 - share)}
        x = np.concatenate([f for f, _ in chains])
        ends = np.cumsum([len(f) for f, _ in chains])
        starts = ends - np.array([len(f) for f, _ in chains])
        weight = np.concatenate([np.full(len(f), balance[y] / len(f)) for f, y in chains])
        y = np.concatenate([np.full(len(f), t) for f, t in chains])
        bad = [(a, b) for (a, b), (_, t) in zip(zip(starts, ends), chains) if t == 0]
        by_length: dict[int, list[int]] = {}
        for i, (a, b) in enumerate(zip(starts, ends)):
            by_length.setdefault(b - a, []).append(i)
        for step in range(rounds):
            if step % 30 == 0:  # guess the lines of bad documents anew
                score = x @ (model.unary[:, 1] - model.unary[:, 0])
                for a, b in bad:
                    y[a:b] = score[a:b] > 0
                    y[a + int(np.argmin(score[a:b]))] = 0
            grad_u, grad_p = np.zeros_like(model.unary), np.zeros_like(model.pair)
            potential = x @ model.unary
            for n, members in by_length.items():
                rows = starts[members][:, None] + np.arange(n)
                node, edge = model._marginals(potential[rows])
                target = np.eye(2)[y[rows]]
                w = weight[rows]
                grad_u += np.einsum("dnf,dnk,dn->fk", x[rows], target - node, w)
                if n > 1:
                    real = np.einsum("dni,dnj->dnij", target[:, :-1], target[:, 1:])
                    grad_p += np.einsum("dnij,dn->ij", real - edge, w[:, 1:])
            model.unary += rate * (grad_u / len(chains) * 4 - l2 * model.unary)
            model.pair += rate * (grad_p / len(chains) * 4 - l2 * model.pair)
        return model

    def _marginals(self, potential: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over documents of one length: node and edge marginals."""
        d, n, _ = potential.shape
        ahead, back = np.empty((d, n, 2)), np.zeros((d, n, 2))
        ahead[:, 0] = potential[:, 0]
        for t in range(1, n):
            ahead[:, t] = potential[:, t] + np.logaddexp(ahead[:, t - 1, :1] + self.pair[0], ahead[:, t - 1, 1:] + self.pair[1])
        for t in range(n - 2, -1, -1):
            nxt = potential[:, t + 1] + back[:, t + 1]
            back[:, t] = np.logaddexp(self.pair[:, 0] + nxt[:, :1], self.pair[:, 1] + nxt[:, 1:])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None, None]
        node = np.exp(ahead + back - total)
        edge = np.exp(ahead[:, :-1, :, None] + self.pair + (potential + back)[:, 1:, None, :] - total[..., None]) if n > 1 else np.zeros((d, 0, 2, 2))
        return node, edge

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The likeliest label of every line."""
        potential = features @ self.unary
        n = len(potential)
        came = np.zeros((n, 2), np.int8)
        p0, p1 = potential[0]
        (t00, t01), (t10, t11) = self.pair
        for t in range(1, n):
            from0, from1 = p0 + t00, p1 + t10
            to0, to1 = p0 + t01, p1 + t11
            came[t] = from1 > from0, to1 > to0
            p0, p1 = max(from0, from1) + potential[t, 0], max(to0, to1) + potential[t, 1]
        out = np.zeros(n, np.int8)
        out[-1] = p1 >= p0
        for t in range(n - 1, 0, -1):
            out[t - 1] = came[t, out[t]]
        return out

    def content_share(self, lines: list[bytes]) -> float:
        if not lines:
            return 0.0
        features, words = line_features(lines)
        return float(words[self.viterbi(features) == 1].sum() / words.sum())


def fit_crf(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 1500) -> LineCrf:
    """Fit on all lines of at most ``max_labelled`` documents."""
    picked = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    # the picked side has max_labelled rows of 12 bytes at most, whatever the input
    rows = texts(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for i, text, y in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("y").to_pylist()):
                if lines := count(text.as_py())[1]:
                    found.append((i, y, line_features(lines)[0].astype(np.float32).ravel()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["doc_id", "y", "x"])

    sample = sorted((r.doc_id, r.y, r.x) for r in rows.mapInArrow(features, "doc_id long, y long, x array<float>").collect())
    return LineCrf.fit([(np.array(x).reshape(-1, len(FEATURES)), int(y)) for _, y, x in sample])


FIELDS = [
    *(pa.field(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    pa.field("base_failed", pa.bool_()),
    pa.field("kept", pa.bool_()),
    pa.field("content_share", pa.float64()),
]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(text: bytes, crf: LineCrf, min_share: float) -> tuple:
    c, lines = count(text)
    share = crf.content_share(lines)
    return c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.base_failed, not c.base_failed and share >= min_share, share


def quality_rules(docs: DataFrame, crf: LineCrf, id_col: str = "doc_id", text_col: str = "text", min_share: float = 0.5) -> DataFrame:
    """Counts and verdict of every row; the model travels inside the closure (a few hundred bytes)."""
    return map_docs(texts(docs, id_col, text_col), lambda: lambda text: judge(text, crf, min_share), FIELDS, SCHEMA).select("doc_id", *(F.col(f.name) for f in FIELDS))


def filter_documents(docs: DataFrame, crf: LineCrf, text_col: str = "text", min_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [judge((x.as_py() or "").encode("utf-8", "replace"), crf, min_share)[6] for x in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
