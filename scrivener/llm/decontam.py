"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance.

Texts and test items are reduced to lower-case words joined by single blanks, in
Unicode characters: lower-cased, composed (NFC), ASCII punctuation as blanks.
An item of m characters has a budget of e = floor(m * ``error_rate``) edits and
is cut into e + 1 pieces: a text that holds the item within e edits holds one
piece unchanged.  One Aho-Corasick automaton finds all pieces in whole texts.

Short pieces are hit often by chance, so a hit climbs a binary tree over the
item's pieces first: a node of u pieces is allowed u - 1 edits, and a node
within its edits has a child within its own (else the children had at least u),
so every match has one hit whose nodes all are within theirs.  Around the hits
that reach the root Myers' algorithm decides the least distance exactly.

Items come to the tasks in blocks of at most ``block_bytes`` of text, each block
against all rows, so that no size of the benchmark is assumed.  Items of fewer
than ``min_words`` words are searched exactly, as whole words.

Cases: null, empty and blank texts or items give no pairs; repeated rows give
repeated pairs, repeated items one pair an item row; a null id stays null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import texts

# behind lower-casing: ASCII letters and digits stay, characters beyond ASCII stay, the rest are blanks
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def normal(text: bytes) -> str:
    """Lower-case words joined by blanks."""
    if text.isascii():
        return b" ".join(text.lower().translate(_WORDS).split()).decode("ascii")
    composed = unicodedata.normalize("NFC", text.decode("utf-8", "replace").lower())
    return " ".join(composed.encode().translate(_WORDS).decode().split())


class Myers:
    """Least edit distance of a pattern to any substring, by bit vectors."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.mask = (1 << self.size) - 1
        self.high = 1 << (self.size - 1)
        self.places: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        mask, high, get = self.mask, self.high, self.places.get
        plus, minus, score = mask, 0, self.size
        best = score
        for c in text:
            eq = get(c, 0)
            vertical = eq | minus
            horizontal = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(horizontal | plus) & mask
            down = plus & horizontal
            if up & high:
                score += 1
            elif down & high:
                score -= 1
                if score < best:
                    best = score
            up = up << 1 & mask
            down = down << 1 & mask
            plus = down | ~(vertical | up) & mask
            minus = up & vertical
        return best


def beside(hay: str, at: int, part: str, before: bool) -> bool:
    """Whether ``part`` may stand within one edit directly behind, or ``before``, place ``at``: one half of it is unchanged."""
    half = len(part) // 2
    first, last = part[:half], part[half:]
    if before:
        if hay.endswith(last, 0, at):
            return True
        start = at - len(part)
        return any(hay.startswith(first, start + k) for k in (-1, 0, 1) if start + k >= 0)
    return hay.startswith(first, at) or any(hay.startswith(last, at + half + k) for k in (-1, 0, 1) if at + half + k >= 0)


class Item:
    """A test item, its pieces, and for each piece the tree's nodes above it."""

    def __init__(self, item_id: int, pattern: str, budget: int, whole_words: bool):
        self.item_id, self.pattern, self.budget, self.whole_words = item_id, pattern, budget, whole_words
        self.cuts = [len(pattern) * i // (budget + 1) for i in range(budget + 2)]
        self.myers: dict[tuple[int, int], Myers] = {}

    def above(self, piece: int) -> list[tuple[int, int]]:
        """Ranges of pieces from the smallest node above ``piece`` to the last below the root."""
        out, low, high = [], 0, self.budget + 1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if piece < middle else (middle, high)
            if high - low > 1:
                out.append((low, high))
        return out[::-1]

    def distance(self, low: int, high: int, hay: str) -> int:
        """Least distance of pieces ``low`` to ``high`` in ``hay``."""
        if (low, high) not in self.myers:
            self.myers[low, high] = Myers(self.pattern[self.cuts[low] : self.cuts[high]])
        return self.myers[low, high].distance(hay)

    def climbs(self, piece: int, nodes: list[tuple[int, int]], at: int, hay: str) -> bool:
        """Whether all nodes above a piece found at ``at`` are within their edits."""
        cuts = self.cuts
        for low, high in nodes:
            if high - low == 2:
                other = low if low < piece else piece + 1
                if not beside(hay, at if other < piece else at + cuts[other] - cuts[piece], self.pattern[cuts[other] : cuts[other + 1]], other < piece):
                    return False
                continue
            edits, start = high - low - 1, at - cuts[piece] + cuts[low]
            if self.distance(low, high, hay[max(0, start - edits) : start + cuts[high] - cuts[low] + edits]) > edits:
                return False
        return True


class Searcher:
    """Finds items within their error budgets; build once a task."""

    def __init__(self, items: list[tuple[int, bytes]], error_rate: float, min_words: int):
        self.items: list[Item] = []
        places: dict[str, list[tuple[int, int, list[tuple[int, int]]]]] = {}
        for item_id, text in items:
            pattern = normal(text)
            if not pattern:
                continue
            short = pattern.count(" ") + 1 < min_words
            item = Item(item_id, pattern, 0 if short else int(len(pattern) * error_rate), short)
            for piece in range(item.budget + 1):
                places.setdefault(pattern[item.cuts[piece] : item.cuts[piece + 1]], []).append((len(self.items), piece, item.above(piece)))
            self.items.append(item)
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()

    def search(self, text: bytes) -> list[tuple[int, int]]:
        """(item id, least distance) of every item that the text holds."""
        if not self.items:
            return []
        hay = normal(text)
        starts: dict[int, set[int]] = {}
        for end, (size, at) in self.automaton.iter(hay):
            place = end + 1 - size
            for k, piece, nodes in at:
                item = self.items[k]
                start = place - item.cuts[piece]
                found = starts.get(k)
                if found is not None and start in found:
                    continue
                if item.whole_words and (place and hay[place - 1] != " " or hay[end + 1 : end + 2].strip()):
                    continue
                if item.climbs(piece, nodes, place, hay):
                    starts.setdefault(k, set()).add(start)
        out = []
        for k, found in starts.items():
            item = self.items[k]
            if item.pattern in hay:
                out.append((item.item_id, 0))
                continue
            best = item.budget + 1
            for a, b in windows(sorted(found), len(item.pattern), item.budget):
                best = min(best, item.distance(0, item.budget + 1, hay[max(0, a) : b]))
            if best <= item.budget:
                out.append((item.item_id, best))
        return sorted(out)


def windows(starts: list[int], size: int, budget: int) -> list[tuple[int, int]]:
    """Ranges that hold every match with one of these starts, overlapping ones merged."""
    out: list[tuple[int, int]] = []
    for s in starts:
        a, b = s - budget, s + size + budget
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", error_rate: float = 0.10, min_words: int = 5, block_bytes: int = 8 << 20, item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance) of every document that holds an item within its budget."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + total // block_bytes
    source = texts(docs, id_col, text_col)
    out = None
    for k in range(blocks):
        block = [(r.item, bytes(r.text)) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()]

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(block, error_rate, min_words)
            for b in batches:
                rows = [(i, item, d) for i, text in zip(b.column("doc_id").to_pylist(), b.column("text")) for item, d in searcher.search(text.as_py())]
                ids, found, distance = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(distance, pa.int64())], names=["doc_id", "item_id", "distance"])

        pairs = source.mapInArrow(run, "doc_id long, item_id long, distance long")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", error_rate: float = 0.10, min_words: int = 5, item_col: str = "item_id", block_bytes: int = 8 << 20, item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; one pass a block, no shuffle."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + total // block_bytes
    at = docs.columns.index(text_col)
    for k in range(blocks):
        block = [(r.item, bytes(r.text)) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()]

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(block, error_rate, min_words)
            for b in batches:
                yield b.filter(pa.array([not searcher.search((x.as_py() or "").encode()) for x in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
