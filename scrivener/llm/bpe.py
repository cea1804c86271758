"""BPE encoding and decoding with a contiguous rank array.

``encode_documents`` encodes with a published word-level BPE vocabulary file
(NFC, lower case, white space dropped, byte symbols, a word-end suffix).  A
word's parts stand in one contiguous list beside the ranks of adjacent parts;
the smallest rank is found by scanning, its boundary is deleted and the two
neighbouring ranks are refreshed.  Words of more than ``LONG`` parts would make
the scan quadratic and go through a heap over a linked list, with equal output.

Cases: null and empty texts have no tokens and decode to ''; repeated rows give
repeated results; texts of any length are encoded whole; other columns of the
input are not read.  Special-token strings inside a text become their own id.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import sys
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import map_docs, texts

LONG = 256
NONE = 1 << 60


def byte_symbols() -> list[str]:
    """The public byte-to-printable-character table of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(shifted)) for b in range(256)]


# Letters and numbers that Unicode 16 added to the 15.1 of unicodedata,
# and (first, last, offset) of capital letters added by 16 and 17.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
CAPITALS_17 = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
]
LOWER_17 = {c: c + by for first, last, by in CAPITALS_17 for c in range(first, last + 1)}


@functools.cache
def word_pattern(wide: bool) -> regex.Pattern:
    """The vocabulary file's split pattern; ``wide``: by Unicode 16 classes, else for code points below 0x530 only."""
    if not wide:
        letter, number, space = r"\p{L}", r"\p{N}", r"\p{White_Space}"
    else:
        runs = {"L": list(LETTERS_16), "N": list(NUMBERS_16)}
        for kind, found in itertools.groupby(range(sys.maxunicode + 1), lambda c: unicodedata.category(chr(c))[0]):
            if kind in runs:
                found = list(found)
                runs[kind].append((found[0], found[-1]))
        letter, number = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs[k]) for k in "LN")
        space = r"\p{White_Space}"
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")


# The sections of the file that this module implements
SECTIONS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def check_sections(spec: dict) -> None:
    """Raise ValueError for a file that would be read wrongly."""
    wrong = [k for k, v in SECTIONS.items() if spec.get(k) != v] + [f"model.{k}" for k, v in MODEL.items() if spec["model"].get(k, v) != v]
    wrong += [f"added token {a['content']}" for a in spec["added_tokens"] if any(a.get(k, v) != v for k, v in ADDED.items())]
    if wrong:
        raise ValueError(f"not a word-level BPE file of the known kind: {', '.join(wrong)}")


class WordBpe:
    """Encoder and decoder of one vocabulary file; build once a task."""

    def __init__(self, path: str, cache_size: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_sections(spec)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.tokens = [""] * (1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.specials.items():
            self.tokens[i] = token
        symbols = byte_symbols()
        self.first = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.suffix] for s in symbols]
        self.width = len(self.tokens)
        self.ranks: dict[int, int] = {}
        self.merged: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            key = vocab[a] * self.width + vocab[b]
            self.ranks[key] = rank
            self.merged[key] = vocab[a + b]
        self.late_capital = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in CAPITALS_17) + "]")
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.odd_space = regex.compile("[\x1c-\x1f]")
        self.cache_size = cache_size
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        parts = [self.first[b] for b in word]
        parts[-1] = self.last[word[-1]]
        return self._merge_short(parts) if len(parts) <= LONG else self._merge_long(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        ranks, width, get = self.ranks, self.width, self.ranks.get
        adjacent = [get(a * width + b, NONE) for a, b in zip(parts, parts[1:])]
        while adjacent:
            low = min(adjacent)
            if low == NONE:
                break
            at = adjacent.index(low)
            parts[at] = self.merged[parts[at] * width + parts[at + 1]]
            del parts[at + 1], adjacent[at]
            if at:
                adjacent[at - 1] = get(parts[at - 1] * width + parts[at], NONE)
            if at < len(adjacent):
                adjacent[at] = get(parts[at] * width + parts[at + 1], NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        width, get, n = self.width, self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] * width + parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else n
            if j >= n or get(parts[i] * width + parts[j]) != rank:
                continue
            parts[i], parts[j] = self.merged[parts[i] * width + parts[j]], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(parts[i] * width + parts[after[i]], NONE)) != NONE:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := get(parts[before[i]] * width + parts[i], NONE)) != NONE:
                heapq.heappush(heap, (r, before[i]))
        return [p for p in parts if p >= 0]

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """(ids as bytes, decoded text) of text without white space, by two cache generations."""
        got = self.old.pop(chunk, None)
        if got is None:
            words = word_pattern(max(chunk) >= "\u0530").findall(chunk)
            ids = [i for word in words for i in self.merge(word.encode())]
            got = (b"".join(i.to_bytes(4, "little") for i in ids), self.decode(ids))
        if len(chunk) < 256:
            if len(self.young) >= self.cache_size:
                self.old, self.young = self.young, {}
            self.young[chunk] = got
        return got

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # each character by itself: no final sigma
        if self.late_capital.search(text):
            text = text.translate(LOWER_17)
        if self.odd_space.search(text):  # str.split() takes these as space, the pattern does not
            chunks = regex.split(r"\p{White_Space}+", text)
        else:
            chunks = text.split()
        young, out = self.young, []
        for c in chunks:
            got = young.get(c)
            if got is None:
                if not c:
                    continue
                got = self._chunk(c)
                young = self.young
            out.append(got)
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit integers, decoded text)."""
        if self.special_pattern and self.special_pattern.search(text):
            found, at = [], 0
            for m in self.special_pattern.finditer(text):
                i = self.specials[m[0]]
                found += [*self._plain(text[at : m.start()]), (i.to_bytes(4, "little"), self.tokens[i])]
                at = m.end()
            found += self._plain(text[at:])
        else:
            found = self._plain(text)
        if not found:
            return b"", ""
        ids, words = zip(*found)
        return b"".join(ids), " ".join(w for w in words if w)

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens joined by blanks, special ones kept."""
        return " ".join([self.tokens[i] for i in ids])


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded) of every row."""

    def build():
        bpe = WordBpe(tokenizer_path)

        def one(text: bytes):
            ids, decoded = bpe.encode(text.decode("utf-8", "replace"))
            return len(ids) // 4, list(memoryview(ids).cast("I")), decoded

        return one

    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())]
    return map_docs(texts(docs, id_col, text_col), build, fields, "n_tokens long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents`` with SHA-256 digests in place of ids and text."""

    def build():
        bpe, sha = WordBpe(tokenizer_path), hashlib.sha256

        def one(text: bytes):
            ids, decoded = bpe.encode(text.decode("utf-8", "replace"))
            return len(ids) // 4, sha(ids).hexdigest(), sha(decoded.encode()).hexdigest()

        return one

    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    out = map_docs(texts(docs, id_col, text_col), build, fields, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
