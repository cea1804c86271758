"""Repeated passages by enhanced suffix arrays, over the whole corpus.

A byte goes if a ``MIN`` = 100-byte string that covers it also starts earlier
(smaller id, or earlier in the same document).  A suffix array of a corpus does
not fit one task, so equal strings are first brought together:

1. *Anchors.*  The leftmost least-hashed ``K``-gram of a ``MIN``-byte window
   depends on the window's bytes alone; equal windows have equal anchors.  An
   anchor stands for the run of windows that choose it, its *context*.  Anchors
   with a 64-bit hash, a 64-bit hash of the context and their place are packed by hash
   bucket.  Equal contexts become one leaf of the later tree with all their
   places: all places but the first go, the first stands for them.  An anchor
   without an equal hash anywhere is unique.  What is left are different
   contexts of equal anchors.
2. *Contexts.*  Documents are co-located with their open anchors by a hash of the
   row, and the contexts' bytes are sent to their hash bucket; those of an anchor
   with more than ``HOT_CONTEXTS`` contexts (an edge of a very common passage) by
   the hashes of their single windows, so that no bucket holds them all.
3. *Suffix arrays.*  A bucket is taken in ``SUB_BUCKETS`` ranges of hashes.  The
   suffixes of their contexts that have ``MIN`` bytes are sorted; the longest common
   prefixes of neighbours are scanned with a stack, which walks the common-prefix
   interval tree.  An interval whose members' left bytes differ is a maximal
   repeat: all its occurrences but the first lose its length.  One whose members
   all have the same left byte is passed over, because the repeat that starts one byte
   before covers it; a context's start counts as different, because what is left
   of it belongs to another anchor.
4. Documents meet their removed ranges, again by a hash of the row; ranges of
   neighbouring contexts that touch are joined there to the passage's full extent.

``repeat_groups`` returns the tree's maximal repeats with all their occurrences;
there every context takes the way of steps 2 and 3.

Cases: null, empty and short texts lose nothing; a null id sorts first; rows of
one id and one text are one document, and rows of one id, or of none, with
different texts are ordered by xxhash64 of the text, which tells them apart;
texts of any length are cut into overlapping segments of ``SEGMENT`` bytes for
hashing; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import materialize, shuffle_parts

MIN, K = 100, 44
SPAN = MIN - K + 1  # K-grams of a window
NO_ID = -(1 << 63)
CHUNK_BYTES, STEP_BYTES = 12 << 20, 1 << 20
HOT_CONTEXTS = 4096  # different contexts of one anchor that still go to one bucket
HASH_BUCKET_BYTES, DOC_BUCKET_BYTES, SUB_BUCKETS = 16 << 20, 4 << 20, 8  # text behind a bucket; parts that are analysed one by one
SEGMENT = 64 << 20  # bytes whose places fit ``POS_BITS``
POS_BITS = np.uint64(28)
ANCHORS, COVERED, OPEN, DOCUMENT, CONTEXTS = 0, 1, 2, 3, 4
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240301).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@functools.lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    inverse = _U(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size, b)])) for b in (_BASE, inverse))


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): (sums[b] - sums[a]) * inverse[a] hashes raw[a:b]."""
    size = 1 << max(20, len(raw).bit_length())
    powers, inverse = _powers(size)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTES[raw] * powers[: len(raw)], out=sums[1:])
    return sums, inverse


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    out, done, size, rest = None, 0, 1, width
    while True:
        if rest & 1:
            out = a if out is None else np.minimum(out[: len(a) - done], a[done : done + len(out[: len(a) - done])])
            done += size
        rest >>= 1
        if not rest:
            return out
        a = np.minimum(a[:-size], a[size:])
        size *= 2


def _segment_anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Anchors of all windows of short texts: document number, place, hash, context hash, bytes of context before and from the place."""
    lens = np.array([len(t) for t in texts], np.int64)
    names = ("doc", "pos", "h", "ctx", "lo", "hi")
    total = int(lens.sum())
    if total < MIN:
        return {n: np.empty(0, np.int64 if n in ("doc", "pos", "lo", "hi") else _U) for n in names}
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(lens) - lens
    sums, inverse = prefix_sums(raw)
    h = mix((sums[K:] - sums[:-K]) * inverse[: total - K + 1])
    low = _U((1 << int(POS_BITS)) - 1)
    least = sliding_min(h & ~low | np.arange(len(h), dtype=_U), SPAN)
    at = (least & low).astype(np.int64)  # of the window that starts here
    # windows that end beyond their document do not count
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, np.maximum(starts, starts + lens - MIN + 1), 1)
    np.add.at(edge, starts + lens, -1)
    windows = np.flatnonzero(np.cumsum(edge[: len(at)]) == 0)
    at = at[windows]
    if not len(at):
        return {n: np.empty(0, np.int64 if n in ("doc", "pos", "lo", "hi") else _U) for n in names}
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    place, first = at[new], windows[new]
    last = windows[np.r_[new[1:] - 1, len(at) - 1]] + MIN
    doc = np.searchsorted(starts, place, "right") - 1
    ctx = mix((sums[last] - sums[first]) * inverse[first] + (place - first).astype(_U) * _U(0xA0761D6478BD642F) + (last - place).astype(_U))
    return {"doc": doc, "pos": place - starts[doc], "h": h[place], "ctx": ctx, "lo": place - first, "hi": last - place}


def find_anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """``_segment_anchors`` of texts of any length; segments share ``MIN`` - 1 bytes, so every window is in one."""
    if sum(map(len, texts)) <= 2 * SEGMENT:
        return _segment_anchors(texts)
    parts = []
    for doc, text in enumerate(texts):
        for at in range(0, max(1, len(text) - MIN + 1), SEGMENT):
            found = _segment_anchors([text[at : at + SEGMENT + MIN - 1]])
            parts.append(found | {"doc": found["doc"] + doc, "pos": found["pos"] + at})
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


# ---- packed arrays: columns of fixed byte widths, one zstd frame

_WIDTHS = {"h": 8, "ctx": 8, "id": 8, "row": 8, "pos": 4, "lo": 1, "hi": 1, "hot": 1, "start": 4, "size": 4}


_PLANES = ("id", "row", "pos", "start", "size")


def pack(columns: dict[str, np.ndarray], tail: bytes = b"") -> bytes:
    parts = [len(next(iter(columns.values()))).to_bytes(8, "little")]
    for name, a in columns.items():
        if name in ("id", "row"):  # neighbours are alike: differences, byte planes
            a = np.diff(a, prepend=np.int64(0))
        planes = np.ascontiguousarray(a.astype("<i8" if a.dtype.kind == "i" else "<u8")).view(np.uint8).reshape(-1, 8)[:, : _WIDTHS[name]]
        parts.append(planes.T.tobytes() if name in _PLANES else planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts) + tail)


def unpack(blob: bytes, names: tuple[str, ...]) -> tuple[dict[str, np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(data[:8], "little"), 8, {}
    for name in names:
        w = _WIDTHS[name]
        part = np.frombuffer(data, np.uint8, n * w, at)
        part = part.reshape(w, n).T if name in _PLANES else part.reshape(n, w)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = part
        a = wide.reshape(-1).view("<u8" if name in ("h", "ctx") else "<i8")
        out[name] = np.cumsum(a) if name in ("id", "row") else a
        at += n * w
    return out, data[at:]


def gather(blobs: list[bytes], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    parts = [unpack(b, names)[0] for b in blobs]
    return {n: np.concatenate([p[n] for p in parts]) for n in names}


def doc_bucket(ids: np.ndarray, rows: np.ndarray, buckets: int) -> np.ndarray:
    """By id and text, so that many rows of one id, or of none, are spread."""
    return (mix(mix(ids.astype(np.int64).view(_U)) ^ rows.astype(np.int64).view(_U)) % _U(buckets)).astype(np.int64)


def bucket_count(total: int, size: int, parts: int) -> int:
    """Buckets of at most about ``size`` bytes; beyond one a partition, full rounds of them, so that all partitions hold as many."""
    least = 1 + total // size
    return least if least <= parts else parts * -(-least // parts)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted keys differs from the row before it."""
    out = np.ones(len(keys[0]), bool)
    if len(out) > 1:
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def union_ranges(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Overlapping or touching ranges of a document (id, row, start, size) as one."""
    if not len(c["id"]):
        return c
    order = np.lexsort((c["start"], c["row"], c["id"]))
    i, r, s = c["id"][order], c["row"][order], c["start"][order]
    other = runs(i, r)
    base = (np.cumsum(other) - 1) << 33
    end = np.maximum.accumulate(base + s + c["size"][order])
    new = other.copy()
    new[1:] |= (base + s)[1:] > end[:-1]
    at = np.flatnonzero(new)
    last = np.r_[at[1:] - 1, len(s) - 1]
    return {"id": i[at], "row": r[at], "start": s[at], "size": end[last] - base[at] - s[at]}


def _by_doc(kind: int, columns: dict[str, np.ndarray], buckets: int) -> list[tuple]:
    bucket = doc_bucket(columns["id"], columns["row"], buckets)
    return _split(kind, columns, bucket)


def _split(kind: int, columns: dict[str, np.ndarray], bucket: np.ndarray) -> list[tuple]:
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(runs(bucket[order]))
    return [(kind, int(bucket[part[0]]), None, None, pack({n: a[part] for n, a in columns.items()})) for part in np.split(order, cuts[1:])]


SCHEMA = "kind int, b long, id long, row long, blob binary"
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=["kind", "b", "id", "row", "blob"])


_ANCHOR = ("h", "ctx", "id", "row", "pos", "lo", "hi")
_OPENED = ("h", "id", "row", "pos", "lo", "hi", "hot")
_RANGE = ("id", "row", "start", "size")
_CONTEXT = ("h", "id", "row", "start", "size")


def _settle(a: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Anchors sorted by (h, ctx, place) without repeats; which of them are the first of their context."""
    order = np.lexsort((a["pos"], a["row"], a["id"], a["ctx"], a["h"]))
    a = {n: v[order] for n, v in a.items()}
    single = runs(a["h"], a["ctx"], a["id"], a["row"], a["pos"])
    a = {n: v[single] for n, v in a.items()}
    return a, runs(a["h"], a["ctx"])


def _ranges(a: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return union_ranges({"id": a["id"][which], "row": a["row"][which], "start": (a["pos"] - a["lo"])[which], "size": (a["lo"] + a["hi"])[which]})


def _anchor_rows(hash_buckets: int, doc_buckets: int, settle: bool, chunk_bytes: int, step_bytes: int):
    """Step 1, by chunks of texts."""

    def flush(docs: list[tuple[int, int]], parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        a = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
        ids, rows = (np.array(x, np.int64) for x in zip(*docs))
        a["id"], a["row"] = ids[a["doc"]], rows[a.pop("doc")]
        if settle:
            a, first = _settle(a)
            yield _batch(_by_doc(COVERED, _ranges(a, ~first), doc_buckets))
            a = {n: v[first] for n, v in a.items()}
        order = np.lexsort((a["pos"], a["id"]))
        yield _batch(_split(ANCHORS, {n: a[n][order] for n in _ANCHOR}, (a["h"][order] % _U(hash_buckets)).astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, int]] = []
        parts: list[dict[str, np.ndarray]] = []
        texts: list[bytes] = []
        size = step = 0

        def work() -> None:
            if texts:
                found = find_anchors(texts)
                found["doc"] = found["doc"] + len(docs) - len(texts)
                parts.append(found)
                texts.clear()

        for b in batches:
            for i, row, text in zip(b.column("id").to_pylist(), b.column("row").to_pylist(), b.column("text")):
                text = text.as_py()
                docs.append((i, row))
                texts.append(text)
                size += len(text)
                step += len(text)
                if step >= step_bytes:
                    work()
                    step = 0
                if size >= chunk_bytes:
                    work()
                    yield from flush(docs, parts)
                    docs, parts, size, step = [], [], 0, 0
        work()
        yield from flush(docs, parts)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list]]:
    """(kind, bucket, rows) of rows sorted by kind and bucket; only the packed blobs of one bucket are held."""
    key, held = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("kind", "b", "id", "row", "blob"))):
            if row[:2] != key:
                if held:
                    yield *key, held
                key, held = row[:2], []
            held.append(row)
    if held:
        yield *key, held


def _bucket_rows(doc_buckets: int, settle: bool, hot_contexts: int):
    """Step 1, by hash buckets: settled ranges and open anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, _, rows in _groups(batches):
            if kind != ANCHORS:
                yield _batch(rows)
                continue
            a, first = _settle(gather([r[4] for r in rows], _ANCHOR))
            if not settle:
                first = np.ones(len(first), bool)
            out = _by_doc(COVERED, _ranges(a, ~first), doc_buckets)
            a = {n: v[first] for n, v in a.items()}
            new = runs(a["h"])
            contexts = np.diff(np.r_[np.flatnonzero(new), len(new)])[np.cumsum(new) - 1] if len(new) else np.empty(0, np.int64)
            several, a["hot"] = contexts > 1, (contexts > hot_contexts).astype(np.int64)
            out += _by_doc(OPEN, {n: a[n][several] for n in _OPENED}, doc_buckets)
            yield _batch(out)

    return run


def _document_rows(doc_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            ids = b.column("id").to_pylist()
            buckets = doc_bucket(np.array(ids, np.int64), np.array(b.column("row").to_pylist(), np.int64), doc_buckets).tolist() if ids else []
            for at in range(0, len(ids), 1000):
                part = slice(at, at + 1000)
                yield _batch([(DOCUMENT, d, i, r, squeeze(t.as_py())) for d, i, r, t in zip(buckets[part], ids[part], b.column("row").to_pylist()[part], b.column("text")[part])])

    return run


def _slices(c: dict[str, np.ndarray]) -> dict[tuple[int, int], slice]:
    """Where each document's rows stand in columns sorted by (id, row)."""
    at = np.flatnonzero(runs(c["id"], c["row"])) if len(c["id"]) else np.empty(0, np.int64)
    ends = [*at[1:].tolist(), len(c["id"])]
    return {k: slice(a, b) for k, a, b in zip(zip(c["id"][at].tolist(), c["row"][at].tolist()), at.tolist(), ends)}


def _stream_documents(batches: Iterator[pa.RecordBatch], kind: int, names: tuple[str, ...]):
    """(bucket, columns of ``kind`` sorted by document, None) and then (bucket, None, (id, row, text)) of its documents."""
    key, blobs, ready = None, [], False
    for b in batches:
        for k, d, i, row, blob in zip(*(b.column(c).to_pylist() for c in ("kind", "b", "id", "row", "blob"))):
            if d != key:
                key, blobs, ready = d, [], False
            if k == kind:
                blobs.append(blob)
                continue
            if not ready:
                c = gather(blobs, names) if blobs else {n: np.empty(0, np.int64) for n in names}
                order = np.lexsort((c["row"], c["id"]))
                yield d, {n: v[order] for n, v in c.items()}, None
                blobs, ready = [], True
            yield d, None, (i, row, blob)


def _context_rows(hash_buckets: int, doc_buckets: int):
    """Step 2: bytes of the open contexts to their hash buckets.

    An anchor with very many contexts would fill its bucket; its windows go to
    the buckets of their own hashes instead, each once a batch, the earliest.
    """

    def flush(found: list[tuple[dict[str, np.ndarray], list[bytes]]], hot: dict[bytes, tuple], later: list[tuple]) -> pa.RecordBatch:
        c = {n: np.concatenate([f[n] for f, _ in found]) for n in _CONTEXT} if found else {n: np.empty(0, np.uint64 if n == "h" else np.int64) for n in _CONTEXT}
        pieces = [p for _, ps in found for p in ps]
        if hot:
            i, r, s = (np.array(x, np.int64) for x in zip(*hot.values()))
            more = {"h": np.array([xxhash.xxh64_intdigest(w) for w in hot], np.uint64), "id": i, "row": r, "start": s, "size": np.full(len(hot), MIN)}
            c = {n: np.concatenate([c[n], more[n]]) for n in _CONTEXT}
            pieces += hot
        bucket = (c["h"] % _U(hash_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        out = []
        for part in np.split(order, np.flatnonzero(runs(bucket[order]))[1:]):
            out.append((CONTEXTS, int(bucket[part[0]]), None, None, pack({n: v[part] for n, v in c.items()}, b"".join([pieces[i] for i in part.tolist()]))))
        if later:
            i, r, s = (np.array(x, np.int64) for x in zip(*later))
            out += _by_doc(COVERED, union_ranges({"id": i, "row": r, "start": s, "size": np.full(len(later), MIN)}), doc_buckets)
        return _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeezed, found, size = zstandard.ZstdDecompressor(), [], 0
        hot: dict[bytes, tuple] = {}
        later: list[tuple] = []
        opened, where = None, {}
        for _, columns, doc in _stream_documents(batches, OPEN, _OPENED):
            if columns is not None:
                opened, where = columns, _slices(columns)
                continue
            i, row, blob = doc
            part = where.pop((i, row), None)  # a repeated row finds nothing
            if part is None:
                continue
            text = squeezed.decompress(blob)
            a = {n: v[part] for n, v in opened.items()}
            start, length = a["pos"] - a["lo"], a["lo"] + a["hi"]
            few = a["hot"] == 0
            pieces = [text[s : s + n] for s, n in zip(start[few].tolist(), length[few].tolist())]
            if pieces:
                found.append(({"h": a["h"][few], "id": a["id"][few], "row": a["row"][few], "start": start[few], "size": length[few]}, pieces))
                size += sum(map(len, pieces))
            for s, n in zip(start[~few].tolist(), length[~few].tolist()):
                for at in range(s, s + n - MIN + 1):
                    place, window = (i, row, at), text[at : at + MIN]
                    other = hot.get(window)
                    if other is None:
                        hot[window] = place
                        size += MIN
                    elif other != place:
                        hot[window] = min(other, place)
                        later.append(max(other, place))
            if size >= 16 << 20 or len(later) > 1 << 20:
                yield flush(found, hot, later)
                found, hot, later, size = [], {}, [], 0
        if found or hot:
            yield flush(found, hot, later)

    return run


def _left_changes(left: np.ndarray) -> np.ndarray:
    """Number of changes of the left byte before each suffix; those of two ends of an interval differ if its left bytes do."""
    return np.cumsum(np.r_[0, (left[1:] != left[:-1]) | (left[1:] < 0) | (left[:-1] < 0)]) if len(left) else left


class SuffixArray:
    """Enhanced suffix array of those suffixes of ``texts`` that have at least ``least`` bytes.

    ``order``: suffixes (text number, offset) in byte order; ``lcp``: bytes that
    a suffix shares with the one before it, 0 for the first.
    """

    def __init__(self, texts: list[bytes] | tuple[np.ndarray, np.ndarray], least: int):
        raw, lens = texts if isinstance(texts, tuple) else (np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64))
        starts = np.cumsum(lens) - lens
        count = np.maximum(0, lens - least + 1)
        text = np.repeat(np.arange(len(lens)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        # only suffixes whose first ``least`` bytes recur can share as much with a neighbour
        sums, inverse = prefix_sums(raw)
        at = starts[text] + offset
        h = (sums[at + least] - sums[at]) * inverse[at]
        by_hash = np.argsort(h, kind="stable")
        new = runs(h[by_hash]) if len(h) else np.empty(0, bool)
        several = np.diff(np.r_[np.flatnonzero(new), len(new)])[np.cumsum(new) - 1] > 1 if len(h) else new
        pick = np.sort(by_hash[several])
        text, offset, at = text[pick], offset[pick], at[pick]
        rest = lens[text] - offset
        width = int(rest.max()) if len(rest) else least
        # text is UTF-8, which has no byte 255: one more makes room for a 0 behind every end
        padded = np.concatenate([raw, np.zeros(width, np.uint8)])
        keys = np.empty((len(at), width), np.uint8)
        column = np.arange(width)
        for a in range(0, len(at), 1 << 15):
            part = slice(a, a + (1 << 15))
            keys[part] = np.where(column < rest[part, None], padded[at[part, None] + column] + 1, 0)
        order = np.argsort(keys.reshape(-1).view(f"S{width}"), kind="stable") if len(at) else np.empty(0, np.int64)
        self.text, self.offset, rest = text[order], offset[order], rest[order]
        self.lcp = np.zeros(len(order), np.int64)
        for a in range(1, len(order), 1 << 15):
            part = order[a - 1 : a + (1 << 15)]
            differ = keys[part[1:]] != keys[part[:-1]]
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            self.lcp[a : a + len(first)] = np.minimum(first, np.minimum(rest[a : a + len(first)], rest[a - 1 : a - 1 + len(first)]))

    def repeated(self, rank: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
        """For every suffix, the length of the longest maximal repeat of which it is not the first occurrence; 0 without one.

        ``rank``: order of occurrence; ``left``: the byte before each suffix, -1
        where it counts as different from all.  When an interval of the tree
        closes and its left bytes differ, its waiting members but the first are
        done, and the first waits for the parent; else all of them wait.
        """
        done, rank = [0] * len(self.lcp), rank.tolist()
        change = _left_changes(left).tolist()
        stack: list[list] = []  # [lcp, first suffix, waiting suffixes]
        for i, lcp in enumerate([*self.lcp.tolist()[1:], 0], 1):
            waiting, first = [i - 1], i - 1
            while stack and stack[-1][0] > lcp:
                value, first, members = stack.pop()
                members, waiting = (members, waiting) if len(members) > len(waiting) else (waiting, members)
                members += waiting
                if change[i - 1] > change[first]:
                    head = min(members, key=rank.__getitem__)
                    for m in members:
                        if m != head:
                            done[m] = value
                    members = [head]
                waiting = members
            if lcp >= least:
                if stack and stack[-1][0] == lcp:
                    top = stack[-1][2]
                    if len(top) < len(waiting):
                        top, waiting = waiting, top
                    top += waiting
                    stack[-1][2] = top
                else:
                    stack.append([lcp, first, waiting])
        return np.array(done, np.int64)

    def maximal_repeats(self, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
        """(lcp, first, last) of the intervals whose members' left bytes differ.

        ``left``: the byte before each suffix, -1 at a start, where nothing is shared.
        """
        change = _left_changes(left)
        stack: list[tuple[int, int]] = []
        for i, lcp in enumerate([*self.lcp.tolist()[1:], 0], 1):
            first = i - 1
            while stack and stack[-1][0] > lcp:
                value, first = stack.pop()
                if change[i - 1] > change[first]:
                    yield value, first, i - 1
            if lcp >= least and (not stack or stack[-1][0] < lcp):
                stack.append((lcp, first))


def _contexts(rows: list) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """A bucket's contexts and their bytes one after the other, by ranges of their hashes."""
    parts, tails = zip(*(unpack(r[4], _CONTEXT) for r in rows))
    c = {n: np.concatenate([p[n] for p in parts]) for n in _CONTEXT}
    raw = np.frombuffer(b"".join(tails), np.uint8)
    del parts, tails
    sub, starts = (mix(c["h"]) % _U(SUB_BUCKETS)).astype(np.int64), np.cumsum(c["size"]) - c["size"]
    for k in range(SUB_BUCKETS):
        mine = np.flatnonzero(sub == k)
        if len(mine):
            size = c["size"][mine]
            at = np.repeat(starts[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            yield {n: v[mine] for n, v in c.items()}, raw[at]


def _left_bytes(sa: SuffixArray, c: dict[str, np.ndarray], raw: np.ndarray) -> np.ndarray:
    """The byte before each suffix, -1 at a context's start."""
    starts = np.cumsum(c["size"]) - c["size"]
    return np.where(sa.offset > 0, raw[np.maximum(0, starts[sa.text] + sa.offset - 1)].astype(np.int64), -1)


def _analysed_rows(doc_buckets: int):
    """Step 3: removed ranges of every hash bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, _, rows in _groups(batches):
            if kind != CONTEXTS:
                yield _batch(rows)
                continue
            parts = []
            for c, raw in _contexts(rows):
                sa = SuffixArray((raw, c["size"]), MIN)
                place = c["start"][sa.text] + sa.offset
                order = np.lexsort((place, c["row"][sa.text], c["id"][sa.text]))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                size = sa.repeated(rank, _left_bytes(sa, c, raw), MIN)
                gone = size > 0
                parts.append({"id": c["id"][sa.text][gone], "row": c["row"][sa.text][gone], "start": place[gone], "size": size[gone]})
            found = union_ranges({n: np.concatenate([p[n] for p in parts]) for n in _RANGE})
            yield _batch(_by_doc(COVERED, found, doc_buckets))

    return run


_RESULT = "id long, row long, n_bytes long, starts array<long>, ends array<long>, kept binary"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4."""
    squeezed, ranges, where = zstandard.ZstdDecompressor(), None, {}
    out: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["id", "row", "n_bytes", "starts", "ends", "kept"])

    for _, columns, doc in _stream_documents(batches, COVERED, _RANGE):
        if columns is not None:
            ranges = union_ranges(columns)
            where = _slices(ranges)
            continue
        i, row, blob = doc
        text = squeezed.decompress(blob)
        part = where.get((i, row))
        starts, ends, kept = [], [], text
        if part is not None:
            starts = ranges["start"][part].tolist()
            ends = (ranges["start"][part] + ranges["size"][part]).tolist()
            kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)]))
        out.append((i, row, len(text), starts, ends, kept))
        size += len(text)
        if size >= 4 << 20:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


class _Plan:
    """Inputs and bucket numbers of one call."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
        self.docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
        total = self.docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.parts = shuffle_parts(docs.sparkSession)
        self.hash_buckets, self.doc_buckets = (bucket_count(total, size, self.parts) for size in (HASH_BUCKET_BYTES, DOC_BUCKET_BYTES))

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartitionById(self.parts, F.pmod("b", F.lit(self.parts)).cast("int")).sortWithinPartitions("kind", "b")

    def with_documents(self, rows: DataFrame) -> DataFrame:
        documents = self.docs.mapInArrow(_document_rows(self.doc_buckets), SCHEMA)
        return rows.unionByName(documents).repartitionById(self.parts, F.pmod("b", F.lit(self.parts)).cast("int")).sortWithinPartitions("b", "kind")

    def opened(self, settle: bool) -> DataFrame:
        anchors = self.docs.mapInArrow(_anchor_rows(self.hash_buckets, self.doc_buckets, settle, CHUNK_BYTES, STEP_BYTES), SCHEMA)
        return materialize(self.dealt(anchors).mapInArrow(_bucket_rows(self.doc_buckets, settle, HOT_CONTEXTS if settle else 1 << 62), SCHEMA))

    def contexts(self, opened: DataFrame) -> DataFrame:
        rows = self.with_documents(opened.where(F.col("kind") == OPEN))
        return self.dealt(rows.mapInArrow(_context_rows(self.hash_buckets, self.doc_buckets), SCHEMA))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept) of every row: removed byte ranges and the bytes that stay."""
    plan = _Plan(docs, id_col, text_col)
    opened = plan.opened(settle=True)
    analysed = materialize(plan.contexts(opened).mapInArrow(_analysed_rows(plan.doc_buckets), SCHEMA))
    covered = opened.where(F.col("kind") == COVERED).unionByName(analysed)
    out = plan.with_documents(covered).mapInArrow(_removed, _RESULT)
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_bytes", "starts", "ends", "kept")


def digest_passages(found: DataFrame) -> DataFrame:
    """The contract's columns from ``dedup_passages``."""
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _group_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, bucket, rows in _groups(batches):
        for part, (c, raw) in enumerate(_contexts(rows)):
            sa = SuffixArray((raw, c["size"]), MIN)
            for n, (size, a, b) in enumerate(sa.maximal_repeats(_left_bytes(sa, c, raw), MIN)):
                text, offset = sa.text[a : b + 1], sa.offset[a : b + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{bucket}:{part}:{n}"] * len(text)), pa.array([size] * len(text), pa.int64()), pa.array(c["id"][text], pa.int64()), pa.array(c["start"][text] + offset, pa.int64())],
                    names=["group", "size", "id", "start"],
                )


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(group, size, doc_id, start) of every occurrence of every maximal repeat of ``MIN`` bytes or more.

    Extents are those within an anchor's context, so a long repeat is a chain of
    groups; a row for each occurrence, also of settled copies.
    """
    plan = _Plan(docs, id_col, text_col)
    found = plan.contexts(plan.opened(settle=False)).mapInArrow(_group_rows, "group string, size long, id long, start long")
    return found.select("group", "size", F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "start")
