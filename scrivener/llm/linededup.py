"""Line dedup by range-partitioned hashes and per-document keep bitmaps.

A line's key is the line stripped of ASCII blanks, A-Z lower-cased.  Keys of at
least ``min_chars`` code points found in at least ``min_docs`` documents lose
all their lines except in the largest id that holds them.

1. Python reads texts once and emits a row for each (document, key): hash,
   id, line positions.  Within a chunk of texts a key held by ``min_docs`` or
   more documents is settled for all but the chunk's largest id, so that a
   frequent line sends at most ``min_docs`` rows a chunk to its range.
2. The open rows are range-partitioned by hash and sorted by (hash, id
   descending, row); a stream over the sorted rows keeps the first id of every
   hash and marks the others.
3. Marks are gathered to one zlib-compressed keep bitmap for each document
   that loses a line; text never travels with them.

Cases: a null or empty text is one empty line; a null id is one document below
all others; rows with the same id are one document, each row keeping its own
bitmap by a hash of its text; without documents there are no bitmaps.  Extra
columns pass through ``drop_lines`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import materialize, shuffle_parts

NO_ID = -(1 << 63)
CHUNK_BYTES = 16 << 20
_KEYED = "h1 long, h2 long, id long, row long, n_lines int, ge boolean, at array<int>"


def line_keys(text: bytes, min_chars: int) -> tuple[dict[bytes, list[int]], int]:
    """(positions by key of every long enough key, number of lines)."""
    lines = text.split(b"\n")
    keys: dict[bytes, list[int]] = {}
    for at, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip().lower()
            size = len(key)
            if size >= 4 * min_chars or size >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars:
                keys.setdefault(key, []).append(at)
    return keys, len(lines)


def _keyed(min_chars: int, min_docs: int, chunk_bytes: int):
    def flush(chunk: dict[bytes, list[tuple]]) -> pa.RecordBatch:
        rows = []
        for digest, found in chunk.items():
            h1, h2 = np.frombuffer(digest, ">i8").tolist()
            ids = {r[0] for r in found}
            most = max(ids) if len(ids) >= min_docs else None
            for i, row, n, at in found:
                if most is None:
                    rows.append((h1, h2, i, row, n, False, at))
                elif i == most:
                    rows.append((h1, h2, i, row, n, True, at))
                else:  # settled: another id of the chunk is larger
                    rows.append((None, None, i, row, n, True, at))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int32())]
        columns = list(zip(*rows)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["h1", "h2", "id", "row", "n_lines", "ge", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: dict[bytes, list[tuple]] = {}
        size = 0
        for b in batches:
            for i, row, text in zip(b.column("id").to_pylist(), b.column("row").to_pylist(), b.column("text")):
                text = text.as_py()
                keys, n = line_keys(text, min_chars)
                for key, at in keys.items():
                    chunk.setdefault(xxhash.xxh3_128_digest(key), []).append((i, row, n, at))
                size += len(text)
                if size >= chunk_bytes:
                    yield flush(chunk)
                    chunk, size = {}, 0
        yield flush(chunk)

    return run


def _stream(min_docs: int):
    """Over rows sorted by (h1, h2, id descending): the rows that lose their lines."""

    def decide(t: pa.Table) -> pa.Table:
        h1, h2, ids, ge = (t.column(c).to_numpy() for c in ("h1", "h2", "id", "ge"))
        first = np.ones(len(h1), bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts = np.flatnonzero(first)
        other = first.copy()
        other[1:] |= ids[1:] != ids[:-1]
        common = (np.add.reduceat(other.astype(np.int64), starts) >= min_docs) | np.logical_or.reduceat(ge, starts)
        run_of = np.cumsum(first) - 1
        return t.filter(pa.array(common[run_of] & (ids != ids[starts][run_of])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ["id", "row", "n_lines", "at"]
        carry: pa.Table | None = None  # the last run of hashes, still of too few documents
        known: tuple[int, int, int] | None = None  # or its hash and largest id, once it is common
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if carry is None else pa.concat_tables([carry, t])
            if t.num_rows and known:
                h1, h2, ids = (t.column(c).to_numpy() for c in ("h1", "h2", "id"))
                same = (h1 == known[0]) & (h2 == known[1])
                n = len(same) if same.all() else int(same.argmin())
                yield from t.slice(0, n).filter(pa.array(ids[:n] != known[2])).select(out).to_batches()
                t = t.slice(n)
            if not t.num_rows:
                continue
            carry = known = None
            h1, h2, ids = (t.column(c).to_numpy() for c in ("h1", "h2", "id"))
            same = (h1 == h1[-1]) & (h2 == h2[-1])
            at = len(h1) - (len(h1) if same.all() else int(np.argmin(same[::-1])))
            if at:
                yield from decide(t.slice(0, at)).select(out).to_batches()
            last, mine = t.slice(at), ids[at:]
            if len(np.unique(mine)) >= min_docs or last.column("ge").to_numpy().any():
                yield from last.filter(pa.array(mine != mine[0])).select(out).to_batches()
                known = int(h1[-1]), int(h2[-1]), int(mine[0])
            else:
                carry = last
        # a run of too few documents loses nothing

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dropped, maps = [], []
        for n, ats in zip(b.column("n_lines").to_pylist(), b.column("ats").to_pylist()):
            keep = np.ones(n, bool)
            keep[[i for at in ats for i in at]] = False
            dropped.append(n - int(keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), b.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], names=["id", "row", "n_lines", "n_dropped", "keep"])


def _rows(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"), *more)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(id, row, n_lines, n_dropped, keep) of the documents that lose lines.

    ``id`` is the id with ``NO_ID`` for null, ``row`` xxhash64 of the text,
    ``keep`` a zlib-compressed bitmap of kept lines, first line highest bit.
    """
    keyed = materialize(_rows(docs, id_col, text_col).mapInArrow(_keyed(min_chars, min_docs, CHUNK_BYTES), _KEYED))
    parts = shuffle_parts(docs.sparkSession)
    ranged = keyed.where("h1 is not null").repartitionByRange(parts, "h1", "h2").sortWithinPartitions("h1", "h2", F.desc("id"), "row")
    lost = "id long, row long, n_lines int, at array<int>"
    marks = ranged.mapInArrow(_stream(min_docs), lost).unionByName(keyed.where("h1 is null").select("id", "row", "n_lines", "at"))
    gathered = marks.groupBy("id", "row", "n_lines").agg(F.collect_list("at").alias("ats"))
    return gathered.mapInArrow(_bitmaps, "id long, row long, n_lines int, n_dropped long, keep binary")


def kept_lines(text: bytes, keep: bytes | None) -> tuple[list[bytes], int]:
    """(kept lines, number of lines)."""
    lines = text.split(b"\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).tolist()
    return [x for x, k in zip(lines, bits) if k], len(lines)


def _joined(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    # no sort of texts: the bitmaps, a few bytes a document, are the hashed side of every partition
    return _rows(docs, id_col, text_col, *more).join(bitmaps.select("id", "row", "keep").hint("shuffle_hash"), ["id", "row"], "left")


def digest_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, keep in zip(b.column("text"), b.column("keep")):
                kept, n = kept_lines(text.as_py(), keep.as_py())
                out.append((n, n - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
            n, dropped, sha = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    joined = _joined(docs, bitmaps, id_col, text_col, F.col(id_col).cast("long").alias("doc_id")).select("doc_id", "text", "keep")
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept lines as text, all columns, types and null texts as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, keep in zip(b.column("text"), b.column("keep")):
                out.append(None if keep.as_py() is None else b"\n".join(kept_lines(text.as_py(), keep.as_py())[0]))
            yield pa.RecordBatch.from_arrays([b.column("whole"), pa.array(out, pa.binary())], names=["whole", "changed"])

    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    joined = _joined(docs, bitmaps, id_col, text_col, rest).select("whole", "text", "keep")
    schema = joined.select("whole", F.col("keep").alias("changed")).schema  # nullable: null where nothing is lost
    out = joined.mapInArrow(run, schema)
    field = lambda c: F.coalesce(F.col("changed").cast("string"), F.col("whole")[c]) if c == text_col else F.col("whole")[c]
    return out.select(*(field(c).alias(c) for c in docs.columns))
