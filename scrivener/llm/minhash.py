"""Near-duplicate documents by one-permutation MinHash with optimal densification.

1. Python reads every text once: distinct 5-word shingle hashes, one-permutation
   signature of ``BINS`` bins (an empty bin takes the first filled bin of its own
   random order), ``BINS / ROWS`` band keys and a 128-bit hash of the whole set.
2. Equal sets become one class.  A class is a node of its own number, not an id:
   several rows may have one id, or none, and different texts.
3. Each band bucket links its members to its smallest class: a star, not all
   pairs.  Star edges are confirmed on full sets and joined to components.
4. A bucket whose members still lie in several components may hide a link that
   its star has not tried.  Members of such buckets form families (buckets that
   touch); families are cut into blocks, and a task decides every pair of
   different components that shares a bucket between two blocks: an upper bound
   of the common shingles first, then full sets.  Only links leave the task, and nothing is capped.

With ``ROWS`` = 4 and 32 bands a pair of similarity 0.75 shares no bucket with a
probability of (1 - 0.75^4)^32 = 5e-6, at 0.8 of 5e-8; shared buckets are
decided exactly.

Cases: null, empty and blank texts have the empty set and no links; a text with
fewer words has its whole sequence as one shingle; a null id is no candidate for
a component's name, so a component of null ids only has a null one; repeated rows are copies of
each other; rows of one id with different texts, null ids too, are classified row by row.
``keep_one`` keeps of each component the rows of its smallest id (null last) and
then smallest text hash, repeated rows included, and every row without words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import Scratch, materialize

WORDS = 5
BINS, ROWS = 128, 4
LAST = (1 << 63) - 1
LEAST_BLOCK, MOST_BLOCK, BLOCK_SHINGLES = 256, 2500, 4_000_000
FINE = 1024
GROUP = 400  # members that are confirmed against one copy of their centre's text
_U = np.uint64
_ORDER = np.random.default_rng(20240229).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)
_BAND = np.arange(1, BINS // ROWS + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Word to 64-bit hash, forgetting all when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(text: bytes, hashes: WordHashes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's ``size``-word shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, _U)
    seq = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, _U)
    for k in range(size):
        h *= _U(0x9FB21C651E98DF25)
        h += seq[k : k + n]
    return np.unique(mix(h))


def signature(sets: np.ndarray) -> np.ndarray:
    """One-permutation signature of a non-empty sorted set."""
    bins = (sets >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    out = np.zeros(BINS, _U)
    filled = np.zeros(BINS, bool)
    out[bins[first]] = sets[first]
    filled[bins[first]] = True
    if len(first) < BINS:
        empty = np.flatnonzero(~filled)
        order = _ORDER[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = _BAND.copy()
    for column in sig.reshape(-1, ROWS).T:
        h = mix(h * _U(0x9FB21C651E98DF25) + column)
    return h.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        sizes, s1, s2, bands = [], [], [], []
        for text in b.column("text"):
            found = shingles(text.as_py(), hashes)
            d = xxhash.xxh3_128_intdigest(found.tobytes())
            sizes.append(len(found))
            s1.append((d >> 64) - (1 << 63))
            s2.append((d & (1 << 64) - 1) - (1 << 63))
            bands.append(band_keys(signature(found)) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in _ROW), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            names=[*_ROW, "n", "s1", "s2", "bands"],
        )


def _confirm(percent: int):
    """Over rows sorted by (center, salt, member?): edges whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, group, centres = WordHashes(), None, []
        for b in batches:
            out = []
            for center, salt, node, is_member, text in zip(*(b.column(c).to_pylist() for c in ("center", "salt", "node", "is_member")), b.column("text")):
                if group != (center, salt):
                    group, centres = (center, salt), []
                found = shingles(text.as_py(), hashes)
                if not is_member:
                    centres.append(found)
                elif any(linked(found, c, percent) for c in centres):
                    out.append((center, node))
            a, m = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(m, pa.int64())], names=["a", "b"])

    return run


def confirm(edges: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of those ``edges`` (center, member) that are linked; ``nodes`` has (id, text).

    A centre's members are dealt to groups of about ``GROUP``, each with one
    copy of the centre's text.
    """
    degree = edges.groupBy("center").agg(F.ceil(F.count("*") / GROUP).alias("salts"))
    dealt = edges.join(degree, "center").select("center", "member", F.pmod(F.xxhash64("member"), "salts").alias("salt"))
    roles = dealt.select("center", "salt", F.col("member").alias("node"), F.lit(True).alias("is_member")).unionByName(
        degree.select("center", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("center").alias("node"), F.lit(False).alias("is_member"))
    )
    rows = roles.join(nodes.withColumnRenamed("id", "node"), "node").repartition("center", "salt").sortWithinPartitions("center", "salt", "is_member")
    return rows.select("center", "salt", "node", "is_member", "text").mapInArrow(_confirm(percent), "a long, b long")


def _open_links(percent: int):
    """Over rows sorted by (family, i, j): links between members of blocks i and j that star edges left apart.

    Every pair of different components that shares a band and passes the size
    bound is decided: at first by shingle counts in ``FINE`` ranges of hashes, whose
    smaller ones add up to the common shingles at least, then on full sets.
    """

    def decide(i: int, j: int, rows: list[tuple]) -> list[tuple[int, int]]:
        hashes, m = WordHashes(), len(rows)
        sets = [shingles(r[3], hashes) for r in rows]
        block = np.array([r[1] for r in rows])
        sizes = np.array([len(x) for x in sets])
        counts = np.array([np.bincount((x >> _U(64 - FINE.bit_length() + 1)).astype(np.int64), minlength=FINE) for x in sets]).astype(np.uint16 if sizes.max() < 1 << 16 else np.uint32)
        keys = np.array([band_keys(signature(x)) for x in sets])
        flat = np.argsort(keys.ravel(), kind="stable")
        first = np.r_[True, np.diff(keys.ravel()[flat]) != 0]
        run = np.empty(len(flat), np.int64)
        run[flat] = np.cumsum(first) - 1
        run = run.reshape(keys.shape)
        cuts = np.r_[np.flatnonzero(first), len(flat)]
        owner = flat // keys.shape[1]
        # components that this block pair has joined so far
        names = {name: k for k, name in enumerate(sorted({r[2] for r in rows}))}
        part = np.array([names[r[2]] for r in rows])
        out = []
        for a in range(m):
            near = np.unique(np.concatenate([owner[cuts[k] : cuts[k + 1]] for k in run[a]]))
            near = near[near > a]
            near = near[(part[near] != part[a]) & ((block[near] != block[a]) | (i == j))]
            near = near[100 * np.minimum(sizes[near], sizes[a]) >= percent * np.maximum(sizes[near], sizes[a])]
            most = np.concatenate([np.minimum(counts[near[k : k + 256]], counts[a]).sum(axis=1, dtype=np.int64) for k in range(0, len(near), 256)] or [near])
            near = near[100 * most >= percent * (sizes[near] + sizes[a] - most)]
            for b in near.tolist():
                if part[b] != part[a] and linked(sets[a], sets[b], percent):
                    out.append((rows[a][0], rows[b][0]))
                    part[part == part[b]] = part[a]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def flush() -> pa.RecordBatch:
            found = decide(group[1], group[2], rows) if rows else []
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for f, i, j, rep, block, label, text in zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j", "rep", "block", "label", "text"))):
                if (f, i, j) != group:
                    if rows:
                        yield flush()
                    group, rows = (f, i, j), []
                rows.append((rep, block, label, text))
        if rows:
            yield flush()

    return run


def confirm_families(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of links inside families of ``members`` (family, rep, n, label).

    A family is cut into blocks of about a 64th of it, ``LEAST_BLOCK`` to
    ``MOST_BLOCK`` members and at most ``BLOCK_SHINGLES`` shingles; a task takes
    one pair of blocks, so that no family has to fit one.
    """
    block_size = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.count("*") / 64))
    size = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / block_size, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    block = members.join(size, "family").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    other = block.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = other.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "block", "label")
    rows = dealt.join(nodes.withColumnRenamed("id", "rep"), "rep").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "rep")
    return rows.select("family", "i", "j", "rep", "block", "label", "text").mapInArrow(_open_links(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node reachable.

    Every round hooks each label to its smallest neighbour, follows the pointers
    to their end and contracts the edges; rounds grow with the logarithm of a chain.
    Tables of past rounds are deleted.
    """
    spark = edges.sparkSession
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels, links, names, jumps = None, Scratch(), Scratch(), Scratch()
    edges = links.write(edges.where("a <> b").distinct())
    while not edges.isEmpty():
        # an edge's smaller end first; hook every label to its smallest neighbour, if smaller
        hooks = jumps.write(both(edges).groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")))
        while True:
            ends = hooks.select(F.col("a").alias("to"), F.col("to").alias("next"))
            jumped = jumps.write(hooks.join(ends, "to").select("a", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved")))
            hooks = jumped.select("a", "to")
            jumps.drop(spark, keep=1)
            if jumped.where("moved").isEmpty():
                break
        step = hooks.select(F.col("a").alias("label"), F.col("to").alias("new"))
        named = hooks.select(F.col("a").alias("node"), F.col("to").alias("label")) if labels is None else labels.join(step, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
        labels = names.write(named)
        names.drop(spark, keep=1)
        ab = hooks.select("a", F.col("to").alias("x")), hooks.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = links.write(edges.join(ab[0], "a").join(ab[1], "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        links.drop(spark, keep=1)
        jumps.drop(spark)
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


_ROW = ("id", "t1", "t2")


def _keys(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """(id, t1, t2, text): two hashes of a text tell rows of one id, or of none, apart."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"), *more)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each node of the task; equal rows may leave others."""
    seen: set[int] = set()
    for b in batches:
        fresh = []
        for node in b.column("id").to_pylist():
            fresh.append(node not in seen)
            seen.add(node)
        yield b.filter(pa.array(fresh, pa.bool_()))


def _classified(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, t1, t2, n, s1, s2) of every row, and (s1, s2, label, low, first) of every set with words.

    ``label`` names the component, ``low`` is its smallest id and ``first`` its first row.
    """
    rows = _keys(docs, id_col, text_col)
    signed = materialize(rows.mapInArrow(_signatures, "id long, t1 long, t2 long, n long, s1 long, s2 long, bands array<long>"))
    order = F.struct(F.coalesce("id", F.lit(LAST)).alias("id"), F.col("t1"), F.col("t2"))
    merged = signed.where("n > 0").groupBy("s1", "s2").agg(F.min(order).alias("first"), F.min("id").alias("low"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # written once, so that the numbers stay
    classes = materialize(merged.withColumn("rep", F.monotonically_increasing_id()))

    # buckets of two classes or more, with their star's centre
    banded = classes.select(F.explode("bands").alias("key"), "rep", "n")
    stars = banded.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"), F.max("rep").alias("most")).where("most > c.rep").select("key", F.col("c.rep").alias("center"), F.col("c.n").alias("center_n"))
    buckets = materialize(banded.join(stars, "key").select("key", "rep", "n", "center", "center_n"))
    similar = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    tried = materialize(buckets.where((F.col("rep") != F.col("center")) & similar(F.col("n"), F.col("center_n"))).select("center", F.col("rep").alias("member")).distinct())

    # one text of each class that shares a bucket
    wanted = buckets.select("rep").distinct().join(classes.select("rep", "first.*"), "rep")
    sent = rows.withColumn("id", F.coalesce("id", F.lit(LAST))).join(wanted.hint("shuffle_hash"), ["id", "t1", "t2"]).select(F.col("rep").alias("id"), "text")
    nodes = materialize(sent.mapInArrow(_once, "id long, text binary"))
    links = materialize(confirm(tried, nodes, percent))
    labels = components(links)

    # members of buckets that still hold several components, by families of buckets that touch
    named = buckets.select("key", "rep", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("label", "rep").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("rep").alias("head")).where("low < high").select("key", "head")
    open_members = materialize(named.join(mixed, "key").select("head", "rep", "n", "label"))
    if not open_members.isEmpty():
        family = components(open_members.select(F.col("head").alias("a"), F.col("rep").alias("b")))
        members = open_members.groupBy("rep").agg(F.first("n").alias("n"), F.first("label").alias("label")).join(family.withColumnRenamed("node", "rep").withColumnRenamed("label", "family"), "rep")
        links = links.unionByName(materialize(confirm_families(members, nodes, percent)))
        labels = components(links)

    named = classes.select("s1", "s2", "rep", "low", "first").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    # most classes are their own component; the members of the others are summed a task at a time before they meet their head
    members = named.where("rep <> label").groupBy("label").agg(F.min("low").alias("m_low"), F.min("first").alias("m_first"))
    heads = named.where("rep = label").select("label", "low", "first")
    joint = heads.join(members, "label").select("label", F.least("low", "m_low").alias("least"), F.least("first", "m_first").alias("front"))
    found = named.join(joint, "label", "left").select("s1", "s2", "label", F.when(F.col("front").isNull(), F.col("low")).otherwise(F.col("least")).alias("low"), F.coalesce("front", "first").alias("first"))
    return signed.drop("bands"), found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    signed, classes = _classified(docs, id_col, text_col, percent)
    own = signed.join(classes, ["s1", "s2"], "left").withColumn("component", F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id")))
    return own.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Of each component the rows of its first document; the columns stay as they are."""
    signed, classes = _classified(docs, id_col, text_col, percent)
    row = F.struct(F.coalesce("id", F.lit(LAST)).alias("id"), F.col("t1"), F.col("t2"))
    lost = signed.where("n > 0").join(classes, ["s1", "s2"]).where(row != F.col("first")).select(*(F.col(f"{c}").alias(f"__{c}") for c in _ROW)).distinct()
    whole = _keys(docs, id_col, text_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")).drop("text")
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("t1") == F.col("__t1")) & (F.col("t2") == F.col("__t2"))
    return whole.join(lost.hint("shuffle_hash"), same, "left_anti").select(*(F.col("whole").getField(c).alias(c) for c in docs.columns))
