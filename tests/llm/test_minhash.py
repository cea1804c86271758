"""op1 against all pairs, and its awkward cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from scrivener.llm import minhash, queries
from scrivener.llm.common import table


def brute(docs, percent=75):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(docs))


def test_equals_all_pairs(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert sorted(map(tuple, queries.op1_minhash(spark, sf_dir).collect())) == brute(docs)


def test_chains_stars_and_mixed_buckets(spark, make_docs):
    """Chains whose ends are unlike, families that share 60 to 75 %, thousands of copies in small."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    docs, base = [], [word() for _ in range(120)]
    for i in range(40):  # a chain: each step replaces four neighbouring words
        at = 3 * i % 116
        base[at : at + 4] = [word() for _ in range(4)]
        docs.append(" ".join(base))
    for _ in range(6):  # families around one template
        template = base[:90] + [word() for _ in range(20)]
        for _ in range(8):
            t = list(template)
            t[rng.randrange(100)] = word()
            docs.append(" ".join(t))
    docs += [docs[0]] * 50 + ["a b c", "A  b c", "a b", "a b c d e f g h", "a b c d e f g h i"]
    rng.shuffle(docs)
    pairs = list(enumerate(docs))
    found = sorted(map(tuple, minhash.near_duplicates(make_docs(pairs)).collect()))
    assert found == brute(pairs)


def test_awkward(spark, awkward, make_docs):
    out = minhash.near_duplicates(awkward).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == awkward.count() and by_id[1].n_shingles == 0 and by_id[1].component_id == 1 and by_id[2].kept
    assert by_id[None].component_id is None and by_id[5].kept and by_id[6].n_shingles == 2
    kept = minhash.keep_one(awkward)
    assert kept.schema == awkward.schema and kept.count() == awkward.count()
    assert minhash.near_duplicates(make_docs([(1, "x")]).where("false")).count() == 0
    none = minhash.keep_one(make_docs([(3, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")]))
    assert [r.doc_id for r in none.collect()] == [2]


def test_rows_of_one_id_or_none_are_told_apart(spark, make_docs):
    """Null and repeated ids with different texts: each row is a document."""
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    near = lambda t: t + " more"
    pairs = [(7, a), (None, near(a)), (9, b), (None, near(b)), (4, c), (4, d), (3, near(c)), (None, text()), (None, "A row"), (None, "a row"), (11, ""), (None, None), (9, b)]
    found = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(make_docs(pairs)).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = [(7, 7, True), (None, 7, False), (9, 9, True), (None, 9, False), (4, 3, False), (4, 4, True), (3, 3, True), (None, None, True), (None, None, True), (None, None, True), (11, 11, True), (None, None, True), (9, 9, True)]
    assert sorted(found, key=key) == sorted(want, key=key)
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(make_docs(pairs)).collect()]
    rest = sorted(((i, t) for i, t in kept if t not in ("A row", "a row")), key=repr)
    assert rest == sorted([(7, a), (9, b), (9, b), (4, d), (3, near(c)), (None, pairs[7][1]), (11, ""), (None, None)], key=repr)
    assert len(kept) == len(rest) + 1


def test_densified_signatures_agree_like_the_sets():
    hashes = minhash.WordHashes()
    rng = random.Random(2)
    for n in (8, 40, 400):
        shares, agree = [], []
        for _ in range(40):
            a = [str(rng.random()) for _ in range(n)]
            b = a[: int(n * 0.9)] + [str(rng.random()) for _ in range(n - int(n * 0.9))]
            x, y = (minhash.shingles(" ".join(t).encode(), hashes) for t in (a, b))
            shares.append(len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
            agree.append((minhash.signature(x) == minhash.signature(y)).mean())
        assert np.mean(agree) == pytest.approx(np.mean(shares), abs=0.08)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (300, 300)]
    found = {r.node: r.label for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}


def test_families_are_decided_on_full_sets_whatever_the_signatures():
    rng, hashes = random.Random(12), minhash.WordHashes()
    words = [f"w{rng.getrandbits(40)}" for _ in range(4000)]
    place = {int(minhash.shingles(" ".join(words[i : i + 5]).encode(), hashes)[0]): i for i in range(len(words) - 4)}
    first = minhash.shingles(" ".join(words).encode(), hashes)
    other = list(words)
    for value in minhash.signature(first)[:75].tolist():  # the least shingle of 75 bins
        other[place[value] + 2] = f"v{rng.getrandbits(40)}"
    second = minhash.shingles(" ".join(other).encode(), hashes)
    signs = minhash.signature(first), minhash.signature(second)
    assert minhash.linked(first, second, 75) and (signs[0] == signs[1]).sum() < 72 and (minhash.band_keys(signs[0]) == minhash.band_keys(signs[1])).any()
    rows = pa.RecordBatch.from_pylist([{"family": 0, "i": 0, "j": 0, "rep": k, "block": 0, "label": k, "text": " ".join(w).encode()} for k, w in ((1, words), (2, other))])
    assert [r for b in minhash._open_links(75)(iter([rows])) for r in b.to_pylist()] == [{"a": 1, "b": 2}]
