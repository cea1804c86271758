"""op6 against a brute-force scan of every 100-byte string."""

import hashlib
import random

from scrivener.llm import queries, suffixes
from scrivener.llm.common import table


def brute(docs):
    seen, out = set(), []
    for i, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(raw)))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    return sorted(map(tuple, suffixes.digest_passages(suffixes.dedup_passages(df)).collect()), key=lambda r: (r[0] is not None, r))


def test_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert sorted(map(tuple, queries.op6_suffix_dedup(spark, sf_dir).collect())) == brute(docs)


def passages(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcde é", k=rng.choice([60, 99, 100, 101, 130, 300]))) for _ in range(12)]
    docs = []
    for i in range(80):
        parts = [rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choices("abcde ", k=rng.randrange(1, 200))) for _ in range(rng.randrange(1, 8))]
        if rng.random() < 0.2:
            parts.append(rng.choice("ab") * rng.randrange(90, 400))
        docs.append((rng.randrange(10**6), "".join(p[rng.randrange(30) :] if rng.random() < 0.3 else p for p in parts)))
    docs += [(2 * 10**6 + k, docs[3][1]) for k in range(20)]
    return docs


def test_overlaps_periods_and_copies(spark, make_docs, monkeypatch):
    for seed, chunk, hot in ((1, 1 << 20, 4096), (2, 3000, 4096), (3, 3000, 1), (4, 1 << 20, 2)):
        monkeypatch.setattr(suffixes, "HOT_CONTEXTS", hot)
        monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(suffixes, "STEP_BYTES", chunk // 3)
        monkeypatch.setattr(suffixes, "HASH_BUCKET_BYTES", 5000)
        docs = passages(seed)
        assert found(make_docs(docs).repartition(5)) == brute(docs)


def test_rows_of_one_id_or_none(spark, make_docs):
    """Many rows without an id, and one id on different texts: each row loses what an earlier row holds, and nothing else."""
    rng = random.Random(11)
    own = lambda n=160: "".join(rng.choices("abcdefgh ", k=n))
    shared = [own() for _ in range(5)]
    docs = [(None, own()) for _ in range(300)] + [(None, own(40) + rng.choice(shared) + own(40)) for _ in range(100)] + [(7, own() + rng.choice(shared)) for _ in range(30)] + [(8, shared[0]), (9, own())]
    df = make_docs(docs)
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(cast(text as binary)) h").collect()}
    least = -(1 << 63)
    named = sorted((least if i is None else i, hashes[t], t) for i, t in docs)
    want = sorted(r[1:] for r in brute([(k, t) for k, (_, _, t) in enumerate(named)]))
    assert sorted(r[1:] for r in found(df.repartition(3))) == want


def test_segments_of_a_long_text(monkeypatch):
    rng = random.Random(12)
    text = "".join(rng.choices("abcdefgh", k=5000)).encode()
    whole = suffixes.find_anchors([text, b"x" * 50, text[:700]])
    monkeypatch.setattr(suffixes, "SEGMENT", 900)
    cut = suffixes.find_anchors([text, b"x" * 50, text[:700]])

    def windows(a):
        return {(int(d), int(p) - int(lo) + k, int(h)) for d, p, h, lo, hi in zip(a["doc"], a["pos"], a["h"], a["lo"], a["hi"]) for k in range(int(lo) + int(hi) - 99)}

    assert windows(cut) == windows(whole) and len(cut["pos"]) > len(whole["pos"])


def test_awkward(spark, awkward, make_docs):
    out = found(awkward.where("doc_id is not null"))
    rows = {r[0]: r for r in out}
    assert len(out) == awkward.count() - 1 and rows[1][1] == 0 and rows[5][2] == 0
    assert rows[7][2] == 29999 and rows[7][3] == 1
    assert suffixes.dedup_passages(awkward).where("doc_id is null").count() == 1
    assert suffixes.dedup_passages(make_docs([(1, "x")]).where("false")).count() == 0


def test_repeat_groups_list_all_occurrences(spark, make_docs):
    rng = random.Random(3)
    own = lambda: "".join(rng.choices("abcdefgh", k=150))
    shared = own()[:120]
    docs = [(i, own() + shared + own()) for i in range(4)] + [(9, own())]
    groups = {}
    for r in suffixes.repeat_groups(make_docs(docs)).collect():
        groups.setdefault(r.group, []).append((r.size, r.doc_id, r.start))
    assert any({d for _, d, _ in g} == {0, 1, 2, 3} for g in groups.values())
    assert all(145 <= s and s + n <= 275 for g in groups.values() for n, _, s in g)


def test_suffix_array_scan():
    import numpy as np

    rng = random.Random(4)
    texts = ["".join(rng.choices("ab", k=60)).encode() for _ in range(30)]
    sa = suffixes.SuffixArray(texts, 8)
    order = [texts[t][o:] for t, o in zip(sa.text, sa.offset)]
    assert order == sorted(order)
    rank = sa.text * 100 + sa.offset
    left = np.array([texts[t][o - 1] if o else -1 for t, o in zip(sa.text, sa.offset)])
    got = sa.repeated(rank, left, 8)

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    # the bytes that maximal repeats take are those of all strings that occur before
    gone = [bytearray(60) for _ in texts]
    for t, o, n in zip(sa.text, sa.offset, got):
        gone[t][o : o + n] = b"\1" * n
    want = [bytearray(60) for _ in texts]
    for i in range(len(order)):
        best = max([common(order[i], order[j]) for j in range(len(order)) if rank[j] < rank[i]], default=0)
        if best >= 8:
            want[sa.text[i]][sa.offset[i] : sa.offset[i] + best] = b"\1" * best
            assert got[i] <= best
    assert gone == want
    groups = list(sa.maximal_repeats(left, 8))
    # a brute-force list: strings that no occurrence set can extend to the left or right (an end differs from all)
    places = {}
    for t, text in enumerate(texts):
        for o in range(53):
            for n in range(8, 61 - o):
                places.setdefault(text[o : o + n], []).append((t, o))
    maximal = set()
    for w, at in places.items():
        lefts = [texts[t][o - 1] if o else -1 - k for k, (t, o) in enumerate(at)]
        rights = [texts[t][o + len(w)] if o + len(w) < 60 else -1 - k for k, (t, o) in enumerate(at)]
        if len(at) > 1 and len(set(lefts)) > 1 and len(set(rights)) > 1:
            maximal.add((w, tuple(sorted(at))))
    assert {(order[a][:size], tuple(sorted((int(sa.text[k]), int(sa.offset[k])) for k in range(a, b + 1)))) for size, a, b in groups} == maximal
    for size, a, b in groups:
        assert len({x[:size] for x in order[a : b + 1]}) == 1 and (len(set(left[a : b + 1])) > 1 or -1 in left[a : b + 1])
