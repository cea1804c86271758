"""op4: counts and base score by brute force, the network by its properties."""

import math
from collections import Counter

import numpy as np
import pytest

from scrivener.llm import lmscore, queries
from scrivener.llm.common import table


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_base_counts_and_better_score(spark, sf_dir):
    docs = {r.doc_id: tokens(r.text) for r in table(spark, sf_dir, "documents").collect()}
    counts = Counter(t for i, ts in docs.items() if not lmscore.held_out(i) for t in ts)
    total, types = sum(counts.values()), len(counts)
    better = []
    for r in queries.op4_lm_scoring(spark, sf_dir).collect():
        ts = docs[r.doc_id]
        assert (r.n_tokens, r.train_tokens, r.held_out) == (len(ts), total, lmscore.held_out(r.doc_id))
        assert r.n_known == sum(counts[t] > 0 for t in ts)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (types + 1))) for t in ts), rel=1e-9)
        if r.held_out:
            better.append(r.score - r.base_score)
    assert sum(better) > 0 and len(better) > 20


def network(seed=1):
    rng = np.random.default_rng(seed)
    net = lmscore.Network.new(rng.integers(1, 99, 1000) + 0.5, np.where(np.arange(32) < 7, 50.0, 0.0))
    for k, v in net.p.items():
        if k[0] != "b":
            v += rng.normal(0, 0.3, v.shape).astype(np.float32)
    return net


def stepped(net, h, symbols):
    out = np.empty_like(h)
    net.step(h, net.shares(symbols), out)
    return out


def test_probabilities_sum_to_one():
    net, h = network(), np.random.default_rng(2).normal(size=(lmscore.HIDDEN, 1)).astype(np.float32)
    every = np.arange(lmscore.SYMBOLS)
    assert np.exp(net.log_probs(np.repeat(h, len(every), 1), every)).sum() == pytest.approx(1, abs=1e-3)


def test_state_is_carried_to_the_end_and_lanes_do_not_matter():
    net, rng = network(), np.random.default_rng(3)
    docs = [rng.integers(0, 1000, n) for n in (1, 2, 63, 64, 65, 500, 1, 130)]
    want = []
    for d in docs:
        h, total = np.zeros((lmscore.HIDDEN, 1), np.float32), 0.0
        for before, now in zip([d[-1], *d[:-1]], d):
            h = stepped(net, h, np.array([before]))
            total += float(net.log_probs(h, np.array([now]))[0])
        want.append(total)
    for lanes in (1, 3, 100):
        assert lmscore.score(net, docs, lanes, steps=16) == pytest.approx(want, rel=1e-3)


def test_gradients():
    net, rng = network(), np.random.default_rng(4)
    net = lmscore.Network({k: v.astype(np.float64) for k, v in net.p.items()})
    seq = rng.integers(0, 1000, (3, 6))
    g, _ = net.gradients(np.zeros((3, lmscore.HIDDEN)), seq[:, :5], seq[:, 1:], np.ones((3, 5), bool))
    g = {k: v.copy() for k, v in g.items()}

    def loss():
        h, total = np.zeros((lmscore.HIDDEN, 3)), 0.0
        for t in range(5):
            h = stepped(net, h, seq[:, t])
            total -= net.log_probs(h, seq[:, t + 1]).sum()
        return total / 15

    for k, v in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        kept = v[at]
        v[at] = kept + 1e-5
        up = loss()
        v[at] = kept - 1e-5
        down = loss()
        v[at] = kept
        assert g[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3)


def test_training_reads_every_symbol_with_the_state_of_its_document():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 1000, n) for n in (1, 15, 16, 17, 300, 2, 1000, 33)]
    net = network()
    seen, real = [], net.gradients

    def watched(before, symbols, targets, mask):
        g, after = real(before, symbols, targets, mask)
        seen.extend((b.copy(), s[m], t[m], a.copy()) for b, s, t, m, a in zip(before, symbols, targets, mask, after))
        return g, after

    net.gradients = watched
    assert lmscore.train(net, iter(docs), lanes=3) == sum(map(len, docs))
    left = Counter(t for _, _, targets, _ in seen for t in targets.tolist())
    assert left == Counter(t for d in docs for t in d.tolist())
    for d in docs:
        full, state = np.concatenate([d[-1:], d]), np.zeros(lmscore.HIDDEN, np.float32)
        for a in range(0, len(d), lmscore.STEPS):
            fits = [w for w in seen if np.array_equal(w[2], d[a : a + lmscore.STEPS]) and np.array_equal(w[1], full[a : a + len(w[2])]) and np.array_equal(w[0], state)]
            assert fits
            state = fits[0][3]


def test_head_grows_with_the_corpus():
    assert lmscore.head_size(0) == lmscore.head_size(10**7) == lmscore.HEAD
    sizes = [lmscore.head_size(10**k) for k in (8, 9, 10, 11)]
    assert sizes == sorted(set(sizes)) and all(lmscore.class_starts(n)[-1] == n for n in sizes)
    size = lmscore.head_size(10**9)
    net = lmscore.Network.new(np.arange(size, 0, -1) + 0.5, np.ones(lmscore.BANDS), size=size)
    again = lmscore.Network.unpack(net.pack(), size)
    assert all(np.array_equal(again.p[k], v) for k, v in net.p.items())
    h, every = np.zeros((lmscore.HIDDEN, 1), np.float32), np.arange(size + lmscore.BANDS)
    assert np.exp(again.log_probs(np.repeat(h, len(every), 1), every)).sum() == pytest.approx(1, abs=1e-3)


def test_splits_and_chunks_do_not_matter(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lmscore, "WORKER_TOKENS", 20_000)  # several workers a round
    docs = table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    first, *others = (
        {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in lmscore.score_documents(docs.repartition(n), chunk_bytes=size).collect()} for n, size in ((1, 1 << 24), (3, 1 << 18), (8, 1 << 16))
    )
    for other in others:
        assert set(other) == set(first)
        assert all(other[i] == pytest.approx(first[i], rel=1e-6) for i in first)


def test_token_rows_are_linear_in_the_chunks(spark, sf_dir):
    """Rows of the exchange: the distinct tokens of every chunk, whatever the number of chunks."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id id", "cast(text as binary) text")
    rows = lambda n: docs.mapInArrow(lmscore._chunks(n), lmscore._CHUNK).groupBy("b").agg({"h": "approx_count_distinct", "*": "count"}).collect()
    for size in (1 << 24, 1 << 14):
        found = rows(size)
        texts = docs.count()
        assert sum(r["count(1)"] for r in found) <= sum(len(set(tokens(r.text.decode()))) for r in docs.collect()) + len(found) and len(found) <= texts


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(lmscore, "SEGMENT_BYTES", 7)
    text = b"One two  three\nfour" + b"x" * 40 + b"\tfive \x0bsix "
    assert [w for words in lmscore.word_lists(text) for w in words] == text.lower().split()
    assert list(lmscore.word_lists(b"")) == []


def test_awkward(spark, awkward, make_docs):
    out = {r.doc_id: r for r in lmscore.score_documents(awkward).collect()}
    assert len(out) == 9 and lmscore.score_documents(awkward).count() == awkward.count()
    assert out[1].n_tokens == 1 and out[6].n_tokens == 40001 and math.isfinite(out[6].score) and not out[None].held_out
    assert lmscore.score_documents(awkward.where("false")).count() == 0
    untrained = make_docs([(i, "a b") for i in range(100) if lmscore.held_out(i)])
    r = lmscore.score_documents(untrained).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.base_score == pytest.approx(0) and r.score == pytest.approx(0, abs=1e-3)
