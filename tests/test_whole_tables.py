"""Queries over whole tables and texts against brute force, beside their SQL."""

import re
from collections import defaultdict

import pytest

from scrivener.operators import sequence
from scrivener.plans import catalog
from scrivener.plans.registry import table


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return lambda name: table(spark, sf_dir, name).collect()


def run(spark, sf_dir, name):
    return catalog.queries()[name](spark, sf_dir).collect()


def test_lexicon_words(spark, sf_dir, rows):
    lexicon = {w.lower() for r in rows("benchmark") for w in r.text.split(" ")}
    want = sorted((r.doc_id, w) for r in rows("documents") for w in r.text.split(" ") if w.lower() in lexicon)
    assert sorted(tuple(r) for r in run(spark, sf_dir, "o68_lexicon_words")) == want
    assert {i for i, _ in want} & {r.doc_id for r in rows("documents") if r.n_chars >= 300}


def test_set_of_words_and_interleaved(spark, sf_dir, rows):
    docs = {r.doc_id: r.text.split(" ") for r in rows("documents")}
    assert {r.doc_id: r.words for r in run(spark, sf_dir, "o132_set_of_words")} == {i: sorted(set(w), key=str.encode) for i, w in docs.items()}
    assert {r.doc_id: (r.words, r.tags) for r in run(spark, sf_dir, "o09_o95_interleaved")} == {i: (w[::2], w[1::2]) for i, w in docs.items()}


def test_pre_tag(spark, sf_dir, rows):
    def tagged(w):
        tag = sequence.ROLE_WORDS.get(w.lower()) or ("S-PER" if re.match("[A-Z]", w) else "O")
        return w if tag == "O" else f"{w} <{tag}>"

    want = {(r.conv_id, r.turn): " ".join(map(tagged, f"{r.text} Associate Editors in Chief of the Advisory Board".split(" "))) for r in rows("conversations")}
    assert {(r.conv_id, r.turn): r.line for r in run(spark, sf_dir, "o156_pre_tag")} == want


def test_organization_scores(spark, sf_dir, rows):
    sums = defaultdict(float)
    for r in rows("customer"):
        sums[r.c_nationkey] += float(r.c_acctbal) / 1000
    found = {r.id: r.pr_score for r in run(spark, sf_dir, "o89_organization_scores")}
    assert found == pytest.approx({r.n_nationkey: 0.15 + 0.85 * sums[r.n_nationkey] for r in rows("nation")}, abs=1e-6)
