"""op2, op3, op7 and op9 against brute force, and their awkward cases."""

import hashlib
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers

from scrivener.llm import bpe, licenses, linededup, quality, queries
from scrivener.llm.common import table

AWKWARD_IDS = [None, 1, 2, 3, 4, 5, 5, 6, 7, 8]


def rows(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))


def docs_of(spark, sf_dir):
    return [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


def brute_lines(docs):
    where = defaultdict(set)
    key = lambda line: line.encode().strip().lower().decode()
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                where[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(where[key(x)]) >= 3 and i != max(where[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup_is_exact(spark, sf_dir):
    found = queries.op3_line_dedup(spark, sf_dir)
    assert sorted(map(tuple, found.collect())) == brute_lines(docs_of(spark, sf_dir))


def test_line_dedup_over_chunks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(linededup, "CHUNK_BYTES", 1)
    docs = [(i, f"own line number {i} of this document\n A line that everyone has, the same \nshort\n") for i in range(60)]
    docs += [(100 + i, "only two documents have this line") for i in range(2)]
    df = make_docs(docs).repartition(7)
    found = linededup.digest_lines(df, linededup.line_bitmaps(df))
    assert sorted(map(tuple, found.collect())) == brute_lines(docs)
    texts = {r.doc_id: r.text for r in linededup.drop_lines(df, linededup.line_bitmaps(df)).collect()}
    assert "everyone" in texts[59] and "everyone" not in texts[58] and texts[100].startswith("only two")


def test_a_common_line_is_streamed(monkeypatch):
    """Whatever the batches, the same rows go; of a run known to be common nothing is held."""
    import random

    import pyarrow as pa

    rng = random.Random(3)
    rows = []
    for h in range(40):
        ids = sorted((rng.randrange(6) for _ in range(rng.choice([1, 2, 3, 60]))), reverse=True)
        rows += [{"h1": h // 3, "h2": h, "id": i, "row": k, "n_lines": 1, "ge": rng.random() < 0.02, "at": [k]} for k, i in enumerate(ids)]
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("n_lines", pa.int32()), ("ge", pa.bool_()), ("at", pa.list_(pa.int32()))])
    want = []
    for h in range(40):
        mine = [r for r in rows if r["h2"] == h]
        if len({r["id"] for r in mine}) >= 3 or any(r["ge"] for r in mine):
            want += [(r["id"], r["row"]) for r in mine if r["id"] != mine[0]["id"]]
    for size in (1, 2, 7, 50, 10_000):
        batches = [pa.RecordBatch.from_pylist(rows[k : k + size], schema) for k in range(0, len(rows), size)]
        assert [(r["id"], r["row"]) for b in linededup._stream(3)(iter(batches)) for r in b.to_pylist()] == want


def test_line_dedup_awkward(spark, awkward, make_docs):
    out = rows(linededup.digest_lines(awkward, linededup.line_bitmaps(awkward)))
    assert [r.doc_id for r in out] == AWKWARD_IDS
    assert out[1].n_lines == 1 and out[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    dropped = linededup.drop_lines(awkward, linededup.line_bitmaps(awkward))
    assert dropped.schema == awkward.schema and dropped.where("doc_id = 1").first().text is None
    empty = make_docs([(1, "x")]).where("false")
    assert linededup.digest_lines(empty, linededup.line_bitmaps(empty)).count() == 0


def test_bpe_equals_the_library(spark, sf_dir, awkward, make_docs):
    path = queries.tokenizer_path()
    lib = tokenizers.Tokenizer.from_file(path)
    odd = ["a<|endoftext|>b  <|startoftext|>", "ΑΣ ẞ\x1cabc\x1d d", "x'll don't 12,3 ½", "a" * 3000, "aé" * 2000 + "!", "\U00010d50 Ɤx Ᲊ"]
    pairs = [*docs_of(spark, sf_dir), *enumerate(odd, 10**6)]
    given = dict(pairs)
    for r in bpe.encode_documents(make_docs(pairs), path).collect():
        want = lib.encode(given[r.doc_id], add_special_tokens=False)
        assert r.ids == want.ids and r.n_tokens == len(want.ids)
        assert r.decoded == lib.decode(want.ids, skip_special_tokens=False)
    long_ids = lib.encode("very long " * 20000, add_special_tokens=False).ids
    assert bpe.encode_documents(awkward, path).where("doc_id = 6").first().ids == long_ids
    assert [r.doc_id for r in rows(bpe.digest_documents(awkward, path))] == AWKWARD_IDS


def test_bpe_refuses_files_of_another_kind():
    import json

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    bpe.check_sections(spec)
    for changed in ({"normalizer": None}, {"decoder": {"type": "BPEDecoder", "suffix": "</w>"}}, {"model": spec["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError):
            bpe.check_sections(spec | changed)


def test_bpe_long_words_merge_alike():
    w = bpe.WordBpe(queries.tokenizer_path())
    for word in (b"internationalization" * 9, b"ab" * 100, bytes(range(256)) * 2):
        parts = [w.first[b] for b in word[:-1]] + [w.last[word[-1]]]
        assert w._merge_short(list(parts)) == w._merge_long(list(parts))


def test_license_scans(spark, sf_dir, awkward):
    found = {r.doc_id: r for r in queries.op2_license_scans(spark, sf_dir).collect()}
    for i, text in docs_of(spark, sf_dir):
        words = text.encode().lower().translate(licenses.BLANKS).split()
        hits = [(at, label) for at in range(len(words)) for phrase, label in licenses.BASE_PHRASES.items() if words[at : at + len(phrase.split())] == phrase.encode().split()]
        r = found[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert [r.doc_id for r in rows(licenses.scan_licenses(awkward))] == AWKWARD_IDS


@pytest.mark.parametrize(
    "text, labels, allowed",
    [
        (b"mit or gpl-2.0", ["mit", "gpl-2.0"], True),
        (b"mit and gpl-2.0", ["mit", "gpl-2.0"], False),
        (b"mit or gpl-2.0 and gpl-3.0", ["mit", "gpl-2.0", "gpl-3.0"], True),
        (b"(mit or gpl-2.0) and gpl-3.0", ["mit", "gpl-2.0", "gpl-3.0"], False),
        (b"gpl-2.0 with classpath-exception-2.0 or mit", ["gpl-2.0", "mit"], True),
        (b"mit or (apache-2.0", ["mit"], True),
        (b"", [], None),
        (b"mit or the best licence there is", ["mit"], True),
        (b"the mit license", [], None),
        (b"((mit)) and (bsd-3-clause or gpl-2.0) or )", ["mit", "bsd-3-clause", "gpl-2.0"], True),
        (b"(((mit", [], None),
        (b"gpl-2.0 with llvm-exception and mit with mit or zlib", ["gpl-2.0", "mit", "zlib"], False),
        (b"mit mit", ["mit"], True),
        (b"or mit", [], None),
        (b"licenseref-own-terms */", ["licenseref-own-terms"], False),
    ],
)
def test_license_expressions(text, labels, allowed):
    assert licenses.parse_expression(text) == (labels, allowed)


def test_license_expressions_of_any_length():
    began = time.monotonic()
    for n in (1, 50_000):
        assert licenses.parse_expression(b"(" + b"mit or " * n) == ([], None)
        labels, allowed = licenses.parse_expression(b"gpl-2.0 and " * n + b"mit or the")
        assert labels == ["gpl-2.0"] * n + ["mit"] and allowed is False
        assert licenses.parse_expression(b"(" * n + b"mit" + b")" * n) == (["mit"], True)
    assert time.monotonic() - began < 10


def test_license_scan_of_tags_and_notices():
    scan = licenses.LicenseScanner().scan
    tagged = scan(b"# SPDX-License-Identifier: Apache-2.0 OR (MIT AND the rest)\nx = 1\n// SPDX-License-Identifier:\tGPL-2.0-only WITH Classpath-exception-2.0 */")
    assert (tagged["labels"], tagged["base_labels"], tagged["n_tags"], tagged["allowed"]) == ("apache-2.0,gpl-2.0-only", "", 2, False)
    assert tagged["score"] == pytest.approx(0.9) and tagged["first_word"] is None
    notice = scan(b"The MIT License.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this")
    assert (notice["labels"], notice["base_labels"], notice["n_base"], notice["first_word"], notice["allowed"]) == ("mit", "mit", 1, 1, None)
    assert notice["score"] == pytest.approx(1 - 0.3 * 0.5)
    many = scan(b"CC BY NC and CC-BY 4.0; GNU Lesser General Public License. All rights reserved")
    assert many["labels"] == "cc-by,cc-by-nc,lgpl,proprietary" and (many["n_base"], many["first_word"], many["last_word"]) == (2, 0, 4)
    nothing = scan(b"SPDX License Identifier of nothing: see the file")
    assert (nothing["labels"], nothing["n_tags"], nothing["score"]) == ("", 0, 0.0)


def brute_repeats(words):
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_quality_counts_and_verdict(spark, sf_dir):
    found = {r.doc_id: r for r in queries.op9_quality_rules(spark, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    right = []
    for i, text in docs_of(spark, sf_dir):
        words, r = text.encode().split(), found[i]
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert r.n_words == len(words) and r.word_chars == len(b"".join(words).decode())
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == brute_repeats(words)
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words))
        assert not (r.base_failed and r.kept)
        if i in labels and not r.base_failed:
            right.append(r.kept == bool(labels[i]))
    assert sum(right) >= 0.97 * len(right)


def test_quality_on_labels_outside_the_fit(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    crf = quality.fit_crf(docs, labels.where("doc_id % 2 = 0"))
    found = quality.quality_rules(docs, crf).join(labels.where("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").where("not base_failed").collect()
    right = [r.kept == bool(r.quality) for r in found]
    assert len(right) > 30 and len({r.quality for r in found}) == 2 and sum(right) >= 0.95 * len(right)


def test_quality_awkward(spark, sf_dir, awkward, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    crf = quality.fit_crf(awkward, none)
    assert [r.doc_id for r in rows(quality.quality_rules(awkward, crf))] == AWKWARD_IDS
    odd = spark.createDataFrame([(1, 1), (1, None), (999, 0), (None, 1), (5, 0), (5, 0)], "doc_id long, quality int")
    kept = quality.filter_documents(awkward, quality.fit_crf(awkward, odd))
    assert kept.schema == awkward.schema and kept.where("doc_id in (1, 2, 3, 4)").count() == 0
    assert quality.quality_rules(awkward.where("false"), crf).count() == 0


def test_training_reads_lines_behind_the_sixtieth(spark, make_docs, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality.LineCrf, "fit", classmethod(lambda cls, chains: fitted.extend(chains) or cls.prior()))
    prose = "".join(f"The plain line number {'x' * k} ends here.\n" for k in range(1, 91))
    boilerplate = "".join(f"Home | About | Contact | {'y' * k} ***\n" for k in range(1, 41))
    quality.fit_crf(make_docs([(1, prose), (2, prose + boilerplate)]), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert [(len(x), y) for x, y in fitted] == [(90, 1), (130, 0)]
    want = quality.line_features(quality.count((prose + boilerplate).encode())[1])[0]
    assert np.allclose(fitted[1][0], want)


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    crf = quality.LineCrf(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=(2, 2)) * 2)
    for n in (1, 2, 5, 7):
        x = rng.normal(size=(n, len(quality.FEATURES)))
        u = x @ crf.unary
        value = lambda path: sum(u[i, y] for i, y in enumerate(path)) + sum(crf.pair[a, b] for a, b in zip(path, path[1:]))
        assert value(crf.viterbi(x)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=n))))
