"""op10 against a brute-force search, and the pipeline stage by stage."""

import random
import unicodedata

import numpy as np

import corpus_pipeline
from scrivener.llm import bpe, decontam, linededup, minhash, queries, quality
from scrivener.llm.common import table


def distance(pattern, text):
    """Least edit distance of the pattern to any substring, by the plain recurrence."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, t in enumerate(text, 1):
            new[j] = min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1)
        row = new
    return int(row.min())


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(1, len(out) - 1)
        rng.choice([lambda: out.pop(k), lambda: out.insert(k, "q"), lambda: out.__setitem__(k, "z")])()
    return "".join(out)


def test_finds_every_item_within_its_budget(spark, make_docs):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(60)]
    passage = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, passage(rng.randrange(5, 14))) for k in range(12)] + [(99, "too short"), (100, None), (101, "")]
    docs = []
    for i in range(60):
        k = rng.randrange(12)
        held = edited(rng, items[k][1], rng.randrange(0, 9))
        docs.append((i, passage(8) + (" " + held.upper() + ". " if i % 2 else " ") + passage(8)))
    found = {(r.doc_id, r.item_id): r.distance for r in decontam.contaminated(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"), error_rate=0.08).collect()}
    want = {}
    for i, text in docs:
        hay = decontam.normal(text.encode())
        for k, item in items[:12]:
            p = decontam.normal(item.encode())
            d = distance(p, hay)
            if d <= int(len(p) * 0.08):
                want[i, k] = d
    assert found == want and len({d for d in want.values()}) > 1
    few = decontam.contaminated(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"), error_rate=0.08, block_bytes=100)
    assert {(r.doc_id, r.item_id): r.distance for r in few.collect()} == want


def test_query_finds_accented_capitals_short_items_and_a_tenth_of_edits(spark, tmp_path):
    rng = random.Random(8)
    accented = "élève où çà naïve être à côté forêt"
    plain = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(17))[:100]
    several = plain
    for k in range(9):  # 9 of 100 characters
        several = several[: 11 * k + 5] + "z" + several[11 * k + 6 :]
    spark.createDataFrame([(1, accented), (2, plain), (3, "Dunkle Öfen"), (4, "?!")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"avant {accented.upper()} après"), (2, f"so {several} on"), (3, "die dunkle öfen. x"), (4, "verdunkle öfenrohr"), (5, unicodedata.normalize("NFD", accented))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {tuple(r) for r in queries.op10_decontamination(spark, str(tmp_path)).select("doc_id", "item_id", "distance").collect()}
    assert found == {(1, 1, 0), (2, 2, 9), (3, 3, 0), (5, 1, 0)}
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()] == [4]


def test_search_equals_brute_force_at_high_rates():
    rng = random.Random(9)
    for n in range(150):
        p = "".join(rng.choices("abé ", k=rng.randrange(20, 90)))
        p = decontam.normal(p.encode())
        rate = rng.choice([0.05, 0.1, 0.2, 0.3])
        text = "".join(rng.choices("abé ", k=20)) + edited(rng, p, rng.randrange(0, int(len(p) * rate) + 3)) + "".join(rng.choices("abé ", k=20))
        d = distance(p, decontam.normal(text.encode()))
        want = [(1, d)] if d <= int(len(p) * rate) else []
        assert decontam.Searcher([(1, p.encode())], rate, 1).search(text.encode()) == want


def test_myers_equals_the_recurrence():
    rng = random.Random(7)
    for _ in range(60):
        p, t = ("".join(rng.choices("abc", k=rng.randrange(1, n))) for n in (90, 120))
        assert decontam.Myers(p).distance(t) == distance(p, t)


def test_awkward(spark, awkward, make_docs):
    items = spark.createDataFrame([(1, "very long very long very long"), (2, None), (1, "very long very long very long")], "item_id long, text string")
    assert [tuple(r) for r in decontam.contaminated(awkward, items).collect()] == [(6, 1, 0)] * 2
    kept = decontam.decontaminate(awkward, items)
    assert kept.schema == awkward.schema and kept.count() == awkward.count() - 1
    assert decontam.contaminated(awkward, items.where("false")).count() == 0 and decontam.contaminated(awkward.where("false"), items).count() == 0


def test_query_names_leaks_only(spark, sf_dir):
    items = {r.item_id: decontam.normal(r.text.encode()) for r in table(spark, sf_dir, "benchmark").collect()}
    docs = {r.doc_id: decontam.normal(r.text.encode()) for r in table(spark, sf_dir, "documents").collect()}
    exact = {(d, i) for d, t in docs.items() for i, p in items.items() if p in t}
    found = {(r.doc_id, r.item_id) for r in queries.op10_decontamination(spark, sf_dir).collect()}
    assert exact <= found and len(found) <= len(exact) + 2


def test_every_stage_decides(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, left = docs.columns, docs.count()
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).persist()
        assert docs.columns == columns and docs.count() <= left
        left, seen[name] = docs.count(), {r.doc_id: r.text for r in docs.collect()}
    assert len(seen["line_dedup"]) == len(seen["quality_rules"]) > len(seen["near_dedup"]) > len(seen["decontamination"]) > 0
    assert sum(labels.get(i, 1) for i in seen["quality_rules"]) >= 0.97 * len(seen["quality_rules"])
    # each stage's own input is clean by its own measure behind it
    assert minhash.near_duplicates(docs).where("not kept").count() == 0
    assert decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).count() == 0
    want = {tuple(r) for r in bpe.digest_documents(docs, queries.tokenizer_path()).collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} == want


def test_stages_take_awkward_rows(spark, sf_dir, awkward):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward, sf_dir).count() <= awkward.count()
        assert stage(spark, awkward.where("false"), sf_dir).count() == 0


def test_kept_lines_roundtrip():
    import zlib

    keep = zlib.compress(np.packbits([1, 0, 1]).tobytes())
    assert linededup.kept_lines(b"a\nb\nc", keep) == ([b"a", b"c"], 3)
    assert quality.count(b"a b c d e a b c d e")[0].n_repeat_words == 10
