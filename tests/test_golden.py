"""Hand-derived cases of the operators, and properties of the iterative ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivener import schemas
from scrivener.functions import names, text, web
from scrivener.operators import cluster, dml, lines, match, rank, sequence, tagger
from scrivener.sources import readers
from scrivener.streaming import frontier


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.clean_line(F.col("t")), t="- John Doe (NUS)\t, ") == "John Doe (NUS) ,"
    assert one(spark, text.full_clean(F.col("t")), t="(General Chair):") == "General Chair"
    assert one(spark, text.clean_for_model(F.col("t")), t="*Prof. A (NUS)*") == "Prof. A NUS"
    assert one(spark, text.space_markup(F.col("t")), t="a:b,<x>") == "a : b , <x> "
    assert one(spark, text.split_line(F.col("t")), t="John Doe (NUS, Singapore), Chair") == ["John Doe", "NUS", "Singapore", "Chair"]
    assert one(spark, text.split_line(F.col("t"), literal=True), t="John Doe (NUS, Singapore), Chair") == ["John Doe", "NUS", "Singapore"]
    assert one(spark, text.year_of(F.col("t")), t="Nov 16, 2020 - Nov 20, 2020") == 2020
    assert one(spark, text.year_of(F.col("t")), t="TBD") == -1
    assert one(spark, text.num_tokens(F.col("t")), t="Dr  john Smith") == 4
    assert one(spark, text.percent_cap(F.col("t")), t="Dr  john Smith") == pytest.approx(2 / 3)
    assert one(spark, text.nfkd(F.col("t")), t="é") == "é"


def test_links_and_roles(spark):
    kind = lambda t, u: one(spark, web.classify_link(F.col("t"), F.col("u")), t=t, u=u)
    assert [kind("Program Committee", "/pc"), kind("Keynote Speakers", "/k"), kind("Venue", "/v"), kind(None, "/about-us")] == ["org", "speakers", "unk", "org"]
    score = lambda d, r: one(spark, names.role_score(F.col("d"), F.col("r")), d=d, r=r)
    assert [score("journal", "Editor"), score("conference", "Senior PC"), score("conference", "PC Member"), score("conference", "General Chair")] == [2, 2, 1, 2]
    dist = lambda a, b: one(spark, names.name_distance(F.col("a"), F.col("b")), a=a, b=b)
    assert [dist("Kan Min-Yen", "Min-Yen Kan"), dist("Jon Smith", "John Smith"), dist("Smith J", "John Smith")] == [1, 1, 3]
    same = lambda h, x: one(spark, web.same_domain(F.col("h"), F.col("x")), h=h, x=x)
    assert [same("http://a.org/x", "mailto:x@y"), same("http://a.org/x", "/rel"), same("http://a.org:80/", "http://a.org/")] == [True, True, False]


def blocks(spark, rows):
    return spark.createDataFrame([(1, 1, i, *r) for i, r in enumerate(rows, 1)], "conf_id long, page_id long, id long, num long, indent long, label string, text string")


def test_role_blocks(spark):
    rows = [(1, 5, "Role-Label", ""), (2, 5, "Person", ""), (3, 30, "Person", ""), (9, 6, "Affiliation", ""), (25, 5, "Person", "")]
    assert [(r.role_id, r.num) for r in lines.role_blocks(blocks(spark, rows)).orderBy("id").collect()] == [(1, 2), (1, 9)]


def test_merges_and_pairs(spark):
    rows = [(7, 0, "Person", "A B"), (7, 0, "Affiliation", "NUS"), (8, 0, "Person", "C D"), (9, 0, "Affiliation", "MIT")]
    b = blocks(spark, rows).withColumn("role_id", F.lit(1))
    assert [(r.num, r.label, r.text) for r in lines.merge_same_line(b).orderBy("id").collect()] == [(7, "Complex", "A B, NUS"), (8, "Person", "C D"), (9, "Affiliation", "MIT")]
    p = blocks(spark, [(k, 0, x, t) for k, (x, t) in enumerate([("Person", "P1"), ("Person", "P2"), ("Affiliation", "A1"), ("Affiliation", "A2"), ("Person", "P3")])]).withColumn("role_id", F.lit(1))
    pairs = lambda literal: {(r.person, r.affiliation) for r in lines.person_affiliations(p, literal).collect()}
    assert pairs(False) == {("P1", None), ("P3", None), ("P2", "A1")} and pairs(True) == {("P2", None), ("P2", "A1")}


def test_proceedings(spark):
    f = lambda t: one(spark, lines.proceedings_person_org(F.col("t")), t=t)
    assert tuple(f("Kan, Min-Yen (NUS)")) == (" Min-Yen  Kan", "NUS")
    assert tuple(f("Ann Lee - MIT U")) == ("Ann Lee ", " MIT University") and f("nothing") is None


def test_roles_and_entities(spark):
    text_lines = [(1, "Editor-in-Chief <ROLE> John <B-PER> Smith <E-PER> NUS <S-ORG>"), (2, "Mary <S-PER>"), (3, "MIT <S-ORG> Associate <B-ROLE> Editors <E-ROLE> Bob <S-PER>")]
    df = spark.createDataFrame(text_lines, "line long, t string")
    tokens = df.select(F.lit("j").alias("journal"), "line", F.inline(sequence.inline_tokens(F.col("t"))))
    roled = sequence.propagate_roles(tokens, ["journal"])
    ents = sequence.entities(roled, ["journal"])
    found = [(r.role, r["name"], r.affiliation) for r in sequence.pair_entities(ents, ["journal"]).orderBy("line", "pos").collect()]
    assert found == [("Editor-in-Chief", "John Smith", "NUS"), ("Editor-in-Chief", "Mary", "MIT")]
    assert [(r.role, r.text) for r in ents.where("text = 'Bob'").collect()] == [("Associate Editors", "Bob")]


def sent(spark, words, tags):
    return spark.createDataFrame([(1, i, w, t) for i, (w, t) in enumerate(zip(words, tags))], "sent long, pos long, word string, tag string")


def test_rectify_and_decode(spark):
    out = lambda words: [r.new_tag for r in sequence.rectify(sent(spark, words, "O" * len(words)), F.lower("word").isin("zhang", "li"), "PER").orderBy("pos").collect()]
    assert out(["Prof", "Wei", "Zhang", ",", "NUS"]) == ["B-PER", "I-PER", "E-PER", "O", "O"] and out([",", "Li", ","]) == ["O", "E-PER", "O"]
    r = sequence.decode_bio(sent(spark, ["A", "B", "x", "C"], ["B-PER", "I-PER", "O", "I-PER"])).collect()
    assert [(x.kind, x.text) for x in r] == [("PER", "A B C")]
    assert one(spark, sequence.to_conll(F.col("t")), t="John <B-PER> is") == ["John B-PER"]


def test_html_lines():
    assert [r[1:] for r in readers.page_lines("<body><div>Chair<br>John<br>Mary</div></body>")] == [("Chair", "div", 1), ("John", "div", 1), ("Mary", "div", 1)]
    assert [r[1:] for r in readers.page_lines("<body><p>Hello <b>Bob</b> there</p></body>")] == [("Bob", "b", 1), ("Hello", "p", 1), ("there", "p", 1)]
    assert readers.page_lines("no body") is None and readers.page_lines("<body>" + "<div>" * 5000 + "deep") is not None
    assert readers.page_lines("<body><p>a<script>x</script></p></body>") == [(1, "a", "p", 1)]


def test_page_rank_by_hand_and_by_numpy(spark):
    roles = spark.createDataFrame([("conference", 1, "General Chair", 1), ("conference", 1, "PC Member", 2)], "doc_type string, doc_id long, role_type string, person_id long")
    first = {(r.kind, r.id): r.pr_score for r in rank.page_rank(rank.weighted_edges(roles), 1).collect()}
    assert first[("conference", 1)] == pytest.approx(1.85) and first[("person", 1)] == pytest.approx(1.198333, abs=1e-6) and first[("person", 2)] == pytest.approx(0.674167, abs=1e-6)
    rng = np.random.default_rng(1)
    rows = [("conference", int(v), str(rng.choice(["Chair", "Member"])), int(p)) for v, p in zip(rng.integers(0, 8, 60), rng.integers(0, 20, 60))]
    found = {(r.kind, r.id): r.pr_score for r in rank.page_rank(rank.weighted_edges(spark.createDataFrame(rows, roles.schema))).collect()}
    share, back = np.zeros((8, 20)), np.zeros((8, 20))
    for _, v, r, p in rows:
        share[v, p] += 2 if "Chair" in r else 1
        back[v, p] += 1
    share, back = share / np.maximum(share.sum(1, keepdims=True), 1e-9), back / np.maximum(back.sum(0, keepdims=True), 1e-9)
    p = np.ones(20)
    for _ in range(30):
        v = 0.15 + 0.85 * back @ p
        p = 0.15 + 0.85 * share.T @ v
    assert all(x == pytest.approx(v[i] if k == "conference" else p[i]) for (k, i), x in found.items())
    dealt = rank.page_rank(rank.weighted_edges(spark.createDataFrame(rows, roles.schema)), hot_edges=2).collect()  # nearly every node in several buckets
    assert {(r.kind, r.id): r.pr_score for r in dealt} == pytest.approx(found)


def test_ward_inside_components_equals_ward_of_all(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "uni", "institute", "lab", "north", "south"]
    pool = sorted({" ".join(rng.choice(words, rng.integers(1, 4), replace=False)) for _ in range(40)}) + ["?"]
    df = spark.createDataFrame(list(enumerate(pool)), "id long, name string")
    vectors = cluster.tf_idf(df).collect()
    terms = {t: k for k, t in enumerate(sorted({v.term for v in vectors}))}
    points = np.zeros((len(pool), len(terms)))
    for v in vectors:
        points[v.id, terms[v.term]] = v.weight
    label = cluster.ward(points, 0.8)
    # by the definition: merge the two clusters whose union adds the least to the squared distances to centres
    groups = [[k] for k in range(len(pool))]
    while True:
        cost = {(i, j): 2 * len(a) * len(b) / (len(a) + len(b)) * ((points[a].mean(0) - points[b].mean(0)) ** 2).sum() for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j}
        (i, j), least = min(cost.items(), key=lambda x: x[1])
        if not np.sqrt(least) < 0.8:
            break
        groups[i] += groups.pop(j)
    assert {frozenset(x) for x in groups} == {frozenset(np.flatnonzero(label == k)) for k in set(label)}
    want = {frozenset(np.flatnonzero(label == k)) for k in set(label)}
    got = {}
    for r in cluster.cluster_names(df).collect():
        got.setdefault(r.cluster, set()).add(r.id)
    cluster.save_clusters(cluster.cluster_names(df), f"file://{tmp_path}/map")
    assert cluster.load_clusters(spark, f"file://{tmp_path}/map").count() == len(pool)
    assert {frozenset(s) for s in got.values()} == want and any(len(s) > 1 for s in want)


def test_links_of_all_elements(spark):
    html = """<head><link rel=x href="/about.css">not mine<base href='/b/'></head><A class=k HREF = '/c'> Us </A><a href=/d><img src=i> Chair</a>
      <div title="a" href="e/f"><b>bold</b> own <i>x</i></div><a href="g"></a><a name="h">no link</a><span data-href="/no">x</span>"""
    found = [(x.url, x.text) for x in one(spark, web.links_of(F.col("h")), h=html)]
    assert found == [("/about.css", ""), ("/b/", ""), ("/c", "Us"), ("/d", "Chair"), ("e/f", "own"), ("g", "")]
    pages = spark.createDataFrame([(1, "http://h.org/a/b?q", '<a href="committee">x</a><a href="/y">chair</a><a href="http://o.org/chair">z</a><a href="mailto:x">about</a><a href="/venue">v</a>')], "page_id long, url string, html string")
    assert {(r.url, r.kind) for r in frontier.relevant_links(pages).collect()} == {("http://h.org/a/committee", "org"), ("http://h.org/y", "org"), ("mailto:x", "org")}


def test_svm_learns_its_labels(spark):
    rows = [(k % 5, k, f"{'Prof' if k % 2 else 'University of'} Name{k % 7}", "p" if k % 2 else "b", "Person" if k % 2 else "Affiliation") for k in range(200)]
    lines_ = spark.createDataFrame(rows, "page_id long, id long, line_text string, tag string, label string")
    model = tagger.train_line_svm(lines_.where("id < 150"))
    scored = model.transform(tagger.line_features(lines_.where("id >= 150")))
    assert scored.where("prediction = label_index").count() == 50
    tags = {(r.page_id, r.tag): r.f_tag for r in tagger.line_features(lines_).collect()}
    assert set(tags.values()) == {0.0, 1.0} and tags[0, "b"] == 0.0


def test_dml(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, title string, url string")
    new = spark.createDataFrame([(3, "a", "z", 1), (4, "c", "y", 2)], "id long, title string, url string, at long")
    assert {r.id for r in dml.upsert(old, new, [("title",), ("url",)], "at").collect()} == {3, 4}
    chained = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "x", 2), (3, "b", "y", 3)], "id long, title string, url string, at long")
    assert {r.id for r in dml.upsert(old.where("false"), chained, [("title",), ("url",)], "at").collect()} == {3}
    nulls = spark.createDataFrame([(None, 1), (None, 2), (5, 3)], "k long, at long")
    assert dml.insert_or_ignore(spark.createDataFrame([(5, 0)], "k long, at long"), nulls, ["k"], "at").count() == 3
    known = dml.get_or_create(spark.createDataFrame([("a", 2), ("b", 1), ("a", 3)], "n string, at long"), ["n"], "at")
    assert {r.n: r.id for r in known.collect()} == {"b": 1, "a": 2}
    grown = dml.get_or_create(spark.createDataFrame([("c", 1), ("a", 2)], "n string, at long"), ["n"], "at", known)
    assert {r.n: r.id for r in grown.collect()} == {"b": 1, "a": 2, "c": 3}
    assert {name for name in schemas.DDL if schemas.empty(spark, name).count() == 0} == set(schemas.DDL)


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "lex.txt").write_text("Tan\n \nLim\n")
    assert {r.content for r in readers.read_lexicon(spark, f"file://{tmp_path}/lex.txt", "surname").collect()} == {"tan", "lim"}
    (tmp_path / "x.conll").write_text("John B-PER\nis O\n\nMIT S-ORG\n")
    assert [(r.sent, r.pos, r.word, r.tag) for r in readers.read_conll(spark, f"file://{tmp_path}/x.conll").orderBy("sent", "pos").collect()] == [(0, 0, "John", "B-PER"), (0, 1, "is", "O"), (1, 0, "MIT", "S-ORG")]
    df = spark.createDataFrame([(1, "a\tb", "train"), (2, "c", "val")], "id long, t string, split string")
    dml.write_text(df, f"{tmp_path}/tsv", dml.tsv_text(["id", "t"]), "split")
    assert {r.value for r in spark.read.text(f"{tmp_path}/tsv").collect()} == {"1\ta\\\tb", "2\tc"}
    pages = spark.createDataFrame([(1, "http://a", "<body><p>Hi</p></body>", None), (2, "http://b", "<body><p>No</p></body>", "Yes")], "page_id long, url string, html string, processed string")
    pages.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run has nothing new
        frontier.process_stream(frontier.stream_pages(spark, f"{tmp_path}/in", "page_id long, url string, html string, processed string"), f"{tmp_path}/out", f"{tmp_path}/cp").start().awaitTermination()
        assert [r.line_text for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["Hi"]


def test_candidates_and_models(spark):
    payload = spark.createDataFrame([(1, "<result><hits><hit><info><author>A B</author><url>u1</url></info></hit></hits></result>")], "person_id long, payload string")
    assert [(r.type, r.id, r["name"]) for r in match.parse_dblp(payload).collect()] == [("dblp", "u1", "A B")]
    df = spark.createDataFrame([("the program committee",), ("Ann Lee",), (None,)], "line_text string")
    assert [r.prediction for r in tagger.predict_lines(df).collect()] == ["Role-Label", "Person", None]
    persons = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (1, "z", 2), (1, "w", 3)], "person_id long, id string, rank int").withColumn("type", F.lit("orcid"))
    assert match.top_candidates(persons).count() == 3


def test_augmentation_is_seeded(spark):
    t = sent(spark, ["Ann", "works", "at", "NUS", "today"], ["S-PER", "O", "O", "S-ORG", "O"])
    lex = spark.createDataFrame([(0, "Tan Ah Kow")], "n long, content string")
    out = sequence.augment(t, lex, "PER", 100, seed=3).orderBy("pos", "sub").collect()
    assert [(r.word, r.tag) for r in out][:4] == [("Tan", "B-PER"), ("Ah", "I-PER"), ("Kow", "E-PER"), ("works", "O")]


def test_column_files(spark, tmp_path):
    (tmp_path / "train.txt").write_text('Ann "B-PER\nof O\n')
    rows = readers.read_columns(spark, str(tmp_path / "train.txt"), "text string, ner string").collect()
    assert [(r.text, r.ner) for r in rows] == [("Ann", '"B-PER'), ("of", "O")]


def test_pages_are_taken_once(spark, tmp_path):
    pages = spark.createDataFrame([("u", "2026-01-01 00:00:00"), ("u", "2026-01-01 00:00:05"), ("v", "2026-01-01 00:00:01")], "url string, seen string")
    pages.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, seen string").parquet(str(tmp_path / "in")).withColumn("seen", F.to_timestamp("seen"))
    out = frontier.first_seen(stream, "seen", "1 hour").writeStream.format("memory").queryName("first_seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
    out.awaitTermination(120)
    assert sorted(r.url for r in spark.table("first_seen").collect()) == ["u", "v"]
