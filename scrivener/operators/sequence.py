"""Token sequences: readers, decoders, rectification, evaluation and synthesis.

Tokens stand in rows (sent, pos, word, tag); ``sent`` orders sentences.  The
carried state (role, last person) ends with each ``scope``, which has to be
given: a document or a journal, so that no window holds all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Role words of editorial boards and their tags
ROLE_WORDS = {
    "co-editor": "ROLE",
    "co-editors": "ROLE",
    "book-review-committee": "ROLE",
    "book-review-editor": "ROLE",
    "review-committee": "ROLE",
    "review-board": "ROLE",
    "advisory-council": "ROLE",
    "advisory-board": "ROLE",
    "managing-board": "ROLE",
    "coordinating-editor": "ROLE",
    "coordinating-editors": "ROLE",
    "founding-editor": "ROLE",
    "founding-editors": "ROLE",
    "department-editor": "ROLE",
    "department-editors": "ROLE",
    "action-editor": "ROLE",
    "action-editors": "ROLE",
    "section-editor": "ROLE",
    "section-editors": "ROLE",
    "managing-editor": "ROLE",
    "managing-editors": "ROLE",
    "senior-associate-editors": "ROLE",
    "senior-associate-editor": "ROLE",
    "editor-in-chief": "ROLE",
    "editors-in-chief": "ROLE",
    "associate-editors": "ROLE",
    "associate-editor": "ROLE",
    "editorial-board": "ROLE",
    "editorialboard": "ROLE",
    "editor-emeritus": "ROLE",
    "editors": "ROLE",
    "editor": "ROLE",
    "executive": "B-ROLE",
    "deputy": "B-ROLE",
    "honorable": "B-ROLE",
    "coordinating": "B-ROLE",
    "action": "B-ROLE",
    "section": "B-ROLE",
    "founding": "B-ROLE",
    "managing": "B-ROLE",
    "senior": "B-ROLE",
    "editorial": "B-ROLE",
    "book": "B-ROLE",
    "advisory": "BI-ROLE",
    "review": "BI-ROLE",
    "associate": "BI-ROLE",
    "board": "E-ROLE",
    "committee": "E-ROLE",
    "council": "E-ROLE",
    "in": "I-ROLE",
    "chief": "E-ROLE",
    "emeritus": "E-ROLE",
}
INLINE_TAG = r"^<[^<>]+>\z"


def role_tag(word: Column) -> Column:
    """Tag of a role word, null for others."""
    w = F.lower(word)
    out = F.lit(None).cast("string")
    for tag in dict.fromkeys(ROLE_WORDS.values()):
        out = F.when(w.isin(*(x for x, t in ROLE_WORDS.items() if t == tag)), tag).otherwise(out)
    return out


def conll_tokens(lines: DataFrame) -> DataFrame:
    """(doc, sent, pos, word, tag) of 'word TAG' lines (doc, n, line); blank and -DOCSTART lines separate."""
    w = Window.partitionBy("doc").orderBy("n")
    cut = (F.trim("line") == "") | F.startswith("line", F.lit("-DOCSTART"))
    numbered = lines.withColumn("cut", cut).withColumn("sent", F.sum(F.when(F.col("cut"), 1).otherwise(0)).over(w)).where(~F.col("cut"))
    fields = F.split(F.trim("line"), " ", -1)
    pos = F.row_number().over(Window.partitionBy("doc", "sent").orderBy("n")) - 1
    return numbered.select("doc", F.col("sent"), pos.alias("pos"), F.element_at(fields, 1).alias("word"), F.element_at(fields, -1).alias("tag"))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def inline_tokens(line: Column) -> Column:
    """array<struct<pos, word, tag>> of 'word <TAG> word ...'; untagged words have the tag O."""
    is_tag = lambda t: F.rlike(t, F.lit(INLINE_TAG))

    def paired(tokens: Column) -> Column:
        # every token beside the next, null behind the last
        pairs = F.zip_with(tokens, F.slice(tokens, 2, F.size(tokens)), lambda t, n: F.struct(t.alias("word"), F.when(is_tag(n), F.regexp_replace(n, "[<>]", "")).otherwise("O").alias("tag")))
        return F.transform(F.filter(pairs, lambda p: ~is_tag(p["word"])), lambda p, i: F.struct(i.alias("pos"), p["word"].alias("word"), p["tag"].alias("tag")))

    return _once(F.filter(F.split(line, " +", -1), lambda t: t != ""), paired)


def to_conll(line: Column) -> Column:
    """'word TAG' lines of an inline-tagged sentence; a last word without a tag is lost, as in the reference."""

    def kept(t: Column) -> Column:
        last = F.try_element_at(t, F.lit(-1))
        return F.when(last["tag"] == "O", F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(t)

    return F.transform(_once(inline_tokens(line), kept), lambda x: F.concat_ws(" ", x["word"], x["tag"]))


def propagate_roles(tokens: DataFrame, scope: list[str], initial: str = "editor") -> DataFrame:
    """Tokens that are no role words, with the role phrase last seen.

    Neighbouring role words of a line join to one phrase; the phrase holds over
    lines until the next, within ``scope``.
    """
    line = Window.partitionBy(*scope, "line").orderBy("pos")
    is_role = F.endswith("tag", F.lit("ROLE"))
    marked = tokens.withColumn("is_role", is_role).withColumn("starts", is_role & ~F.coalesce(F.lag(is_role).over(line), F.lit(False)))
    phrase = marked.withColumn("phrase_id", F.sum(F.col("starts").cast("int")).over(line))
    names = phrase.where("is_role").groupBy(*scope, "line", "phrase_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("role"), F.min("pos").alias("pos"))
    marks = phrase.where(~F.col("is_role")).select(*scope, "line", "pos", "word", "tag", "phrase_id", F.lit(None).cast("string").alias("role")).unionByName(names.select(*scope, "line", "pos", F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("tag"), "phrase_id", "role"))
    carried = F.coalesce(F.last("role", ignorenulls=True).over(Window.partitionBy(*scope).orderBy("line", "pos")), F.lit(initial))
    return marks.withColumn("role", carried).where("word is not null")


def entities(tokens: DataFrame, scope: list[str], kinds: tuple[str, ...] = ("PER", "ORG")) -> DataFrame:
    """Neighbouring words of one kind joined: (scope, line, pos, kind, text, role); B and S marks do not separate."""
    w = Window.partitionBy(*scope, "line").orderBy("pos")
    kind = F.element_at(F.split("tag", "-", -1), -1)
    marked = tokens.withColumn("kind", kind).withColumn("new", ~(F.lag("kind").over(w).eqNullSafe(F.col("kind")) & (F.lag("phrase_id").over(w) == F.col("phrase_id"))))
    numbered = marked.withColumn("ent", F.sum(F.col("new").cast("int")).over(w)).where(F.col("kind").isin(*kinds))
    return numbered.groupBy(*scope, "line", "ent", "kind", "role").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text")).drop("ent")


def pair_entities(found: DataFrame, scope: list[str]) -> DataFrame:
    """(role, name, affiliation): an organization right behind a person in the entity sequence."""
    w = Window.partitionBy(*scope).orderBy("line", "pos")
    marked = found.withColumn("p_kind", F.lag("kind").over(w)).withColumn("name", F.lag("text").over(w))
    return marked.where((F.col("kind") == "ORG") & (F.col("p_kind") == "PER")).select(*scope, "line", "pos", "role", "name", F.col("text").alias("affiliation"))


def rectify(tokens: DataFrame, seed: Column, kind: str) -> DataFrame:
    """Relabel islands of alphabetic words around seed words: B-, I-, E-; a single word gets E-."""
    s = Window.partitionBy("sent").orderBy("pos")
    inside = seed | F.rlike("word", F.lit(r"^\p{L}+$"))
    marked = tokens.withColumn("inside", inside).withColumn("seed", seed)
    marked = marked.withColumn("isle", F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(s))
    isle = Window.partitionBy("sent", "isle", "inside")
    hit = F.col("inside") & (F.max(F.col("seed").cast("int")).over(isle) == 1)
    first, last = F.min("pos").over(isle) == F.col("pos"), F.max("pos").over(isle) == F.col("pos")
    tag = F.when(last, f"E-{kind}").when(first, f"B-{kind}").otherwise(f"I-{kind}")
    return marked.withColumn("new_tag", F.when(hit, tag).otherwise(F.col("tag"))).select(*tokens.columns, "new_tag")


def change_log(rectified: DataFrame) -> DataFrame:
    return rectified.where("tag <> new_tag")


def decode_bio(tokens: DataFrame) -> DataFrame:
    """(sent, entity, kind, text): B starts an entity, I goes on with the last one, O does not end it."""
    w = Window.partitionBy("sent").orderBy("pos")
    numbered = tokens.withColumn("entity", F.sum(F.when(F.startswith("tag", F.lit("B-")), 1).otherwise(0)).over(w)).where("tag <> 'O' and entity > 0")
    parts = F.array_sort(F.collect_list(F.struct("pos", "word", "tag")))
    return numbered.groupBy("sent", "entity").agg(parts.alias("p")).select("sent", "entity", F.expr("substr(p[0].tag, 3)").alias("kind"), F.array_join(F.transform("p", lambda x: x["word"]), " ").alias("text"))


def bies_spans(tokens: DataFrame, tag_col: str = "tag") -> DataFrame:
    """(sent, kind, first, last) of the islands of one kind; B and S start anew."""
    w = Window.partitionBy("sent").orderBy("pos")
    t = F.col(tag_col)
    kind = F.when(t != "O", F.regexp_extract(t, r"^(?:[BIES]-)?(.*)$", 1))
    marked = tokens.select("sent", "pos", t.alias("t"), kind.alias("kind"))
    starts = F.rlike("t", F.lit("^[BS]-")) | ~F.lag("kind").over(w).eqNullSafe(F.col("kind")) | F.coalesce(F.rlike(F.lag("t").over(w), F.lit("^[ES]-")), F.lit(False))
    numbered = marked.withColumn("span", F.sum(starts.cast("int")).over(w)).where("kind is not null")
    return numbered.groupBy("sent", "span", "kind").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("span")


def span_report(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(kind, gold, predicted, correct, precision, recall, f1) of exact spans.

    Kinds first; 'micro avg' is of all spans, 'macro avg' the kinds' mean weighted by their gold spans.
    """
    keys = ["sent", "kind", "first", "last"]
    both = gold.select(*keys, F.lit(1).alias("g")).join(predicted.select(*keys, F.lit(1).alias("p")), keys, "full")
    counts = both.groupBy("kind").agg(F.count("g").alias("gold"), F.count("p").alias("predicted"), F.sum(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("correct"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("correct"), F.col("predicted")), ratio(F.col("correct"), F.col("gold"))
    scored = lambda df: df.select("*", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))
    kinds = scored(counts)
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gold", "predicted", "correct")]
    micro = scored(counts.agg(*totals).select(F.lit("micro avg").alias("kind"), "*"))
    mean = lambda c: F.coalesce(F.sum(F.col(c) * F.col("gold")) / F.nullif(F.sum("gold"), F.lit(0)), F.lit(0.0)).alias(c)
    macro = kinds.agg(*totals, *(mean(c) for c in ("precision", "recall", "f1"))).select(F.lit("macro avg").alias("kind"), "*")
    return kinds.unionByName(micro).unionByName(macro)


def bucket(key: Column, seed: int | None = None) -> Column:
    """Split of a key: 0 dev, 1 test, else train, by tenths; random if a seed is given."""
    return F.floor(F.rand(seed) * 10) if seed is not None else F.pmod(key, F.lit(10))


def split_of(key: Column, seed: int | None = None) -> Column:
    b = bucket(key, seed)
    return F.when(b == 0, "dev").when(b == 1, "test").otherwise("train")


def augment(tokens: DataFrame, lexicon: DataFrame, kind: str, keep_percent: int = 20, seed: int | None = None) -> DataFrame:
    """Sentences with their first run of ``kind`` replaced by a lexicon entry; other words kept at ``keep_percent``.

    The choice is random with a seed, else by arithmetic on the sentence, which an
    oracle can repeat.  A run that ends its sentence is not replaced.
    ``lexicon``: (n, content) numbered from 0.
    """
    w = Window.partitionBy("sent").orderBy("pos")
    mine = F.endswith("tag", F.lit(f"-{kind}"))
    marked = tokens.withColumn("mine", mine).withColumn("run", F.sum((mine & ~F.coalesce(F.lag(mine).over(w), F.lit(False))).cast("int")).over(w)).withColumn("last", F.max("pos").over(Window.partitionBy("sent")))
    first = marked.where("mine and run = 1").groupBy("sent").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.max("last").alias("last")).where("b < last")
    size = lexicon.count()  # a small table by contract: entries of one type
    pick = F.floor(F.rand(seed) * size) if seed is not None else F.pmod(F.col("sent"), F.lit(size))
    entry = first.withColumn("n", pick).join(lexicon, "n")
    words = entry.select("sent", "a", F.split("content", " ", -1).alias("w")).select("sent", F.col("a").alias("pos"), F.posexplode("w").alias("sub", "word"), F.size("w").alias("size"))
    tag = F.when(F.col("sub") == 0, f"B-{kind}").when(F.col("sub") == F.col("size") - 1, f"E-{kind}").otherwise(f"I-{kind}")
    new = words.select("sent", "pos", "sub", "word", tag.alias("tag"))
    keep = (F.rand(seed + 1) * 100 if seed is not None else F.pmod(F.col("sent") * 31 + F.col("pos") * 17, F.lit(100))) < keep_percent
    joined = marked.join(first.select("sent", "a", "b"), "sent", "left").where(F.col("a").isNull() | (F.col("pos") < F.col("a")) | (F.col("pos") > F.col("b")))
    follows = F.col("pos") == F.col("b") + 1  # the word behind a replaced run always stays
    return joined.where(F.coalesce(follows, F.lit(False)) | keep).select("sent", "pos", F.lit(0).alias("sub"), "word", "tag").unionByName(new)


def synthesize(people: DataFrame, orgs: DataFrame, roles: DataFrame) -> DataFrame:
    """(sent, pos, word, tag): a person always, an organization in 8 and a role in 2 of 10 sentences; by key arithmetic.

    Inputs are (n, content) numbered from 0.
    """
    n_org, n_role = orgs.count(), roles.count()
    s = people.select(F.col("n").alias("sent"), F.col("content").alias("person"), F.pmod("n", F.lit(max(1, n_org))).alias("o"), F.pmod("n", F.lit(max(1, n_role))).alias("r"))
    s = s.join(orgs.select(F.col("n").alias("o"), F.col("content").alias("org")), "o", "left").join(roles.select(F.col("n").alias("r"), F.col("content").alias("role")), "r", "left")

    def tagged(c: str, kind: str) -> Column:
        return F.transform(F.split(c, " ", -1), lambda w, i: F.struct(w.alias("word"), F.when(i == 0, f"B-{kind}").otherwise(f"I-{kind}").alias("tag")))

    none = F.expr("cast(array() as array<struct<word:string,tag:string>>)")
    parts = F.concat(tagged("person", "PER"), F.when((F.col("sent") % 10 < 8) & F.col("org").isNotNull(), tagged("org", "ORG")).otherwise(none), F.when((F.col("sent") % 10 >= 8) & F.col("role").isNotNull(), tagged("role", "ROLE")).otherwise(none))
    return s.select("sent", F.posexplode(parts).alias("pos", "t")).select("sent", "pos", "t.word", "t.tag")
