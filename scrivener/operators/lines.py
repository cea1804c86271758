"""Ordered folds over the lines of a page: blocks, merges, pairs, runs.

Order is explicit everywhere: ``id`` orders the lines of a page, pages order by
``page_id`` inside a conference.  Window forms are used where the fold has one;
the block fold, whose acceptance depends on the last accepted line, is a
higher-order ``aggregate`` over one role label's segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivener.functions.names import valid_person_name
from scrivener.functions.text import clean_line, full_clean, num_tokens, stripped

INDENT_LIMIT, LINE_LIMIT = 12, 10


def relevant_lines(lines: DataFrame, label_col: str) -> DataFrame:
    """Labelled, non-empty lines; ``label`` is the chosen label column."""
    return lines.where((F.col("line_text") != "") & (F.col(label_col) != "Undefined")).withColumn("label", F.col(label_col))


def role_blocks(lines: DataFrame, indent_limit: int = INDENT_LIMIT, line_limit: int = LINE_LIMIT) -> DataFrame:
    """Content lines with the role line they belong to.

    ``lines``: (conf_id, page_id, id, num, indent, label, ...).  A line is taken if
    its indentation differs from the role line's by less than ``indent_limit`` and
    its number from the last taken line's (at first the role line's) by less than
    ``line_limit``.  Labels carry across pages of a conference.
    """
    w = Window.partitionBy("conf_id").orderBy("page_id", "id")
    role = F.col("label") == "Role-Label"
    carried = lambda c: F.last(F.when(role, F.col(c)), ignorenulls=True).over(w)
    segment = lines.select("*", carried("id").alias("role_id"), carried("num").alias("role_num"), carried("indent").alias("role_indent")).where(~role & F.col("role_id").isNotNull())
    near = segment.where(F.abs(F.col("indent") - F.col("role_indent")) < indent_limit)
    rest = [c for c in lines.columns if c not in ("conf_id",)]
    grouped = near.groupBy("conf_id", "role_id", "role_num").agg(F.array_sort(F.collect_list(F.struct("page_id", "id", *[c for c in rest if c not in ("page_id", "id")]))).alias("rows"))
    start = F.struct(F.col("role_num").alias("prev"), F.expr("cast(array() as array<int>)").alias("taken"), F.lit(0).alias("at"))

    def step(acc: Column, row: Column) -> Column:
        ok = F.abs(row["num"] - acc["prev"]) < line_limit
        return F.struct(
            F.when(ok, row["num"]).otherwise(acc["prev"]).alias("prev"),
            F.when(ok, F.concat(acc["taken"], F.array(acc["at"]))).otherwise(acc["taken"]).alias("taken"),
            (acc["at"] + 1).alias("at"),
        )

    taken = F.transform(F.aggregate("rows", start, step)["taken"], lambda i: F.get(F.col("rows"), i))
    return grouped.select("conf_id", "role_id", F.explode(taken).alias("row")).select("conf_id", "role_id", *(F.col("row")[c].alias(c) for c in rest))


def merge_same_line(blocks: DataFrame, test_col: str = "label") -> DataFrame:
    """A Person and the non-Person that follows on the same line become one Complex line 'a, b'."""
    w = Window.partitionBy("conf_id", "role_id").orderBy("page_id", "id")
    person = F.col(test_col) == "Person"
    with_next = blocks.select(
        "*",
        F.lead("num").over(w).alias("n_num"),
        F.lead(test_col).over(w).alias("n_label"),
        F.lead("text").over(w).alias("n_text"),
        F.lag("num").over(w).alias("p_num"),
        F.lag(test_col).over(w).alias("p_label"),
    )
    left = person & (F.col("n_num") == F.col("num")) & (F.col("n_label") != "Person")
    right = ~person & (F.col("p_num") == F.col("num")) & (F.col("p_label") == "Person")
    merged = with_next.where(~F.coalesce(right, F.lit(False)))
    hit = F.coalesce(left, F.lit(False))
    return merged.select(
        *(c for c in blocks.columns if c not in ("text", "label")),
        F.when(hit, clean_line(F.concat_ws(", ", "text", "n_text"))).otherwise(F.col("text")).alias("text"),
        F.when(hit, "Complex").otherwise(F.col("label")).alias("label"),
    )


def person_affiliations(blocks: DataFrame, literal: bool = False) -> DataFrame:
    """(conf_id, role_id, id, person, affiliation) of Person and Affiliation lines.

    An Affiliation right behind a Person belongs to it; other persons stand
    alone.  ``literal`` repeats the known fault: of two persons in a row the
    second is stored alone (again if an affiliation follows) and a last person is lost.
    """
    w = Window.partitionBy("conf_id", "role_id").orderBy("page_id", "id")
    kept = blocks.where(F.col("label").isin("Person", "Affiliation")).select(
        "conf_id", "role_id", "id", "label", "text", F.lag("label").over(w).alias("p_label"), F.lag("text").over(w).alias("p_text"), F.lag("id").over(w).alias("p_id"), F.lead("label").over(w).alias("n_label")
    )
    pairs = kept.where((F.col("label") == "Affiliation") & (F.col("p_label") == "Person")).select("conf_id", "role_id", F.col("p_id").alias("id"), F.col("p_text").alias("person"), F.col("text").alias("affiliation"))
    if literal:
        alone = kept.where((F.col("label") == "Person") & (F.col("p_label") == "Person"))
    else:
        alone = kept.where((F.col("label") == "Person") & (F.coalesce("n_label", F.lit("Person")) == "Person"))
    return pairs.unionByName(alone.select("conf_id", "role_id", "id", F.col("text").alias("person"), F.lit(None).cast("string").alias("affiliation")))


def person_runs(blocks: DataFrame, long_tokens: int = 5) -> DataFrame:
    """(conf_id, role_id, island, kind, text): runs of wrapped person lines of proceedings.

    In an island of Person lines, the first line of more than ``long_tokens``
    tokens starts a run that ends with the island; lines before it stand alone.
    A run that ends its block is lost, as the reference loses it.
    """
    w = Window.partitionBy("conf_id", "role_id").orderBy("page_id", "id")
    person = F.col("label") == "Person"
    marked = blocks.withColumn("island", F.sum(F.when(~person, 1).otherwise(0)).over(w)).withColumn("last_island", F.max("island").over(Window.partitionBy("conf_id", "role_id")))
    only = marked.where(person)
    inner = Window.partitionBy("conf_id", "role_id", "island").orderBy("page_id", "id")
    in_run = F.max(F.when(num_tokens(F.col("text")) > long_tokens, 1).otherwise(0)).over(inner) == 1
    flagged = only.select("conf_id", "role_id", "island", "last_island", "page_id", "id", "text", in_run.alias("in_run"))
    runs = (
        flagged.where(F.col("in_run") & (F.col("island") < F.col("last_island")))
        .groupBy("conf_id", "role_id", "island")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "id", "text"))), lambda r: r["text"]), " ").alias("text"))
        .withColumn("kind", F.lit("run"))
    )
    single = flagged.where(~F.col("in_run")).select("conf_id", "role_id", "island", "text", F.lit("single").alias("kind"))
    return runs.unionByName(single)


def persons_of_run(text: Column) -> Column:
    """Names of a joined run: pieces at ', '; more than three tokens make two names; cleaned, valid ones only."""
    pieces = F.transform(F.split(text, ", ", -1), full_clean)

    def cut(p: Column) -> Column:
        tokens = F.split(p, " ", -1)
        two = F.array(F.array_join(F.slice(tokens, 1, 2), " "), F.array_join(F.slice(tokens, 3, F.greatest(F.size(tokens) - 2, F.lit(0))), " "))
        return F.when(F.size(tokens) > 3, two).otherwise(F.array(p))

    names = F.transform(F.flatten(F.transform(pieces, cut)), clean_line)
    return F.filter(names, lambda n: (n != "") & valid_person_name(n))


def proceedings_person_org(text: Column) -> Column:
    """struct<person, org> of a proceedings line, null if no format fits.

    NAME (ORG, ...); LAST, FIRST (ORG); NAME, ORG or NAME - ORG with 'U' for University.
    """
    bracket = F.regexp_extract(text, r"\((.*?)\)", 1)
    org = F.element_at(F.split(bracket, ",", -1), 1)
    first = F.struct(F.element_at(F.split(text, r"\(", -1), 1).alias("person"), org.alias("org"))
    turned = F.array_join(F.reverse(F.split(F.regexp_extract(text, r"^(.*?)\(", 1), ",", -1)), " ")
    second = F.struct(turned.alias("person"), org.alias("org"))
    wide = F.regexp_replace(text, "U ", "University ")
    wide = F.when(F.endswith(wide, F.lit("U")), F.concat(wide, F.lit("niversity"))).otherwise(wide)
    wide = F.regexp_replace(wide, r"\([(a-zA-Z0-9-)]*\)", "")
    by = lambda sep: F.struct(F.element_at(F.split(wide, sep, -1), 1).alias("person"), F.element_at(F.split(wide, sep, -1), 2).alias("org"))
    third = F.when(F.contains(wide, F.lit(" - ")), by("-")).when(F.contains(wide, F.lit(", ")), by(","))
    found = F.when(F.rlike(text, F.lit(r"^[^,]+\(.+\)")), first).when(F.rlike(text, F.lit(r"^[^,]+,[^,]+\(.+\)")), second).otherwise(third)
    return F.when(found.isNotNull(), F.struct(full_clean(found["person"]).alias("person"), full_clean(found["org"]).alias("org")))


def until_contents(pages: DataFrame, marker: str = "Table of Contents") -> DataFrame:
    """Lines of (doc_id, page, text) before the first page that holds ``marker``; 'p' lines with running numbers."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = pages.withColumn("stop", F.max(F.contains("text", F.lit(marker)).cast("int")).over(w)).where("stop = 0")
    lines = before.select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", stripped(F.col("line"))).where("line <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "pos")) - 1
    return lines.select("doc_id", number.alias("line_num"), F.col("line").alias("line_text"), F.lit("p").alias("tag"), F.lit(1).alias("indentation"))


def encode_tags(lines: DataFrame, scope: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Per page, tags as ranks of their sorted distinct values."""
    return lines.withColumn("tag_id", F.dense_rank().over(Window.partitionBy(*scope).orderBy("tag")) - 1)


def complex_relations(parts: DataFrame) -> DataFrame:
    """First PER, ORG and LOC of every line from tagged spans (conf_id, line_id, part, span, tag, text)."""
    firsts = parts.groupBy("conf_id", "line_id").agg(*(F.min_by(F.when(F.col("tag") == t, F.col("text")), F.when(F.col("tag") == t, F.struct("part", "span"))).alias(c) for t, c in (("PER", "person"), ("ORG", "org"), ("LOC", "location"))))
    return firsts.where("person is not null or org is not null")


def relations(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Persons of ``pairs`` with the first organization and location found in their affiliation line."""
    return pairs.join(entities, ["conf_id", "affiliation"], "left").select("conf_id", "role_id", full_clean(F.col("person")).alias("person"), "org", F.when(F.col("org").isNotNull(), F.col("location")).alias("location"))
