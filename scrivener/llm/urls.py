"""URL filters: fixed rules first, then a path-template tree per host.

Paths become segments (digits and long hexadecimal ids by shape).  Level by
level, where more than ``max_children`` shapes lie below one parent, segments
with at least a twentieth of the parent's pages stay and the others become a
wildcard; where fewer lie, they stay as they are, so a path may have any depth.

Every node of the tree is compared with its siblings by a two-proportion test on
labelled pages: a branch that does not differ is merged into its parent, up
through all levels to the host.  A template takes the figures of its deepest
branch that differs, or its host's, smoothed by the corpus rate; where that reaches
``max_bad`` it is rejected.  All of it is aggregation over distinct (host, path shape) rows,
pre-aggregated before each shuffle; rows meet the figures of one host or shape in ``SALTS`` parts.

Cases: a null url or one without '://' has an empty host and path and belongs to
the empty template; null labels and labels of absent pages are ignored, a page
with several labels is bad if one of them is; repeated rows repeat their
verdict; other columns of pages are not read, so clashing names do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import materialize


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the contract
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path), both empty where there is no '://'."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), CAPITALS, SMALL), F.regexp_extract(url, URL, 2)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, null if none does."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest is tested first
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def shape(path: Column) -> Column:
    """Path segments with digits and long hexadecimal ids by shape."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    # runs of hex digits that hold a digit, of eight or more; then any digits
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, "(?=[a-f]*[0-9])[0-9a-f]{8,}", "<id>"), "[0-9]+", "<n>"))


SALTS = 8


def salted(df: DataFrame) -> DataFrame:
    """Every row once for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def template_tree(shapes: DataFrame, max_children: int = 20) -> DataFrame:
    """``shapes`` (host, shape, n, ...) with their template: variable segments as '*'.

    A parent of more than ``max_children`` different shapes keeps the segments
    that hold at least one in ``max_children`` of its pages and makes '*' of the
    others.  Smaller parents are done, so levels end where paths stop being many.
    """
    names = shapes.columns
    salt = F.pmod(F.xxhash64("shape"), F.lit(SALTS)).cast("int")
    open_rows = shapes.withColumn("template", F.array().cast("array<string>")).withColumn("salt", salt)
    done, d = None, 0
    while True:
        d += 1
        # a written table keeps the plan from doubling with each level
        open_rows = materialize(open_rows)
        here = F.element_at("shape", d)
        parents = open_rows.groupBy("host", "template").agg(F.count("*").alias("shapes"), F.sum("n").alias("all"))
        sized = open_rows.join(salted(parents), ["host", "template", "salt"])
        rest = F.slice("shape", d, F.greatest(F.size("shape") - (d - 1), F.lit(0)))
        few = sized.where((F.col("shapes") <= max_children) | (F.size("shape") < d)).withColumn("template", F.concat("template", rest)).select(*names, "template")
        done = few if done is None else done.unionByName(few)
        many = sized.where((F.col("shapes") > max_children) & (F.size("shape") >= d)).withColumn("value", here)
        # the pages of a value against its parent's
        kept = many.groupBy("host", "template", "value").agg(F.sum("n").alias("mine"), F.first("all").alias("all")).where(F.col("mine") * max_children >= F.col("all"))
        marked = many.join(salted(kept.select("host", "template", "value", F.lit(True).alias("kept"))), ["host", "template", "value", "salt"], "left")
        open_rows = marked.withColumn("template", F.concat("template", F.array(F.when(F.col("kept"), F.col("value")).otherwise("*")))).select(*names, "template", "salt")
        if many.isEmpty():
            return done


def judge_templates(counts: DataFrame, prior_weight: float = 4.0, max_bad: float = 0.6, z: float = 1.96) -> DataFrame:
    """(host, template, bad_rate, reject) of labelled ``counts`` (host, template, labelled, bad)."""
    # one number of the whole corpus: the smoothed rate of bad pages
    p0 = F.lit(counts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2)).alias("p0")).first().p0)
    root = F.xxhash64("host")
    keys = F.aggregate("template", F.struct(root.alias("last"), F.array(root).alias("out")), lambda acc, s: F.struct(F.xxhash64(acc["last"], s).alias("last"), F.concat(acc["out"], F.array(F.xxhash64(acc["last"], s))).alias("out")))["out"]
    leaves = counts.withColumn("keys", keys).withColumn("leaf", F.element_at("keys", -1))
    paths = leaves.select("host", "leaf", "labelled", "bad", "keys", F.posexplode("keys").alias("k", "node")).withColumn("parent", F.get("keys", F.col("k") - 1)).drop("keys")
    nodes = paths.groupBy("host", "node", "k", "parent").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    above = nodes.select("host", F.col("node").alias("parent"), F.col("labelled").alias("p_labelled"), F.col("bad").alias("p_bad"))
    rest = F.col("p_labelled") - F.col("labelled")
    pooled = F.col("p_bad") / F.nullif("p_labelled", F.lit(0))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif("labelled", F.lit(0)) + 1 / F.nullif(rest, F.lit(0))))
    gap = F.abs(F.col("bad") / F.nullif("labelled", F.lit(0)) - (F.col("p_bad") - F.col("bad")) / F.nullif(rest, F.lit(0)))
    # the host itself always counts; a branch with no labels, or all of its parent's, is its parent
    differs = F.when(F.col("parent").isNull(), True).when((F.col("labelled") == 0) | (rest == 0), False).otherwise(gap > z * error)
    flagged = nodes.join(above, ["host", "parent"], "left").where(differs).select("host", "node", "k", "labelled", "bad")
    of_leaf = paths.select("host", "leaf", "node").join(flagged, ["host", "node"]).groupBy("host", "leaf").agg(F.max_by(F.struct("labelled", "bad"), "k").alias("f"))
    rate = (F.col("f.bad") + prior_weight * p0) / (F.col("f.labelled") + prior_weight)
    return leaves.select("host", "template", "leaf").join(of_leaf, ["host", "leaf"]).select("host", "template", rate.alias("bad_rate"), (rate >= max_bad).alias("reject"))


MARKS = "#*$%|"


def page_labels(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", percent: int = 2) -> DataFrame:
    """(page_id, bad) of pages with html: bad if marks are ``percent`` or more of a hundred characters of its text."""
    html = F.regexp_replace(F.regexp_replace(F.col(html_col), r"(?is)<(script|style)\b.*?</\1>", " "), "(?s)<[^>]*>", " ")
    text = pages.select(F.col(id_col).alias("page_id"), html.alias("text")).where("text is not null")
    marks = F.length("text") - F.length(F.translate("text", MARKS, ""))
    return text.select("page_id", (100 * marks >= percent * F.greatest(F.length("text"), F.lit(1))).cast("int").alias("bad"))


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, max_children: int = 20, max_bad: float = 0.6) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, bad_rate) of every row; ``labels``: (page_id, bad)."""
    url = F.col(url_col)
    host, path = split_url(url)
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    shaped = materialize(split.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), shape(F.col("path")).alias("shape")))
    one = labels.select("page_id", F.col("bad").cast("int").alias("bad")).where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counts = shaped.join(one, "page_id", "left").groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = materialize(template_tree(counts, max_children))
    verdicts = judge_templates(tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), max_bad=max_bad)
    by_shape = tree.select("host", "shape", "template").join(verdicts, ["host", "template"]).select("host", "shape", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "bad_rate", "reject")
    judged = shaped.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted(by_shape), ["host", "shape", "salt"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("reject"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "bad_rate")
