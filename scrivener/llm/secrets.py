"""Secret scans with corpus-wide ownership frequency, in DataFrame expressions only.

Spans come from regular expressions: base kinds ``assign``, ``access`` and
``hex``, and the method's own kinds ``token`` (prefixed service tokens, signed
web tokens) and ``key`` (private keys from header to end line; the value is the
body without blanks, or the header where no end line follows).  Each span's value is hashed, and
every hash is counted over distinct owners and distinct repositories: a value
of ``copied_owners`` owners is a copied example, and so is one of several owners
and ``copied_repos`` repositories; what an owner alone holds looks live, in
however many of the owner's repositories.  Hashes are aggregated to distinct (hash, owner,
repository) before they meet, and a value's spans meet its counts in ``SALTS`` parts, so a
value copied everywhere is no hot key.  Values themselves are never written, only their hashes.

Places are found without positions from the regex engine: the text is split at
the matches, and running sums of the lengths of gaps and matches give starts and
ends in code points.

Cases: a null or empty text has no spans; null owners count as one owner of
their own; repeated rows repeat their results and count as one repository;
nothing else of the input is read, so clashing columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import materialize

# Patterns of the contract; lengths are tested after matching
ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# {16,} and {24,} find the same places as + with a test of the whole length: runs are maximal either way
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "(?:gh[pousr]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+)"
# header, body and end line; a body has single hyphens only (in its header lines), so no match runs into another key
KEY = "-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,64}-----END [A-Z ]*PRIVATE KEY-----)?"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN, "key": KEY}
AROUND_BODY = "-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----|\\s|\\\\[nr]"
BASE = ("assign", "access", "hex")
MIN_ASSIGNED = 6

SALTS = 16

_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value_hash:bigint>>"


CHUNK = 512


def pieces_of(text: Column, kind: str) -> Column:
    """array<struct<gap, whole, value>> of one kind's matches and the text before each; null without a match."""
    pattern = F.lit(KINDS[kind])
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else whole
    if kind == "key":
        value = F.transform(whole, lambda w: F.coalesce(F.nullif(F.regexp_replace(w, F.lit(AROUND_BODY), F.lit("")), F.lit("")), w))
    return F.when(F.rlike(text, pattern), F.arrays_zip(F.split(text, KINDS[kind], -1).alias("gap"), whole.alias("whole"), value.alias("value")))


def sums_before(lengths: Column) -> Column:
    """Sum of all elements before each, in chunks: appending to one long array would copy it for every element."""
    none = F.array().cast("array<int>")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), lambda i: F.slice(lengths, i * CHUNK + 1, CHUNK))

    def running(values: Column, start: Column) -> Column:
        first = F.struct(start.cast("int").alias("at"), none.alias("out"))
        return F.aggregate(values, first, lambda acc, x: F.struct((acc["at"] + x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(chunks, running(totals, F.lit(0)), running))


def spans_of(pieces: Column, before: Column, kind: str) -> Column:
    """array<struct<start, rank, kind, end, value_hash>> from ``pieces_of`` and the lengths before each piece."""
    rank = list(KINDS).index(kind)

    least = MIN_ASSIGNED if kind == "assign" else 1

    def span(p: Column, at: Column) -> Column:
        start = at + F.length(p["gap"])
        hashed = F.when(F.length(p["value"]) >= least, F.xxhash64(p["value"]))
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + F.length(p["whole"])).alias("end"), hashed.alias("value_hash"))

    # the last gap has no match behind it
    found = F.filter(F.zip_with(pieces, before, span), lambda s: s["value_hash"].isNotNull())
    return F.coalesce(found.cast(_SPAN), F.array().cast(_SPAN))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(rid, doc_id, owner, repo, spans) of every row, written once; ``rid`` names the row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    repo = F.xxhash64(*(F.col(c) for c in repo_cols), *(F.col(c).isNull() for c in repo_cols))
    keys = ["doc_id", "owner", "repo"]
    found = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(owner_col, F.col(owner_col).isNull()).alias("owner"), repo.alias("repo"), text.alias("text"))
    # one projection for each use of the last one's arrays, so that no pattern runs twice
    cut = found.select(*keys, *(pieces_of(F.col("text"), k).alias(k) for k in KINDS))
    length = lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["whole"]), F.lit(0))
    measured = cut.select(*keys, *KINDS, *(F.transform(k, length).alias(f"{k}_lengths") for k in KINDS))
    summed = measured.select(*keys, *KINDS, *(sums_before(F.col(f"{k}_lengths")).alias(f"{k}_before") for k in KINDS))
    spans = F.array_sort(F.concat(*(spans_of(F.col(k), F.col(f"{k}_before"), k) for k in KINDS)))
    return materialize(summed.select(F.monotonically_increasing_id().alias("rid"), *keys, spans.alias("spans")))


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repos) of every candidate value of ``find_spans``."""
    values = spans.where(F.size("spans") > 0).select(F.explode(F.col("spans.value_hash")).alias("value_hash"), "owner", "repo")
    by_repo = values.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), copied_owners: int = 3, copied_repos: int = 6) -> DataFrame:
    """(doc_id, spans with n_owners, n_repos and live) of every row.

    A span is ``live`` unless ``copied_owners`` owners hold its value, or two
    owners or more in ``copied_repos`` repositories.
    """
    rows = find_spans(docs, id_col, text_col, owner_col, repo_cols)
    hashed = rows.where(F.size("spans") > 0).select("rid", F.explode("spans").alias("s")).select("rid", "s", F.col("s.value_hash").alias("value_hash"), F.pmod(F.col("rid"), F.lit(SALTS)).cast("int").alias("salt"))
    counts = ownership(rows).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_owners") > 1) & (F.col("n_repos") >= copied_repos)
    judged = hashed.join(counts, ["value_hash", "salt"]).select("rid", F.struct("s.start", "s.rank", "s.kind", "s.end", "s.value_hash", "n_owners", "n_repos", (~copied).alias("live")).alias("s"))
    lists = judged.groupBy("rid").agg(F.array_sort(F.collect_list("s")).alias("judged"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value_hash:bigint,n_owners:bigint,n_repos:bigint,live:boolean>>")
    return rows.select("rid", "doc_id").join(lists, "rid", "left").select("doc_id", F.coalesce("judged", none).alias("spans"))


def digest_secrets(found: DataFrame) -> DataFrame:
    """The contract's columns from ``scan_secrets``, with counts of live and copied spans."""
    count = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)")
    joined = lambda array: F.expr(f"array_join(transform({array}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")
    base = "filter(spans, s -> s.kind in ({}))".format(", ".join(f"'{k}'" for k in BASE))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.expr("cast(size(filter(spans, s -> s.live)) as bigint)").alias("n_live"),
        F.expr("cast(size(filter(spans, s -> not s.live)) as bigint)").alias("n_copied"),
    )
