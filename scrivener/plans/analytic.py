"""Queries of text functions, ordered folds, sequences, ranking, matching, clustering and models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivener.functions import names, text
from scrivener.operators import cluster, dml, lines, match, rank, sequence, tagger
from scrivener.plans import inputs
from scrivener.plans.inputs import JOURNAL_LINES_SQL, PAGE_LINES_SQL, ROLES_SQL, TOKENS_SQL
from scrivener.plans.registry import query, table
from scrivener.plans.relational import EDGES_SQL
from scrivener.sources import readers

_P = text.PUNCTUATION.replace("'", "''")
_PB = text.PUNCTUATION_KEEP_BRACKET.replace("'", "''")
_B = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_WS = r"'[\t\n\v\f\r ]+'"


def _clean_sql(c: str) -> str:
    return f"trim(regexp_replace(trim({c}, '{_PB}'), {_WS}, ' ', 'g'), {_B})"


def _model_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(trim({c}, '{_P}'), '[\t\r\n()]', ' ', 'g'), ' +', ' ', 'g'), ' ')"


@query(f"WITH {JOURNAL_LINES_SQL} SELECT doc_id, pos, {_clean_sql('line')} AS line FROM journal_lines")
def o51_clean_line(spark, d):
    return inputs.journal_lines(spark, d).select("doc_id", "pos", text.clean_line(F.col("line")).alias("line"))


_SPACED = "replace(replace(replace(replace(replace(line, '<', ' <'), '>', '> '), ',', ' ,'), ':', ' : '), '  ', ' ')"


@query(f"WITH {JOURNAL_LINES_SQL} SELECT doc_id, pos, {_SPACED} AS line FROM journal_lines")
def o52_space_markup(spark, d):
    return inputs.journal_lines(spark, d).select("doc_id", "pos", text.space_markup(F.col("line")).alias("line"))


@query(f"WITH {JOURNAL_LINES_SQL} SELECT doc_id, pos, trim(line, '{_P}') AS line FROM journal_lines")
def o53_full_clean(spark, d):
    return inputs.journal_lines(spark, d).select("doc_id", "pos", text.full_clean(F.col("line")).alias("line"))


@query(f"WITH {JOURNAL_LINES_SQL} SELECT doc_id, pos, {_model_sql('line')} AS line FROM journal_lines")
def o54_clean_for_model(spark, d):
    return inputs.journal_lines(spark, d).select("doc_id", "pos", text.clean_for_model(F.col("line")).alias("line"))


@query(f"SELECT c_custkey, {_model_sql('c_name')} AS name FROM customer")
def o55_clean_for_tagger(spark, d):
    # ASCII input: decomposition changes nothing, so the oracle can follow; accents are tested in tests/
    return table(spark, d, "customer").select("c_custkey", text.clean_for_tagger(F.col("c_name")).alias("name"))


@query(rf"SELECT c_custkey, trim(regexp_replace(regexp_replace(trim('(' || c_name || ' ''x'' \"y\" z).', '{_P}'), '[\t\r\n()\"'']', ' ', 'g'), ' +', ' ', 'g'), ' ') AS name FROM customer".replace('\\"', '"'))
def o56_clean_name(spark, d):
    c = F.concat(F.lit("("), F.col("c_name"), F.lit(" 'x' \"y\" z)."))
    return table(spark, d, "customer").select("c_custkey", text.clean_name(c).alias("name"))


@query(rf"SELECT c_custkey, list_filter(list_transform(string_split(regexp_replace(t, '\((.*?)\)', ',\1,', 'g'), ','), lambda s: trim(s)), lambda s: s <> '') AS pieces FROM (SELECT c_custkey, c_name || ' (' || c_mktsegment || ', x), Chair' AS t FROM customer)")
def o57_split_line(spark, d):
    c = F.concat(F.col("c_name"), F.lit(" ("), F.col("c_mktsegment"), F.lit(", x), Chair"))
    return table(spark, d, "customer").select("c_custkey", text.split_line(c).alias("pieces"))


@query("SELECT c_custkey, list_filter([c_name, c_mktsegment, 'x', substr(', Chair and more', length(c_name || ' (' || c_mktsegment || ', x)') + 1)], lambda s: trim(s) <> '') AS pieces FROM customer")
def o57_split_line_literal(spark, d):
    c = F.concat(F.col("c_name"), F.lit(" ("), F.col("c_mktsegment"), F.lit(", x), Chair and more"))
    return table(spark, d, "customer").select("c_custkey", text.split_line(c, literal=True).alias("pieces"))


@query(r"SELECT o_orderkey, CASE WHEN regexp_extract(t, '\b(19|20)\d{2}') = '' THEN -1 ELSE CAST(regexp_extract(t, '\b(19|20)\d{2}') AS BIGINT) END AS year FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'TBD' ELSE 'Nov 16, ' || CAST(o_orderdate AS VARCHAR) END AS t FROM orders)")
def o58_year(spark, d):
    c = F.when(F.col("o_orderkey") % 5 == 0, "TBD").otherwise(F.concat(F.lit("Nov 16, "), F.col("o_orderdate").cast("string")))
    return table(spark, d, "orders").select("o_orderkey", text.year_of(c).cast("long").alias("year"))


_PERSONS = "CASE c_custkey % 4 WHEN 0 THEN 'Kan Min ' WHEN 1 THEN ' Min-Yen  Kan' WHEN 2 THEN 'Ann Lee' END"
_ORGS = "CASE c_custkey % 4 WHEN 0 THEN 'NUS' WHEN 1 THEN 'NUS' WHEN 2 THEN ' University of Lima' END"


@query(f"SELECT c_custkey, {_PERSONS} AS person, {_ORGS} AS org FROM customer WHERE c_custkey % 4 <> 3")
def o59_proceedings_formats(spark, d):
    m = F.col("c_custkey") % 4
    line = F.when(m == 0, "Kan Min (NUS, Singapore)").when(m == 1, "Kan, Min-Yen (NUS)").when(m == 2, "Ann Lee, U of Lima").otherwise("nothing here")
    found = table(spark, d, "customer").select("c_custkey", lines.proceedings_person_org(line).alias("f")).where("f is not null")
    return found.select("c_custkey", "f.person", "f.org")


@query(f"WITH {ROLES_SQL} SELECT role_type, CASE WHEN contains(lower(role_type), 'senior') OR contains(lower(role_type), 'chair') THEN 2 ELSE 1 END AS conference, 2 AS journal, CASE WHEN contains(lower(role_type), 'chief') OR contains(lower(role_type), 'senior') THEN 2 ELSE 1 END AS intended FROM (SELECT DISTINCT role_type FROM roles)")
def o74_role_scores(spark, d):
    r = inputs.roles(spark, d).select("role_type").distinct()
    s = lambda kind, literal=True: names.role_score(F.lit(kind), F.col("role_type"), literal)
    return r.select("role_type", s("conference").alias("conference"), s("journal").alias("journal"), s("journal", False).alias("intended"))


_T = "string_split({}, ' ')"
_DISTANCE = (
    f"CASE WHEN len({_T.format('b')}) > 1 AND len(list_filter({_T.format('b')}, lambda x: NOT list_contains({_T.format('a')}, x))) = 0 THEN 1 ELSE least(levenshtein(lower(a), lower(b)), "
    f"levenshtein(lower(array_to_string(list_concat(list_slice({_T.format('a')}, 2, 99), list_slice({_T.format('a')}, 1, 1)), ' ')), lower(b)), "
    f"levenshtein(lower(array_to_string(list_concat(list_slice({_T.format('a')}, len({_T.format('a')}), 99), list_slice({_T.format('a')}, 1, len({_T.format('a')}) - 1)), ' ')), lower(b))) END"
)


@query(f"WITH n AS (SELECT DISTINCT p_name FROM part) SELECT x.p_name AS a, y.p_name AS b, {_DISTANCE.replace('(a)', '(x.p_name)').replace('(b)', '(y.p_name)').replace('(a,', '(x.p_name,').replace('(b,', '(y.p_name,')} AS distance FROM n x JOIN n y ON substr(x.p_name, 1, 1) = substr(y.p_name, 1, 1)")
def o75_name_distance(spark, d):
    n = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct().withColumn("k", F.substring("a", 1, 1))
    return n.join(n.select(F.col("a").alias("b"), "k"), "k").select("a", "b", names.name_distance(F.col("a"), F.col("b")).cast("long").alias("distance"))


@query(f"WITH {JOURNAL_LINES_SQL} SELECT doc_id, pos, len(string_split(line, ' ')) AS n, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) / len(w) ELSE 0 END, 9) AS caps FROM (SELECT *, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM journal_lines)")
def o76_line_shape(spark, d):
    return inputs.journal_lines(spark, d).select("doc_id", "pos", text.num_tokens(F.col("line")).cast("long").alias("n"), F.round(text.percent_cap(F.col("line")), 9).alias("caps"))


@query(f"WITH {JOURNAL_LINES_SQL} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http://h.org/a/x' || page_id ELSE 'https://o.org/y' END AS absolute FROM pages")
def o77_absolute_url(spark, d):
    from scrivener.functions.web import absolute_url

    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("x"), F.col("page_id").cast("string"))).otherwise("https://o.org/y")
    return table(spark, d, "pages").select("page_id", absolute_url(F.lit("http://h.org/a/b?q"), link).alias("absolute"))


@query("SELECT l_orderkey, l_linenumber, abs(l_discount - l_tax) AS gap, greatest(l_discount, l_tax) AS top, CAST(floor(l_quantity * 8 / 10) AS BIGINT) AS part FROM lineitem")
def o79_arithmetic(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"), F.greatest("l_discount", "l_tax").alias("top"), F.floor(F.col("l_quantity") * 8 / 10).alias("part"))


@query("SELECT doc_id, list_filter(string_split(text, ' '), lambda x, i: i % 2 = 1) AS words, list_filter(string_split(text, ' '), lambda x, i: i % 2 = 0) AS tags FROM documents")
def o09_o95_interleaved(spark, d):
    t = F.split("text", " ", -1)
    return table(spark, d, "documents").select("doc_id", text.interleaved(t, 0).alias("words"), text.interleaved(t, 1).alias("tags"))


# ---- ordered folds

_BLOCKS_SQL = f"""{PAGE_LINES_SQL},
  seg AS (SELECT *, last_value(CASE WHEN label = 'Role-Label' THEN id END IGNORE NULLS) OVER w AS role_id, last_value(CASE WHEN label = 'Role-Label' THEN num END IGNORE NULLS) OVER w AS role_num,
    last_value(CASE WHEN label = 'Role-Label' THEN indent END IGNORE NULLS) OVER w AS role_indent FROM page_lines WINDOW w AS (PARTITION BY conf_id ORDER BY page_id, id)),
  near AS (SELECT *, row_number() OVER (PARTITION BY conf_id, role_id ORDER BY id) AS k FROM seg WHERE label <> 'Role-Label' AND role_id IS NOT NULL AND abs(indent - role_indent) < 12),
  fold AS (
    SELECT conf_id, role_id, id, k, num, abs(num - role_num) < 10 AS ok, CASE WHEN abs(num - role_num) < 10 THEN num ELSE role_num END AS prev FROM near WHERE k = 1
    UNION ALL
    SELECT n.conf_id, n.role_id, n.id, n.k, n.num, abs(n.num - f.prev) < 10, CASE WHEN abs(n.num - f.prev) < 10 THEN n.num ELSE f.prev END FROM fold f JOIN near n ON n.conf_id = f.conf_id AND n.role_id = f.role_id AND n.k = f.k + 1),
  blocks AS (SELECT n.conf_id, n.role_id, n.page_id, n.id, n.num, n.indent, n.label, n.line_text AS text FROM fold f JOIN near n USING (conf_id, role_id, id) WHERE f.ok)"""


def _blocks(spark, d):
    found = inputs.page_lines(spark, d).withColumnRenamed("line_text", "text")
    return lines.role_blocks(found)


@query(f"WITH RECURSIVE {_BLOCKS_SQL} SELECT conf_id, role_id, id, label FROM blocks")
def o100_role_blocks(spark, d):
    return _blocks(spark, d).select("conf_id", "role_id", "id", "label")


def _same_line(spark, d):
    """Blocks whose lines share numbers in pairs."""
    found = inputs.page_lines(spark, d).where("label in ('Person', 'Affiliation')").withColumnRenamed("line_text", "text")
    return found.select("conf_id", F.lit(1).cast("long").alias("role_id"), "page_id", "id", F.floor(F.col("num") / 2).cast("long").alias("num"), "indent", "label", "text")


@query(f"""WITH {PAGE_LINES_SQL}, b AS (SELECT conf_id, id, CAST(floor(num / 2) AS BIGINT) AS num, label, line_text AS text FROM page_lines WHERE label IN ('Person', 'Affiliation')),
  w AS (SELECT *, lead(num) OVER o AS nn, lead(label) OVER o AS nl, lead(text) OVER o AS nt, lag(num) OVER o AS pn, lag(label) OVER o AS pl FROM b WINDOW o AS (PARTITION BY conf_id ORDER BY id))
SELECT conf_id, id, num, CASE WHEN label = 'Person' AND nn = num AND nl <> 'Person' THEN 'Complex' ELSE label END AS label,
  CASE WHEN label = 'Person' AND nn = num AND nl <> 'Person' THEN {_clean_sql("text || ', ' || nt")} ELSE text END AS text
FROM w WHERE NOT coalesce(label <> 'Person' AND pn = num AND pl = 'Person', false)""")
def o101_merge_same_line(spark, d):
    return lines.merge_same_line(_same_line(spark, d)).select("conf_id", "id", "num", "label", "text")


_PAIR_BASE = f"""{PAGE_LINES_SQL}, b AS (SELECT conf_id, id, label, line_text AS text, lag(label) OVER o AS pl, lag(line_text) OVER o AS pt, lag(id) OVER o AS pi, lead(label) OVER o AS nl
  FROM page_lines WHERE label IN ('Person', 'Affiliation') WINDOW o AS (PARTITION BY conf_id ORDER BY id))"""
_PAIR_SQL = "SELECT conf_id, pi AS id, pt AS person, text AS affiliation FROM b WHERE label = 'Affiliation' AND pl = 'Person' UNION ALL SELECT conf_id, id, text, NULL FROM b WHERE label = 'Person' AND "


@query(f"WITH {_PAIR_BASE} {_PAIR_SQL} coalesce(nl, 'Person') = 'Person'")
def o102_person_affiliations(spark, d):
    return lines.person_affiliations(_same_line(spark, d)).select("conf_id", "id", "person", "affiliation")


@query(f"WITH {_PAIR_BASE} {_PAIR_SQL} pl = 'Person'")
def o102_person_affiliations_literal(spark, d):
    return lines.person_affiliations(_same_line(spark, d), literal=True).select("conf_id", "id", "person", "affiliation")


_RUN_TEXT = "CASE WHEN id % 4 = 0 THEN line_text || ' a b c d e' ELSE line_text END"


@query(f"""WITH {PAGE_LINES_SQL}, b AS (SELECT conf_id, id, label, {_RUN_TEXT} AS text, sum(CASE WHEN label <> 'Person' THEN 1 ELSE 0 END) OVER (PARTITION BY conf_id ORDER BY id) AS island,
    sum(CASE WHEN label <> 'Person' THEN 1 ELSE 0 END) OVER (PARTITION BY conf_id) AS final FROM page_lines),
  r AS (SELECT *, max(CASE WHEN len(string_split(text, ' ')) > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY conf_id, island ORDER BY id) AS in_run FROM b WHERE label = 'Person')
SELECT conf_id, 'run' AS kind, string_agg(text, ' ' ORDER BY id) AS text FROM r WHERE in_run = 1 AND island < final GROUP BY conf_id, island
UNION ALL SELECT conf_id, 'single', text FROM r WHERE in_run = 0""")
def o103_person_runs(spark, d):
    found = inputs.page_lines(spark, d).select("conf_id", F.lit(1).alias("role_id"), "page_id", "id", "label", F.when(F.col("id") % 4 == 0, F.concat("line_text", F.lit(" a b c d e"))).otherwise(F.col("line_text")).alias("text"))
    return lines.person_runs(found).select("conf_id", "kind", "text")


@query("SELECT c_custkey, name FROM (SELECT c_custkey, unnest(['Ann Lee', 'Bo Chan', 'Cy Dorn' || (c_custkey % 9)]) AS name FROM customer)")
def o104_persons_of_run(spark, d):
    run = F.concat(F.lit("Ann Lee, Zed龰, Bo Chan Cy Dorn"), (F.col("c_custkey") % 9).cast("string"))
    return table(spark, d, "customer").select("c_custkey", F.explode(lines.persons_of_run(run)).alias("name"))


@query(f"WITH {PAGE_LINES_SQL} SELECT conf_id, id, CAST(dense_rank() OVER (PARTITION BY conf_id ORDER BY label) - 1 AS BIGINT) AS tag_id FROM page_lines")
def o113_encode_tags(spark, d):
    found = inputs.page_lines(spark, d).select("conf_id", "id", F.col("conf_id").alias("page_id"), F.col("label").alias("tag"))
    return lines.encode_tags(found).select("conf_id", "id", F.col("tag_id").cast("long").alias("tag_id"))


# ---- token sequences

_ROLE_SQL = f"""{TOKENS_SQL}, t AS (SELECT sent AS line, CAST(floor(sent / 1000) AS BIGINT) AS conv, pos, word, tag, tag LIKE '%ROLE' AS is_role FROM tokens),
  s AS (SELECT *, is_role AND NOT coalesce(lag(is_role) OVER (PARTITION BY conv, line ORDER BY pos), false) AS starts FROM t),
  p AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY conv, line ORDER BY pos) AS phrase FROM s),
  n AS (SELECT conv, line, phrase, string_agg(word, ' ' ORDER BY pos) AS role, min(pos) AS pos FROM p WHERE is_role GROUP BY ALL),
  m AS (SELECT conv, line, pos, word, tag, phrase, NULL AS role FROM p WHERE NOT is_role UNION ALL SELECT conv, line, pos, NULL, NULL, phrase, role FROM n),
  roled AS (SELECT conv, line, pos, word, tag, phrase, coalesce(last_value(role IGNORE NULLS) OVER (PARTITION BY conv ORDER BY line, pos), 'editor') AS role FROM m QUALIFY word IS NOT NULL)"""
_ENTITY_SQL = f"""{_ROLE_SQL}, k AS (SELECT *, string_split(tag, '-')[-1] AS kind FROM roled),
  f AS (SELECT *, NOT (lag(kind) OVER o IS NOT DISTINCT FROM kind AND lag(phrase) OVER o = phrase) AS fresh FROM k WINDOW o AS (PARTITION BY conv, line ORDER BY pos)),
  g AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY conv, line ORDER BY pos) AS ent FROM f),
  ents AS (SELECT conv, line, kind, role, min(pos) AS pos, string_agg(word, ' ' ORDER BY pos) AS text FROM g WHERE kind IN ('PER', 'ORG') GROUP BY conv, line, ent, kind, role)"""


def _roled(spark, d):
    t = inputs.tokens(spark, d).select(F.floor(F.col("sent") / 1000).alias("conv"), F.col("sent").alias("line"), "pos", "word", "tag")
    return sequence.propagate_roles(t, ["conv"])


@query(f"WITH {_ROLE_SQL} SELECT conv, line, pos, word, role FROM roled")
def o105_propagate_roles(spark, d):
    return _roled(spark, d).select("conv", "line", "pos", "word", "role")


@query(f"WITH {_ENTITY_SQL}, l AS (SELECT *, lag(kind) OVER o AS pk, lag(text) OVER o AS name FROM ents WINDOW o AS (PARTITION BY conv ORDER BY line, pos)) SELECT conv, line, role, name, text AS affiliation FROM l WHERE kind = 'ORG' AND pk = 'PER'")
def o106_pair_entities(spark, d):
    return sequence.pair_entities(sequence.entities(_roled(spark, d), ["conv"]), ["conv"]).select("conv", "line", "role", "name", "affiliation")


_RECT_SQL = f"""{TOKENS_SQL}, m AS (SELECT *, word IN ('the', 'of') AS seed, word IN ('the', 'of') OR regexp_matches(word, '^\\p{{L}}+$') AS inside FROM tokens),
  i AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY sent ORDER BY pos) AS isle FROM m),
  h AS (SELECT *, inside AND max(CAST(seed AS INT)) OVER g = 1 AS hit, min(pos) OVER g = pos AS first, max(pos) OVER g = pos AS last FROM i WINDOW g AS (PARTITION BY sent, isle, inside)),
  rect AS (SELECT sent, pos, word, tag, CASE WHEN NOT hit THEN tag WHEN last THEN 'E-PER' WHEN first THEN 'B-PER' ELSE 'I-PER' END AS new_tag FROM h)"""


@query(f"WITH {_RECT_SQL} SELECT * FROM rect")
def o107_rectify(spark, d):
    return sequence.rectify(inputs.tokens(spark, d), F.col("word").isin("the", "of"), "PER")


@query(f"WITH {_RECT_SQL} SELECT * FROM rect WHERE tag <> new_tag")
def o39_change_log(spark, d):
    return sequence.change_log(sequence.rectify(inputs.tokens(spark, d), F.col("word").isin("the", "of"), "PER"))


_BIO_CASE = "CASE WHEN regexp_matches(word, '^[A-Z]') THEN 'B-PER' WHEN length(word) % 3 = 0 THEN 'I-PER' ELSE 'O' END"


@query(f"""WITH {TOKENS_SQL}, b AS (SELECT sent, pos, word, {_BIO_CASE} AS tag FROM tokens), n AS (SELECT *, sum(CASE WHEN tag LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY sent ORDER BY pos) AS entity FROM b)
SELECT sent, CAST(entity AS BIGINT) AS entity, 'PER' AS kind, string_agg(word, ' ' ORDER BY pos) AS text FROM n WHERE tag <> 'O' AND entity > 0 GROUP BY sent, entity""")
def o108_decode_bio(spark, d):
    tag = F.when(F.rlike("word", F.lit("^[A-Z]")), "B-PER").when(F.length("word") % 3 == 0, "I-PER").otherwise("O")
    return sequence.decode_bio(inputs.tokens(spark, d).withColumn("tag", tag))


@query("""WITH x AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda w: w <> '' AND NOT regexp_matches(w, '^<[^<>]+>$')) AS w FROM conversations),
  y AS (SELECT conv_id, turn, list_transform(w, lambda x, i: x || CASE WHEN i % 3 = 1 THEN ' B-PER' ELSE ' O' END) AS lines FROM x)
SELECT conv_id, turn, CASE WHEN len(lines) % 3 = 1 THEN lines ELSE list_slice(lines, 1, len(lines) - 1) END AS lines FROM y""")
def o109_inline_to_conll(spark, d):
    words = F.filter(F.split("text", " ", -1), lambda w: (w != "") & ~F.rlike(w, F.lit(sequence.INLINE_TAG)))
    # every third word is tagged
    line = F.array_join(F.transform(words, lambda w, i: F.when(i % 3 == 0, F.concat(w, F.lit(" <B-PER>"))).otherwise(w)), " ")
    return table(spark, d, "conversations").select("conv_id", "turn", sequence.to_conll(line).alias("lines"))


@query("SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM documents")
def o109_split(spark, d):
    return table(spark, d, "documents").select("doc_id", sequence.split_of(F.col("doc_id")).alias("split"))


_SPANS = """{n} AS (WITH k AS (SELECT sent, pos, {tag} AS t FROM tokens), q AS (SELECT *, CASE WHEN t <> 'O' THEN string_split(t, '-')[-1] END AS kind FROM k),
    s AS (SELECT *, t LIKE 'S-%' OR lag(kind) OVER o IS DISTINCT FROM kind OR coalesce(lag(t) OVER o LIKE 'S-%', false) AS fresh FROM q WINDOW o AS (PARTITION BY sent ORDER BY pos)),
    c AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY sent ORDER BY pos) AS span FROM s)
  SELECT sent, kind, min(pos) AS first, max(pos) AS last FROM c WHERE kind IS NOT NULL GROUP BY sent, span, kind)"""
_GUESS = "CASE WHEN pos % 5 = 0 THEN 'O' ELSE tag END"


@query(f"WITH {TOKENS_SQL}, {_SPANS.format(n='gold', tag='tag')} SELECT * FROM gold")
def o110_bies_spans(spark, d):
    return sequence.bies_spans(inputs.tokens(spark, d))


@query(f"""WITH {TOKENS_SQL}, {_SPANS.format(n='gold', tag='tag')}, {_SPANS.format(n='guess', tag=_GUESS)},
  g AS (SELECT kind, count(*) AS gold FROM gold GROUP BY 1), p AS (SELECT kind, count(*) AS predicted FROM guess GROUP BY 1), b AS (SELECT kind, count(*) AS correct FROM gold JOIN guess USING (sent, kind, first, last) GROUP BY 1)
, k AS (SELECT * FROM g JOIN p USING (kind) JOIN b USING (kind) UNION ALL SELECT 'micro avg', (SELECT count(*) FROM gold), (SELECT count(*) FROM guess), (SELECT count(*) FROM gold JOIN guess USING (sent, kind, first, last))),
  s AS (SELECT kind, gold, predicted, correct, correct / predicted AS p, correct / gold AS r, 2 * (correct / predicted) * (correct / gold) / (correct / predicted + correct / gold) AS f FROM k)
SELECT kind, gold, predicted, correct, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1 FROM s
UNION ALL SELECT 'macro avg', CAST(sum(gold) AS BIGINT), CAST(sum(predicted) AS BIGINT), CAST(sum(correct) AS BIGINT), round(sum(p * gold) / sum(gold), 9), round(sum(r * gold) / sum(gold), 9), round(sum(f * gold) / sum(gold), 9) FROM s WHERE kind <> 'micro avg'""")
def o91_span_report(spark, d):
    t = inputs.tokens(spark, d)
    guess = t.withColumn("tag", F.when(F.col("pos") % 5 == 0, "O").otherwise(F.col("tag")))
    r = sequence.span_report(sequence.bies_spans(t), sequence.bies_spans(guess))
    return r.select("kind", "gold", "predicted", "correct", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""WITH {JOURNAL_LINES_SQL}, c AS (SELECT doc_id, pos, line, trim(line) = '' OR length(line) < 60 AS cut FROM journal_lines),
  n AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sent FROM c)
SELECT doc_id AS doc, CAST(sent AS BIGINT) AS sent, CAST(row_number() OVER (PARTITION BY doc_id, sent ORDER BY pos) - 1 AS BIGINT) AS pos, string_split(trim(line), ' ')[1] AS word, string_split(trim(line), ' ')[-1] AS tag FROM n WHERE NOT cut""")
def o07_o08_conll_tokens(spark, d):
    rows = inputs.journal_lines(spark, d).select(F.col("doc_id").alias("doc"), F.col("pos").alias("n"), F.when(F.length("line") < 60, "").otherwise(F.col("line")).alias("line"))
    out = sequence.conll_tokens(rows)
    return out.select("doc", "sent", F.col("pos").cast("long").alias("pos"), "word", "tag")


@query(f"WITH {TOKENS_SQL} SELECT sent, string_agg(word || ' ' || tag, chr(10) ORDER BY pos) AS block FROM tokens GROUP BY sent")
def o37_conll_text(spark, d):
    line = F.concat_ws(" ", "word", "tag")
    rows = inputs.tokens(spark, d).groupBy("sent").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("rows"))
    return rows.select("sent", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("block"))


_LEX = "lex AS (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS n, n_name || ' Tech Lab' AS content FROM nation)"


@query(f"""WITH {TOKENS_SQL}, {_LEX}, m AS (SELECT *, tag LIKE '%-ORG' AS mine FROM tokens), s AS (SELECT *, mine AND NOT coalesce(lag(mine) OVER (PARTITION BY sent ORDER BY pos), false) AS st, max(pos) OVER (PARTITION BY sent) AS last FROM m),
  r AS (SELECT *, sum(CAST(st AS INT)) OVER (PARTITION BY sent ORDER BY pos) AS run FROM s), f AS (SELECT sent, min(pos) AS a, max(pos) AS b, max(last) AS last FROM r WHERE mine AND run = 1 GROUP BY sent HAVING max(pos) < max(last)),
  e AS (SELECT sent, a, string_split(content, ' ') AS w FROM f JOIN lex ON lex.n = f.sent % (SELECT count(*) FROM lex))
SELECT r.sent, r.pos, CAST(0 AS BIGINT) AS sub, word, tag FROM r LEFT JOIN f USING (sent) WHERE (a IS NULL OR pos < a OR pos > b) AND (coalesce(pos = b + 1, false) OR (r.sent * 31 + pos * 17) % 100 < 20)
UNION ALL SELECT sent, a, CAST(i - 1 AS BIGINT), w[i], CASE WHEN i = 1 THEN 'B-ORG' WHEN i = len(w) THEN 'E-ORG' ELSE 'I-ORG' END FROM (SELECT sent, a, w, unnest(range(1, len(w) + 1)) AS i FROM e)""")
def o157_augment(spark, d):
    lex = dml.numbered(table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(" Tech Lab")).alias("content")), ["n_nationkey"], "n", 0).select("n", "content")
    out = sequence.augment(inputs.tokens(spark, d), lex, "ORG")
    return out.select("sent", "pos", F.col("sub").cast("long").alias("sub"), "word", "tag")


@query(f"""WITH {_LEX}, p AS (SELECT c_custkey AS sent, c_name AS person FROM customer), r AS (SELECT CAST(r_regionkey AS BIGINT) AS n, r_name || ' Chair' AS role FROM region),
  j AS (SELECT sent, person, content AS org, role FROM p LEFT JOIN lex ON lex.n = sent % (SELECT count(*) FROM lex) LEFT JOIN r ON r.n = sent % (SELECT count(*) FROM r)),
  t AS (SELECT sent, list_concat(list_transform(string_split(person, ' '), lambda w, i: w || '|' || CASE WHEN i = 1 THEN 'B-PER' ELSE 'I-PER' END),
    CASE WHEN sent % 10 < 8 THEN list_transform(string_split(org, ' '), lambda w, i: w || '|' || CASE WHEN i = 1 THEN 'B-ORG' ELSE 'I-ORG' END) ELSE list_transform(string_split(role, ' '), lambda w, i: w || '|' || CASE WHEN i = 1 THEN 'B-ROLE' ELSE 'I-ROLE' END) END) AS x FROM j)
SELECT sent, CAST(i - 1 AS BIGINT) AS pos, string_split(x[i], '|')[1] AS word, string_split(x[i], '|')[2] AS tag FROM (SELECT sent, x, unnest(range(1, len(x) + 1)) AS i FROM t)""")
def o158_synthesize(spark, d):
    lex = dml.numbered(table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(" Tech Lab")).alias("content")), ["n_nationkey"], "n", 0).select("n", "content")
    roles = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("n"), F.concat("r_name", F.lit(" Chair")).alias("content"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.col("c_name").alias("content"))
    return sequence.synthesize(people, lex, roles).select("sent", F.col("pos").cast("long").alias("pos"), "word", "tag")


# ---- relations, ranking, matching, clustering


@query(f"WITH {TOKENS_SQL} SELECT sent AS line_id, arg_min(word, pos) FILTER (WHERE tag = 'S-PER') AS person, arg_min(word, pos) FILTER (WHERE tag = 'S-ORG') AS org FROM tokens GROUP BY sent HAVING count(*) FILTER (WHERE tag LIKE 'S-%') > 0")
def o160_complex_relations(spark, d):
    parts = inputs.tokens(spark, d).select(F.lit(1).alias("conf_id"), F.col("sent").alias("line_id"), F.lit(0).alias("part"), F.col("pos").alias("span"), F.regexp_replace("tag", "^S-", "").alias("tag"), F.col("word").alias("text"))
    return lines.complex_relations(parts).select("line_id", "person", "org")


@query(f"WITH {_PAIR_BASE} SELECT conf_id, trim(pt, '{_P}') AS person, CASE WHEN id % 2 = 0 THEN 'Org ' || id END AS org FROM b WHERE label = 'Affiliation' AND pl = 'Person'")
def o161_o165_relations(spark, d):
    pairs = lines.person_affiliations(_same_line(spark, d)).where("affiliation is not null").select("conf_id", "role_id", "person", "affiliation", "id")
    b = inputs.page_lines(spark, d).where("label = 'Affiliation'").select("conf_id", F.col("line_text").alias("text"), "id")
    w = Window.partitionBy("conf_id").orderBy("id")
    own = _same_line(spark, d).select("conf_id", "id", "label", F.lag("label").over(w).alias("pl"), F.lag("id").over(w).alias("pi")).where("label = 'Affiliation' and pl = 'Person'")
    keyed = pairs.join(own.select("conf_id", F.col("pi").alias("id"), F.col("id").alias("line")), ["conf_id", "id"])
    ents = b.where("id % 2 = 0").select("conf_id", F.col("id").cast("string").alias("affiliation"), F.concat(F.lit("Org "), F.col("id").cast("string")).alias("org"), F.lit(None).cast("string").alias("location"))
    return lines.relations(keyed.withColumn("affiliation", F.col("line").cast("string")), ents).select("conf_id", "person", "org")


@query(f"WITH {PAGE_LINES_SQL} SELECT id, person FROM (SELECT id, trim(CASE WHEN id % 5 = 0 THEN line_text || chr(40880) ELSE line_text END, '{_P}') AS person FROM page_lines WHERE label = 'Person') WHERE NOT regexp_matches(person, '[\\x{{4e00}}-\\x{{9fff}}]') AND len(string_split(person, ' ')) < 5 AND length(person) < 20")
def o163_o164_valid_persons(spark, d):
    c = text.full_clean(F.when(F.col("id") % 5 == 0, F.concat("line_text", F.lit("龰"))).otherwise(F.col("line_text")))
    return inputs.page_lines(spark, d).where("label = 'Person'").select("id", c.alias("person")).where(names.valid_person_name(F.col("person")))


def _rank_sql(iterations: int) -> str:
    ctes = [ROLES_SQL.strip(), EDGES_SQL.strip(), "p0 AS (SELECT DISTINCT person_id, CAST(1.0 AS DOUBLE) AS p FROM edges)"]
    for k in range(1, iterations + 1):
        ctes.append(f"v{k} AS MATERIALIZED (SELECT doc_type, doc_id, 0.15 + 0.85 * sum(to_venue * p) AS v FROM edges JOIN p{k - 1} USING (person_id) GROUP BY ALL)")
        ctes.append(f"p{k} AS MATERIALIZED (SELECT person_id, 0.15 + 0.85 * sum(to_person * v) AS p FROM edges JOIN v{k} USING (doc_type, doc_id) GROUP BY ALL)")
    return f"WITH {', '.join(ctes)} SELECT doc_type AS kind, doc_id AS id, round(CAST(v AS DOUBLE), 6) AS pr_score FROM v{iterations} UNION ALL SELECT 'person', person_id, round(CAST(p AS DOUBLE), 6) FROM p{iterations}"


@query(_rank_sql(30))
def o140_page_rank(spark, d):
    scores = rank.page_rank(rank.weighted_edges(inputs.roles(spark, d)))
    return scores.select("kind", "id", F.round("pr_score", 6).alias("pr_score"))


@query(f"WITH n AS (SELECT DISTINCT p_name FROM part), k AS (SELECT c_custkey, c_custkey % (SELECT count(*) FROM n) AS k FROM customer), m AS (SELECT c_custkey, x.p_name AS a, y.p_name AS b FROM k JOIN (SELECT p_name, row_number() OVER (ORDER BY p_name) AS r FROM n) x ON x.r = k + 1 JOIN (SELECT p_name, row_number() OVER (ORDER BY p_name) AS r FROM n) y ON y.r BETWEEN k AND k + 2) SELECT c_custkey AS person_id, b AS name, {_DISTANCE} AS distance FROM m WHERE {_DISTANCE} < 3")
def o71_fuzzy_matches(spark, d):
    n = dml.numbered(table(spark, d, "part").select("p_name").distinct(), ["p_name"], "r")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % n.agg(F.count("*")).scalar()).alias("k"))
    persons = c.join(n, F.col("r") == F.col("k") + 1).select("id", F.col("p_name").alias("name"))
    cand = c.select(F.col("id").alias("person_id"), F.explode(F.array(*(F.col("k") + i for i in range(3)))).alias("r")).join(n, "r").select("person_id", F.col("p_name").alias("name"))
    return match.fuzzy_matches(persons, cand).select("person_id", "name", F.col("distance").cast("long").alias("distance"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'kept' ELSE 'o' || c_custkey || '-0' END AS orcid, 'd' || c_custkey || '-1' AS dblp_id FROM customer")
def o154_enrich(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    null = F.lit(None).cast("string")
    persons = c.select("id", F.when(F.col("id") % 3 == 0, "kept").alias("orcid"), null.alias("gscholar_id"), null.alias("aminer_id"), null.alias("dblp_id"))
    found = c.select(F.col("id").alias("person_id"), F.explode(F.array(*(F.struct(F.lit(t).alias("type"), F.concat(F.lit(t[0]), F.col("id").cast("string"), F.lit(f"-{r}")).alias("id"), F.lit(r).alias("rank")) for t, r in (("orcid", 0), ("orcid", 1), ("dblp", 2), ("dblp", 1))))).alias("m"))
    return match.enrich(persons, found.select("person_id", "m.type", "m.id", "m.rank")).select("id", "orcid", "dblp_id")


_NAMES = "names AS (SELECT CAST(row_number() OVER (ORDER BY p_name) - 1 AS BIGINT) AS id, p_name AS name FROM (SELECT DISTINCT p_name FROM part))"
_TFIDF = rf"""{_NAMES}, w AS (SELECT id, regexp_extract_all(lower(name), '\w\w+') AS w FROM names),
  t AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w) GROUP BY ALL),
  f AS (SELECT term, count(*) AS df FROM t GROUP BY 1), raw AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM names)) / (1 + df)) + 1) AS x FROM t JOIN f USING (term)),
  vec AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM raw)"""


def _names(spark, d):
    return dml.numbered(table(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), ["name"], start=0).select("id", "name")


@query(f"WITH {_TFIDF} SELECT id, term, round(weight, 9) AS weight FROM vec")
def o150_tf_idf(spark, d):
    return cluster.tf_idf(_names(spark, d)).select("id", "term", F.round("weight", 9).alias("weight"))


@query(f"WITH {_TFIDF} SELECT a.id AS a, b.id AS b, round(sum(a.weight * b.weight), 6) AS cosine FROM vec a JOIN vec b ON a.term = b.term AND a.id < b.id GROUP BY ALL HAVING sum(a.weight * b.weight) > 0.15")
def o151_similar_pairs(spark, d):
    return cluster.similar_pairs(cluster.tf_idf(_names(spark, d)), 0.15).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query()
def o151_ward_clusters(spark, d):
    return cluster.cluster_names(_names(spark, d), 1.3)


@query("SELECT s_nationkey, s_name, min(s_name) OVER (PARTITION BY s_nationkey) AS representative FROM supplier")
def o70_o152_representative(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", "s_name")
    reps = s.groupBy("s_nationkey").agg(F.min("s_name").alias("representative"))
    return s.join(reps, "s_nationkey").select("s_nationkey", "s_name", "representative")


@query(f"WITH {ROLES_SQL} SELECT DISTINCT doc_id AS conf_id, person_id AS person, r_name AS org, role_type AS role FROM roles JOIN customer ON c_custkey = person_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def o153_consolidate(spark, d):
    clusters = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("representative"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("person_id"), F.col("n_name").alias("org"))
    facts = inputs.roles(spark, d).join(c, "person_id").select(F.col("doc_id").alias("conf_id"), F.col("person_id").alias("person"), "org", F.col("role_type").alias("role"))
    return cluster.consolidate(facts, clusters)


_CRAWLED = "crawled AS (SELECT o_orderkey AS seq, 'C' || (o_custkey % 50) AS name, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Org ' || (o_orderkey % 11) END AS affiliation, o_orderpriority AS role, 'J' || (o_orderkey % 3) AS title FROM orders)"


def _crawled(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    s = lambda c: c.cast("string")
    rows = o.select(k.alias("seq"), F.concat(F.lit("C"), s(F.col("o_custkey") % 50)).alias("name"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("Org "), s(k % 11))).alias("affiliation"), F.col("o_orderpriority").alias("role"), F.concat(F.lit("J"), s(k % 3)).alias("title"))
    return dml.load_crawled(rows, spark.createDataFrame([("J0", 0), ("J1", 1)], "title string, id long"))


@query(f"""WITH {_CRAWLED}, p AS (SELECT name, row_number() OVER (ORDER BY min(seq), name) AS id FROM crawled WHERE name <> '' GROUP BY name), o AS (SELECT affiliation AS name, row_number() OVER (ORDER BY min(seq), affiliation) AS id FROM crawled WHERE affiliation <> '' GROUP BY affiliation),
  f AS (SELECT name, arg_min(affiliation, seq) AS affiliation FROM crawled GROUP BY name)
SELECT CAST(p.id AS BIGINT) AS person_id, CAST(o.id AS BIGINT) AS org_id FROM f JOIN p USING (name) JOIN o ON o.name = f.affiliation""")
def o155_affiliations_of_crawled(spark, d):
    return _crawled(spark, d)["person_organization"]


@query(f"""WITH {_CRAWLED}, p AS (SELECT name, row_number() OVER (ORDER BY min(seq), name) AS id FROM crawled WHERE name <> '' GROUP BY name)
SELECT seq, role AS role_type, CASE title WHEN 'J0' THEN 0 WHEN 'J1' THEN 1 END AS doc_id, CAST(p.id AS BIGINT) AS person_id FROM crawled JOIN p USING (name)""")
def o155_roles_of_crawled(spark, d):
    return _crawled(spark, d)["person_role"].select("seq", "role_type", "doc_id", "person_id")


# ---- pages and models


@query("SELECT page_id, 'Title ' || page_id AS line_text, 'b' AS tag, 2 AS indentation FROM pages UNION ALL SELECT page_id, url, 'p', 2 FROM pages")
def o96_html_lines(spark, d):
    n = F.col("page_id").cast("string")
    page = F.concat(F.lit("<html><head><style>x</style></head><body><div><p>"), F.col("url"), F.lit("<b>Title "), n, F.lit("</b></p></div></body></html>"))
    found = readers.lines_of_pages(table(spark, d, "pages").select("page_id", page.alias("html")))
    return found.select("page_id", "line_text", "tag", "indentation")


@query()
def o96_lines_of_real_pages(spark, d):
    return readers.lines_of_pages(table(spark, d, "pages"))


_CONF = '<div class="contsec"><center><table><tr><td>x</td></tr><tr><td><h2><span property="v:description">Conf {n}</span></h2></td></tr><tr><td><a href="http://c{n}.org">l</a></td></tr><tr><td>y</td></tr><tr><td><table><tr><td><table><tr><th>When</th><td>Nov 1, 2020</td></tr></table></td></tr><tr><td><a href="call?x">AI</a></td></tr></table></td></tr></table></center></div>'


@query("SELECT 'u' || page_id AS url, 'Conf ' || page_id AS title, 'http://c' || page_id || '.org' AS link, CAST(2020 AS BIGINT) AS year, 'AI' AS topic FROM pages")
def o22_o166_conference_pages(spark, d):
    n = F.col("page_id").cast("string")
    p = table(spark, d, "pages").select(F.concat(F.lit("u"), n).alias("url"), F.replace(F.lit(_CONF), F.lit("{n}"), n).alias("html"))
    out = readers.conferences_of_pages(p)
    return out.select("url", "title", "link", F.col("year").cast("long").alias("year"), F.get("categories", 0).alias("topic"))


_HINTS = r"""regexp_matches(line, '(?i)\b(?:univ|institute|college|laborator|school|dept)') AS a, regexp_matches(line, '(?i)^[^,(]*[,(].*(?:univ|institute)') AS c,
  regexp_matches(line, '^[A-Z][\p{L}\p{N}_.''-]*(?: [A-Z][\p{L}\p{N}_.''-]*){1,2}$') AS p, regexp_matches(line, '(?i)\b(?:chair|committee|editor|board)') AS r"""


@query(f"""WITH {JOURNAL_LINES_SQL}, h AS (SELECT doc_id, pos, {_HINTS} FROM journal_lines), k AS (SELECT *, CAST(a AS INT) + CAST(c AS INT) + CAST(p AS INT) + CAST(r AS INT) AS k FROM h)
SELECT doc_id, pos, CASE WHEN k = 1 THEN CASE WHEN a THEN 'Affiliation' WHEN c THEN 'Complex' WHEN p THEN 'Person' ELSE 'Role-Label' END END AS prediction,
  round(CASE WHEN k > 0 THEN exp(4) ELSE exp(1) END / (k * exp(4) + (4 - k) + exp(1)), 6) AS probability FROM k""")
def o92_predict_lines(spark, d):
    found = inputs.journal_lines(spark, d).withColumnRenamed("line", "line_text")
    return tagger.predict_lines(found).select("doc_id", "pos", "prediction", F.round("probability", 6).alias("probability"))


@query("SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: CASE WHEN regexp_matches(w, '^(?i:univ|institute)') THEN 'S-ORG' WHEN upper(substr(w, 1, 1)) = substr(w, 1, 1) AND lower(substr(w, 1, 1)) <> substr(w, 1, 1) THEN 'S-PER' ELSE 'O' END) AS tags FROM conversations")
def o92_o42_tag_tokens(spark, d):
    s = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ", -1).alias("words"))
    return tagger.tag_tokens(s).select("conv_id", "turn", "tags")


# role words behind the text of every turn, as the lexicon of the reference tags them
_ROLE_ENDING = "Associate Editors in Chief of the Advisory Board"
_ROLE_ENDING_TAGGED = "Associate <BI-ROLE> Editors <ROLE> in <I-ROLE> Chief <E-ROLE> of the Advisory <BI-ROLE> Board <E-ROLE>"
_ROLE_TAGS_SQL = """CASE WHEN lower(w) IN ('editor', 'editors', 'co-editor', 'editorialboard') THEN w || ' <ROLE>'
  WHEN lower(w) IN ('executive', 'deputy', 'honorable', 'coordinating', 'action', 'section', 'founding', 'managing', 'senior', 'editorial', 'book') THEN w || ' <B-ROLE>'
  WHEN lower(w) IN ('advisory', 'review', 'associate') THEN w || ' <BI-ROLE>' WHEN lower(w) = 'in' THEN w || ' <I-ROLE>'
  WHEN lower(w) IN ('board', 'committee', 'council', 'chief', 'emeritus') THEN w || ' <E-ROLE>' WHEN regexp_matches(w, '^[A-Z]') THEN w || ' <S-PER>' ELSE w END"""


@query(f"SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ' '), lambda w: {_ROLE_TAGS_SQL}), ' ') || ' {_ROLE_ENDING_TAGGED}' AS line FROM conversations")
def o156_pre_tag(spark, d):
    words = F.split(F.concat("text", F.lit(f" {_ROLE_ENDING}")), " ", -1)
    tags = F.transform(words, lambda w: F.when(F.rlike(w, F.lit("^[A-Z]")), "S-PER").otherwise("O"))
    return table(spark, d, "conversations").select("conv_id", "turn", tagger.inline_tagged(words, tagger.pre_tag(words, tags)).alias("line"))


_PAGE_OF_LINES = ("conf_id", "page_id")


def _tagged_lines(spark, d):
    """Page lines with one of three tags; not every page has all."""
    tag = F.when(F.col("indent") % 3 == 0, "p").when(F.col("indent") % 3 == 1, "li").otherwise("b")
    return inputs.page_lines(spark, d).withColumn("tag", tag)


@query(f"""WITH {PAGE_LINES_SQL}, t AS (SELECT *, CASE indent % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'li' ELSE 'b' END AS tag FROM page_lines), d AS (SELECT DISTINCT conf_id, page_id, tag FROM t)
SELECT id, CAST(len(string_split(line_text, ' ')) AS DOUBLE) AS f_tokens, CAST(CASE WHEN line_text = '' THEN 0 ELSE 1 END AS DOUBLE) AS f_caps, CAST((SELECT count(*) FROM d WHERE d.conf_id = t.conf_id AND d.page_id = t.page_id AND d.tag < t.tag) AS DOUBLE) AS f_tag FROM t""")
def o98_line_features(spark, d):
    return tagger.line_features(_tagged_lines(spark, d), scope=_PAGE_OF_LINES).select("id", "f_tokens", "f_caps", "f_tag")


@query("""WITH b AS (SELECT doc_id, list_concat(['[CLS]'], list_slice(string_split(text, ' '), 1, 14), ['[SEP]']) AS w FROM documents)
SELECT doc_id, list_concat(w, list_transform(range(len(w), 16), lambda i: '[PAD]')) AS input, list_transform(range(0, 16), lambda i: CASE WHEN i < len(w) THEN 1 ELSE 0 END) AS mask FROM b""")
def o99_feature_windows(spark, d):
    window, mask = tagger.feature_window(F.split("text", " ", -1), 16)
    return table(spark, d, "documents").select("doc_id", window.alias("input"), mask.alias("mask"))


@query("SELECT p_partkey, list_concat(list_transform([p_size, p_partkey], lambda x: x - 3), [0, 0]) AS ids FROM part")
def o170_padded_ids(spark, d):
    ids = F.array(F.col("p_size").cast("long"), F.col("p_partkey").cast("long"))
    return table(spark, d, "part").select("p_partkey", tagger.padded(ids, 4, 0, -3).alias("ids"))


@query()
def o97_train_line_svm(spark, d):
    found = _tagged_lines(spark, d).where("line_text <> ''")
    model = tagger.train_line_svm(found, scope=_PAGE_OF_LINES)
    scored = model.transform(tagger.line_features(found, scope=_PAGE_OF_LINES))
    return scored.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("prediction") == F.col("label_index")).cast("long")).alias("right"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 > 0 THEN round(ln(exp(l_quantity / 10) + exp(l_discount) + exp(l_tax) + exp(1)) - [l_quantity / 10, l_discount, l_tax, 1.0][l_linenumber % 4 + 1], 6) END AS loss FROM lineitem")
def o171_masked_loss(spark, d):
    scores = F.array(F.col("l_quantity") / 10, F.col("l_discount"), F.col("l_tax"), F.lit(1.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(tagger.masked_loss(scores, F.col("l_linenumber") % 4), 6).alias("loss"))
