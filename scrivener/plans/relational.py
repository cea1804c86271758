"""Queries of sources, sinks, predicates, joins, aggregates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivener import schemas
from scrivener.functions import names, text, web
from scrivener.operators import dml, rank, sequence
from scrivener.plans import inputs
from scrivener.plans.inputs import JOURNAL_LINES_SQL, JOURNAL_ROLES_SQL, PAGE_LINES_SQL, ROLES_SQL
from scrivener.plans.registry import query, table
from scrivener.streaming import frontier


@query("SELECT page_id, url FROM pages WHERE url LIKE 'https%'")
def o01_journal_urls(spark, d):
    return table(spark, d, "pages").where(F.startswith("url", F.lit("https"))).select("page_id", "url")


@query(f"WITH {JOURNAL_LINES_SQL} SELECT doc_id, pos, publisher, title, line FROM journal_lines WHERE publisher = 'src3'")
def o02_lines_of_publisher(spark, d):
    return inputs.journal_lines(spark, d).where("publisher = 'src3'")


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'")
def o03_tagged_lines(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def o04_page_saved(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query(f"WITH {PAGE_LINES_SQL} SELECT * FROM page_lines WHERE conf_id < 50")
def o05_lines_of_a_page(spark, d):
    return inputs.page_lines(spark, d).where("conf_id < 50")


@query("SELECT DISTINCT 'surname' AS type, lower(word) AS content FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) WHERE trim(word) <> ''")
def o06_lexicon(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", " ", -1)).alias("word")).where("trim(word) <> ''")
    return words.select(F.lit("surname").alias("type"), F.lower("word").alias("content")).distinct()


_LINK_SQL = r"""(?is)<([a-z][a-z0-9]*)\s(?:[^>]*?\s)?href\s*=\s*["'']?([^"''\s>]*)["'']?[^>]*>([^<]*)"""
# links of the test pages hold no inner elements, so an element's own text is what stands before the next tag
_LINKS_SQL = f"""
links AS (
  SELECT page_id, home, url, CASE WHEN lower(name) IN ('link', 'base', 'area') THEN '' ELSE trim(text) END AS text FROM (
    SELECT page_id, url AS home, unnest(regexp_extract_all(html, '{_LINK_SQL}', 1)) AS name, unnest(regexp_extract_all(html, '{_LINK_SQL}', 2)) AS url, unnest(regexp_extract_all(html, '{_LINK_SQL}', 3)) AS text FROM pages))"""
_ORIGIN = "regexp_extract(home, '^[a-z]+://[^/?#]*')"
_ABSOLUTE = f"CASE WHEN contains(url, '://') THEN url WHEN starts_with(url, '/') THEN {_ORIGIN} || url ELSE {_ORIGIN} || regexp_extract(home, '^[a-z]+://[^/?#]*([^?#]*/)', 1) || url END"
_KIND_SQL = f"CASE WHEN regexp_matches(lower(coalesce({{u}}, '')), '{web.COMMITTEE}') OR regexp_matches(lower(coalesce({{t}}, '')), '{web.COMMITTEE}') THEN 'org' WHEN regexp_matches(lower(coalesce({{u}}, '')), '{web.SPEAKERS}') OR regexp_matches(lower(coalesce({{t}}, '')), '{web.SPEAKERS}') THEN 'speakers' ELSE 'unk' END"
_AUTHORITY = "regexp_extract(coalesce({}, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


@query(f"WITH {_LINKS_SQL} SELECT page_id, home, url, text FROM links")
def o12_links_of_pages(spark, d):
    found = table(spark, d, "pages").select("page_id", F.col("url").alias("home"), F.explode(web.links_of(F.col("html"))).alias("a"))
    return found.select("page_id", "home", F.col("a.url").alias("url"), F.col("a.text").alias("text"))


@query(f"WITH {_LINKS_SQL} SELECT page_id, url, CASE WHEN contains(url, '/th') OR contains(url, '/de') THEN 'follow' WHEN contains(url, '.') THEN 'parse' END AS action FROM links WHERE contains(url, '/th') OR contains(url, '/de') OR contains(url, '.')")
def o10_link_rules(spark, d):
    found = table(spark, d, "pages").select("page_id", F.explode(web.links_of(F.col("html"))["url"]).alias("url"))
    return frontier.link_actions(found, {"follow": ["/th", "/de"], "parse": ["."]})


@query("SELECT 'https://x.org/' || page_id AS url, 'seed' AS status, CAST(NULL AS VARCHAR) AS error FROM pages WHERE url LIKE 'https%' UNION ALL SELECT 'http://start', 'seed', NULL")
def o168_seeds(spark, d):
    urls = table(spark, d, "pages").where(F.startswith("url", F.lit("https"))).select(F.concat(F.lit("https://x.org/"), F.col("page_id").cast("string")).alias("url"))
    return frontier.seeds(urls, ["http://start"])


@query("SELECT page_id, url, CASE WHEN page_id % 9 = 0 THEN 404 ELSE 200 END AS http_status, CASE WHEN page_id % 9 = 0 THEN 'Error' WHEN page_id % 2 = 0 THEN 'Accessible URL' ELSE 'Wayback Accessible' END AS status FROM pages")
def o24_o167_o169_fetch_status(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 9 == 0, 404).otherwise(200).alias("http_status"), (F.col("page_id") % 2 == 1).alias("archived"))
    return frontier.with_status(p).select("page_id", "url", "http_status", "status")


@query("""WITH RECURSIVE l AS (SELECT c_custkey AS src, c_custkey * 7 % 1009 + k * c_nationkey AS dst FROM customer, (VALUES (1), (2)) v(k)),
  w AS (SELECT c_custkey AS url, CAST(0 AS BIGINT) AS hop FROM customer WHERE c_custkey % 50 = 1
  UNION SELECT l.dst, w.hop + 1 FROM w JOIN l ON l.src = w.url WHERE w.hop < 3 AND l.dst IN (SELECT c_custkey FROM customer))
SELECT url, min(hop) AS hop FROM w GROUP BY url""")
def o11_frontier_walk(spark, d):
    c = table(spark, d, "customer")
    pages, key = c.select(F.col("c_custkey").alias("url")), F.col("c_custkey")
    links = c.select(key.alias("src"), F.explode(F.array(*(key * 7 % 1009 + k * F.col("c_nationkey") for k in (1, 2)))).alias("dst"))
    return frontier.walk(pages, links, pages.where("url % 50 = 1"), 3).select("url", F.col("hop").cast("long").alias("hop"))


@query(r"""SELECT page_id, list_transform(range(2, len(p) + 1), lambda i: struct_pack(code := string_split(string_split(p[i], 'com/')[2], '"')[1],
    title := replace(string_split(string_split(p[i], '</a></h3>')[1], '>')[-1], 'amp;', '')).code || '|' || replace(string_split(string_split(p[i], '</a></h3>')[1], '>')[-1], 'amp;', '')) AS journals
  FROM (SELECT page_id, string_split('<div product-information href="x.com/' || page_id || '"><h3><a>Title &amp; ' || page_id || '</a></h3>', 'product-information') AS p FROM pages)""")
def o13_springer_journals(spark, d):
    html = F.concat(F.lit('<div product-information href="x.com/'), F.col("page_id").cast("string"), F.lit('"><h3><a>Title &amp; '), F.col("page_id").cast("string"), F.lit("</a></h3>"))
    return table(spark, d, "pages").select("page_id", F.transform(web.springer_journals(html), lambda j: F.concat_ws("|", j["code"], j["title"])).alias("journals"))


@query("SELECT page_id, url || '|' || 'Page ' || page_id AS journal FROM pages")
def o14_acm_journals(spark, d):
    zipped = web.acm_journals(F.array("url"), F.array(F.concat(F.lit("Page "), F.col("page_id").cast("string")), F.lit("no link")))
    return table(spark, d, "pages").select("page_id", F.explode(zipped).alias("j")).select("page_id", F.concat_ws("|", "j.url", "j.title").alias("journal"))


@query("SELECT page_id, list_distinct(regexp_extract_all(replace(url, 'en/', 'punumber='), 'punumber=([0-9][^\"]*)', 1)) AS numbers FROM pages")
def o15_ieee_numbers(spark, d):
    return table(spark, d, "pages").select("page_id", web.ieee_journal_numbers(F.replace("url", F.lit("en/"), F.lit("punumber="))).alias("numbers"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/editor/' || page_id ELSE url END AS board, string_split('Page ' || page_id || ' | IEEE', ' |')[1] AS title FROM pages")
def o16_ieee_board_link(spark, d):
    n = F.col("page_id").cast("string")
    hrefs = F.array(F.lit("/about"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/editor/"), n)).otherwise("/x"))
    return table(spark, d, "pages").select("page_id", web.ieee_board_link(hrefs, F.col("url")).alias("board"), web.title_before_bar(F.concat(F.lit("Page "), n, F.lit(" | IEEE"))).alias("title"))


_SPACED = "replace(replace(replace(replace(replace({}, '<', ' <'), '>', '> '), ',', ' ,'), ':', ' : '), '  ', ' ')"


@query(f"SELECT page_id, {_SPACED.format('piece')} AS line FROM (SELECT page_id, unnest(regexp_split_to_array(html, '{web.BOARD_SPLIT['ieee']}')) AS piece FROM pages) WHERE regexp_matches({_SPACED.format('piece')}, '[a-zA-Z]')")
def o17_board_lines(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(web.board_lines(F.col("html"), "ieee")).alias("line"))


@query("""WITH d AS (SELECT doc_id, replace(text, chr(10), chr(160) || chr(10) || chr(9)) AS text FROM documents),
  p AS (SELECT doc_id, CAST(page AS BIGINT) AS page, piece FROM (SELECT doc_id, unnest(string_split(text, '.')) AS piece, unnest(range(1, len(string_split(text, '.')) + 1)) AS page FROM d)),
  s AS (SELECT *, max(CASE WHEN contains(piece, 'Re') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS stop FROM p),
  l AS (SELECT doc_id, page, pos, trim(line, ' ' || chr(9) || chr(160)) AS line FROM (SELECT doc_id, page, unnest(string_split(piece, chr(10))) AS line, unnest(range(1, len(string_split(piece, chr(10))) + 1)) AS pos FROM s WHERE stop = 0))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS BIGINT) AS line_num, line AS line_text, 'p' AS tag, CAST(1 AS BIGINT) AS indentation FROM l WHERE line <> ''""")
def o18_o111_pdf_lines_until_contents(spark, d):
    from scrivener.operators.lines import until_contents

    # lines that end with a fixed blank and begin with a tab
    text = F.replace("text", F.lit("\n"), F.lit(" \n\t"))
    pages = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(text, r"\.", -1)).alias("page", "text"))
    out = until_contents(pages, "Re")
    return out.select("doc_id", F.col("line_num").cast("long").alias("line_num"), "line_text", "tag", F.col("indentation").cast("long").alias("indentation"))


@query(r"SELECT p_partkey, trim(regexp_replace(t, '\(\d+\)', '', 'g')) AS series, CAST(regexp_extract(t, '(\d+)', 1) AS BIGINT) AS year FROM (SELECT p_partkey, p_name || ' (' || (1990 + p_size) || ')' AS t FROM part)")
def o19_acl_meta(spark, d):
    title = F.concat("p_name", F.lit(" ("), (1990 + F.col("p_size")).cast("string"), F.lit(")"))
    return table(spark, d, "part").select("p_partkey", web.acl_series(title).alias("series"), web.acl_year(title).cast("long").alias("year"))


@query("""SELECT c_custkey AS person_id, 'aminer' AS type, 'a' || c_custkey AS id, c_name AS name, CAST(0 AS BIGINT) AS rank,
  CASE WHEN c_custkey % 2 = 0 THEN 'Lab ' || c_nationkey ELSE 'Not Available' END AS affiliation FROM customer""")
def o20_o78_candidates_from_json(spark, d):
    from scrivener.operators.match import parse_aminer

    c = table(spark, d, "customer")
    aff = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('{"desc":"Lab '), F.col("c_nationkey").cast("string"), F.lit('"}'))).otherwise("{}")
    payload = F.concat(F.lit('{"result":[{"id":"a'), F.col("c_custkey").cast("string"), F.lit('","name":"'), F.col("c_name"), F.lit('","aff":'), aff, F.lit("}]}"))
    found = parse_aminer(c.select(F.col("c_custkey").cast("long").alias("person_id"), payload.alias("payload")))
    return found.select("person_id", "type", "id", "name", F.col("rank").cast("long").alias("rank"), F.get("affiliations", 0).alias("affiliation"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'http://web/' || page_id ELSE 'Not Available' END AS url FROM pages")
def o21_wayback_url(spark, d):
    n, m = F.col("page_id").cast("string"), F.col("page_id") % 3
    found = F.concat(F.lit('{"archived_snapshots":{"closest":{"url":"http://web/'), n, F.lit('","status":"200"}}}'))
    payload = F.when(m == 0, found).when(m == 1, '{"archived_snapshots":{}}')
    return table(spark, d, "pages").select("page_id", web.wayback_url(payload).alias("url"))


@query("SELECT page_id, CASE WHEN contains(CASE WHEN page_id % 2 = 0 THEN 'application/pdf; x' ELSE 'text/html' END, 'application/pdf') THEN 'pdf' ELSE 'html' END AS content_type FROM pages")
def o23_content_type(spark, d):
    return table(spark, d, "pages").select("page_id", web.content_type(F.when(F.col("page_id") % 2 == 0, "application/pdf; x").otherwise("text/html")).alias("content_type"))


_ACCESS = "CASE page_id % 3 WHEN 0 THEN 'Accessible URL' WHEN 1 THEN 'Wayback Accessible' END"
_WAYBACK = "CASE WHEN page_id % 2 = 0 THEN 'Not Available' ELSE 'http://web/' || page_id END"


@query(rf"SELECT page_id, CASE WHEN {_ACCESS} = 'Accessible URL' AND regexp_matches(url, '\d{{2}}') THEN url WHEN {_WAYBACK} <> 'Not Available' THEN {_WAYBACK} END AS access_url FROM pages")
def o25_access_url(spark, d):
    accessible = F.when(F.col("page_id") % 3 == 0, "Accessible URL").when(F.col("page_id") % 3 == 1, "Wayback Accessible")
    wayback = F.when(F.col("page_id") % 2 == 0, "Not Available").otherwise(F.concat(F.lit("http://web/"), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", web.access_url(accessible, F.col("url"), wayback).alias("access_url"))


_MORE_LINKS = '<link rel="about" href="/style.css"><link href="/about.css">text behind<area shape="x" href="/people"><div href="/board/x">Chair <b>y</b></div><a href="/committee">Us</a><a class="x" href="http://other.org/chair">Chair</a><a href="t.html">Tutorial</a>'


@query(f"WITH {_LINKS_SQL.replace('FROM pages)', f"FROM (SELECT page_id, url, html || '{_MORE_LINKS}' AS html FROM pages))")} SELECT page_id, home, {_ABSOLUTE} AS url, text, {_KIND_SQL.format(u='url', t='text')} AS kind FROM links WHERE ({_AUTHORITY.format('url')} = '' OR {_AUTHORITY.format('url')} = {_AUTHORITY.format('home')}) AND {_KIND_SQL.format(u='url', t='text')} <> 'unk'")
def o26_relevant_links(spark, d):
    return frontier.relevant_links(table(spark, d, "pages").withColumn("html", F.concat("html", F.lit(_MORE_LINKS))))


@query(f"SELECT a.page_id, b.page_id AS other_id FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 WHERE {_AUTHORITY.format('b.url')} = '' OR {_AUTHORITY.format('a.url')} = {_AUTHORITY.format('b.url')}")
def o27_same_domain(spark, d):
    a = table(spark, d, "pages").select("page_id", "url")
    b = a.select((F.col("page_id") - 1).alias("page_id"), F.col("page_id").alias("other_id"), F.col("url").alias("link"))
    return a.join(b, "page_id").where(web.same_domain(F.col("url"), F.col("link"))).select("page_id", "other_id")


@query(f"SELECT page_id, {_KIND_SQL.format(u='url', t='title')} AS kind FROM (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'Program Committee' WHEN 1 THEN 'Keynote Speakers' WHEN 2 THEN 'Venue' END AS title FROM pages)")
def o28_classify_link(spark, d):
    m = F.col("page_id") % 4
    title = F.when(m == 0, "Program Committee").when(m == 1, "Keynote Speakers").when(m == 2, "Venue")
    return table(spark, d, "pages").select("page_id", web.classify_link(title, F.col("url")).alias("kind"))


@query(f"SELECT page_id FROM pages WHERE contains(coalesce({_ACCESS}, ''), 'Accessible')")
def o29_accessible(spark, d):
    accessible = F.when(F.col("page_id") % 3 == 0, "Accessible URL").when(F.col("page_id") % 3 == 1, "Wayback Accessible")
    return table(spark, d, "pages").where(web.is_accessible(accessible)).select("page_id")


@query("""SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderkey % 5 = 0 GROUP BY o_custkey
UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)""")
def o30_upsert_last_wins(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("status"))
    new = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    return dml.upsert(old, new, [("id",)], "o_orderkey")


@query("""WITH u AS (SELECT o_orderkey AS id, 't' || o_custkey AS title, 'u' || (o_orderkey * 7 % 1000) AS url FROM orders)
SELECT id, title, url FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.title = u.title AND v.id > u.id) AND NOT EXISTS (SELECT 1 FROM u v WHERE v.url = u.url AND v.id > u.id)""")
def o30_upsert_two_keys(spark, d):
    key, s = F.col("o_orderkey"), lambda c: c.cast("string")
    rows = table(spark, d, "orders").select(key.alias("id"), F.concat(F.lit("t"), s(F.col("o_custkey"))).alias("title"), F.concat(F.lit("u"), s(key * 7 % 1000)).alias("url"), key.alias("at"))
    return dml.upsert(rows.where("false").drop("at"), rows, [("title",), ("url",)], "at")


@query("""SELECT c_custkey AS id, 'old' AS status FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY o_custkey""")
def o31_insert_or_ignore(spark, d):
    old = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("old").alias("status"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    return dml.insert_or_ignore(old, new, ["id"], "o_orderkey")


@query("SELECT p_name, CAST(row_number() OVER (ORDER BY first, p_name) AS BIGINT) AS id FROM (SELECT p_name, min(p_partkey) AS first FROM part GROUP BY p_name)")
def o32_get_or_create_id(spark, d):
    return dml.get_or_create(table(spark, d, "part").select("p_name", "p_partkey"), ["p_name"], "p_partkey")


@query("SELECT c_custkey, c_name, coalesce(CASE WHEN n > 10 THEN 'busy' END, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def o33_update(spark, d):
    busy = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).select("c_custkey", F.when(F.col("n") > 10, "busy").alias("c_mktsegment"))
    return dml.update(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), busy, ["c_custkey"], ["c_mktsegment"])


@query("SELECT l_orderkey, l_linenumber, 'old' AS v FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT DISTINCT l_orderkey, 1, 'new' FROM lineitem WHERE l_orderkey % 4 = 0")
def o34_replace_group(spark, d):
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("old").alias("v"))
    new = old.where("l_orderkey % 4 = 0").select("l_orderkey", F.lit(1).alias("l_linenumber"), F.lit("new").alias("v")).distinct()
    return dml.replace_group(old, new, ["l_orderkey"])


@query("SELECT s_suppkey, CAST(NULL AS DOUBLE) AS pr_score FROM supplier")
def o35_add_column(spark, d):
    out = dml.add_column(table(spark, d, "supplier").select("s_suppkey"), "pr_score", "double")
    return dml.add_column(out, "pr_score", "double")


@query(f"WITH {PAGE_LINES_SQL}, n AS (SELECT id, concat_ws(chr(9), label, 'p', CAST(indent AS VARCHAR), line_text) AS line, row_number() OVER (ORDER BY id) AS r, count(*) OVER () AS total FROM page_lines) SELECT id, line, CASE WHEN r <= floor(total * 8 / 10) THEN 'train' ELSE 'val' END AS split FROM n")
def o36_ordered_split(spark, d):
    lines = inputs.page_lines(spark, d).select("id", "label", F.lit("p").alias("tag"), "indent", "line_text")
    return dml.ordered_split(lines, ["id"], 8, 2).select("id", dml.tsv_text(["label", "tag", "indent", "line_text"]).alias("line"), "split")


@query("SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents")
def o38_vocabulary(spark, d):
    from scrivener.operators.tagger import vocabulary

    return vocabulary(table(spark, d, "documents"), F.explode(F.split("text", " ", -1)))


@query("SELECT s_suppkey AS conf_id, topic FROM (SELECT DISTINCT s_suppkey, unnest(['t' || (s_nationkey % 5), 't' || (s_nationkey % 3), 't0']) AS topic FROM supplier)")
def o40_normalise_conferences(spark, d):
    topics = F.array(*(F.concat(F.lit("t"), (F.col("s_nationkey") % k).cast("string")) for k in (5, 3)), F.lit("t0"))
    confs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(" series ").alias("series"), topics.alias("categories"))
    out = dml.normalise_conferences(confs)
    return out["conference_topics"].join(out["topics"].withColumnRenamed("id", "topic_id"), "topic_id").select("conf_id", "topic")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def o43_o162_merge(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    old = c.where("c_acctbal > 5000").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    # nodes that are there already stay, new ones are added once
    seen = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("new").alias("n_name"), "o_orderkey")
    return dml.insert_or_ignore(old, seen, ["c_custkey"], "o_orderkey")


@query("SELECT p.page_id, p.url FROM pages p LEFT JOIN labels l ON l.doc_id = p.page_id AND l.quality = 1 WHERE l.doc_id IS NULL")
def o112_next_batch(spark, d):
    done = table(spark, d, "labels").select(F.col("doc_id").alias("page_id"), F.when(F.col("quality") == 1, "Yes").otherwise("Error").alias("status"))
    return frontier.next_batch(table(spark, d, "pages").select("page_id", "url"), done)


_TABLES_SQL = " UNION ALL ".join(f"SELECT '{t}' AS name, CAST({ddl.count(', ') + 1} AS BIGINT) AS columns, CAST({ddl.count('NOT NULL')} AS BIGINT) AS required" for t, ddl in schemas.DDL.items())


@query(_TABLES_SQL)
def o44_schemas(spark, d):
    shapes = [(t, len(schemas.schema(t).fields), sum(not f.nullable for f in schemas.schema(t).fields)) for t in schemas.DDL]
    return spark.createDataFrame(shapes, "name string, columns long, required long")


@query(f"WITH {PAGE_LINES_SQL} SELECT id, label, line_text FROM page_lines WHERE line_text <> '' AND label <> 'Undefined'")
def o46_relevant_lines(spark, d):
    from scrivener.operators.lines import relevant_lines

    return relevant_lines(inputs.page_lines(spark, d), "label").select("id", "label", "line_text")


@query("SELECT page_id FROM pages WHERE (CASE page_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Error' END) IS DISTINCT FROM 'Yes' AND page_id % 2 = 0")
def o45_pages_to_process(spark, d):
    from scrivener.sources.readers import pages_to_process

    m = F.col("page_id") % 3
    p = table(spark, d, "pages").select("page_id", F.when(m == 0, "Yes").when(m == 1, "Error").alias("processed"), F.when(F.col("page_id") % 2 == 0, "html").otherwise("pdf").alias("content_type"))
    return pages_to_process(p).select("page_id")


@query("SELECT doc_id, pos, line FROM (WITH " + JOURNAL_LINES_SQL + " SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN line || chr(40880) ELSE line END AS line FROM journal_lines) WHERE NOT regexp_matches(line, '[\\x{4e00}-\\x{9fff}]') AND len(string_split(line, ' ')) < 5 AND length(line) < 20")
def o47_valid_person_name(spark, d):
    # an ideograph near the block's end behind every third line
    found = inputs.journal_lines(spark, d).select("doc_id", "pos", F.when(F.col("pos") % 3 == 0, F.concat("line", F.lit("龰"))).otherwise(F.col("line")).alias("line"))
    return found.where(names.valid_person_name(F.col("line")))


@query("SELECT p_partkey, len(string_split(p_name, ' ')) < 3 AS person, len(string_split(p_type, ' ')) > 1 AND len(string_split(p_type, ' ')) < 4 AS org FROM part")
def o48_valid_lengths(spark, d):
    return table(spark, d, "part").select("p_partkey", names.valid_length(F.col("p_name"), "person").alias("person"), names.valid_length(F.col("p_type"), "org").alias("org"))


@query(f"WITH {PAGE_LINES_SQL} SELECT id, replace(label, ' ', '-') AS label FROM page_lines WHERE label IS NOT NULL AND line_text <> '' AND id % 11 <> 0")
def o49_labelled_lines(spark, d):
    # every eleventh line is punctuation, which cleaning makes empty
    line = text.clean_line(F.when(F.col("id") % 11 == 0, F.lit("--.")).otherwise(F.col("line_text")))
    return inputs.page_lines(spark, d).where(F.col("label").isNotNull() & (line != "")).select("id", F.replace("label", F.lit(" "), F.lit("-")).alias("label"))


@query(f"WITH {JOURNAL_LINES_SQL} SELECT doc_id, pos, list_filter(string_split(line, ' '), lambda w: regexp_matches(w, '^\\p{{L}}+$')) AS words FROM journal_lines WHERE regexp_matches(line, '[a-zA-Z]')")
def o50_alphabetic(spark, d):
    return inputs.journal_lines(spark, d).where(text.has_letter(F.col("line"))).select("doc_id", "pos", F.filter(F.split("line", " ", -1), text.is_alpha).alias("words"))


@query(f"WITH {ROLES_SQL} SELECT s_suppkey, c_name, role_type FROM supplier JOIN roles ON s_suppkey = doc_id JOIN customer ON c_custkey = person_id WHERE doc_type = 'conference'")
def o61_conference_persons(spark, d):
    r = inputs.roles(spark, d).where("doc_type = 'conference'")
    return table(spark, d, "supplier").join(r, F.col("s_suppkey") == F.col("doc_id")).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("person_id")).select("s_suppkey", "c_name", "role_type")


@query(f"WITH {JOURNAL_ROLES_SQL} SELECT p_partkey, c_name, role_type FROM part JOIN journal_roles ON p_partkey = doc_id JOIN customer ON c_custkey = person_id")
def o60_journal_persons(spark, d):
    r = inputs.roles(spark, d, "journal")
    return table(spark, d, "part").join(r, F.col("p_partkey") == F.col("doc_id")).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("person_id")).select("p_partkey", "c_name", "role_type")


@query(f"WITH {ROLES_SQL}, {JOURNAL_ROLES_SQL} SELECT person_id, doc_type, count(*) AS n FROM (SELECT * FROM roles UNION ALL SELECT * FROM journal_roles) GROUP BY person_id, doc_type")
def o62_o130_roles_of_both_kinds(spark, d):
    both = inputs.roles(spark, d).unionByName(inputs.roles(spark, d, "journal"))
    return both.groupBy("person_id", "doc_type").agg(F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS persons FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def o63_organization_persons(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("persons"))


@query(f"WITH {ROLES_SQL} SELECT DISTINCT c_name, n_name, role_type, doc_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN roles ON person_id = c_custkey JOIN supplier ON s_suppkey = doc_id")
def o64_o65_four_way_join(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    r = inputs.roles(spark, d).join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("doc_id"), "left_semi")
    return c.join(r, F.col("person_id") == F.col("c_custkey")).select("c_name", "n_name", "role_type", "doc_id").distinct()


@query("SELECT d.doc_id, p.page_id, l.quality FROM documents d JOIN pages p ON p.page_id = d.doc_id JOIN labels l ON l.doc_id = d.doc_id")
def o66_conference_pages_lines(spark, d):
    doc, lab = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality")
    return doc.join(table(spark, d, "pages").select("page_id"), F.col("page_id") == F.col("doc_id")).join(lab, "doc_id").select("doc_id", "page_id", "quality")


_ROLE_TAG = "CASE lower({w}) " + " ".join(f"WHEN '{word}' THEN '{tag}'" for word, tag in sequence.ROLE_WORDS.items()) + " END"


@query("SELECT conv_id, turn, word, tag FROM (SELECT conv_id, turn, word, " + _ROLE_TAG.format(w="word") + " AS tag FROM (SELECT conv_id, turn, unnest(list_concat(string_split(text, ' '), ['Editor-in-Chief', 'Senior'])) AS word FROM conversations)) WHERE tag IS NOT NULL")
def o67_role_words(spark, d):
    words = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.concat(F.split("text", " ", -1), F.array(F.lit("Editor-in-Chief"), F.lit("Senior")))).alias("word"))
    return words.withColumn("tag", sequence.role_tag(F.col("word"))).where("tag is not null")


@query("SELECT doc_id, word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE lower(word) IN (SELECT lower(unnest(string_split(text, ' '))) FROM benchmark)")
def o68_lexicon_words(spark, d):
    lexicon = table(spark, d, "benchmark").select(F.explode(F.split("text", " ", -1)).alias("content")).select(F.lower("content").alias("content")).distinct()
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ", -1)).alias("word"))
    return words.join(lexicon, F.lower("word") == F.col("content"), "left_semi")


@query("SELECT l_orderkey, l_linenumber, p_partkey AS journal_id FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 25")
def o69_title_lookup(spark, d):
    small = table(spark, d, "part").where("p_size < 25").select("p_partkey")
    return table(spark, d, "lineitem").join(small, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", F.col("p_partkey").alias("journal_id"))


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0)")
def o72_unsaved_urls(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return frontier.unsaved(p, p.where("page_id % 4 = 0"))


@query(f"WITH {ROLES_SQL} SELECT doc_id, person_id, c_nationkey AS org_id, role_type FROM roles JOIN customer ON c_custkey = person_id WHERE role_type = 'General Chair'")
def o73_graph_pattern(spark, d):
    chairs = inputs.roles(spark, d).where("role_type = 'General Chair'")
    return chairs.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("person_id")).select("doc_id", "person_id", F.col("c_nationkey").alias("org_id"), "role_type")


@query("SELECT DISTINCT user_id AS conf_id FROM events")
def o80_distinct_ids(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("conf_id")).distinct().orderBy("conf_id")


@query("SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT trim(p_name) AS name FROM part)")
def o81_distinct_sorted_names(spark, d):
    return dml.numbered(table(spark, d, "part").select(F.trim("p_name").alias("name")).distinct(), ["name"], start=0).select("name", "id")


@query("SELECT DISTINCT event_type AS tag FROM events")
def o82_distinct_tags(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("tag")).distinct()


@query(f"WITH {ROLES_SQL} SELECT role_type, count(*) AS n FROM roles GROUP BY role_type HAVING count(*) > 100")
def o83_frequent_roles(spark, d):
    return inputs.roles(spark, d).groupBy("role_type").agg(F.count("*").alias("n")).where("n > 100")


@query("SELECT count(*) AS n, coalesce(max(c_custkey), 0) AS top FROM customer WHERE c_acctbal > 1e9 UNION ALL SELECT count(*), coalesce(max(s_suppkey), 0) FROM supplier")
def o84_o85_count_and_max(spark, d):
    agg = lambda df, c: df.agg(F.count("*").alias("n"), F.coalesce(F.max(c), F.lit(0)).alias("top"))
    return agg(table(spark, d, "customer").where("c_acctbal > 1e9"), "c_custkey").unionByName(agg(table(spark, d, "supplier"), "s_suppkey"))


_SCORE = "CASE WHEN doc_type = 'journal' OR contains(lower(role_type), 'senior') OR contains(lower(role_type), 'chair') THEN 2 ELSE 1 END"
EDGES_SQL = f"""
pairs AS (SELECT doc_type, doc_id, person_id, sum({_SCORE}) AS score, count(*) AS n FROM roles GROUP BY ALL),
edges AS (SELECT doc_type, doc_id, person_id, score / sum(score) OVER (PARTITION BY doc_type, doc_id) AS to_person, n / sum(n) OVER (PARTITION BY person_id) AS to_venue FROM pairs)"""


@query(f"WITH {ROLES_SQL}, {EDGES_SQL} SELECT doc_id, person_id, round(CAST(to_person AS DOUBLE), 9) AS to_person, round(CAST(to_venue AS DOUBLE), 9) AS to_venue FROM edges")
def o86_o87_edge_weights(spark, d):
    return rank.weighted_edges(inputs.roles(spark, d)).select("doc_id", "person_id", F.round("to_person", 9).alias("to_person"), F.round("to_venue", 9).alias("to_venue"))


@query(f"WITH {ROLES_SQL}, {EDGES_SQL} SELECT doc_id, round(CAST(sum(to_venue * (person_id % 7 + 1)) AS DOUBLE), 6) AS total FROM edges GROUP BY doc_id")
def o88_inbound_sum(spark, d):
    e = rank.weighted_edges(inputs.roles(spark, d))
    scores = e.select("person_id").distinct().withColumn("p", (F.col("person_id") % 7 + 1).cast("double"))
    return rank.inbound(e, scores).select("doc_id", F.round("total", 6).alias("total"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, round(0.15 + 0.85 * coalesce(sum(c_acctbal / 1000), 0), 6) AS pr_score FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def o89_organization_scores(spark, d):
    c = table(spark, d, "customer")
    persons = c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("pr_score"))
    links = c.select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").cast("long").alias("org_id"))
    orgs = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return rank.organization_scores(orgs, links, persons).select("id", F.round("pr_score", 6).alias("pr_score"))


_SPAN_OF_LINE = "(l_partkey * 100000 + l_suppkey) * 10 + l_linenumber"


@query(f"""SELECT l_orderkey, arg_min(CAST(l_suppkey AS VARCHAR), {_SPAN_OF_LINE}) FILTER (WHERE l_returnflag = 'A') AS person, arg_min(CAST(l_suppkey AS VARCHAR), {_SPAN_OF_LINE}) FILTER (WHERE l_returnflag = 'N') AS org, arg_min(CAST(l_suppkey AS VARCHAR), {_SPAN_OF_LINE}) FILTER (WHERE l_returnflag = 'R') AS location
FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_returnflag IN ('A', 'N')) > 0""")
def o90_first_per_type(spark, d):
    from scrivener.operators.lines import complex_relations

    kind = F.element_at(F.create_map(F.lit("A"), F.lit("PER"), F.lit("N"), F.lit("ORG"), F.lit("R"), F.lit("LOC")), F.col("l_returnflag"))
    spans = table(spark, d, "lineitem").select(F.lit(1).alias("conf_id"), F.col("l_orderkey").alias("line_id"), F.lit(0).alias("part"), F.expr(_SPAN_OF_LINE).alias("span"), kind.alias("tag"), F.col("l_suppkey").cast("string").alias("text"))
    return complex_relations(spans).select(F.col("line_id").alias("l_orderkey"), "person", "org", "location")


@query("SELECT c_nationkey, list_sort(list(c_name)) AS members FROM customer GROUP BY c_nationkey")
def o93_members(spark, d):
    from scrivener.operators.cluster import cluster_members

    return cluster_members(table(spark, d, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_name").alias("name"))).withColumnRenamed("cluster", "c_nationkey")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def o94_distinct_tuples(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("SELECT s_suppkey, s_name FROM supplier")
def o120_ordered_scan(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey")


@query("SELECT o_custkey AS person_id, o_orderstatus AS type, CAST(o_orderkey AS VARCHAR) AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3")
def o121_top_candidates(spark, d):
    from scrivener.operators.match import top_candidates

    found = table(spark, d, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderstatus").alias("type"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("rank"))
    return top_candidates(found).select("person_id", "type", "id")


@query("SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, value) AS best_type FROM events GROUP BY user_id")
def o122_o123_first_and_argmax(spark, d):
    # as in SQL, rows without type count for neither; of equal ones the table's first wins (max_by takes any)
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    keys = {"first": ("event_id", F.struct("event_id", *place)), "best": ("value", F.struct(~F.isnan("value"), -F.col("value"), *place))}
    ranked = table(spark, d, "events").select("user_id", "event_type", *(F.when(F.col("event_type").isNotNull() & F.col(c).isNotNull(), k).alias(n) for n, (c, k) in keys.items()))
    return ranked.groupBy("user_id").agg(*(F.min_by("event_type", n).alias(f"{n}_type") for n in keys))


@query("SELECT c_custkey AS id, c_acctbal AS pr_score FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def o124_top_scores(spark, d):
    scores = table(spark, d, "customer").select(F.lit("person").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("pr_score"))
    return rank.top(scores, 20).drop("kind")


@query("SELECT c_custkey, list_extract(['a', 'b', 'c'], CAST(c_custkey % 3 + 1 AS INT)) AS pick FROM customer")
def o125_pick_by_key(spark, d):
    choices = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return table(spark, d, "customer").select("c_custkey", F.element_at(choices, (F.col("c_custkey") % 3 + 1).cast("int")).alias("pick"))


@query("SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_name FROM part")
def o131_union_all(spark, d):
    from scrivener.operators.match import union_sources

    one = lambda t, c: table(spark, d, t).select(F.col(c).alias("name"))
    return union_sources(one("customer", "c_name"), one("supplier", "s_name"), one("part", "p_name"))


@query("SELECT doc_id, list_sort(list_distinct(string_split(text, ' '))) AS words FROM documents")
def o132_set_of_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_sort(F.array_distinct(F.split("text", " ", -1))).alias("words"))


@query("SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains(string_split(p_type, ' '), x))) = 0 AS inside FROM part")
def o133_subset_of_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", names.is_subset(F.col("p_name"), F.col("p_type")).alias("inside"))


@query("SELECT DISTINCT token FROM (SELECT unnest(string_split(text, '')) AS token FROM documents) WHERE token <> ''")
def o134_characters(spark, d):
    from scrivener.operators.tagger import characters

    return characters(table(spark, d, "documents"), F.col("text"))
