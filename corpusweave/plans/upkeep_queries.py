"""Queries of upkeep: ids, purges, rebuilds, run states, caches; of scraped records; of field-weighted and list-based search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusweave.catalogue import query, read, rounded
from corpusweave.functions import markup as M
from corpusweave.functions import text as T
from corpusweave.operators import index as I
from corpusweave.operators import weighted as W
from corpusweave.operators.quantised import QuantisedLists
from corpusweave.operators.results import previews


@query("""WITH k AS (SELECT n_name AS name, n_nationkey + 1 AS id FROM nation), c AS (SELECT DISTINCT 'NATION_' || (n_nationkey + 5) AS name FROM nation),
n AS (SELECT name, row_number() OVER (ORDER BY name) AS rn FROM c WHERE name NOT IN (SELECT name FROM k))
SELECT name, id::BIGINT AS id, CASE WHEN name IN (SELECT name FROM c) THEN '2024-02-01' ELSE '2024-01-01' END AS updated_at FROM k UNION ALL SELECT name, ((SELECT max(id) FROM k) + rn)::BIGINT, '2024-02-01' FROM n""")
def upsert_contexts(spark, sf_dir):
    """Known names keep their ids and get a new time, new names get the next ids."""
    n = read(spark, sf_dir, "nation")
    known = n.select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 1).cast("long").alias("id"), F.lit("2024-01-01").alias("updated_at"))
    return I.upsert_ids(known, n.select(F.concat(F.lit("NATION_"), (F.col("n_nationkey") + 5).cast("string")).alias("name")), ["name"], "2024-02-01")


@query("SELECT c_mktsegment AS context, c_custkey AS id FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_acctbal > 9500) UNION ALL SELECT c_mktsegment, c_custkey FROM customer WHERE c_acctbal > 9500")
def force_rebuild(spark, sf_dir):
    """Contexts that come anew are replaced as a whole."""
    c = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("context"), F.col("c_custkey").alias("id"), "c_acctbal")
    return I.force_rebuild(c, c.where("c_acctbal > 9500")).select("context", "id")


@query("SELECT count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS purged, count(*) FILTER (WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')) AS kept FROM orders")
def cache_purge(spark, sf_dir):
    """Cache rows of one context and version go; how many went, and how many stayed."""
    rest, gone = I.purge(read(spark, sf_dir, "orders"), {"o_orderpriority": "1-URGENT", "o_orderstatus": "F"})
    return gone.crossJoin(F.broadcast(rest.agg(F.count("*").alias("kept"))))  # one row each


@query(r"""WITH d AS (SELECT doc_id, source, lang, '# ' || text AS content FROM documents)
SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN source END, CASE WHEN lang = 'de' THEN 'fixed' END, nullif(regexp_extract(content, '^# ([^ \t\n\r\f\x0B]+)', 1), '')) AS source_id FROM d""")
def backfill_sources(spark, sf_dir):
    """Missing source ids: a fixed one for a context, else the name in the first heading."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("context"), F.when(F.col("lang") == "en", F.col("source")).alias("source_id"), F.concat(F.lit("# "), "text").alias("content"))
    return I.backfill(d, "source_id", {"de": "fixed"}).select("doc_id", "source_id")


@query("SELECT user_id AS run_id, arg_max(event_type, (ts, event_id)) AS state, min(ts) AS started_at, max(ts) FILTER (WHERE event_type <> 'created') AS ended_at, count(*) AS n_events FROM events GROUP BY user_id")
def run_states(spark, sf_dir):
    """Latest state of each run from its appended events."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("kind"), F.col("ts").alias("at"), "event_id")
    return I.latest_runs(e)


@query("SELECT p_brand AS agent, p_partkey AS ordinal, p_name AS body, false AS active FROM part UNION ALL SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey), p_type, true FROM part")
def forced_reseed(spark, sf_dir):
    """New sections of every group: old rows are turned off, ordinals start at 1."""
    p = read(spark, sf_dir, "part")
    stored = p.select(F.col("p_brand").alias("agent"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("body"), F.lit(True).alias("active"))
    new = p.select(F.col("p_brand").alias("agent"), F.col("p_type").alias("body"), F.struct("p_name", "p_partkey").alias("at"))
    return I.reseed(stored, new, "agent", position="at", force=True)


@query("""WITH r AS (SELECT *, CASE event_type WHEN 'error' THEN 'stale' WHEN 'signup' THEN 'miss' ELSE 'exact' END AS outcome FROM events), g AS (SELECT *, outcome <> 'exact' AND row_number() OVER (PARTITION BY user_id, outcome <> 'exact' ORDER BY ts, event_id) <= 3 AS granted FROM r)
SELECT count(*) FILTER (WHERE outcome = 'exact') AS exact, count(*) FILTER (WHERE outcome = 'stale' AND NOT granted) AS stale, count(*) FILTER (WHERE outcome = 'stale' AND granted) AS rewarmed, count(*) FILTER (WHERE outcome = 'miss' AND granted) AS missed, count(*) FILTER (WHERE outcome = 'miss' AND NOT granted) AS skipped FROM g""")
def cache_run_counters(spark, sf_dir):
    """Counters of a cache run: three extractions a context, for misses and for re-warming stale rows."""
    e = read(spark, sf_dir, "events").withColumn("outcome", F.when(F.col("event_type") == "error", "stale").when(F.col("event_type") == "signup", "miss").otherwise("exact"))
    return I.cache_counters(I.within_budget(e, F.col("outcome") != "exact", 3, by=["user_id"], order=["ts", "event_id"]))


@query("SELECT l_orderkey, max(l_linenumber)::INT AS top FROM lineitem GROUP BY l_orderkey UNION ALL SELECT -1, 0")
def greatest_of_list(spark, sf_dir):
    """Greatest number of a comma-separated list; 0 for an empty one."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.col("l_linenumber").cast("string")), " , ").alias("ids"))
    empty = spark.range(1).select(F.lit(-1).cast("long").alias("l_orderkey"), F.lit(" ,").alias("ids"))
    return rows.unionByName(empty).select("l_orderkey", M.greatest_listed(F.col("ids")).alias("top"))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def newest_listing(spark, sf_dir):
    """Documents of some types since a day, newest first, up to a stop (a feature of the listing)."""
    o = read(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O") & F.expr("o_orderdate >= TIMESTAMP_NTZ '1995-01-01'"))
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200).select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT doc_id, d FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN '' ELSE '2024-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') END AS d FROM documents) ORDER BY d DESC, doc_id LIMIT 300")
def most_recent(spark, sf_dir):
    """Newest rows by a date in text, missing dates last, ties in input order."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "de", F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"))).alias("d"))
    return d.withColumn("d", F.coalesce("d", F.lit(""))).orderBy(F.desc("d"), "doc_id").limit(300)


@query("SELECT user_id, event_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, event_id) AS place FROM (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS score FROM events)")
def evaluation_order(spark, sf_dir):
    """Results by question and falling score, those without a score last."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("score"))
    return e.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("score"), "event_id")).cast("long"))


@query("SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY strpos(html, link), link) AS place FROM (SELECT DISTINCT page_id, html, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\"')) AS link FROM pages)")
def document_order(spark, sf_dir):
    """Elements in the order in which a page has them, by their place in it."""
    p = read(spark, sf_dir, "pages").select("page_id", "html", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="[^"]*"'), F.lit(0)))).alias("link"))
    w = Window.partitionBy("page_id").orderBy(F.expr("locate(link, html)"), "link")
    return p.select("page_id", "link", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT o_custkey, array_to_string(k[1:3], ', ') || CASE WHEN len(k) > 3 THEN ' (+' || (len(k) - 3) || ' more)' ELSE '' END AS preview FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY o_custkey)")
def list_previews(spark, sf_dir):
    """First three entries of a list, and how many more there are."""
    return previews(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_returnflag AS title FROM lineitem WHERE l_linenumber % 3 = 0 AND l_linestatus = 'O'")
def wiki_index(spark, sf_dir):
    """Links of saved parse answers: main namespace, existing pages."""
    link = F.struct((F.col("l_linenumber") % 3).alias("ns"), F.when(F.col("l_linestatus") == "O", "").alias("exists"), F.concat_ws(":", "l_linenumber", "l_returnflag").alias("*"))
    pages = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.struct(F.collect_list(link).alias("links")).alias("parse"))).alias("body"))
    found = pages.select("l_orderkey", F.explode(M.page_links(F.col("body"))).alias("t"))
    return found.select("l_orderkey", F.split_part("t", F.lit(":"), F.lit(1)).cast("int").alias("l_linenumber"), F.split_part("t", F.lit(":"), F.lit(2)).alias("title"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'https://x/f' WHEN o_orderstatus = 'O' THEN 'https://x/o/' || o_custkey WHEN o_orderkey % 2 = 0 THEN 'https://x/l' ELSE '' END AS url FROM orders""")
def source_urls(spark, sf_dir):
    """Source address of metadata: two keys, the first reference link, or nothing."""
    o = read(spark, sf_dir, "orders")
    meta = F.to_json(F.struct(F.when(F.col("o_orderstatus") == "F", "https://x/f").otherwise("").alias("source_url"), F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("https://x/o/"), F.col("o_custkey").cast("string"))).alias("link"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("https://x/l"), F.lit("https://x/m"))).otherwise(F.array().cast("array<string>")).alias("ReferenceLinks")))
    return o.select("o_orderkey", M.source_url(meta, "source_url", "link").alias("url"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '' ELSE 'gov ה- ' || c_nationkey || ', ' || c_mktsegment END AS government, CASE WHEN c_acctbal < 0 THEN '' ELSE c_nationkey::VARCHAR END AS number FROM customer")
def decision_metadata(spark, sf_dir):
    """Tags of a JSON item: a title where the way to it exists, and the number between its mark and the comma."""
    said = F.concat(F.lit("gov ה- "), F.col("c_nationkey").cast("string"), F.lit(", "), "c_mktsegment")
    tags = F.when(F.col("c_acctbal") >= 0, F.struct(F.struct(F.array(F.struct(said.alias("title"))).alias("ממשלה")).alias("metaData")))
    rows = read(spark, sf_dir, "customer").select("c_custkey", M.tag_title(F.to_json(F.struct(tags.alias("tags"))), "metaData", "ממשלה").alias("government"))
    return rows.select("c_custkey", "government", M.number_after(F.col("government"), "ה-").alias("number"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_nationkey % 2 = 0 THEN 'https://laws/takanon#סעיף_' || c_nationkey || 'א' ELSE 'https://laws/knesset#סעיף_' || c_nationkey || 'א' END AS url FROM customer")
def law_sections(spark, sf_dir):
    """Section a text refers to, in the law that it names first."""
    laws = F.when(F.col("c_nationkey") % 2 == 0, "תקנון הכנסת, ובהמשך חוק הכנסת").otherwise("חוק  הכנסת, ובהמשך תקנון הכנסת")
    said = F.concat(F.lit("לפי "), laws, F.when(F.col("c_acctbal") < 0, " בלבד").otherwise(F.concat(F.lit(" סְעיף "), F.col("c_nationkey").cast("string"), F.lit("א(ב)"))))
    return read(spark, sf_dir, "customer").select("c_custkey", M.law_section(said, {"takanon": "https://laws/takanon", "chok_knesset": "https://laws/knesset"}).alias("url"))


@query("SELECT doc_id, CASE WHEN n = '' THEN 'document.docx' WHEN length(f) > 100 THEN f[1:95] || '.docx' ELSE f END AS name FROM (SELECT *, CASE WHEN lower(n) LIKE '%.docx' THEN n ELSE n || '.docx' END AS f FROM (SELECT doc_id, trim(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '[\\x00-\\x1f/\\\\]', '', 'g')) AS n FROM documents))")
def document_names(spark, sf_dir):
    """Download names from first lines."""
    return read(spark, sf_dir, "documents").select("doc_id", M.document_name(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))).alias("name"))


@query("SELECT page_id, '[a](https://page#s' || page_id || ') [b](https://host/wiki/x) [c](' || url || '/a b(' || page_id || ')) [d](rel)' AS text FROM pages")
def rewritten_links(spark, sf_dir):
    """Markdown links made absolute and decoded."""
    said = F.concat(F.lit("[a](#s"), F.col("page_id").cast("string"), F.lit(") [b](/wiki/x) [c]("), "url", F.lit("/a%20b%28"), F.col("page_id").cast("string"), F.lit("%29) [d](rel)"))
    return read(spark, sf_dir, "pages").select("page_id", M.absolute_links(said, "https://page", "https://host").alias("text"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def unwrapped_objects(spark, sf_dir):
    """Objects of answers: wrapped under one key, as a list, or single."""
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.lit("x").alias("t"))).alias("items"))
    body = F.when(F.size("items") == 1, F.to_json(F.get("items", F.lit(0)))).when(F.col("l_orderkey") % 2 == 0, F.to_json(F.struct("items"))).otherwise(F.to_json("items"))
    return g.select("l_orderkey", F.explode(M.unwrapped(body)).alias("o")).select("l_orderkey", F.get_json_object("o", "$.n").cast("int").alias("l_linenumber"))


@query("SELECT page_id, list_sort([url, 'http://b/' || page_id]) AS urls FROM pages")
def attachment_lists(spark, sf_dir):
    said = F.concat(F.lit(" http://b/"), F.col("page_id").cast("string"), F.lit(" \n ftp://no,,"), "url", F.lit(" ,x"))
    return read(spark, sf_dir, "pages").select("page_id", F.sort_array(M.attachment_urls(said)).alias("urls"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(translate(text, '()[]{}', ')(][}{'), chr(10)), lambda l: array_to_string(list_transform(range(length(l), 0, -1), lambda i: substr(l, i, 1)), '')), chr(10)) AS shown FROM documents")
def mirrored_lines(spark, sf_dir):
    """Right-to-left display: mirrored brackets, lines spelt backwards by code points."""
    return read(spark, sf_dir, "documents").select("doc_id", M.reversed_lines(M.mirrored(F.col("text"))).alias("shown"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_returnflag = 'N' THEN floor(l_quantity)::INT::VARCHAR ELSE 'many' END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, (CASE WHEN try_cast(v AS INT) IS NULL THEN 10 ELSE least(greatest(try_cast(v AS INT), 5), 40) END)::INT AS value, v IS NOT NULL AND (try_cast(v AS INT) IS NULL OR try_cast(v AS INT) NOT BETWEEN 5 AND 40) AS warned FROM s""")
def int_settings(spark, sf_dir):
    """Whole-number settings with default, bounds and a warning."""
    v = F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("int").cast("string")).when(F.col("l_returnflag") != "A", "many")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", M.int_setting(v, 10, 5, 40).alias("s")).select("l_orderkey", "l_linenumber", "s.value", "s.warned")


@query("SELECT p_partkey, p_type AS content, p_name AS title, p_brand AS extracted FROM part WHERE p_size > 3")
def index_documents(spark, sf_dir):
    """Documents for a field-weighted index, of Markdown files only, with an optional namespace."""
    p = read(spark, sf_dir, "part").withColumn("file", F.concat(F.lit("x/"), "p_name", F.when(F.col("p_size") > 3, ".md").otherwise(".txt")))
    doc = M.search_document(F.col("p_type"), F.col("file"), F.col("p_brand"))
    return p.where(F.endswith("file", F.lit(".md"))).select("p_partkey", doc.alias("d")).select("p_partkey", "d.content", "d.metadata.title", F.col("d.metadata.metadata.extracted_data").alias("extracted"))


@query("""WITH s AS (SELECT p_partkey AS id, CASE WHEN ' ' || lower(p_name) || ' ' LIKE '% small widget %' THEN 6.0 END AS a, nullif(contains(' ' || lower(p_name) || ' ', ' small ')::INT + contains(' ' || lower(p_name) || ' ', ' widget ')::INT, 0) * 1.5 AS b FROM part)
SELECT id, round(coalesce(a, 0) + coalesce(b, 0), 6)::DOUBLE AS score, row_number() OVER (ORDER BY coalesce(a, 0) + coalesce(b, 0) DESC, id) - 1 AS rank FROM s WHERE (a IS NOT NULL OR b IS NOT NULL) AND coalesce(a, 0) + coalesce(b, 0) >= 2 ORDER BY rank LIMIT 60""")
def field_weighted_search(spark, sf_dir):
    """A phrase counts more than single words; scores under the least one are cut."""
    fields = (W.Field("p_name", exact=3.0, boost=2.0, phrase=True), W.Field("p_name", partial=0.5, boost=3.0))
    top = W.field_weighted(read(spark, sf_dir, "part"), fields, "small widget", 60, id_col="p_partkey", min_score=2.0)
    return top.select("id", rounded("score", "score"), "rank")


@query()
def knn_lists(spark, sf_dir):
    """Every twentieth vector searched by product codes, the fifty best of each scored exactly (tests hold its recall against brute force)."""
    e = read(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return QuantisedLists.build(e, id_col="vec_id", vec="embedding").search(asked, 10, short=50).select("query_id", "id", rounded("score", "score"), "rank")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'daily_quota' WHEN event_type = 'signup' THEN 'rate_limit' ELSE 'other' END AS kind FROM events")
def error_kinds(spark, sf_dir):
    """Failures by message, whole words only."""
    said = F.when(F.col("event_type") == "error", "Daily limit reached").when(F.col("event_type") == "signup", "429: RPM exceeded").otherwise("harpdown failed")
    return read(spark, sf_dir, "events").select("event_id", T.error_kind(said).alias("kind"))
