"""Queries of names in whole query tables, of validation and freshness, of first events and lexicon pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.catalogue import query, read, rounded
from corpusweave.operators import guards as G
from corpusweave.operators import names as N
from corpusweave.plans.retrieval_queries import _GRAMS
from corpusweave.sources import binary as B
from corpusweave.streaming import events as S

_BEST = f"""n AS (SELECT DISTINCT p_name AS name FROM part), a AS (SELECT mention, unnest({_GRAMS.format(c="mention")}) AS g FROM (SELECT DISTINCT mention FROM m)), b AS (SELECT name, unnest({_GRAMS.format(c="name")}) AS g FROM n),
na AS (SELECT mention, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT name, count(*) AS nb FROM b GROUP BY 1), o AS (SELECT mention, name, count(*) AS o FROM a JOIN b USING (g) GROUP BY 1, 2),
r AS (SELECT mention, name, o / (na + nb - o)::DOUBLE AS sim FROM o JOIN na USING (mention) JOIN nb USING (name)), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY sim DESC, name) AS rn FROM r WHERE sim >= $least) WHERE rn = 1)"""


@query(f"""WITH q AS (SELECT p_partkey AS id, 'tell ' || p_name || CASE p_size % 4 WHEN 0 THEN ', now' WHEN 1 THEN ' of ' || p_brand WHEN 2 THEN ' red' ELSE ' please and very soon today' END AS query FROM part),
w AS (SELECT id, string_split(query, ' ') AS raw, list_transform(string_split(query, ' '), lambda x: trim(x, '?,.!"''():;')) AS bare FROM q),
t AS (SELECT *, list_filter(range(1, len(bare) + 1), lambda i: list_contains(['small', 'red', 'blue'], bare[i]) OR list_contains(['small', 'red', 'blue'], substr(bare[i], 2))) AS s, len(list_filter(bare, lambda x: x <> '' AND x <> 'of')) AS content FROM w),
m AS (SELECT id, content, k + 1 AS words, array_to_string(bare[s[1]:s[1] + k], ' ') AS mention FROM t, (VALUES (1), (2), (3)) v(k) WHERE len(s) = 1 AND s[1] + k <= len(bare)
AND len(list_filter(range(1, k + 1), lambda j: bare[s[1] + j] IN ('', 'of'))) = 0 AND len(list_filter(range(1, k), lambda j: bare[s[1] + j] <> raw[s[1] + j])) = 0), {_BEST.replace("$least", "0.55")}
SELECT id, name, round(sim, 6) AS similarity FROM (SELECT m.*, best.name, best.sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC, words) AS place FROM m JOIN best USING (mention)) WHERE place = 1 AND words / content::DOUBLE >= 0.5""")
def detected_names(spark, sf_dir):
    """The part name that each of many queries is about."""
    more = F.when(F.col("p_size") % 4 == 0, ", now").when(F.col("p_size") % 4 == 1, F.concat(F.lit(" of "), "p_brand")).when(F.col("p_size") % 4 == 2, " red").otherwise(" please and very soon today")
    p = read(spark, sf_dir, "part")
    asked = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("tell "), "p_name", more).alias("query"))
    found = N.detect_names(asked, p.select(F.col("p_name").alias("name")), ["small", "red", "blue"], ["of"])
    return found.select("id", "name", rounded("similarity", "similarity"))


@query(f"""WITH q AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' x' WHEN 2 THEN 'zzqq' ELSE '' END AS wanted FROM part),
m AS (SELECT DISTINCT wanted AS mention FROM q WHERE wanted <> '' AND wanted NOT IN (SELECT p_name FROM part)), {_BEST.replace("$least", "0.45")}
SELECT id, CASE WHEN wanted IN (SELECT name FROM n) THEN wanted ELSE best.name END AS name, CASE WHEN wanted = '' THEN 'all' WHEN wanted IN (SELECT name FROM n) THEN 'exact' WHEN best.name IS NOT NULL THEN 'resolved' ELSE 'absent' END AS decision FROM q LEFT JOIN best ON best.mention = q.wanted""")
def resolved_names(spark, sf_dir):
    """Name filters of many requests: known, put right, or absent, where the search goes on without them."""
    p = read(spark, sf_dir, "part")
    wanted = F.when(F.col("p_size") % 4 == 0, F.col("p_name")).when(F.col("p_size") % 4 == 1, F.concat("p_name", F.lit(" x"))).when(F.col("p_size") % 4 == 2, "zzqq").otherwise("")
    asked = p.select(F.col("p_partkey").alias("id"), wanted.alias("wanted"))
    return N.resolve_names(asked, p.select(F.col("p_name").alias("name"))).select("id", "name", "decision")


@query("""WITH o AS (SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS a, '' AS b, CASE WHEN o_totalprice > 480000 THEN o_orderstatus END AS c FROM orders)
SELECT field, missing, total, CASE WHEN missing = total THEN 'error' WHEN missing > 0.8 * total THEN 'warning' ELSE 'ok' END AS verdict FROM
(SELECT 'a' AS field, count(*) FILTER (WHERE a IS NULL) AS missing, count(*) AS total FROM o UNION ALL SELECT 'b', count(*), count(*) FROM o UNION ALL SELECT 'c', count(*) FILTER (WHERE c IS NULL), count(*) FROM o)""")
def required_fields(spark, sf_dir):
    """Missing values of required columns, with the verdict on each."""
    o = read(spark, sf_dir, "orders")
    rows = o.select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("a"), F.lit("").alias("b"), F.when(F.col("o_totalprice") > 480000, F.col("o_orderstatus")).alias("c"))
    return G.required_fields(rows, ["a", "b", "c"])


@query("SELECT doc_id, length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))::DOUBLE / nullif(length(text), 0) < 0.7 AS refused FROM documents")
def script_refusals(spark, sf_dir):
    """Whole texts with under seven tenths of Latin letters are refused."""
    return read(spark, sf_dir, "documents").select("doc_id", G.script_refusal(F.col("text"), "a-zA-Z", 0.7).isNotNull().alias("refused"))


@query("WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_type, user_id, max(ts) AS newest, any_value((epoch_us(now) - epoch_us(t)) // 1000000)::BIGINT AS age, any_value((epoch_us(now) - epoch_us(t)) // 1000000) > 86400 AS stale FROM (SELECT *, max(ts) OVER (PARTITION BY event_type, user_id) AS t FROM events), n GROUP BY 1, 2")
def freshness_alarm(spark, sf_dir):
    """Feeds without an event for a day, seen from the newest event of all."""
    e = read(spark, sf_dir, "events")
    return S.freshness(e, ["event_type", "user_id"], now=e.agg(F.max("ts")).scalar(), most_seconds=86400)


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_events(spark, sf_dir):
    """The first event of each user and type, as the stream keeps it."""
    return S.first_of_key(read(spark, sf_dir, "events"), ["user_id", "event_type"], order=["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT page_id, ['/lexicon/' || page_id, split_part(url, '#', 1)] AS links FROM pages")
def lexicon_index(spark, sf_dir):
    """Links of index cells only."""
    cell = F.concat(F.lit('<tr><td class="a lexColumns b"><a href="/lexicon/'), F.col("page_id").cast("string"), F.lit('">x</a></td><td><a href="/no">n</a></td>\n<td class="lexColumns">\n<a title="t" href="'), F.split_part("url", F.lit("#"), F.lit(1)), F.lit('">y</a></td></tr>'))
    return read(spark, sf_dir, "pages").select("page_id", B.lexicon_links(cell).alias("links"))
