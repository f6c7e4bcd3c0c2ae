"""Queries of trigram similarity over the titles of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.catalogue import query, read, rounded
from corpusweave.operators import similarity as S
from corpusweave.plans.retrieval_queries import _GRAMS

_TITLES = "t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"


def _titles(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(f"""WITH {_TITLES}, n AS (SELECT DISTINCT title AS name FROM t), m AS (SELECT DISTINCT substr(title, 4) || ' x' AS mention FROM t WHERE page_id % 20 = 0),
a AS (SELECT mention, unnest({_GRAMS.format(c="mention")}) AS g FROM m), b AS (SELECT name, unnest({_GRAMS.format(c="name")}) AS g FROM n),
na AS (SELECT mention, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT name, count(*) AS nb FROM b GROUP BY 1), o AS (SELECT mention, name, count(*) AS o FROM a JOIN b USING (g) GROUP BY 1, 2)
SELECT mention, name, round(o / (na + nb - o)::DOUBLE, 6) AS similarity FROM o JOIN na USING (mention) JOIN nb USING (name) WHERE o / (na + nb - o)::DOUBLE >= 0.45""")
def similar_titles(spark, sf_dir):
    """All titles like a cut one (every twentieth page's) at 0.45 or more."""
    t = _titles(spark, sf_dir)
    m = t.where("page_id % 20 = 0").select(F.concat(F.expr("substr(title, 4)"), F.lit(" x")).alias("mention"))
    return S.similar_pairs(m, t.withColumnRenamed("title", "name"), least=0.45).select("mention", "name", rounded("similarity", "similarity"))


@query(f"""WITH {_TITLES}, q AS (SELECT page_id AS query_id, array_to_string(string_split(title, ' ')[2:3], ' ') AS q FROM t WHERE page_id % 20 = 0),
w AS (SELECT query_id, {_GRAMS.format(c="q")} AS w FROM q), h AS (SELECT page_id AS id, {_GRAMS.format(c="title").removeprefix("list_distinct(").removesuffix(")")} AS h FROM t),
p AS (SELECT query_id, id, w, h, list_filter(range(1, len(h) + 1), lambda i: list_contains(w, h[i])) AS spots FROM w, h WHERE len(list_intersect(w, h)) >= 0.6 * len(w) AND len(w) > 0),
x AS (SELECT query_id, id, w, h, unnest(spots) AS i, spots FROM p), y AS (SELECT query_id, id, w, h, i, unnest(list_filter(spots, lambda j: j >= i)) AS j FROM x),
z AS (SELECT query_id, id, len(w) AS n, len(list_intersect(w, list_distinct(h[i:j]))) AS c, len(list_distinct(h[i:j])) AS s FROM y),
s AS (SELECT query_id, id, max(c / (n + s - c)::DOUBLE) AS score FROM z GROUP BY 1, 2)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s WHERE score >= 0.6) WHERE rank < 10""")
def word_similarity_batch(spark, sf_dir):
    """Two words of every twentieth title against all titles, by the best extent."""
    t = _titles(spark, sf_dir)
    asked = t.where("page_id % 20 = 0").select(F.col("page_id").alias("query_id"), F.array_join(F.slice(F.split("title", " "), 2, 2), " ").alias("query_text"))
    return S.word_similar(asked, t, 10, text="title", id_col="page_id").select("query_id", "id", rounded("score", "score"), "rank")
