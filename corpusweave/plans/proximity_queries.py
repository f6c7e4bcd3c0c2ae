"""Queries of word proximity and of protocol heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.catalogue import query, read, rounded
from corpusweave.functions import text as T
from corpusweave.functions.proximity import cover_density, holds_all
from corpusweave.operators.turns import HeadRules, heads


@query(r"""WITH t AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(list_filter(w, lambda x: x <> '')) AS word, generate_subscripts(list_filter(w, lambda x: x <> ''), 1) AS pos FROM t),
h AS (SELECT doc_id, pos, starts_with(word, 'th') AS a FROM u WHERE starts_with(word, 'th') OR starts_with(word, 'an')),
c AS (SELECT doc_id, pos, a, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS p, lag(a) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM h)
SELECT doc_id, round(sum(0.1 / (pos - p)), 8) AS density FROM c WHERE a <> b GROUP BY doc_id""")
def cover_density_words(spark, sf_dir):
    """Documents with words of both beginnings, and how near these stand to each other."""
    words = ["th", "an"]
    d = read(spark, sf_dir, "documents").where(holds_all(F.col("text"), words))
    return d.select("doc_id", rounded(cover_density(T.tokens(F.col("text")), words), "density", 8))


@query(r"""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, ls FROM x),
n AS (SELECT doc_id, pos, regexp_replace(ls[pos], '^\s+|\s+$', '', 'g') AS t FROM l),
b AS (SELECT *, min(CASE WHEN starts_with(t, 'Le') THEN pos END) OVER (PARTITION BY doc_id) AS body FROM n WHERE t <> ''),
e AS (SELECT *, CASE WHEN contains(t, 'ha') THEN 1 WHEN length(t) > 60 OR suffix(t, ':') THEN 0 END AS turn FROM b WHERE body IS NULL OR pos < body),
s AS (SELECT *, last_value(turn IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS inside FROM e)
SELECT doc_id, arg_min(regexp_extract(t, 'the\s+h?(\S+)', 1), pos) FILTER (WHERE regexp_matches(t, 'the\s+h?(\S+)') AND NOT contains(t, 'ing')) AS number,
arg_min(t, pos) FILTER (WHERE regexp_matches(t, '^The|on')) AS label, arg_min(regexp_extract(t, '(an\s+\S+(?:\s+\S+){0,3})', 1), pos) FILTER (WHERE regexp_matches(t, 'an\s+\S+')) AS committee,
arg_min(t, pos) FILTER (WHERE regexp_matches(t, '[0-9]{4}')) AS date, coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (WHERE inside = 1 AND turn IS NULL), '') AS participants FROM s GROUP BY doc_id""")
def document_heads(spark, sf_dir):
    """Fields and the block of names from the lines of each document before its first header line."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rules = HeadRules(number=r"the\s+h?(\S+)", not_number="ing", label="^The|on", committee=r"(an\s+\S+(?:\s+\S+){0,3})", date="[0-9]{4}", block="ha")
    found = heads(d, by="doc_id", pos="pos", text="line", header=F.startswith(F.regexp_replace("line", r"^\s+", ""), F.lit("Le")), rules=rules)
    return found.withColumn("participants", F.array_join("participants", "\n"))
