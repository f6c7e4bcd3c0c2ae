"""Queries of the training-data operators, one for each, over whole tables; and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm import alignment, chat, decontaminate, imatch, jaccard_join, mixing, pii, prefix_trie, quality, repetition, token_counts, token_output, toxicity
from corpusweave.llm.common import table


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.chat_windows(turns.unionByName(extra)))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repetition.quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "base_failed", "kept")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


_SHINGLES = r"""
words AS (SELECT {id} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
{name} AS (SELECT id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM words WHERE len(w) > 0)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_jaccard_join": "WITH RECURSIVE " + _SHINGLES.format(id="doc_id", table="documents", name="shingles") + """,
n AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id),
links AS (SELECT o.a, o.b FROM o JOIN n x ON o.a = x.id JOIN n y ON o.b = y.id WHERE 100 * o.o >= 75 * (x.n + y.n - o.o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
sets AS (SELECT id, list_sort(list(s)) AS l FROM shingles GROUP BY id),
classes AS (SELECT x.id, min(y.id) AS class_id FROM sets x JOIN sets y ON x.l = y.l GROUP BY x.id),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
mates AS (SELECT links.a, count(DISTINCT y.class_id) AS n_links FROM links JOIN classes x ON x.id = links.a JOIN classes y ON y.id = links.b WHERE x.class_id <> y.class_id GROUP BY links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least.component_id::BIGINT AS component_id, coalesce(c.class_id, d.doc_id)::BIGINT AS class_id, coalesce(mates.n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN mates ON mates.a = d.doc_id LEFT JOIN n ON n.id = d.doc_id LEFT JOIN classes c ON c.id = d.doc_id JOIN least ON least.a = d.doc_id""",
        "op6_mixing": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM c),
l AS (SELECT *, arg_min(share, cap / w) FILTER (WHERE cap / w > share) OVER () AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, w * level) END AS target FROM l),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (greatest(0, least(size, floor(target)::BIGINT - before)) + greatest(0, least(size, floor(target)::BIGINT - before - source_size)))::BIGINT AS taken FROM q""",
        "op7_decontamination": "WITH " + _SHINGLES.format(id="doc_id", table="documents", name="ds") + "," + _SHINGLES.format(id="item_id", table="benchmark", name="bs").replace("words", "words2") + """,
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id),
o AS (SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS o FROM bs JOIN ds ON bs.s = ds.s GROUP BY 1, 2)
SELECT o.doc_id, o.item_id, n.n::BIGINT AS n_shingles, o.o::BIGINT AS n_shared FROM o JOIN n ON n.id = o.item_id WHERE 100 * o.o >= 75 * n.n""",
        # A word lies under a repeat of n words or more exactly if it lies in an n-word window that comes twice; a repeat of more
        # than 100 words is a 101-word window that comes twice.
        "op11_repetition": r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
p AS (SELECT r, s.s, unnest(list_transform(range(1, len(w) - s.s + 2), lambda i: md5(array_to_string(w[i:i + s.s - 1], ' ')))) AS k, unnest(range(1, len(w) - s.s + 2)) AS i FROM d, (VALUES (3), (8), (101)) AS s(s)),
g AS (SELECT r, s, i, count(*) OVER (PARTITION BY r, s, k) AS c FROM p),
q AS (SELECT DISTINCT r, s, unnest(range(i, i + s)) AS at FROM g WHERE c > 1),
n AS (SELECT r, count(*) FILTER (WHERE s = 3) AS n3, count(*) FILTER (WHERE s = 8) AS n8, count(*) FILTER (WHERE s = 101) AS n101 FROM q GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n3, 0)::BIGINT AS n_repeat_words, coalesce(n8, 0)::BIGINT AS n_covered, coalesce(n101, 0) AS n101 FROM d LEFT JOIN n USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered <= 30 * n_words AND n101 = 0 AS kept FROM f""",
        "op13_prefix_trie": """WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, count(*) AS n, c - c % 100 AS base, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % 6 AS h FROM t GROUP BY c),
m AS (SELECT h.c, h.h, h.base, least(h.h, coalesce(b.n, 0)) AS m FROM h LEFT JOIN h b ON b.c = h.base),
r AS (SELECT m.c, t.pos AS depth, role, text FROM m JOIN t ON t.c = m.base AND t.pos <= m.h UNION ALL SELECT t.c, m.m + t.pos - m.h, role, text FROM t JOIN m ON t.c = m.c WHERE t.pos > m.h),
mem AS (SELECT c, 0 AS depth, 0 AS chars, '' AS k FROM h UNION ALL SELECT c, depth, length(text), md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY depth)) FROM r),
node AS (SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM mem GROUP BY depth, k),
ends AS (SELECT mem.depth, k, sha256(string_agg(mem.c::VARCHAR, ',' ORDER BY mem.c)) AS e FROM mem JOIN (SELECT c, max(depth) AS l FROM mem GROUP BY c) x ON mem.c = x.c AND mem.depth = x.l GROUP BY mem.depth, k),
up AS (SELECT node.depth, node.k, p.k AS pk, p.conv_id AS parent FROM node JOIN mem ON mem.c = node.conv_id AND mem.depth = node.depth - 1 JOIN node p ON p.depth = mem.depth AND p.k = mem.k),
kids AS (SELECT depth - 1 AS depth, pk AS k, count(*) AS n FROM up GROUP BY depth, pk),
own AS (SELECT node.*, coalesce(kids.n, 0) AS n, (n_convs - 1) * chars AS saved FROM node LEFT JOIN kids USING (depth, k)),
total AS (SELECT mem.depth, mem.k, count(*) FILTER (WHERE own.n = 0) AS leaves, sum(saved) AS saved FROM own JOIN mem ON mem.c = own.conv_id AND mem.depth <= own.depth GROUP BY mem.depth, mem.k)
SELECT own.conv_id::BIGINT AS conv_id, own.depth::BIGINT AS depth, up.parent::BIGINT AS parent_conv_id, own.n_convs::BIGINT AS n_convs, own.n::BIGINT AS n_children, total.leaves::BIGINT AS n_leaves, total.saved::BIGINT AS saved_tokens, coalesce(ends.e, sha256('')) AS ends_sha256
FROM own JOIN total USING (depth, k) LEFT JOIN up USING (depth, k) LEFT JOIN ends USING (depth, k)""",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_output, op2_pii, op3_chat_windows, op4_jaccard_join, op5_imatch, op6_mixing, op7_decontamination, op8_token_counts, op9_quality, op10_toxicity, op11_repetition, op12_token_alignment, op13_prefix_trie)
    return {f.__name__: f for f in own}
