"""Queries of sources, scalar functions, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.catalogue import query, read
from corpusweave.functions import text as T
from corpusweave.sources import feeds, files


@query("""SELECT 'region_' || (row_number() OVER (ORDER BY r_regionkey) - 1) || '.md' AS filename, 'r_regionkey:' || chr(10) || r_regionkey || chr(10) || chr(10) || 'r_name:' || chr(10) || r_name || chr(10) || chr(10) AS content FROM region
UNION ALL SELECT 'nation_' || n_nationkey || '.md', 'n_nationkey:' || chr(10) || n_nationkey || chr(10) || chr(10) || 'n_name:' || chr(10) || n_name || chr(10) || chr(10) || 'n_regionkey:' || chr(10) || n_regionkey || chr(10) || chr(10) FROM nation""")
def scan_csv_flatten(spark, sf_dir):
    """Rows as text blocks, named by position."""
    out = None
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey")):
        t = read(spark, sf_dir, name)
        part = t.select(F.concat(F.lit(f"{name}_"), F.col(key).cast("string"), F.lit(".md")).alias("filename"), files.flatten(t)[0].alias("content"))
        out = part if out is None else out.union(part)
    return out


@query("SELECT doc_id, (i - 1)::INT AS pos, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def split_blocks(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.missing') IS NOT NULL AS has_missing FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND json_extract_string(props, '$.k')::BIGINT >= 3")
def json_extract_props(spark, sf_dir):
    """Value, existence and containment on JSON text."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return e.where(F.array_contains(F.json_object_keys("props"), F.lit("k")) & (k >= 3)).select("event_id", k.alias("k"), F.array_contains(F.json_object_keys("props"), F.lit("missing")).alias("has_missing"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), 'none') AS label, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END, ''), lang) AS place FROM documents")
def coalesce_fields(spark, sf_dir):
    """First filled value in a stated precedence."""
    d = read(spark, sf_dir, "documents")
    a = T.first_filled(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), F.col("source"), F.lit("none"))
    b = F.coalesce(T.blank_to_null(F.when(F.col("doc_id") % 2 == 0, None).otherwise(F.col("source"))), "lang")
    return d.select("doc_id", a.alias("label"), b.alias("place"))


@query("""SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS preview, 'Available (' || format('{:,}', length(text)) || ' characters)' AS note,
split_part(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), 1) AS first_line FROM documents""".replace("\\\\", "\\"))
def truncate_preview(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.ellipsis(t, 150).alias("preview"), T.full_text_note(t).alias("note"), T.first_line(t).alias("first_line"))


@query(r"""SELECT c_custkey, trim(regexp_replace(translate(n, '־:״׳', '- "' || chr(39)), '[\s\x{00A0}]+', ' ', 'g')) AS norm, trim(split_part(n, ' - ', 1)) AS base FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN replace(c_name, '#', '־') || ':  x - tail' WHEN 1 THEN '  ' || c_name || '״׳ ' ELSE c_name END AS n FROM customer)""")
def name_normalize(spark, sf_dir):
    """Names with marks put in, brought to one form; and the title before ' - '."""
    n = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.replace("c_name", F.lit("#"), F.lit("־")), F.lit(":  x - tail"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("  "), "c_name", F.lit("״׳ "))).otherwise(F.col("c_name"))
    return read(spark, sf_dir, "customer").select("c_custkey", T.norm_name(n).alias("norm"), T.base_title(n).alias("base"))


@query(r"SELECT doc_id, sha256(text) AS content_hash, substr(sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')), 1, 16) AS cache_key FROM documents")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), T.content_hash(F.col("text"), True, 16).alias("cache_key"))


_HTML = "regexp_replace(regexp_replace(regexp_replace(html, '(?i)</(p|div|li|h[1-6]|tr|br)\\s*>', chr(10), 'g'), '(?i)<br\\s*/?\\s*>', chr(10), 'g'), '<[^>]+>', '', 'g')"
for _entity, _plain in T.ENTITIES:
    _HTML = f"replace({_HTML}, '{_entity}', " + ("chr(10)" if _plain == "\n" else "chr(39)" if _plain == "'" else f"'{_plain}'") + ")"
_HTML = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_HTML}, '&#?\\w+;', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n[ \\t]+', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')".replace("{{3,}}", "{3,}")


@query(f"SELECT page_id, {_HTML} AS plain FROM pages")
def html_to_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("plain"))


@query(r"""SELECT page_id, len(l)::INT AS n_links, array_to_string(l, ' ') AS links, sha256(array_to_string(list_sort(list_distinct(list_filter(l, lambda x: x <> ''))), chr(10))) AS fingerprint
FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']([^"''#]+)["'']', 1) AS l FROM pages)""")
def html_links(spark, sf_dir):
    from corpusweave.operators.index import link_fingerprint

    p = read(spark, sf_dir, "pages").select("page_id", feeds.links(F.col("html")).alias("l"))
    return p.select("page_id", F.size("l").alias("n_links"), F.array_join("l", " ").alias("links"), link_fingerprint(F.col("l")).alias("fingerprint"))


@query(r"SELECT page_id, regexp_replace(string_split(url, '/')[-1], '^_', '') AS page, replace(url_decode(replace(string_split(url, '/')[-1], '+', '%2B')), '_', ' ') AS title, regexp_extract(url, '^(https?://[^/]+)', 1) || '/x.pdf' AS sibling FROM pages")
def url_normalize(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", T.page_name(u).alias("page"), T.title_of_url(u).alias("title"), feeds.absolute(F.lit("/x.pdf"), u).alias("sibling"))


_DATES = "CASE o_orderkey % 5 WHEN 0 THEN '2025-13-01' WHEN 1 THEN '2025-02-31' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00' WHEN 3 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE '3390-06-91' END"


@query(rf"""SELECT o_orderkey, s AS raw, regexp_matches(s, '^(19[0-9]{{2}}|20[0-3][0-9])-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])') AS plausible,
coalesce(CASE WHEN regexp_matches(s, '^\d{{2}}\.\d{{2}}\.\d{{4}}$') THEN CAST(try_strptime(s, '%d.%m.%Y') AS DATE) END, CASE WHEN regexp_matches(s, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN CAST(try_strptime(substr(s, 1, 10), '%Y-%m-%d') AS DATE) END) AS day,
coalesce(strftime(try_strptime(replace(substr(s, 1, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S'), '%d/%m/%Y %H:%M'), s) AS shown FROM (SELECT o_orderkey, {_DATES} AS s FROM orders)""")
def date_validate(spark, sf_dir):
    """Dates as text, some of them impossible: which pass the pattern, which are days, and how they are shown."""
    k = F.col("o_orderkey") % 5
    s = F.when(k == 0, "2025-13-01").when(k == 1, "2025-02-31").when(k == 2, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00"))).when(k == 3, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise("3390-06-91")
    o = read(spark, sf_dir, "orders").select("o_orderkey", s.alias("raw"))
    return o.select("o_orderkey", "raw", T.is_plausible_date(F.col("raw")).alias("plausible"), T.publish_date(F.col("raw")).alias("day"), T.display_time(F.col("raw")).alias("shown"))


@query(r"""SELECT doc_id, 'http://h/' || source AS source_url, CAST(doc_id AS VARCHAR) AS source_doc FROM documents""")
def labelled_extract(spark, sf_dir):
    """Values under labels, out of flattened blocks."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("title:\n"), F.substring_index("text", "\n", 1), F.lit("\n\ndocument_id:\n"), F.col("doc_id").cast("string"), F.lit("\n\nsource_url:\nhttp://h/"), "source", F.lit("\n\n")).alias("block"))
    b = F.col("block")
    return d.select("doc_id", T.labelled_value(b, ("source_url", "file_url", "url"), r"https?://[^\n]+").alias("source_url"), T.labelled_value(b, ("file_url", "url", "document_id", "session_id")).alias("source_doc"))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(p_type || ' / ' || p_name || '?', '[<>:\"/\\|?*]', '_', 'g'), '[_\s]+', '_', 'g'), '_') AS file_name FROM part".replace('\\"', '"'))
def file_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.safe_file_name(F.concat("p_type", F.lit(" / "), "p_name", F.lit("?"))).alias("file_name"))


@query("""SELECT o_orderkey, CASE WHEN starts_with(o_orderpriority, '1') OR starts_with(o_orderpriority, '2') THEN 'high' WHEN starts_with(o_orderpriority, '3') THEN 'middle' ELSE 'other' END AS class FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def title_classes(spark, sf_dir):
    """Prefix table, first match wins; value-in filter."""
    o = read(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return o.select("o_orderkey", T.title_class(F.col("o_orderpriority"), (("high", ("1", "2")), ("middle", ("3",)))).alias("class"))


@query("SELECT doc_id, round(coalesce(length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))::DOUBLE / nullif(length(text), 0), 0), 6) AS latin_share FROM documents WHERE length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))::DOUBLE / nullif(length(text), 0) >= 0.5")
def script_filter(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("s", T.script_share(F.col("text"), "a-zA-Z")).where("s >= 0.5")
    return d.select("doc_id", F.round("s", 6).alias("latin_share"))


@query("""SELECT conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN length(regexp_replace(l, '[^a-z]', '', 'g'))::DOUBLE / nullif(length(l), 0) >= 0.3 THEN array_to_string(list_transform(string_split(l, ' '), lambda w: CASE WHEN regexp_matches(w, '[a-z]') THEN reverse(w) ELSE w END), ' ') ELSE l END), chr(10)) AS turned FROM conversations""")
def direction_repair(spark, sf_dir):
    """Lines whose words are spelt backwards, in whole texts."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.reverse_words(F.col("text"), "a-z").alias("turned"))


@query("SELECT page_id, regexp_replace(html, 'https?://[^\\s\"<>]*', '', 'g') AS scrubbed, crc32_of AS n_chars FROM (SELECT page_id, html, length(html)::INT AS crc32_of FROM pages)".replace("\\\\", "\\"))
def url_scrub(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.scrub_urls(F.col("html"), r'https?://[^\s"<>]*').alias("scrubbed"), F.length("html").alias("n_chars"))
