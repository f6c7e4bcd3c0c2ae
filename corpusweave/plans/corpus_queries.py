"""Queries of chunk tables: joins, sets, windows, chunking, delta sync, caches, snapshots, turns, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusweave.catalogue import query, read, rounded
from corpusweave.operators import index as I
from corpusweave.operators import turns as N


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def join_inner(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders").where("o_totalprice > 100000"), read(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT d.doc_id, l.quality, coalesce(l.toxic, -1)::INT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_left(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_semi(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return read(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_anti(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_custkey")
    return read(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT coalesce(d.doc_id, e.vec_id) AS id, d.doc_id IS NOT NULL AS has_text, e.vec_id IS NOT NULL AS has_vector FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id")
def join_full(spark, sf_dir):
    d, e = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "embeddings").select("vec_id")
    return d.join(e, F.col("doc_id") == F.col("vec_id"), "full").select(F.coalesce("doc_id", "vec_id").alias("id"), F.col("doc_id").isNotNull().alias("has_text"), F.col("vec_id").isNotNull().alias("has_vector"))


_ONCE = "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderpriority = '1-URGENT') AND (SELECT count(*) FROM orders r WHERE r.o_custkey = o.o_custkey) >= 2"


@query(_ONCE)
def join_not_exists_scalar(spark, sf_dir):
    """NOT EXISTS and a correlated count, decorrelated by Catalyst."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("cw_orders")
    return spark.sql(_ONCE.replace("FROM orders", "FROM cw_orders"))


@query("SELECT c_custkey, coalesce(arg_max(o_orderkey, (o_orderdate, o_orderkey)), -1)::BIGINT AS latest_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_latest_wins(spark, sf_dir):
    """Latest row per key by partial aggregation, then a left join with a fallback."""
    last = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return read(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("latest", F.lit(-1)).cast("long").alias("latest_order"))


@query("""SELECT doc_id, (i - 1)::INT AS window_no, array_to_string(w[(i - 1) * 40 + 1:(i - 1) * 40 + 50], ' ') AS content FROM (SELECT doc_id, w, unnest(range(1, greatest(ceil((len(w) - 50) / 40.0), 0)::INT + 2)) AS i
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS w FROM documents) WHERE len(w) > 0)""".replace("\\\\", "\\"))
def token_windows(spark, sf_dir):
    """Windows of fifty words that overlap by ten."""
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(I.token_windows(F.col("text"), 50, 10)).alias("window_no", "content"))


@query()
def chunk_greedy(spark, sf_dir):
    """Section packing is a fold with resets, so it runs as an Arrow function."""
    c = I.chunk(read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("content")), size=120, overlap=20)
    return c.select("doc_id", "chunk_index", "total_chunks", "content_hash", F.length("content").alias("n_chars"))


def _two_states(spark, sf_dir):
    """The whole table twice: as stored, with other texts in every third row, and as it comes in, with other texts in every second."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("context"), F.concat(F.lit("f"), (F.col("doc_id") % 100).cast("string")).alias("filename"), "text", F.col("doc_id").alias("position"))
    digest = lambda changed, mark: F.sha2(F.when(changed, F.concat("text", F.lit(mark))).otherwise(F.col("text")), 256).alias("content_hash")
    stored, incoming = digest(F.col("position") % 3 == 0, " before"), digest(F.col("position") % 2 == 1, " after")
    return d.select("context", "filename", stored, "position"), d.select("context", "filename", incoming, "position")


_STATE = "SELECT source AS context, 'f' || (doc_id % 100) AS filename, sha256(CASE WHEN {} THEN text || '{}' ELSE text END) AS content_hash, doc_id AS position FROM documents"
_STORED, _INCOMING = _STATE.format("doc_id % 3 = 0", " before"), _STATE.format("doc_id % 2 = 1", " after")


@query(f"""WITH s AS ({_STORED}), d AS ({_INCOMING}), i AS (SELECT *, row_number() OVER (PARTITION BY context, content_hash ORDER BY position) AS rn FROM d)
SELECT position, CASE WHEN rn = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.context = i.context AND s.content_hash = i.content_hash) THEN 'insert' ELSE 'unchanged' END AS action FROM i""")
def delta_plan(spark, sf_dir):
    stored, incoming = _two_states(spark, sf_dir)
    return I.delta_plan(stored, incoming).select("position", "action")


@query(f"""WITH s AS ({_STORED}), i AS ({_INCOMING})
SELECT position, (EXISTS (SELECT 1 FROM i WHERE i.context = s.context AND i.filename = s.filename) AND NOT EXISTS (SELECT 1 FROM i WHERE i.context = s.context AND i.content_hash = s.content_hash)) AS orphan FROM s""")
def reconcile_plan(spark, sf_dir):
    stored, incoming = _two_states(spark, sf_dir)
    return I.reconcile_plan(stored, incoming).select("position", "orphan")


@query(f"""WITH s AS ({_STORED}), d AS ({_INCOMING}), i AS (SELECT *, row_number() OVER (PARTITION BY context, content_hash ORDER BY position) AS rn FROM d),
a AS (SELECT count(*) FILTER (WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.context = i.context AND s.content_hash = i.content_hash)) AS inserted, count(*) AS n FROM i),
o AS (SELECT count(*) AS orphaned FROM s WHERE EXISTS (SELECT 1 FROM i WHERE i.context = s.context AND i.filename = s.filename) AND NOT EXISTS (SELECT 1 FROM i WHERE i.context = s.context AND i.content_hash = s.content_hash))
SELECT n - inserted AS unchanged, inserted, orphaned, round_even(100.0 * orphaned / nullif(inserted, 0), 0)::BIGINT AS churn_percent FROM a, o""")
def sync_counters(spark, sf_dir):
    stored, incoming = _two_states(spark, sf_dir)
    return I.sync_counters(stored, incoming)


@query("""WITH c AS (SELECT sha256(text) AS content_hash, v AS extractor_version, 'p' || min(doc_id) || v AS payload, min(doc_id) * 10 + CASE v WHEN 'v1' THEN 1 ELSE 2 END AS extracted_at FROM documents, (VALUES ('v1'), ('v2')) t(v) WHERE (v = 'v1' AND doc_id % 2 = 0) OR (v = 'v2' AND doc_id % 3 = 0) GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY (extractor_version = 'v2') DESC, extracted_at DESC, extractor_version DESC) AS rn FROM c)
SELECT d.doc_id, b.extractor_version, b.payload, CASE WHEN b.extractor_version IS NULL THEN 'miss' WHEN b.extractor_version = 'v2' THEN 'exact' ELSE 'stale' END AS outcome FROM documents d LEFT JOIN b ON b.content_hash = sha256(d.text) AND rn = 1""")
def cache_lookup(spark, sf_dir):
    """Exact version, else the newest other one, else a miss."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    v = d.select("doc_id", "content_hash", F.explode(F.expr("filter(array('v1', 'v2'), v -> (v = 'v1' AND doc_id % 2 = 0) OR (v = 'v2' AND doc_id % 3 = 0))")).alias("extractor_version"))
    c = v.groupBy("content_hash", "extractor_version").agg(F.min("doc_id").alias("m"))
    c = c.select("content_hash", "extractor_version", F.concat(F.lit("p"), F.col("m").cast("string"), "extractor_version").alias("payload"), (F.col("m") * 10 + F.when(F.col("extractor_version") == "v1", 1).otherwise(2)).alias("extracted_at"))
    return I.cache_lookup(d, c, "v2").select("doc_id", "extractor_version", "payload", "outcome")


@query("SELECT doc_id, (doc_id % 4 = 0 AND row_number() OVER (PARTITION BY source, doc_id % 4 = 0 ORDER BY doc_id) <= 5) AS granted FROM documents")
def budget_cap(spark, sf_dir):
    """The first five wanted rows of each source."""
    d = read(spark, sf_dir, "documents").withColumn("_w", F.col("doc_id") % 4 == 0)
    return I.within_budget(d, F.col("_w"), 5, by=["source"], order=["doc_id"]).select("doc_id", "granted")


@query("""SELECT c_custkey, c_name || ' live' AS c_name FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0""")
def merge_live_seed(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    live = c.where("c_acctbal >= 0").select("c_custkey", F.concat("c_name", F.lit(" live")).alias("c_name"))
    return I.live_or_seed(live, c.drop("c_acctbal"), "c_custkey")


@query("""WITH u AS (SELECT o_custkey, o_orderkey, o_totalprice, 0 AS new FROM orders UNION ALL SELECT o_custkey, o_orderkey, o_totalprice + 1, 1 FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC, new DESC) AS rn FROM u) WHERE rn = 1""")
def upsert_last_wins(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    changes = o.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    out = I.upsert(o.drop("o_orderstatus"), changes.drop("o_orderstatus"), ["o_custkey"], "o_orderkey")
    return out.select("o_custkey", "o_orderkey", rounded("o_totalprice", "o_totalprice", 2))


@query("SELECT l_orderkey, l_linenumber, l_shipmode IS NOT NULL AS reuse FROM (SELECT l.l_orderkey, l.l_linenumber, o.o_orderkey::VARCHAR AS l_shipmode FROM lineitem l LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON l.l_orderkey = o.o_orderkey)")
def reuse_split(spark, sf_dir):
    """Rows whose key was processed before, kept row by row."""
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return I.reuse_split(read(spark, sf_dir, "lineitem"), done, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "reuse")


@query("""SELECT lang, CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source_id, count(DISTINCT doc)::BIGINT AS doc_count FROM (SELECT lang, CASE WHEN doc_id % 10 = 0 THEN '(unknown)' ELSE source END AS source, substr(sha256(text), 1, 8) AS doc FROM documents WHERE doc_id % 7 <> 0)
GROUP BY GROUPING SETS ((lang, source), (lang))""")
def snapshot_counts(spark, sf_dir):
    """Distinct documents by language and source, and by language."""
    d = read(spark, sf_dir, "documents").withColumn("source", F.when(F.col("doc_id") % 10 == 0, None).otherwise(F.col("source")))
    return I.snapshot_counts(d, levels=["lang"], source="source", doc=F.when(F.col("doc_id") % 7 != 0, F.substring(F.sha2("text", 256), 1, 8)))


@query("SELECT DISTINCT lang AS context, source AS name FROM documents WHERE source <> ''")
def catalog_distinct(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("source <> ''").select(F.col("lang").alias("context"), F.col("source").alias("name")).distinct()


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS n, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def ordered_agg(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("s"), F.count("*").alias("n"), F.max("turn").alias("last_turn"))
    return c.select("conv_id", F.array_join(F.col("s.role"), ",").alias("roles"), "n", "last_turn")


@query("SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def list_agg(spark, sf_dir):
    read(spark, sf_dir, "conversations").createOrReplaceTempView("cw_conversations")
    return spark.sql("SELECT conv_id, listagg(text, '|') WITHIN GROUP (ORDER BY turn) AS body FROM cw_conversations GROUP BY conv_id")


@query("""SELECT o_custkey, sha256(string_agg(line, chr(10) ORDER BY line COLLATE "C")) AS fingerprint, count(*) AS n_lines FROM (SELECT o_custkey, o_orderkey || ',' || o_orderstatus AS line FROM orders) GROUP BY 1""".replace(' COLLATE "C"', ""))
def fingerprint(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return I.fingerprint(o, ["o_custkey"], F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus"))


@query("""SELECT 'both' AS part, word FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents INTERSECT SELECT DISTINCT unnest(string_split(text, ' ')) FROM benchmark)
UNION ALL SELECT 'benchmark', word FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark EXCEPT SELECT DISTINCT unnest(string_split(text, ' ')) FROM documents)""")
def set_ops(spark, sf_dir):
    words = lambda t: read(spark, sf_dir, t).select(F.explode(F.split("text", " ")).alias("word")).distinct()
    d, b = words("documents"), words("benchmark")
    return d.intersect(b).select(F.lit("both").alias("part"), "word").union(b.exceptAll(d).select(F.lit("benchmark"), "word"))


@query("""SELECT a.source AS source_a, b.source AS source_b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS jaccard FROM
(SELECT source, list_sort(list_distinct(list(lang)))  AS w FROM documents GROUP BY 1) a JOIN (SELECT source, list_distinct(list(CASE WHEN doc_id % 10 < 4 THEN lang ELSE 'x' || lang END)) AS w FROM documents GROUP BY 1) b ON a.source = b.source""")
def jaccard_topk(spark, sf_dir):
    """Agreement of two lists per source."""
    from corpusweave.operators.evaluate import top_k_jaccard

    d = read(spark, sf_dir, "documents")
    a = d.groupBy(F.col("source").alias("source_a")).agg(F.sort_array(F.collect_set("lang")).alias("a"))
    b = d.groupBy(F.col("source").alias("source_b")).agg(F.sort_array(F.collect_set(F.when(F.col("doc_id") % 10 < 4, F.col("lang")).otherwise(F.concat(F.lit("x"), "lang")))).alias("b"))
    return a.join(b, F.col("source_a") == F.col("source_b")).select("source_a", "source_b", rounded(top_k_jaccard(F.col("a"), F.col("b"), 100), "jaccard"))


@query("""WITH l AS (SELECT *, CASE WHEN role = 'system' THEN text END AS a, role = 'user' AS h FROM conversations), t AS (SELECT *, sum(h::INT) OVER w AS turn_no, last_value(a IGNORE NULLS) OVER w AS agenda FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, turn_no::BIGINT AS turn_no, max(CASE WHEN h THEN text END) AS speaker, max(CASE WHEN h THEN agenda END) AS agenda, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE NOT h AND a IS NULL) AS text, (count(*) FILTER (WHERE NOT h AND a IS NULL))::INT AS n_paragraphs FROM t WHERE turn_no > 0 GROUP BY 1, 2
HAVING trim(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE NOT h AND a IS NULL), '')) <> ''""")
def turn_segments(spark, sf_dir):
    """A user line opens a turn, what follows is its body, system lines are the agenda."""
    c = read(spark, sf_dir, "conversations")
    t = N.segment(c, by="conv_id", pos="turn", header=F.col("role") == "user", text=F.col("text"), agenda=F.when(F.col("role") == "system", F.col("text")))
    return t.select("conv_id", F.col("turn_no").cast("long").alias("turn_no"), "speaker", "agenda", "text", "n_paragraphs")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS agenda FROM conversations")
def forward_fill(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("a", F.when(F.col("role") == "system", F.col("text")))
    return N.forward_fill(c, by="conv_id", pos="turn", value="a", out="agenda").select("conv_id", "turn", "agenda")


@query("SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS next_start FROM lineitem")
def lead_bounds(spark, sf_dir):
    return N.bounds(read(spark, sf_dir, "lineitem"), by="l_orderkey", start="l_linenumber").select("l_orderkey", "l_linenumber", "next_start")


@query("""SELECT l_orderkey, l_linenumber, (SELECT max(p.l_linenumber) FROM lineitem p WHERE p.l_orderkey = c.l_orderkey AND p.l_linenumber < c.l_linenumber AND floor(p.l_quantity)::INT % 5 < floor(c.l_quantity)::INT % 5) AS parent FROM lineitem c""")
def depth_parents(spark, sf_dir):
    """Nearest earlier item of smaller depth (depth: quantity modulo five)."""
    i = read(spark, sf_dir, "lineitem").withColumn("depth", F.col("l_quantity").cast("int") % 5)
    return N.parents(i, by="l_orderkey", pos="l_linenumber", depth="depth").select("l_orderkey", "l_linenumber", F.col("parent_pos").alias("parent"))


@query("SELECT conv_id, turn, 'c_' || (row_number() OVER (ORDER BY conv_id, turn) - 1) || '.md' AS filename FROM conversations")
def positional_names(spark, sf_dir):
    """Names by global position: counts per conversation give each one's offset, so no window spans all rows."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn")
    per = c.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("bucket", F.floor(F.col("conv_id") / 1000))
    heads = per.groupBy("bucket").agg(F.sum("n").alias("t")).withColumn("b0", F.coalesce(F.sum("t").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("conv_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.withColumn("i0", inside).join(heads.select("bucket", "b0"), "bucket").select("conv_id", (F.col("b0") + F.col("i0")).alias("offset"))
    rows = c.withColumn("p", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).join(offsets, "conv_id")
    return rows.select("conv_id", "turn", F.concat(F.lit("c_"), (F.col("offset") + F.col("p")).cast("string"), F.lit(".md")).alias("filename"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """The windowed aggregate of the event stream, run as a batch over the same table (tests hold both equal)."""
    from corpusweave.streaming.events import tumbling

    e = read(spark, sf_dir, "events")
    return tumbling(e.withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", rounded("total", "total", 4))


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, k""")
def stream_session(spark, sf_dir):
    from corpusweave.streaming.events import sessions

    s = sessions(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n", rounded("total", "total", 4))
