import pytest
from pyspark.sql import functions as F

from corpusweave.operators import index as I

COLS = "context string, filename string, content_hash string, position int"


def table(spark, *rows):
    return spark.createDataFrame([("c", *r) for r in rows], COLS)


def test_delta_and_reconcile(spark):
    stored = table(spark, ("a.md", "h1", 0), ("b.md", "h2", 1), ("z.md", "h9", 2))
    incoming = table(spark, ("a.md", "h1", 0), ("b.md", "h3", 1), ("c.md", "h3", 2))
    assert {(r.filename, r.action) for r in I.delta_plan(stored, incoming).collect()} == {("a.md", "unchanged"), ("b.md", "insert"), ("c.md", "unchanged")}
    assert {r.content_hash for r in I.reconcile_plan(stored, incoming).where("orphan").collect()} == {"h2"}
    r = I.sync_counters(stored, incoming).first()
    assert (r.unchanged, r.inserted, r.orphaned, r.churn_percent) == (2, 1, 1, 100)
    after = I.next_state(stored, incoming)
    assert {x.content_hash for x in after.collect()} == {"h1", "h3", "h9"}
    again = I.sync_counters(after, incoming).first()
    assert (again.inserted, again.orphaned, again.churn_percent) == (0, 0, None)


def test_empty_run_deletes_nothing(spark):
    stored = table(spark, ("a.md", "h1", 0))
    assert I.next_state(stored, stored.limit(0)).count() == 1


def test_chunker():
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    assert I.pack_sections("short", 10, 2) == ["short"]
    cut = I.pack_sections("\n".join(f"## s{i}\n{words(25)}" for i in range(3)), 40, 5)
    assert len(cut) == 3 and all(len(c.split()) <= 45 for c in cut)
    long = I.pack_sections(words(90), 40, 5)
    assert len(long) == 3 and all(len(c.split()) <= 40 for c in long) and long[1].split()[:5] == long[0].split()[-5:]


def test_cache_prefers_exact_then_newest(spark):
    cache = spark.createDataFrame([("h", "v1", "p1", 1), ("h", "v2", "p2", 2), ("h", "v3", "p3", 3), ("g", "v1", "q1", 1)], "content_hash string, extractor_version string, payload string, extracted_at int")
    asked = spark.createDataFrame([("h",), ("g",), ("n",)], "content_hash string")
    got = {r.content_hash: (r.payload, r.outcome) for r in I.cache_lookup(asked, cache, "v2").collect()}
    assert got == {"h": ("p2", "exact"), "g": ("q1", "stale"), "n": (None, "miss")}
    budget = I.within_budget(I.cache_lookup(asked, cache, "v9").withColumn("b", F.lit(1)), F.col("outcome") != "exact", 2, by=["b"], order=["content_hash"])
    assert budget.where("granted").count() == 2


def test_snapshots_count_distinct_documents(spark):
    rows = [("b", "s1", "d1"), ("b", "s1", "d1"), ("b", "s2", "d1"), ("b", None, "d2"), ("b", "s2", None)]
    df = spark.createDataFrame(rows, "ctx string, source string, doc string")
    got = {r.source_id: r.doc_count for r in I.snapshot_counts(df, levels=["ctx"], source="source", doc=F.col("doc")).collect()}
    assert got == {"s1": 1, "s2": 1, "(unknown)": 1, "*": 2}


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a")], "k string, l string")
    turned = df.orderBy("l")
    assert I.fingerprint(df, ["k"], F.col("l")).first() == I.fingerprint(turned, ["k"], F.col("l")).first()


def test_guards():
    assert I.guard_coverage(95, 10, 100) == 95
    with pytest.raises(I.CoverageShrunk):
        I.guard_coverage(80, 10, 100)


def test_results_do_not_depend_on_partitions(spark):
    stored = table(spark, *[(f"f{i % 7}", f"h{i % 50}", i) for i in range(200)])
    incoming = table(spark, *[(f"f{i % 5}", f"h{i % 60}", i) for i in range(300)])
    one = sorted(I.delta_plan(stored.coalesce(1), incoming.coalesce(1)).collect())
    assert one == sorted(I.delta_plan(stored.repartition(13), incoming.repartition(7)).collect())


def test_chunks_take_up_few_texts_at_once(spark, monkeypatch):
    texts = [None, "", "one", "## a\n\n" + "x " * 30 + "\n## b\n\n" + "y " * 25] * 3
    files = spark.createDataFrame([(t, i, float(i)) for i, t in enumerate(texts)], "content string, doc_id long, w double").coalesce(1)
    monkeypatch.setattr(I, "CHUNK_ROWS", 5)
    rows = I.chunk(files, size=20, overlap=5).orderBy("doc_id", "chunk_index").collect()
    want = [(i, float(i), n, c) for i, t in enumerate(texts) for n, c in enumerate(I.pack_sections(t or "", 20, 5))]
    assert [(r.doc_id, r.w, r.chunk_index, r.content) for r in rows] == want
    assert all(r.total_chunks == sum(x[0] == r.doc_id for x in want) for r in rows)
