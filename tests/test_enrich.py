import json

from pyspark.sql import functions as F

from corpusweave.operators import enrich as X
from corpusweave.operators import results as Y


def test_embed_batches_in_order(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(7)] + [(7, None)], "id int, content string").coalesce(1)
    got = {r.id: r.embedding for r in X.embed(df, size=3).collect()}
    assert got[3] == X.hashed_embedding("t3") and abs(sum(x * x for x in got[3]) - 1) < 1e-9 and set(got[7]) == {0.0}


def test_extract_isolates_errors(spark):
    def ask(t):
        if t == "boom":
            raise RuntimeError("no")
        return {"a": '{"x": 1}', "b": "{'x': 2,}", "c": "nothing"}[t]

    df = spark.createDataFrame([("a",), ("b",), ("boom",), ("c",)], "t string")
    got = {r.t: (r.extracted, r.extracted_error) for r in X.extract(df, "t", ask).collect()}
    assert json.loads(got["a"][0]) == {"x": 1} and json.loads(got["b"][0]) == {"x": 2} and got["boom"] == (None, "RuntimeError: no") and got["c"] == (None, "no JSON")


def test_categorize_falls_back(spark):
    answers = {"good": '{"type": "k", "topic": "t"}', "odd": '{"type": "zz", "topic": "t"}', "bad": "?"}
    df = spark.createDataFrame([(a,) for a in answers], "t string")
    got = {r.t: (r.doc_type, r.topic) for r in X.categorize(df, "t", lambda t: answers[t], frozenset({"k"}), frozenset({"t"}), ("other", "none")).collect()}
    assert got == {"good": ("k", "t"), "odd": ("other", "none"), "bad": ("other", "none")}


def test_small_rules(spark):
    df = spark.createDataFrame([("a", "b"), ("", "b"), ("a", None), ("", " ")], "n string, o string")
    assert [r.v for r in df.select(X.short_verdict(F.col("n"), F.col("o")).alias("v")).collect()] == [None, "OLD", "NEW", "TIE"]
    r = X.repair_fields(spark.createDataFrame([("x", "y")], "Title string, publish_date string"), {"title": "?", "date": "?", "who": "nobody"}).first()
    assert (r["date"], r["who"]) == ("y", "nobody")
    b = spark.createDataFrame([("# H\ntext\n- one\n2. two",)], "t string").select(X.markdown_blocks(F.col("t")).alias("b")).first().b
    assert [(x.kind, x.text) for x in b] == [("heading", "H"), ("paragraph", "text"), ("bullet", "one"), ("number", "two")]


def test_results(spark):
    meta = json.dumps({"a": "", "n": None, "u": ["http://made.up/x"], "source_url": "http://h", "extracted_data": {"a": "deep", "d": "2020"}, "long": "z" * 300})
    df = spark.createDataFrame([(meta,)], "m string")
    m = F.col("m")
    r = df.select(Y.json_field(m, "a").alias("a"), Y.has_key(m, "n").alias("n"), Y.has_key(m, "zz").alias("z"), Y.contains_all(m, {"source_url": "http://h"}).alias("c"), Y.surfaced(m, {"url": ("u", "source_url"), "t": ("long",)}, made_up_url="made").alias("s"), Y.browse_fields(m, ("extracted_data", "u")).alias("b")).first()
    assert r.a == "deep" and r.n and not r.z and r.c and r.s["url"] == "http://h" and len(r.s["t"]) == 203 and set(r.b) == {"source_url", "long"} and len(r.b["long"]) == 153
    hits = spark.createDataFrame([("x", 0.5, "one\ntwo"), ("y", 0.9, "three")], "id string, score double, content string")
    assert Y.to_text(hits, "text-short") == "three\none" and Y.to_text(hits).startswith("[Score: 0.90]\nthree") and Y.to_text(hits.limit(0)) == Y.NO_RESULTS
    g = df.select(Y.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("g")).first().g
    assert g == {"a": "1", "b": "3"}
