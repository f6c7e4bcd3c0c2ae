import hashlib

import pytest
from pyspark.sql import functions as F

from corpusweave.functions import markup as M
from corpusweave.functions import text as T
from corpusweave.operators import index as I
from corpusweave.operators import retrieve as R
from corpusweave.operators.quantised import QuantisedLists
from corpusweave.plans import upkeep_queries as Q


def one(spark, make, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("o"))
    return [r.o for r in rows.orderBy("i").collect()]


def test_lists_of_vectors_find_most_neighbours(spark, sf_dir):
    d = f"{sf_dir[:-5]}0.01"
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    found = {(r.query_id, r.id) for r in Q.knn_lists(spark, d).collect()}
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = {(r.query_id, r.id) for r in R.knn_many(e, asked, 10, id_col="vec_id").collect()}
    assert len(found & exact) >= 0.9 * len(exact) > 0
    assert QuantisedLists.build(e, id_col="vec_id").rows.count() == e.where("embedding is not null").count()


def test_batch_search_limits_groups_before_the_shuffle(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    assert "WindowGroupLimit" in R.knn_many(e, asked, 5, id_col="vec_id")._jdf.queryExecution().executedPlan().toString()


def test_file_names(spark):
    long = "צו איסור הלבנת הון " * 20
    clean = "_".join(long.split())
    got = one(spark, T.safe_file_name, ' a<b>:"c  d_/', long, "x" * 180, "x" * 181)
    kept = clean.encode()[:180].decode("utf-8", "ignore").rstrip("_")
    assert got[0] == "a_b_c_d" and got[1] == f"{kept}_{hashlib.sha1(clean.encode()).hexdigest()[:8]}" and got[2] == "x" * 180 and len(got[3]) == 189


def test_error_kinds(spark):
    assert one(spark, T.error_kind, "Daily limit reached", "rpd exceeded", "harpdown failed", "RPM", "rpms", None) == ["daily_quota", "daily_quota", "other", "rate_limit", "other", "other"]


def test_markup(spark):
    assert one(spark, M.document_name, None, " ", "a/b\x01", "R.DOCX", "n" * 120) == ["document.docx", "document.docx", "ab.docx", "R.DOCX", "n" * 95 + ".docx"]
    assert one(spark, M.unwrapped, '{"a":[{"x":1},{"x":2}]}', '{"a":1,"b":[{"x":1}]}', '{"a":[1]}', '[{"y":1}]') == [['{"x":1}', '{"x":2}'], ['{"a":1,"b":[{"x":1}]}'], ['{"a":[1]}'], ['{"y":1}']]
    assert one(spark, lambda c: M.absolute_links(c, "P", "H"), "[a](#b) [c](#) [d](http://x/%41+b) (http://x/%41) [e](https://y/%zz)") == ["[a](P#b) [c](#) [d](http://x/A+b) (http://x/%41) [e](https://y/%zz)"]
    assert one(spark, M.greatest_listed, "24, 25,,7", "", None) == [25, 0, 0]
    assert one(spark, M.attachment_urls, "http://a,\n https://b ,ftp://c", None) == [["http://a", "https://b"], []]
    assert one(spark, lambda c: M.number_after(c, "n-"), "gov n- 37, x", "none", None) == ["37", "", ""]
    assert one(spark, lambda c: M.int_setting(c, 7, 1, 9)["value"], "5", "50", "x", None) == [5, 9, 7, 7]
    assert one(spark, M.lock_key, "a")[0] == 3904355907
    assert one(spark, lambda c: M.law_section(c, {"yesod": "Y", "takanon": "T"}), "חוק־יסוד: הכנסת סעיף 6א(ב)", "סעיף 3", "תקנון הכנסת", None) == ["Y#סעיף_6א", None, None, None]


def test_guards_and_choices(spark, tmp_path):
    with pytest.raises(I.ColdStart):
        I.guard_cold_start(0, 1001)
    I.guard_cold_start(1, 5000)
    assert I.selected_contexts(["a", "b"], "none") == [] and I.selected_contexts(["a", "b"], "b") == ["b"] and I.selected_contexts(["a", "b"], None, True) == ["a", "b"]
    with pytest.raises(ValueError):
        I.selected_contexts(["a"], "z")
    stored = spark.createDataFrame([("a", 1, "x", True), ("b", 1, "y", False)], "g string, ordinal long, body string, active boolean")
    new = spark.createDataFrame([("a", "n1", 1), ("a", "n2", 2)], "g string, body string, at int")
    with pytest.raises(I.ActiveRows):
        I.reseed(stored, new, "g", position="at")
    got = sorted(map(tuple, I.reseed(stored, new, "g", position="at", force=True).collect()))
    assert got == [("a", 1, "n1", True), ("a", 1, "x", False), ("a", 2, "n2", True), ("b", 1, "y", False)]
    counts = spark.createDataFrame([("c", 3)], "context string, doc_count long")
    for _ in range(2):
        I.append_snapshot(counts, str(tmp_path / "s"), "2024-01-01")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1


def test_planned_runs():
    runs = I.plan_runs([3, 4, 9, 2, 6, 1], 8, 2)
    assert [(r.first, r.end, r.carried, r.wide) for r in runs] == [(0, 2, 0, False), (2, 3, 0, True), (3, 5, 0, False), (5, 6, 2, False)]
    text = "a b c\n\nd e f g\n\n" + " ".join("w%d" % i for i in range(9)) + "\n\nh i\n\nj k l m n o\n\np"
    assert I.pack_sections(text, 8, 2) == ["a b c\n\nd e f g", "w0 w1 w2 w3 w4 w5 w6 w7", "w6 w7 w8", "h i\n\nj k l m n o", "n o\n\np"]
