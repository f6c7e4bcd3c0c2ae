import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusweave import catalogue
from corpusweave.functions.lexical import prefix_query
from corpusweave.functions.vector import cosine
from corpusweave.operators import retrieve as R
from corpusweave.plans import search as S

RULES = S.NameRules(frozenset({"law", "code"}), frozenset({"what", "or"}))


def chunks(spark):
    rows = [("a", "water law section one", [1.0, 0.0], "Water Law", 0), ("b", "water law section two", [0.9, 0.4], "Water Law", 1), ("c", "tax code part", [0.0, 1.0], "Tax Code", 0), ("d", "nothing", None, "Other Code", 0)]
    return spark.createDataFrame(rows, "id string, content string, embedding array<double>, law_name string, chunk_index int")


def test_knn_ties_and_nulls(spark):
    got = [r.id for r in R.knn(chunks(spark), [1.0, 0.0], 4).collect()]
    assert got == ["a", "b", "c", "d"]


def test_rrf_prefers_vector_on_ties(spark):
    v = spark.createDataFrame([("x", 0), ("y", 1)], "id string, rank long")
    w = spark.createDataFrame([("z", 0), ("y", 1)], "id string, rank long")
    same = [r.id for r in R.rrf(v, w, 3, lexical_weight=1.0).collect()]
    assert same == ["y", "x", "z"]
    assert R.rrf(v, w, 3).first().id == "y"


def test_lexical_or_and(spark):
    index = R.postings(chunks(spark), id_col="id", fields={"law_name": "A", "content": "D"})
    assert R.lexical(index, prefix_query("water"), 5).first().id == "a"
    assert R.lexical(index, prefix_query("!!"), 5).count() == 0
    many = prefix_query("water law section one water law section")
    assert many.all and [r.id for r in R.lexical(index, many, 5).collect()] == ["a"]


def test_recency_dates(spark):
    rows = [(f"r{i}", d, "k%d" % i, 0) for i, d in enumerate(["2026-04-25", "3390-06-91", "2025-04-03T10:00:00", "", None, "1999-05-31"])] + [("r9", "2026-04-25", "k0", 1)]
    df = spark.createDataFrame(rows, "id string, date string, file string, ci int")
    assert [r.id for r in R.recency(df, 10, dates=[F.col("date")], keys=[F.col("file")], order=F.col("ci")).collect()] == ["r0", "r2", "r5"]


def test_expand(spark):
    c = spark.createDataFrame([(f"t{t}-{i}", f"t{t}", i, f"c{t}{i}") for t in range(3) for i in range(3)], "id string, title string, chunk_index int, content string")
    hits = spark.createDataFrame([(0, "t0", "h0"), (1, "t0", "h0b"), (2, None, "plain"), (3, "t1", "h1"), (4, "t2", "h2")], "rank int, title string, content string")
    got = {r["rank"]: r for r in R.expand(hits, c, most=2, total=3).collect()}
    assert sorted(got) == [0, 2, 3, 4]
    assert got[0].content == "c00\n\nc01" and got[0].expanded_chunks == 2 and got[0].expanded_truncated
    assert got[2].content == "plain" and got[3].content == "c10\n\nc11" and got[4].content == "h2" and got[4].expanded_chunks is None


def test_names(spark):
    catalog = spark.createDataFrame([("Water Law",), ("Tax Code",)], "name string")
    assert S.best_name(catalog, "water laws", 0.45)[0] == "Water Law"
    assert S.best_name(catalog, "zzqq", 0.45) is None
    assert S.name_spans("the law of or", RULES) == [("law of", 2)]
    he = spark.createDataFrame([("חוק חובת המכרזים",), ("חוק האזנת סתר",)], "name string")
    assert S.best_name(he, "חוק המכרזים", 0.45)[0] == "חוק חובת המכרזים"


def test_detect_needs_one_name_and_dominance(spark):
    catalog = spark.createDataFrame([("law water rights",), ("code of tax",)], "name string")
    assert S.detect_name(catalog, "law water rights", RULES) == "law water rights"
    assert S.detect_name(catalog, "law water and code of tax", RULES) is None
    assert S.detect_name(catalog, "water rights", RULES) is None
    assert S.detect_name(catalog, "a long question about other things near law water rights maybe", RULES) is None


def test_scoped_search(spark):
    c = chunks(spark)
    index = R.postings(c, id_col="id", fields={"content": "D"})
    catalog = c.select(F.col("law_name").alias("name")).distinct()
    mode = S.mode_of("REGULAR")
    ids = lambda h: [r.id for r in h.rows.collect()]
    assert ids(S.scoped_search(c, index, catalog, "tax", [1.0, 0.0], mode, name="Tax:Code")) == ["c"]
    moved = S.scoped_search(c, index, catalog, "x", [1.0, 0.0], mode, name="Water Laws")
    assert ids(moved) == ["a", "b"] and moved.note == "resolved_from=Water Laws"
    wide = S.scoped_search(c, index, catalog, "x", [1.0, 0.0], mode, name="qqqq")
    assert wide.note == "fallback=name_absent" and len(ids(wide)) == 4
    assert ids(S.scoped_search(c, index, catalog, "x", [1.0, 0.0], mode, name="qqqq", other=F.col("chunk_index") == 9)) == []


def test_modes():
    assert S.mode_of("nope").name == "REGULAR" and S.mode_of("SECTION_NUMBER").n == 3 and not S.mode_of("SECTION_NUMBER").vector
    assert S.mode_of("REGULAR", words=True).words


def test_distribution_needs_two(spark):
    df = spark.createDataFrame([("10", "x", "01.02.2020"), ("9", "y", "2021-03-04"), ("9", "y", "bad")], "k string, l string, d string")
    got = R.distribution(df, F.col("k"), F.col("l"), F.col("d")).collect()
    assert [(r.group_key, r.doc_count, str(r.latest_date)) for r in got] == [("9", 2, "2021-03-04"), ("10", 1, "2020-02-01")]
    assert R.distribution(df.where("k = '9'"), F.col("k"), F.col("l"), F.col("d")).count() == 0


def test_topk_plans(spark):
    plan = R.knn(chunks(spark), [1.0, 0.0], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = R.recency(chunks(spark).withColumn("d", F.lit("2020-01-01")), 3, dates=[F.col("d")], keys=[F.col("law_name")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_knn_many_takes_any_number_of_queries(spark):
    rng = random.Random(3)
    vectors = [[float(rng.randrange(-2, 3)) for _ in range(3)] for _ in range(300)] + [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0]]
    e = spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<float>").repartition(5)
    queries = e.where("id % 7 = 0 or id >= 300").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in R.knn_many(e, queries, 4, block=10).collect())
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "id")
    plain = e.crossJoin(queries).select("query_id", "id", cosine(F.col("embedding"), F.col("query_vec")).alias("score")).withColumn("rank", F.row_number().over(w) - 1).where("rank < 4")
    assert got == sorted((r.query_id, r["rank"], r.id, r.score) for r in plain.collect()) and len(got) == 4 * queries.count()


def test_a_registered_search_asks_for_every_twentieth_vector(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = catalogue.queries()["knn_all_batch"](spark, sf_dir)
    assert got.select("query_id").distinct().count() == e.where("vec_id % 20 = 0").count()
