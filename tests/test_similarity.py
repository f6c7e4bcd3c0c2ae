import random
import re

from pyspark.sql import functions as F

from corpusweave.operators import quantised as Z
from corpusweave.operators import retrieve as R
from corpusweave.operators import similarity as S


def _grams(text):
    return [f"  {w} "[i : i + 3] for w in re.split(r"[^\w]+", text.lower()) if w for i in range(len(w) + 1)]


def _names(rng, n):
    return [" ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    names, mentions = _names(rng, 250), _names(rng, 60) + [None, "", "!!"]
    for least in (0.2, 0.45, 0.8, 1.0):
        got = {(r.mention, r.name): r.similarity for r in S.similar_pairs(spark.createDataFrame([(m,) for m in mentions], "mention string"), spark.createDataFrame([(x,) for x in names + [None, ""]], "name string"), least=least).collect()}
        want = {}
        for m in filter(None, mentions):
            for x in set(names):
                a, b = set(_grams(m)), set(_grams(x))
                if a & b and len(a & b) / len(a | b) >= least:
                    want[m, x] = len(a & b) / len(a | b)
        assert got == want


def test_a_trigram_common_to_all_names_does_not_multiply_rows(spark):
    def met(n):
        rng = random.Random(n)
        names = spark.createDataFrame([("common " + "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(12)),) for _ in range(n)], "name string")
        return S.candidate_pairs(names.select(F.col("name").alias("mention")), names, least=0.6).count()

    small, large = met(300), met(1200)
    assert 1200 <= large <= 5 * small


def test_extents_against_brute_force(spark):
    rng = random.Random(3)
    texts, queries = _names(rng, 80) + ["aa aa aa bb aa", "", None], _names(rng, 25) + ["aa bb", "?"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, query_text string")
    for least, k in ((0.3, 1000), (0.6, 2)):
        got = {}
        for r in S.word_similar(q, t, k, least=least).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, round(r.score, 9)))
        want = {}
        for qi, query in enumerate(queries):
            w, scored = set(_grams(query)), []
            for i, text in enumerate(texts):
                have = _grams(text or "")
                best = max((len(w & set(have[a:b])) / len(w | set(have[a:b])) for a in range(len(have)) for b in range(a + 1, len(have) + 1)), default=0) if w else 0
                if best >= least:
                    scored.append((-best, i))
            if scored:
                want[qi] = [(i, round(-s, 9)) for s, i in sorted(scored)[:k]]
        assert got == want


def test_quantised_search_scores_few_vectors_and_finds_most(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir[:-5]}0.1/embeddings.parquet")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    index = Z.QuantisedLists.build(e, id_col="vec_id")
    exact = {(r.query_id, r.id): r["rank"] for r in R.knn_many(e, asked, 10, id_col="vec_id").collect()}
    found = {(r.query_id, r.id) for r in index.search(asked, 10, short=50).collect()}
    assert len(found & set(exact)) >= 0.9 * len(exact) and len(found) == len(exact)
    scored = index.short_lists(asked, 50, block=30)
    assert scored.count() <= 0.1 * e.count() * asked.count() and scored.groupBy("query_id").count().where("count <> 50").count() == 0
    few = index.search(asked, 10, probes=1)
    assert few.join(index.rows, "id").groupBy("query_id").agg(F.count_distinct("list").alias("n")).where("n > 1").count() == 0


def test_quantised_index_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.5]), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [None, 1.0, 2.0]), (6, [1.0, 0.1, 0.5]), (7, [0.0, 1.0, 0.0]), (8, [1.0, 2.0])]
    e = spark.createDataFrame(rows, "id long, embedding array<float>")
    index = Z.QuantisedLists.build(e)
    assert {r.id for r in index.rows.collect()} <= {1, 6, 7, 8}
    got = index.search(e.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec")), 2)
    assert [r.id for r in got.where("query_id = 1").orderBy("rank").collect()] == [1, 6]
    assert Z.QuantisedLists.build(e.limit(0)).search(e.limit(0).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec")), 2).count() == 0


def _tables(spark, names, mentions):
    return spark.createDataFrame([(m,) for m in mentions], "mention string"), spark.createDataFrame([(x,) for x in names], "name string")


def test_pairs_are_verified_where_they_meet(spark):
    rng = random.Random(5)
    names = _names(rng, 400)
    found = S.similar_pairs(*_tables(spark, names, names), least=0.45)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    # Few bytes, much work: small tables are not joined to one task.
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() >= 8


def test_extents_are_scored_where_texts_meet(spark):
    rng = random.Random(6)
    texts = spark.createDataFrame(list(enumerate(_names(rng, 400))), "id int, query_text string")
    plan = S.word_similar(texts.withColumnRenamed("id", "query_id"), texts, 3, text="query_text")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and plan.count("Join") <= 1 and "REPARTITION_BY_NUM" in plan  # only queries take up their rows


def test_several_groups_on_both_sides(spark, monkeypatch):
    rng = random.Random(7)
    names, mentions = _names(rng, 120), _names(rng, 60)
    texts = spark.createDataFrame([(f"i{i:03}", x) for i, x in enumerate(names + names[:40] * 2 + ["a b " * 300])], "id string, text string")
    queries = spark.createDataFrame(list(enumerate(mentions + mentions[:5])), "query_id int, query_text string")
    def both():
        return sorted(S.similar_pairs(*_tables(spark, names, mentions), least=0.3).collect()), sorted(S.word_similar(queries, texts, 4, least=0.4).collect())
    whole = both()
    for chars, least, vector in ((150, 1, 200), (1 << 20, 1, 1)):
        monkeypatch.setattr(S, "GROUP_CHARS", chars)
        monkeypatch.setattr(S, "LEAST_GROUPS", least)
        monkeypatch.setattr(S, "VECTOR", vector)
        assert both() == whole and all(whole)
