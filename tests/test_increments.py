import hashlib
import random

from pyspark.sql import functions as F

from corpusweave.operators import increments as N
from corpusweave.operators import index as I
from corpusweave.operators.results import previews
from tests.oracle import compare, connection


def test_counts_after_random_batches_equal_those_from_scratch(spark, tmp_path):
    rng = random.Random(4)
    store, there = N.CountStore(spark, str(tmp_path), ["bot", "ctx"]), []
    schema = "bot string, ctx string, source string, doc string, n int"
    for batch in range(5):
        new = [(rng.choice("ab"), rng.choice(["x", None]), rng.choice(["s1", "s2", None]), rng.choice([None, *"pqrstu"]), 1) for _ in range(40 if batch != 3 else 0)]
        gone = [(*r[:4], -1) for r in rng.sample(there, min(len(there), 25))]
        for r in gone:
            there.remove((*r[:4], 1))
        there += new
        store.apply(batch, spark.createDataFrame(new + gone, schema), source="source", doc=F.col("doc"), sign=F.col("n"))
        if batch == 2:  # once more
            store.apply(batch, spark.createDataFrame(new + gone, schema), source="source", doc=F.col("doc"), sign=F.col("n"))
        want = I.snapshot_counts(spark.createDataFrame(there, schema), levels=["bot", "ctx"], source="source", doc=F.col("doc"))
        assert sorted(map(str, store.snapshot(batch + 1).collect())) == sorted(map(str, want.select("bot", "ctx", "source_id", "doc_count").collect()))


def test_a_batch_reads_only_buckets_it_touches(spark, tmp_path):
    store = N.CountStore(spark, str(tmp_path), ["bot"])
    rows = spark.range(2000).select(F.lit("b").alias("bot"), F.lit("s").alias("source"), F.col("id").cast("string").alias("doc"))
    store.apply(0, rows, source="source", doc=F.col("doc"), sign=F.lit(1))
    store.apply(1, rows.limit(1), source="source", doc=F.col("doc"), sign=F.lit(-1))
    touched = spark.read.parquet(str(tmp_path / "refs/batch=1")).select("bucket").distinct().count()
    assert touched <= 2 and {r.source_id: r.doc_count for r in store.snapshot(2).collect()} == {"s": 1999, "*": 1999}


def test_changes_through_hash_trees(spark, tmp_path):
    base = spark.range(6000).select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") * 2).alias("v"), F.lit(None).cast("string").alias("w"))
    new = base.where("id not in (17, 4000)").withColumn("v", F.when(F.col("id").isin(30, 5), 1).otherwise(F.col("v"))).withColumn("w", F.when(F.col("id") == 77, "").otherwise(F.col("w"))).union(spark.createDataFrame([(9999, None, None)], base.schema))
    a, b = N.HashedTable.write(base, ["id"], str(tmp_path / "a")), N.HashedTable.write(new.repartition(5), ["id"], str(tmp_path / "b"))
    assert {(r.id, r.change) for r in N.diff(a, b).collect()} == {(17, "delete"), (4000, "delete"), (30, "update"), (5, "update"), (77, "update"), (9999, "insert")}
    leaves = a.differing(b)
    assert len(leaves) <= 6 and a.part(leaves).count() < 60
    plan = a.part(leaves)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_top" in plan or "PartitionFilters: [_top" in plan
    same = N.HashedTable.write(base.repartition(3), ["id"], str(tmp_path / "c"))
    assert a.differing(same) == [] and N.diff(a, same).count() == 0
    none = N.HashedTable.write(base.limit(0), ["id"], str(tmp_path / "d"))
    assert N.diff(none, a).where("change = 'insert'").count() == 6000


def test_changes_of_keys_moved_onto_others_equal_the_sql(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(k + shift, k % 9, "FOP"[(k + shift // 1000000) % 3], float(k + shift % 7)) for shift in (0, 1000000) for k in range(60)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    orders.toPandas().to_parquet(tmp_path / "orders.parquet")
    compare(entry.queries()["version_changes"](spark, str(tmp_path)), connection(str(tmp_path)), entry.oracle_sql()["version_changes"])


def test_unlike_rows_of_one_key_meet_in_leaves_that_do_not_differ(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c"), (3, "d")], "id long, v string")
    a, b = (N.HashedTable.write(rows, ["id"], str(tmp_path / x)) for x in "ab")
    assert [(r.id, r.change) for r in N.diff(a, b).collect()] == [(1, "update"), (1, "update")]
    assert len(a.differing(b)) == 1


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("name")).repartition(7)
    got = {r.name: r["_n"] for r in I.numbered(rows, ["name"]).collect()}
    assert [n for n, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got) and sorted(got.values()) == list(range(1, 1001))
    assert I.numbered(rows.limit(0), ["name"]).count() == 0


def test_fingerprints_of_large_and_odd_groups(spark):
    lines = [("a", f"l{i % 700}") for i in range(3000)] + [("b", None), ("b", "x"), (None, "y"), ("c", None), ("d", "")]
    got = {r.k: (r.fingerprint, r.n_lines) for r in I.fingerprint(spark.createDataFrame(lines, "k string, l string").repartition(6), ["k"], F.col("l")).collect()}
    want = {}
    for key in [*"abcd", None]:
        own = sorted((x for g, x in lines if g == key and x is not None), key=str.encode)
        want[key] = (hashlib.sha256("\n".join(own).encode()).hexdigest(), sum(g == key for g, _ in lines))
    assert got == want


def test_previews_gather_what_they_show(spark):
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 2), ("b", 1), ("c", None)], "k string, i int")
    shown = previews(rows, ["k"], "i")
    assert {r.k: r.preview for r in shown.collect()} == {"a": "0, 1, 2 (+47 more)", "b": "1, 2", "c": ""}
    assert "WindowGroupLimit" in shown._jdf.queryExecution().executedPlan().toString()
