import duckdb
from pyspark.sql import functions as F

from corpusweave.operators import index as I
from corpusweave.streaming import events as S
from tests.oracle import compare


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = S.stream_table(spark, f"{sf_dir}/events.parquet", batch.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    got = []
    out = S.tumbling(stream, late="60 days")
    S.run_available(out, "", str(tmp_path / "cp"), mode="complete", each=lambda df, i: got.append(sorted((str(r.window_start), r.event_type, r.n) for r in df.collect())))
    want = S.tumbling(batch.withColumn("ts", F.col("ts").cast("timestamp")))
    assert got[-1] == sorted((str(r.window_start), r.event_type, r.n) for r in want.collect())


def test_sync_stream_is_idempotent(spark, tmp_path):
    schema = "context string, filename string, content_hash string, position int"
    spark.createDataFrame([("c", "a", "h1", 0), ("c", "a", "h1", 1)], schema).write.parquet(str(tmp_path / "in/one"))
    spark.createDataFrame([("c", "a", "h2", 0)], schema).write.parquet(str(tmp_path / "in/two"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    S.run_available(stream, "", str(tmp_path / "cp"), each=S.sync_batches(str(tmp_path / "state"), I.next_state))
    first = {r.content_hash for r in spark.read.parquet(str(tmp_path / "state/state-0")).collect()}
    assert first == {"h1", "h2"}
    S.sync_batches(str(tmp_path / "state"), I.next_state)(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), 0)
    assert spark.read.parquet(str(tmp_path / "state/state-0")).count() == 2


def test_a_table_of_several_files_streams_whole(spark, tmp_path):
    rows = spark.createDataFrame([(c, t, "user", f"text {c} {t}") for c in range(6) for t in range(1 + c % 3)], "conv_id long, turn long, role string, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "many/conversations.parquet"))
    rows.toPandas().to_parquet(tmp_path / "conversations.parquet")
    got = [[], []]
    for kept, path in zip(got, (tmp_path / "many/conversations.parquet", tmp_path / "conversations.parquet")):
        S.run_available(S.stream_table(spark, str(path), rows.schema), "", str(tmp_path / f"cp{len(str(path))}"), each=lambda df, i, kept=kept: kept.extend(df.collect()))
        assert sorted(kept) == sorted(rows.collect())


def test_synced_table_of_several_files_equals_its_sql(spark, tmp_path):
    import __spark_entry__ as entry

    rows = spark.createDataFrame([(c, t, "user", f"text {c} {t}") for c in range(6) for t in range(1 + c % 3)], "conv_id long, turn long, role string, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    compare(entry.queries()["synced_table"](spark, str(tmp_path)), con, entry.oracle_sql()["synced_table"])
