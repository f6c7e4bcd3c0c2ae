import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusweave.operators import index as I
from corpusweave.streaming import sync as S

SCHEMA = "context string, filename string, content_hash string, position long, run_at timestamp"
START = datetime(2024, 1, 1)


def _runs(seed):
    """Runs in order: each brings some files whole, with hashes of their own."""
    rng, out = random.Random(seed), []
    for run in range(5):
        rows = []
        for f in rng.sample(range(6), 3):
            rows += [("c%d" % (f % 2), f"f{f}", f"f{f}-h{h}", i) for i, h in enumerate(rng.sample(range(8), rng.randrange(1, 6)))]
        out.append(rows)
    return out


def _batches(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/b{i}")
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def test_log_equals_batch_states_with_late_and_repeated_rows(spark, tmp_path):
    runs = _runs(3)
    timed = [[(*r, START + timedelta(hours=i)) for r in rows] for i, rows in enumerate(runs)]
    rng = random.Random(9)
    # Rows of a run come late, beside those of the next, and some come again.
    batches = [list(rows) for rows in timed]
    for i in range(4):
        held = [r for r in batches[i] if rng.random() < 0.3 and r in timed[i]][: len(batches[i]) - 1]
        batches[i] = [r for r in batches[i] if r not in held]
        batches[i + 1] += held + rng.sample(timed[i], 1)
    batches.append([("other", "tick", "t", 0, START + timedelta(days=9))])
    batches.append([("other", "tick", "t", 0, START + timedelta(days=18))])
    stream = _batches(spark, str(tmp_path / "in"), batches)
    log = str(tmp_path / "log")
    S.run_sync(spark, stream, log, str(tmp_path / "cp"), late="3 hours")
    state = spark.createDataFrame([], "context string, filename string, content_hash string, position long")
    for rows in runs:
        state = spark.createDataFrame(sorted(I.next_state(state, spark.createDataFrame(rows, state.schema)).collect()), state.schema)
    table = S.current(spark.read.schema(S.CHANGES).parquet(log)).where("filename <> 'tick'")
    keys = ("context", "filename", "content_hash")
    assert sorted(map(tuple, table.select(*keys).collect())) == sorted(map(tuple, state.select(*keys).collect()))
    newest = {(c, f): run for run, rows in enumerate(runs) for c, f, *_ in rows}
    places = {(c, f, h): p for run, rows in enumerate(runs) for c, f, h, p in rows if newest[c, f] == run}
    assert {(r.context, r.filename, r.content_hash): r.position for r in table.collect()} == places
    # A restart from the checkpoint finds nothing new.
    before = sorted(map(tuple, spark.read.schema(S.CHANGES).parquet(log).collect()))
    S.run_sync(spark, stream, log, str(tmp_path / "cp"), late="3 hours")
    assert sorted(map(tuple, spark.read.schema(S.CHANGES).parquet(log).collect())) == before
    assert all(n == 1 for (n,) in spark.read.schema(S.CHANGES).parquet(log).groupBy(*keys, "action", "run_at").count().select("count").collect())


def test_a_processed_file_without_chunks_is_emptied_and_odd_rows_pass(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    batches = [
        [("c", "a", "h1", 0, at(0)), ("c", "a", "h2", 1, at(0)), (None, None, "n", None, at(0)), ("c", "b", "h1", 0, at(0)), ("c", "b", "h1", 0, None)],
        [("c", "a", None, None, at(1))],
        [("x", "tick", "t", 0, at(500))],
        [("x", "tick", "t", 0, at(1000))],
    ]
    S.run_sync(spark, _batches(spark, str(tmp_path / "in"), batches), str(tmp_path / "log"), str(tmp_path / "cp"))
    log = spark.read.schema(S.CHANGES).parquet(str(tmp_path / "log"))
    got = {(r.context, r.filename, r.content_hash) for r in S.current(log).where(F.col("filename").isNull() | (F.col("filename") != "tick")).collect()}
    assert got == {(None, None, "n"), ("c", "b", "h1")}
    assert {(r.content_hash, r.action) for r in log.where("filename = 'a'").collect()} == {("h1", "insert"), ("h2", "insert"), ("h1", "delete"), ("h2", "delete")}
