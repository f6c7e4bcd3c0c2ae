import random

import pytest
from pyspark.sql import functions as F

from corpusweave.operators import enrich as E
from corpusweave.operators import guards as G
from corpusweave.operators import names as N
from corpusweave.plans.search import NameRules, name_spans
from corpusweave.sources import binary as B
from corpusweave.streaming import events as S


def test_spans_equal_the_single_query_form(spark):
    rng = random.Random(5)
    words = ["red", "blue", "ared", "of", "widget", "ring,", "big", "(old)", "?", "gear."]
    queries = [" ".join(rng.choices(words, k=rng.randrange(0, 8))) for _ in range(300)] + ["", "  ", "red"]
    rules = NameRules(frozenset(["red", "blue"]), frozenset(["of"]))
    df = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "id int, q string")
    got = {r.id: [(s.mention, s.words) for s in r.s or []] for r in df.select("id", N.spans(F.col("q"), ["red", "blue"], ["of"], rules.marks).alias("s")).collect()}
    assert got == {i: name_spans(q, rules) for i, q in enumerate(queries)}


def test_retries_double_and_give_up():
    waits, calls = [], []

    def ask(text):
        calls.append(text)
        if len(calls) < 4:
            raise OSError("busy")
        return "done"

    assert G.retrying(ask, sleep=waits.append)("x") == "done" and len(calls) == 4
    assert all(2**n / 2 <= w <= 2**n for n, w in enumerate(waits)) and len(waits) == 3
    calls.clear()
    with pytest.raises(OSError):
        G.retrying(ask, tries=2, sleep=waits.append)("x")
    calls.clear()
    with pytest.raises(OSError):
        G.retrying(ask, again=lambda e: False, sleep=waits.append)("x")
    assert len(calls) == 1


def test_quota_keeps_earlier_results(spark):
    def ask(text):
        if text == "c":
            raise RuntimeError("daily limit")
        return '{"v": "%s"}' % text

    rows = spark.createDataFrame([(i, t) for i, t in enumerate("abcde")], "i int, content string").coalesce(1)
    got = E.extract(rows, "content", G.until_quota(ask, lambda e: "daily limit" in str(e))).orderBy("i").collect()
    assert [r.extracted is not None for r in got] == [True, True, False, False, False]
    assert "daily limit" in got[2].extracted_error and got[3].extracted_error.startswith("QuotaReached")


def test_deadline_cancels_jobs(spark):
    assert G.within_deadline(spark, 60, lambda: spark.range(5).count()) == 5

    @F.udf("int")
    def slow(x):
        import time

        time.sleep(30)
        return 1

    with pytest.raises(G.DeadlineExceeded):
        G.within_deadline(spark, 1, lambda: spark.range(4).select(slow("id")).collect())


def test_required_fields_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "a string, b int")
    assert {(r.field, r.missing, r.total, r.verdict) for r in G.required_fields(rows, ["a", "b"]).collect()} == {("a", 0, 0, "ok"), ("b", 0, 0, "ok")}


def test_schema_and_namespace(spark):
    df = spark.createDataFrame([("x", [(1, "a")])], "bot string, items array<struct<n:int,t:string>>")
    assert [(r.path, r.type) for r in G.schema_rows(df).collect()] == [("bot", "string"), ("items", "array"), ("items[]", "struct"), ("items[].n", "integer"), ("items[].t", "string")]
    assert df.where(G.in_namespace("bot", "")).count() == 1 and df.where(G.in_namespace("bot", "y")).count() == 0


def test_binary_files_by_the_first_reader_that_can(spark, tmp_path):
    (tmp_path / "good.bin").write_bytes(b"text " * 400)
    (tmp_path / "bad.bin").write_bytes(b"\xff" * 2000)
    (tmp_path / "small.bin").write_bytes(b"x")

    def strict(raw):
        return raw.decode("ascii")

    def blank(raw):
        return " "

    got = {r.path.rsplit("/", 1)[1]: r for r in B.binary_texts(spark, str(tmp_path / "*.bin"), [blank, strict]).collect()}
    assert got["good.bin"].text == "text " * 400 and got["good.bin"].error is None
    assert got["bad.bin"].text is None and got["bad.bin"].error.startswith("UnicodeDecodeError")
    assert got["small.bin"].error == "too small"


def test_index_has_one_origin(spark, tmp_path):
    (tmp_path / "index.csv").write_text("url,title\nhttp://a,A\n")
    assert B.index_rows(spark, local=str(tmp_path / "index.csv")).first().title == "A"
    for origins in ({}, {"remote": "a", "local": "b"}):
        with pytest.raises(ValueError):
            B.index_rows(spark, **origins)


def test_stream_keeps_first_of_key(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 3).alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), "id")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.first_of_key(S.stream_table(spark, str(tmp_path / "in"), rows.schema), ["user_id"], order=["ts"])
    S.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.user_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]
    assert {(r.user_id, r.id) for r in S.first_of_key(rows, ["user_id"], order=["ts"]).collect()} == {(0, 0), (1, 1), (2, 2)}
