import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusweave.sources import paged

FIRST, LAST = dt.date(2024, 1, 1), dt.date(2024, 1, 6)


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    rows = spark.range(500).select("id", F.date_add(F.lit(FIRST), (F.col("id") % 5).cast("int")).alias("day"), F.to_json(F.struct("id", F.lit('a "b"').alias("t"))).alias("item"))
    path = "file://" + str(tmp_path_factory.mktemp("feed") / "pages")
    paged.record(rows, path, day="day", order="id", item="item", per_page=30)
    return paged.register(spark, "test_feed", *paged.recorded(path)), {r.id for r in rows.collect()}


def _read(spark, name, **more):
    return spark.read.format(name).options(first=FIRST.isoformat(), last=LAST.isoformat(), **more).load()


def test_all_pages_are_followed(spark, feed):
    name, ids = feed
    rows = _read(spark, name, days_per_task=2)
    got = rows.withColumn("id", F.get_json_object("item", "$.id").cast("long"))
    assert {r.id for r in got.collect()} == ids and rows.count() == len(ids) and rows.rdd.getNumPartitions() == 3
    assert got.groupBy("day").agg(F.max("page").alias("p")).where("p <> 3").count() == 0
    assert rows.select(F.get_json_object("item", "$.t")).distinct().collect()[0][0] == 'a "b"'


def test_filters_cut_days(spark, feed):
    name, _ = feed
    rows = _read(spark, name).where("day >= '2024-01-02' and day < '2024-01-04' and page = 0")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 60 and rows.rdd.getNumPartitions() == 2
    assert "day >=" not in plan.split("BatchScan")[0] and "(page" in plan.split("BatchScan")[0]
    assert _read(spark, name).where("day = '2023-01-01'").count() == 0 and _read(spark, name).where("day in ('2024-01-02', '2024-01-05')").count() == 200


def test_stream_reads_what_batch_reads(spark, feed, tmp_path):
    name, ids = feed
    for last in ("2024-01-03", "2024-01-06"):  # a second start goes on behind the first
        stream = spark.readStream.format(name).options(first=FIRST.isoformat(), last=last).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, _read(spark, name).collect())) and out.count() == len(ids)


def test_broken_feeds_end_in_errors():
    pages = {"a": {"items": [1], "next": "b"}, "b": {"items": [2], "next": "a"}, "c": {"items": [], "next": "d"}, "e": {"items": None, "next": None}}
    with pytest.raises(paged.FeedError, match="came before"):
        list(paged.follow(pages.__getitem__, "a"))
    with pytest.raises(paged.FeedError, match="empty"):
        list(paged.follow(pages.__getitem__, "c"))
    assert list(paged.follow(pages.__getitem__, "e")) == []
