"""Paged feeds as a Python data source: days are partitions, each follows its cursors; batch and stream share the reader.

A feed is a callable page(address) -> {"items": [...], "next": address or None}, given with the addresses of a day's first page; it is
sent to the tasks, so it must be picklable. Filters on the day column are pushed down and cut the days that are asked for at
all. A cursor that comes a second time, or a page without items that still has a next one, ends in an error instead of a loop.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "day date, page int, place int, item string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class FeedError(RuntimeError):
    """A feed whose pages cannot be followed to the end."""


class Days(InputPartition):
    def __init__(self, days: list[dt.date]):
        super().__init__([d.isoformat() for d in days])


def follow(page: Callable[[str], dict], first: str) -> Iterator[tuple[int, int, dict]]:
    """(page number, place, item) of all pages from the first one on."""
    address, seen, number = first, set(), 0
    while address is not None:
        if address in seen:
            raise FeedError(f"page {number}: cursor {address} came before")
        seen.add(address)
        got = page(address)
        items, after = got.get("items") or [], got.get("next")
        if not items and after is not None:
            raise FeedError(f"page {number}: {address} is empty but has a next page")
        for place, item in enumerate(items):
            yield number, place, item
        address, number = after, number + 1


def _between(first: dt.date, last: dt.date) -> list[dt.date]:
    return [first + dt.timedelta(i) for i in range((last - first).days + 1)]


class _Feed:
    def __init__(self, page: Callable[[str], dict], address: Callable[[dt.date], str], options):
        self.page, self.address = page, address
        self.first, self.last = (dt.date.fromisoformat(options[k]) for k in ("first", "last"))
        self.span = int(options.get("days_per_task", 1))

    def parts(self, days: list[dt.date]) -> list[Days]:
        return [Days(days[i : i + self.span]) for i in range(0, len(days), self.span)] or [Days([])]

    def read(self, partition: Days) -> Iterator[tuple]:
        for text in partition.value:
            day = dt.date.fromisoformat(text)
            for number, place, item in follow(self.page, self.address(day)):
                yield day, number, place, json.dumps(item, ensure_ascii=False, sort_keys=True)


class FeedReader(_Feed, DataSourceReader):
    def pushFilters(self, filters):
        self.days = set(_between(self.first, self.last))
        tests = {EqualTo: lambda d, v: d == v, GreaterThan: lambda d, v: d > v, GreaterThanOrEqual: lambda d, v: d >= v, LessThan: lambda d, v: d < v, LessThanOrEqual: lambda d, v: d <= v, In: lambda d, v: d in v}
        for f in filters:
            if type(f) in tests and tuple(f.attribute) == ("day",):
                self.days = {d for d in self.days if tests[type(f)](d, f.value)}
            else:
                yield f

    def partitions(self):
        return self.parts(sorted(getattr(self, "days", _between(self.first, self.last))))


class FeedStream(_Feed, DataSourceStreamReader):
    """Offsets are days: whole days up to `last` are there; a later start may name a later one."""

    def initialOffset(self):
        return {"day": (self.first - dt.timedelta(1)).isoformat()}

    def latestOffset(self):
        return {"day": self.last.isoformat()}

    def partitions(self, start, end):
        return self.parts(_between(dt.date.fromisoformat(start["day"]) + dt.timedelta(1), dt.date.fromisoformat(end["day"])))


def register(spark: SparkSession, name: str, page: Callable[[str], dict], address: Callable[[dt.date], str]) -> str:
    """Registers a feed under a name for spark.read.format(name) and spark.readStream.format(name); options: first, last, days_per_task."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> FeedReader:
            return FeedReader(page, address, self.options)

        def streamReader(self, schema) -> FeedStream:
            return FeedStream(page, address, self.options)

    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Paged)
    return name


def record(items: DataFrame, path: str, *, day: str, order: str, item: str, per_page: int = 100) -> None:
    """Writes items (day, order, JSON text) as recorded pages: path/day=.../page=n holds one JSON text with items and next."""
    rows = items.select(F.col(day).cast("date").alias("day"), F.col(order).alias("o"), F.col(item).alias("item"))
    w = Window.partitionBy("day").orderBy("o", "item")
    rows = rows.withColumn("page", F.floor((F.row_number().over(w) - 1) / per_page).cast("int"))
    pages = rows.groupBy("day", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "item"))), lambda s: s["item"]).alias("items"))
    last = pages.groupBy("day").agg(F.max("page").alias("last"))
    after = F.when(F.col("page") < F.col("last"), F.concat(F.lit('"'), F.col("day").cast("string"), F.lit("/"), (F.col("page") + 1).cast("string"), F.lit('"'))).otherwise(F.lit("null"))
    body = F.concat(F.lit('{"items": ['), F.array_join("items", ", "), F.lit('], "next": '), after, F.lit("}"))
    pages.join(last, "day").select("day", "page", body.alias("value")).write.mode("overwrite").partitionBy("day", "page").text(path)


def recorded(path: str) -> tuple[Callable[[str], dict], Callable[[dt.date], str]]:
    """page() and address() over what record() wrote, in any store that Arrow's file systems reach; a day without pages is empty."""

    def page(address: str) -> dict:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        day, number = address.split("/")
        found = [f for f in store.get_file_info(fs.FileSelector(f"{base}/day={day}/page={number}", allow_not_found=True)) if f.base_name.startswith("part-")]
        if not found:
            return {"items": [], "next": None}
        with store.open_input_stream(found[0].path) as file:
            return json.loads(file.read())

    return page, lambda day: f"{day.isoformat()}/0"
