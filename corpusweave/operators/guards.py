"""Guards round calls and results: retries, quotas, deadlines, validation rules, script checks."""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from corpusweave.functions.text import script_share

Out = TypeVar("Out")


class QuotaReached(RuntimeError):
    """A call was left out because the quota had run out before it."""


class DeadlineExceeded(TimeoutError):
    """Jobs were cancelled because their time was over."""


def retrying(ask: Callable[[str], str], *, tries: int = 6, first: float = 1.0, again: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """ask with up to `tries` tries; the waits between them double and are drawn between their half and the whole."""

    def run(text: str) -> str:
        for n in range(tries - 1):
            try:
                return ask(text)
            except Exception as e:
                if not again(e):
                    raise
                sleep(first * 2**n * random.uniform(0.5, 1))
        return ask(text)

    return run


def until_quota(ask: Callable[[str], str], is_quota: Callable[[Exception], bool]) -> Callable[[str], str]:
    """ask until a call of the same task meets the quota; later calls fail at once, earlier results stay."""
    tripped = []

    def run(text: str) -> str:
        if tripped:
            raise QuotaReached("left out")
        try:
            return ask(text)
        except Exception as e:
            if is_quota(e):
                tripped.append(True)
            raise

    return run


def within_deadline(spark: SparkSession, seconds: float, action: Callable[[], Out]) -> Out:
    """The result of action; jobs that it started and that still run after so many seconds are cancelled."""
    sc, tag, late = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise DeadlineExceeded(f"more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def required_fields(rows: DataFrame, required: list[str], warn_over: float = 0.8) -> DataFrame:
    """field, missing, total and verdict of each required column: error if all rows lack it, warning if more than a share do.

    Null and empty values are missing; a table without rows gives no error.
    """
    missing = [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(c) for c in required]
    found = rows.agg(F.count("*").alias("_total"), *missing)
    each = found.select("_total", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in required])).alias("f"))
    verdict = F.when((F.col("_total") > 0) & (F.col("f.missing") == F.col("_total")), "error").when(F.col("f.missing") > warn_over * F.col("_total"), "warning").otherwise("ok")
    return each.select("f.field", "f.missing", F.col("_total").alias("total"), verdict.alias("verdict"))


def script_refusal(text: Column, letters: str, least: float = 0.5) -> Column:
    """Why a text is refused: too few of its code points are in the script; null if it is taken."""
    share = script_share(text, letters)
    return F.when(share < least, F.concat(F.lit("script share "), F.format_number(share, 3)))


def in_namespace(column: str, value: str | None) -> Column:
    """Rows of one namespace, or all where none is asked for."""
    return F.col(column) == value if value else F.lit(True)


def schema_rows(df: DataFrame) -> DataFrame:
    """path and type of every field of a table's schema, nested ones too."""
    rows, waiting = [], [("", df.schema)]
    while waiting:
        path, kind = waiting.pop()
        if isinstance(kind, TT.StructType):
            waiting += [(f"{path}.{f.name}" if path else f.name, f.dataType) for f in reversed(kind.fields)]
            if not path:
                continue
        if isinstance(kind, TT.ArrayType):
            waiting.append((f"{path}[]", kind.elementType))
        rows.append((path, kind.typeName()))
    return df.sparkSession.createDataFrame(rows, "path string, type string")
