"""Feeds kept as files: paged JSON envelopes, manifests, cursor pages, HTML link lists, gold and evaluation sets; and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from corpusweave.operators.index import EmptyUpstream


def odata_rows(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Items of saved pages with a 'value' or 'd.results' envelope; item is the items' schema."""
    pages = spark.read.schema(f"value array<struct<{item}>>, d struct<results:array<struct<{item}>>>").json(path, multiLine=True)
    return pages.select(F.explode(F.coalesce("value", "d.results")).alias("i")).select("i.*")


def date_range(column: str, since: str, until: str) -> Column:
    """Half-open range of ISO strings."""
    return (F.col(column) >= since) & (F.col(column) < until)


def live_window(since: str, until: str, most_days: int = 400) -> tuple[str, str]:
    """Validated [since, until): equal bounds mean that day; turned bounds and over-long windows are refused."""
    from datetime import date, timedelta

    a, b = date.fromisoformat(since), date.fromisoformat(until)
    if a == b:
        b += timedelta(days=1)
    if b < a or (b - a).days > most_days:
        raise ValueError(f"no valid window: {since} to {until}")
    return a.isoformat(), b.isoformat()


def manifest_hash(spark: SparkSession, path: str, resource: str) -> DataFrame:
    pages = spark.read.schema("resources array<struct<path:string,hash:string>>").json(path, multiLine=True)
    return pages.select(F.explode("resources").alias("r")).where(F.col("r.path") == resource).select("r.path", "r.hash")


def cursor_items(pages: DataFrame) -> DataFrame:
    """PDF items of cursor pages (page, Items): slashes put right, one row per URL (its first page)."""
    rows = pages.select("page", F.posexplode("Items").alias("pos", "i")).where(F.lower("i.FileFormat") == "pdf")
    rows = rows.withColumn("url", F.replace("i.DocumentPath", F.lit("\\"), F.lit("/")))
    first = rows.groupBy("url").agg(F.min_by(F.struct("i.ItemId", "i.DecisionDate", "i.DocumentTitle"), F.struct("page", "pos")).alias("f"))
    return first.select("url", F.concat(F.col("f.ItemId").cast("string"), F.lit(".pdf")).alias("filename"), F.col("f.DecisionDate").alias("date"), F.col("f.DocumentTitle").alias("title"))


def next_cursor(pages: DataFrame) -> DataFrame:
    """One second before the earliest date of a page."""
    rows = pages.select(F.explode("Items").alias("i")).agg(F.min(F.to_timestamp("i.DecisionDate")).alias("m"))
    return rows.select(F.date_format(F.col("m") - F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss").alias("cursor"))


def links(html: Column, pattern: str = r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"'#]+)["']""") -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def link_file_name(url: Column) -> Column:
    """Last segment of a URL; a hash of the URL where that is empty, too long or percent-coded."""
    last = F.substring_index(F.split_part(url, F.lit("?"), F.lit(1)), "/", -1)
    return F.when((last == "") | (F.length(last) > 200) | F.contains(last, F.lit("%")), F.substring(F.md5(url), 1, 16)).otherwise(last)


def absolute(url: Column, base: Column) -> Column:
    root = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    return F.when(F.rlike(url, F.lit("(?i)^https?://")), url).when(F.startswith(url, F.lit("/")), F.concat(root, url)).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), url))


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    schema = "row int, source_excel_row int, question string, expected_behavior string, must_not_contain array<string>, followup_prompt string"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(F.coalesce("source_excel_row", "row").alias("row"), "question", "expected_behavior", "must_not_contain", F.nullif("followup_prompt", F.lit("")).alias("followup_prompt"))


def missing_values(rows: DataFrame, required: list[str]) -> DataFrame:
    """Nulls of each required column, in one pass."""
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])


def write_csv(df: DataFrame, path: str, *, refuse_empty: bool = True) -> None:
    """Written beside the target first; the old one is moved aside, the new one put in its place, and only then the old one goes.
    An empty result never replaces what is there."""
    spark = df.sparkSession
    if refuse_empty and df.isEmpty():
        raise EmptyUpstream(path)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (TT.ArrayType, TT.MapType, TT.StructType)) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.csv(tmp, header=True, escape='"')
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(tmp)
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.old")
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"cannot put {tmp} in its place")
    if had:
        fs.delete(aside, True)


#: Source kinds and how they are read.
KINDS = ("files", "split", "csv", "spreadsheet")


def read_source(spark: SparkSession, kind: str, path: str, context: str) -> DataFrame:
    from corpusweave.sources import files

    if kind == "files":
        return files.whole_files(spark, path)
    if kind == "split":
        return files.split_file(spark, path, context)
    if kind == "csv":
        return files.csv_blocks(spark, path)
    if kind == "spreadsheet":
        rows = files.csv_rows(spark, path)
        return rows.select(files.sheet_block(rows.columns).alias("content")).where("content is not null")
    raise ValueError(f"unknown source kind {kind!r}; known: {', '.join(KINDS)}")
