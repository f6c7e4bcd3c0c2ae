"""File sources: globs of whole files, split files, CSV and spreadsheet rows as text blocks, section trees, marked blobs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.text import blank_to_null

# Columns that carry one URL a row, those of them that mean the source itself, and bookkeeping columns.
URL_COLUMNS = ("source_url", "file_url", "url", "lexicon_url")
URL_ALIASES = ("source_url", "file_url", "url")
BOOKKEEPING = ("upstream_hash", "upstream_revision", "revision", "file_last_updated")


def whole_files(spark: SparkSession, glob: str) -> DataFrame:
    """filename, content, content_type: one row per file."""
    rows = spark.read.text(glob, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"), F.lit("text/markdown").alias("content_type"))


def split_file(spark: SparkSession, path: str, context: str, separator: str = "\n---\n", offset: int = 0) -> DataFrame:
    """One row per part of each file, named by position."""
    rows = spark.read.text(path, wholetext=True)
    parts = rows.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\\Q" + separator + "\\E")).alias("pos", "content"))
    return parts.select(F.concat(F.lit(f"{context}_"), F.col("pos") + offset, F.lit(".md")).alias("filename"), "content", F.lit("text/markdown").alias("content_type"))


def flatten(rows: DataFrame, columns: list[str] | None = None) -> tuple[Column, Column]:
    """The text block of a row ('name:' and value for each column, URL and bookkeeping columns left out), and its URL metadata."""
    columns = columns or rows.columns
    shown = [c for c in columns if c not in URL_COLUMNS and c not in BOOKKEEPING]
    content = F.concat(*[F.concat(F.lit(f"{c}:\n"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n\n")) for c in shown]) if shown else F.lit("")
    urls = [(("source_url" if c in URL_ALIASES else c), F.col(c).cast("string")) for c in columns if c in URL_COLUMNS]
    names = dict.fromkeys(n for n, _ in urls)
    entries = [F.struct(F.lit(n).alias("key"), F.coalesce(*[blank_to_null(v) for m, v in reversed(urls) if m == n]).alias("value")) for n in names]
    meta = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())) if entries else F.create_map().cast("map<string,string>")
    return content, meta


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, quoted line breaks and doubled quotes kept."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)


def csv_blocks(spark: SparkSession, path: str) -> DataFrame:
    rows = csv_rows(spark, path)
    content, meta = flatten(rows)
    return rows.select(content.alias("content"), meta.alias("metadata"))


def sheet_block(columns: list[str]) -> Column:
    """First column bare, then 'header:' and value of every other filled column; null when only the first is filled."""
    head = F.coalesce(F.col(columns[0]), F.lit(""))
    rest = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{c}:\n"), F.col(c), F.lit("\n\n"))) for c in columns[1:]]
    body = F.concat_ws("", *rest)
    return F.when(body != "", F.concat(head, F.lit("\n\n"), body))


def flatten_tree(tree: dict) -> list[tuple[str, list[tuple[str, int]], str]]:
    """(document, path of (name, depth), content) of each section of a tree that has content, in order."""
    doc, out = tree.get("metadata", {}).get("document_name", ""), []
    stack = [(item, []) for item in reversed(tree.get("structure", []))]
    while stack:
        item, path = stack.pop()
        path = [*path, (item.get("section_name", ""), int(item.get("depth", len(path))))]
        if (item.get("content") or "").strip():
            out.append((doc, path, item["content"]))
        stack += [(child, path) for child in reversed(item.get("children") or [])]
    return out


def section_trees(spark: SparkSession, glob: str) -> DataFrame:
    """filename, doc, path array<struct<name, depth>>, content: sections of recursive JSON files, which no fixed schema can hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, d, [{"name": n, "depth": k} for n, k in p], c) for f, v in zip(pdf["filename"], pdf["content"]) for d, p, c in flatten_tree(json.loads(v))]
            yield pd.DataFrame(rows, columns=["filename", "doc", "path", "content"])

    return whole_files(spark, glob).select("filename", "content").mapInPandas(run, "filename string, doc string, path array<struct<name:string,depth:int>>, content string")


def marked_sections(text: Column, marker: str = r"<!-- SECTION_KEY: ([^ >]+) -->") -> Column:
    """array<struct<key, body>> of a blob with key markers; a body ends at the next marker, a closing '---' goes."""
    keys = F.regexp_extract_all(text, F.lit(marker), F.lit(1))
    parts = F.split(text, marker.replace("(", "(?:"), -1)
    bodies = F.slice(parts, F.lit(2), F.size(parts))
    return F.zip_with(keys, bodies, lambda k, b: F.struct(k.alias("key"), F.regexp_replace(F.regexp_replace(b, r"^\s+|\s+$", ""), r"\s*---$", "").alias("body")))
