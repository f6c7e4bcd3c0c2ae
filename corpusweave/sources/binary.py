"""Binary files read by an injected reader, index tables that name them, and index pages of a lexicon."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.sources.feeds import links
from corpusweave.sources.files import csv_rows

# Fixed value: class of the table cells that hold a lexicon's links.
LEXICON_CELL = "lexColumns"


def binary_texts(spark: SparkSession, glob: str, readers: list[Callable[[bytes], str]], *, least_bytes: int = 1024) -> DataFrame:
    """path, text and error of each file: the first reader that gives a text counts; files under least_bytes are refused unread.

    A file that no reader can read has a null text and the last failure; the other files are not affected.
    """

    @F.pandas_udf("struct<text:string,error:string>")
    def run(contents: pd.Series) -> pd.DataFrame:
        out = []
        for raw in contents:
            got = (None, "too small") if raw is None or len(raw) < least_bytes else (None, "no text")
            for read in readers if got[1] == "no text" else ():
                try:
                    text = read(bytes(raw))
                except Exception as e:  # the next reader's turn
                    got = (None, f"{type(e).__name__}: {e}")
                    continue
                if text and text.strip():
                    got = (text, None)
                    break
            out.append(got)
        return pd.DataFrame(out, columns=["text", "error"])

    rows = spark.read.format("binaryFile").load(glob)
    return rows.select("path", run("content").alias("_r")).select("path", "_r.text", "_r.error")


def index_rows(spark: SparkSession, *, remote: str | None = None, local: str | None = None) -> DataFrame:
    """Rows of an index CSV with exactly one origin."""
    if bool(remote) == bool(local):
        raise ValueError("an index has exactly one origin: remote or local")
    return csv_rows(spark, remote or local)


def lexicon_links(html: Column) -> Column:
    """Links inside the index cells of a lexicon page, in their order."""
    cells = F.regexp_extract_all(html, F.lit(rf'(?is)<td\b[^>]*class="[^"]*\b{LEXICON_CELL}\b[^"]*"[^>]*>(.*?)</td>'), F.lit(1))
    return F.flatten(F.transform(cells, lambda c: links(c)))
