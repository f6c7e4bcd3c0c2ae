"""Calls to models as Arrow functions with an injectable implementation: embeddings, extracted fields, categories, judgements.

Each takes the callable as a parameter, works on batches, isolates errors per row, and has a deterministic stand-in for tests.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_embedding(text: str, dims: int = 64) -> list[float]:
    """Stand-in embedder: signed counts of hashed words, scaled to length one."""
    v = [0.0] * dims
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dims] += 1.0 if h >> 63 else -1.0
    size = sum(x * x for x in v) ** 0.5
    return [x / size for x in v] if size else v


def embed(rows: DataFrame, text: str = "content", out: str = "embedding", *, batch: Callable[[list[str]], list[list[float]]] | None = None, size: int = 1000) -> DataFrame:
    """rows with a vector column; batch is called with at most `size` texts at a time, in order."""
    call = batch or (lambda texts: [hashed_embedding(t) for t in texts])

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), size) for v in call(texts[i : i + size])], dtype="object")

    return rows.withColumn(out, run(F.col(text)))


def parsed_json(c: Column) -> Column:
    """JSON text as it is, or with single quotes and trailing commas put right; null where that does not parse either."""
    fixed = F.regexp_replace(F.regexp_replace(c, r"'", '"'), r",\s*([}\]])", "$1")
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(valid(c), valid(fixed))


def extract(rows: DataFrame, text: str, ask: Callable[[str], str], out: str = "extracted") -> DataFrame:
    """out (JSON text) and out_error per row; a failing call leaves the other rows alone."""

    @F.pandas_udf("struct<value:string,error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        got = []
        for t in texts:
            try:
                got.append((ask(t or ""), None))
            except Exception as e:  # a row's failure is its own result
                got.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(got, columns=["value", "error"])

    made = rows.withColumn("_x", run(F.col(text)))
    return made.withColumn(out, parsed_json(F.col("_x.value"))).withColumn(f"{out}_error", F.coalesce("_x.error", F.when(F.col(out).isNull(), "no JSON"))).drop("_x")


def category(answer: str | None, kinds: frozenset[str], topics: frozenset[str], fallback: tuple[str, str]) -> tuple[str, str]:
    """Both labels of a JSON answer if they are in the vocabularies, else the fallback pair."""
    try:
        got = json.loads(answer or "")
        pair = (got["type"], got["topic"])
    except (ValueError, KeyError, TypeError):
        return fallback
    return pair if pair[0] in kinds and pair[1] in topics else fallback


def categorize(rows: DataFrame, text: str, ask: Callable[[str], str], kinds: frozenset[str], topics: frozenset[str], fallback: tuple[str, str]) -> DataFrame:
    """doc_type and topic; one more try after a bad answer, never a failure."""

    @F.pandas_udf("struct<doc_type:string,topic:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            pair = fallback
            for _ in range(2):
                try:
                    pair = category(ask(t or ""), kinds, topics, fallback)
                except Exception:  # an unreachable model means the fallback
                    pair = fallback
                if pair != fallback:
                    break
            out.append(pair)
        return pd.DataFrame(out, columns=["doc_type", "topic"])

    return rows.withColumn("_c", run(F.col(text))).withColumn("doc_type", F.col("_c.doc_type")).withColumn("topic", F.col("_c.topic")).drop("_c")


def short_verdict(new: Column, old: Column) -> Column:
    """What needs no judge: an empty side loses, two empty sides tie; null where a judge must look."""
    n, o = F.trim(F.coalesce(new, F.lit(""))) == "", F.trim(F.coalesce(old, F.lit(""))) == ""
    return F.when(n & o, "TIE").when(n, "OLD").when(o, "NEW")


def repair_fields(rows: DataFrame, required: dict[str, str]) -> DataFrame:
    """Required columns (name -> default): own value, else that of a column whose name matches without case or as a part."""
    have = {c.lower(): c for c in rows.columns}
    out = rows
    for name, default in required.items():
        near = [have[k] for k in have if k == name.lower()] or [have[k] for k in have if name.lower() in k or k in name.lower()]
        source = F.col(name) if name in rows.columns else F.col(near[0]) if near else F.lit(None)
        out = out.withColumn(name, F.coalesce(F.nullif(source.cast("string"), F.lit("")), F.lit(default)))
    return out




def markdown_blocks(text: Column) -> Column:
    """array<struct<kind, level, text>> of headings, bullets, numbered lines and paragraphs."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")

    def block(x: Column) -> Column:
        heading, bullet, number = F.regexp_extract(x, r"^(#{1,6})\s+", 1), F.rlike(x, F.lit(r"^\s*[-*]\s+")), F.rlike(x, F.lit(r"^\s*\d+\.\s+"))
        kind = F.when(heading != "", "heading").when(bullet, "bullet").when(number, "number").otherwise("paragraph")
        return F.struct(kind.alias("kind"), F.length(heading).alias("level"), F.regexp_replace(x, r"^(#{1,6}\s+|\s*[-*]\s+|\s*\d+\.\s+)", "").alias("text"))

    return F.transform(lines, block)
