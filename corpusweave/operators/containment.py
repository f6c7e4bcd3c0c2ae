"""Deep containment of JSON: one pattern as a filter in built-in functions, or a table of patterns against a table of rows.

Rules: an object contains another whose every key it has with a value that contains the other's; an array contains another
whose every element some element of it contains; scalars contain their equals, numbers by value. At the top only, an array
also contains a scalar that is one of its elements. Text that is null, no JSON, or repeats a key in an object contains nothing and
is contained in nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.scratch import cut


class NoJson:
    """Stands for the value of a text that is no JSON (a class, as it stays the same object in other processes)."""


# ---- one pattern


def _child(v: Column, key: str) -> Column:
    if "'" in key and '"' in key:
        raise ValueError(f"a key with both kinds of quotes cannot be reached: {key!r}")
    quote = '"' if "'" in key else "'"
    return F.try_variant_get(v, f"$[{quote}{key}{quote}]", "variant")


def _some(elements: Column, pattern) -> Column:
    return F.exists(elements, lambda e: _inside(e, pattern))


def _inside(v: Column, pattern) -> Column:
    kind = F.schema_of_variant(v)
    if isinstance(pattern, dict):
        out = F.startswith(kind, F.lit("OBJECT"))
        for k, p in pattern.items():
            out = out & _inside(_child(v, k), p)
    elif isinstance(pattern, list):
        elements = F.try_variant_get(v, "$", "array<variant>")
        out = F.startswith(kind, F.lit("ARRAY"))
        for p in pattern:
            out = out & _some(elements, p)
    elif pattern is None:
        out = F.is_variant_null(v)
    elif isinstance(pattern, bool):
        out = (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(pattern))
    elif isinstance(pattern, str):
        out = (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(pattern))
    else:
        out = F.rlike(kind, F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")) & (F.try_variant_get(v, "$", "double") == F.lit(float(pattern)))
        if isinstance(pattern, int) and abs(pattern) < 10**37:  # doubles do not tell large whole numbers apart
            out = out & F.coalesce(F.try_variant_get(v, "$", "decimal(38,0)") == F.lit(str(pattern)).cast("decimal(38,0)"), F.lit(True))
    return F.coalesce(out, F.lit(False))


def contains(text: Column, pattern) -> Column:
    """Whether a JSON text contains a pattern of Python objects, lists and scalars; the pattern becomes one expression."""
    v = F.try_parse_json(text)
    out = _inside(v, pattern)
    if not isinstance(pattern, (dict, list)):
        out = out | F.coalesce(_some(F.try_variant_get(v, "$", "array<variant>"), pattern), F.lit(False))
    return out


# ---- a table of patterns


def _object(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def parsed(text: str | None):
    """The value of a JSON text, or a mark that there is none."""
    try:
        return NoJson if text is None else json.loads(text, object_pairs_hook=_object, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return NoJson


def holds(a, b, top: bool = True) -> bool:
    """Whether a contains b."""
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and holds(a[k], p, False) for k, p in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(holds(x, p, False) for x in a) for p in b)
    if isinstance(a, list):
        return top and any(holds(x, b, False) for x in a if not isinstance(x, list))
    return not isinstance(a, dict) and isinstance(a, bool) == isinstance(b, bool) and a == b


def _scalar(x) -> str:
    return repr(int(x) if isinstance(x, float) and x.is_integer() else x)


def keys(value, whole: bool) -> set[int]:
    """Hashes of the pairs of path and scalar (places in arrays count alike), and of the containers: all of them or empty ones only.

    The keys of what a value contains (whole false) are among the value's own (whole true).
    """
    found, stack = set(), [("", value)]
    if whole and isinstance(value, list):
        found.update("\0=" + _scalar(x) for x in value if not isinstance(x, (dict, list)))
    while stack:
        path, x = stack.pop()
        if isinstance(x, dict):
            if whole or not x:
                found.add(path + "\0{")
            stack.extend((f"{path}\1{k}", y) for k, y in x.items())
        elif isinstance(x, list):
            if whole or not x:
                found.add(path + "\0[")
            stack.extend((path + "\2", y) for y in x)
        else:
            found.add(f"{path}\0={_scalar(x)}")
    return {xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) for k in found}


def _key_rows(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(1)):
                value = parsed(text.as_py())
                if value is not NoJson:
                    mine = keys(value, whole)
                    out.extend(mine)
                    at.extend([i] * len(mine))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(np.array(out, np.uint64).view(np.int64))], [batch.schema.names[0], "key"])

    return run


def key_table(rows: DataFrame, id_col: str, json_col: str, *, whole: bool) -> DataFrame:
    """id_col and key, once each for a row: the path-value index of JSON texts."""
    source = rows.select(id_col, F.col(json_col).cast("string").alias("_json"))
    return source.mapInArrow(_key_rows(whole), T.StructType([source.schema[id_col], T.StructField("key", T.LongType())]))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pattern = lru_cache(4096)(parsed)
    for batch in batches:
        keep = [holds(parsed(a.as_py()), pattern(b.as_py())) for a, b in zip(batch.column(2), batch.column(3))]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def contained_pairs(rows: DataFrame, patterns: DataFrame, *, id_col: str, json_col: str, pattern_id: str, pattern_col: str) -> DataFrame:
    """(pattern_id, id_col), once each, of the patterns and the rows that contain them.

    A pattern meets the rows only through that of its keys which the fewest rows hold, so a key that all rows share costs nothing
    unless a pattern has no other. What meets is tested exactly. Rows and patterns without id are left out; where an id
    repeats, one of its rows has to contain one of the pattern's texts. Both id columns need different names.
    """
    texts = rows.where(F.col(id_col).isNotNull()).select(id_col, F.col(json_col).cast("string").alias("_json"))
    asked = patterns.where(F.col(pattern_id).isNotNull()).select(pattern_id, F.col(pattern_col).cast("string").alias("_pattern")).distinct()
    asked = asked.withColumn("_no", F.xxhash64(pattern_id, "_pattern"))
    wanted = cut(key_table(asked, "_no", "_pattern", whole=False), "containment-patterns")
    held = key_table(texts, id_col, "_json", whole=True).join(wanted.select("key").distinct(), "key", "left_semi")
    held = cut(held.distinct(), "containment-keys")
    often = held.groupBy("key").agg(F.count("*").alias("n"))
    rarest = wanted.join(often, "key", "left").groupBy("_no").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    near = held.join(rarest, "key").select("_no", id_col).join(asked, "_no").join(texts, id_col).select(pattern_id, id_col, "_json", "_pattern")
    return near.mapInArrow(_verified, T.StructType([near.schema[pattern_id], near.schema[id_col]])).distinct()
