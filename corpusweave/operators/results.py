"""Shaping hits: surfaced metadata, browse items, and text forms of a small result list."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.markup import list_preview
from corpusweave.functions.text import blank_to_null, ellipsis

NO_RESULTS = "No results found."
RULE = "-" * 40


def json_field(meta: Column, *names: str, nested_first: bool = True) -> Column:
    """First filled value of keys of a JSON text, at the top or under extracted_data, in a stated precedence."""
    top = [blank_to_null(F.get_json_object(meta, f"$['{n}']")) for n in names]
    deep = [blank_to_null(F.get_json_object(meta, f"$['extracted_data']['{n}']")) for n in names]
    pairs = zip(deep, top) if nested_first else zip(top, deep)
    return F.coalesce(*[c for pair in pairs for c in pair])


def has_key(meta: Column, name: str) -> Column:
    """Whether a key exists, even with a JSON null."""
    return F.coalesce(F.array_contains(F.json_object_keys(meta), F.lit(name)), F.lit(False))


def contains_all(meta: Column, wanted: dict[str, str]) -> Column:
    """Every key has its value."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & F.coalesce(F.get_json_object(meta, f"$['{k}']") == F.lit(v), F.lit(False))
    return out


def surfaced(meta: Column, fields: dict[str, tuple[str, ...]], *, made_up_url: str | None = None, limit: int = 200) -> Column:
    """map<canonical, value> over candidate keys: lists give their first value, made-up URLs are passed over, long ones cut."""

    def clean(c: Column) -> Column:
        first = F.when(F.startswith(c, F.lit("[")), F.get(F.from_json(c, "array<string>"), F.lit(0))).otherwise(c)
        return blank_to_null(F.when(F.rlike(first, F.lit(made_up_url)), None).otherwise(first) if made_up_url else first)

    entries = []
    for name, keys in fields.items():
        found = F.coalesce(*[clean(c) for k in keys for c in (F.get_json_object(meta, f"$['extracted_data']['{k}']"), F.get_json_object(meta, f"$['{k}']"))])
        entries.append(F.struct(F.lit(name).alias("key"), ellipsis(found, limit).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def browse_fields(meta: Column, core: tuple[str, ...], limit: int = 150) -> Column:
    """The rest of a flat JSON object: no core keys, no empty values, long ones cut."""
    flat = F.from_json(meta, "map<string,string>")
    kept = F.map_filter(flat, lambda k, v: ~k.isin(*core) & (F.coalesce(v, F.lit("")) != ""))
    return F.transform_values(kept, lambda _, v: ellipsis(v, limit))


def merged(base: Column, extra: Column) -> Column:
    """Two maps; on clashes the second wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k)), extra)


def to_text(hits: DataFrame, form: str = "text", *, limit: int = 200) -> str:
    """A small ranked list (id, score, content) as 'text', 'text-short' or 'json'; it is collected, so it is limited first."""
    rows = hits.orderBy(F.desc("score"), "id").limit(limit).collect()
    if not rows:
        return NO_RESULTS
    if form == "json":
        return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, sort_keys=True, default=str)
    if form == "text-short":
        return "\n".join(r["content"].strip().split("\n")[0] for r in rows)
    return f"\n{RULE}\n".join(f"[Score: {r['score']:.2f}]\n{r['content']}" for r in rows)


def previews(rows: DataFrame, by: list[str], item: str, most: int = 3) -> DataFrame:
    """by and preview: the least `most` items of each group and how many more there are; only those shown are gathered."""
    first = rows.select(*by, item).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(item))).where(F.col("_n") <= most)
    shown = first.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.col(item).cast("string").alias("i")))), lambda x: x["i"]).alias("_shown"))
    counts = rows.groupBy(*by).agg(F.count(item).alias("_total"))
    return shown.join(counts, by).select(*by, list_preview(F.col("_shown"), most, F.col("_total")).alias("preview"))
