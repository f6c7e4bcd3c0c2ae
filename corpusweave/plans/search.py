"""Search plans: modes, name detection in queries, guards and fallbacks. Decisions are taken on single small rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions import text as T
from corpusweave.functions.lexical import prefix_query
from corpusweave.operators import retrieve as R

DETECT, RESOLVE, DOMINANCE = 0.55, 0.45, 0.5
OVERRIDE_VECTOR_WEIGHT = 0.5


@dataclass(frozen=True)
class Mode:
    name: str
    n: int
    vector: bool = True
    words: bool = False
    browse: bool = False
    by_date: bool = False


MODES = MappingProxyType({m.name: m for m in (Mode("REGULAR", 15), Mode("SECTION_NUMBER", 3, vector=False, words=True), Mode("METADATA_BROWSE", 25, browse=True), Mode("RECENCY_BROWSE", 10, vector=False, by_date=True))})


def mode_of(name: str | None, *, words: bool | None = None) -> Mode:
    """Unknown names mean REGULAR; a context may switch lexical search on or off."""
    mode = MODES.get(name or "REGULAR", MODES["REGULAR"])
    return mode if words is None else replace(mode, words=words)


@dataclass(frozen=True)
class NameRules:
    """Language of names in queries: words a name begins with, words that end it, one-letter articles that may precede."""

    prefixes: frozenset[str]
    boundaries: frozenset[str] = frozenset()
    marks: str = "?,.!\"'():;"


def name_spans(query: str, rules: NameRules) -> list[tuple[str, int]]:
    """Spans (text, words) that may name something: one name-beginning word (exactly one in the query) and 1 to 3 words after it."""
    raw = query.split()
    bare = [w.strip(rules.marks) for w in raw]
    starts = [i for i, w in enumerate(bare) if w in rules.prefixes or w[1:] in rules.prefixes]
    if len(starts) != 1:
        return []
    out, i = [], starts[0]
    for end in range(i + 1, min(i + 4, len(bare))):
        if not bare[end] or bare[end] in rules.boundaries:
            break
        out.append((" ".join(bare[i : end + 1]), end - i + 1))
        if bare[end] != raw[end]:
            break
    return out


def best_name(catalog: DataFrame, mention: str, least: float) -> tuple[str, float] | None:
    spark = catalog.sparkSession
    row = R.similar_names(spark.createDataFrame([(mention,)], "mention string"), catalog, least=least).first()
    return (row["name"], row["similarity"]) if row else None


def detect_name(catalog: DataFrame, query: str, rules: NameRules, least: float = DETECT) -> str | None:
    """The catalog name that a query is about: its best span, if that is at least half of the query's words."""
    spans = name_spans(query, rules)
    if not spans:
        return None
    found = R.similar_names(catalog.sparkSession.createDataFrame(spans, "mention string, words int").select("mention"), catalog, least=least).collect()
    size = dict(spans)
    best = max(found, key=lambda r: (r["similarity"], -size[r["mention"]]), default=None)
    content = sum(1 for w in query.split() if (b := w.strip(rules.marks)) and b not in rules.boundaries)
    return best["name"] if best and content and size[best["mention"]] / content >= DOMINANCE else None


def same_name(name: str) -> Callable[[str], Column]:
    return lambda column: T.norm_name(F.col(column)) == T.norm_name(F.lit(name))


@dataclass
class Hits:
    rows: DataFrame
    note: str | None = None


def hybrid(chunks: DataFrame, index: DataFrame, query: str, vector: list[float] | None, mode: Mode, *, scope: Column | None = None, vec: str = "embedding", id_col: str = "id", drop: frozenset[str] = frozenset(), vector_weight: float = R.VECTOR_WEIGHT) -> DataFrame:
    """Vector and lexical branches as the mode asks, each 5 n long, fused. Only the branches needed are planned."""
    n, fetch = mode.n, 5 * mode.n
    near = R.knn(chunks, vector, fetch, vec=vec, id_col=id_col, scope=scope) if mode.vector and vector else None
    if not mode.words:
        return (near if near is not None else R.knn(chunks, vector or [], 0, vec=vec, id_col=id_col)).where(F.col("rank") < n)
    allowed = index if scope is None else index.join(chunks.where(scope).select(F.col(id_col).alias("id")), "id", "left_semi")
    words = R.lexical(allowed, prefix_query(query, drop), fetch)
    none = words.where(F.lit(False))
    return R.rrf(near if near is not None else none, words, n, vector_weight=vector_weight)


def scoped_search(chunks: DataFrame, index: DataFrame, catalog: DataFrame, query: str, vector: list[float] | None, mode: Mode, *, name: str | None = None, other: Column | None = None, name_col: str = "law_name", rules: NameRules | None = None, depth: int = 2, **options) -> Hits:
    """Search inside one named work.

    A name detected in the query overrides a missing or contradicting filter; a filter that matches nothing is resolved to the
    nearest name, and without one the search is widened, unless other conditions stand. Depth bounds the rewrites.
    """
    detected = detect_name(catalog, query, rules) if rules and depth == 2 else None
    if detected and (not name or norm(chunks, detected) != norm(chunks, name)):
        return replace_note(scoped_search(chunks, index, catalog, query, vector, mode, name=detected, other=other, name_col=name_col, depth=depth - 1, **options), f"query_detected={detected}")
    if not name:
        return Hits(hybrid(chunks, index, query, vector, mode, scope=other, **options))
    scope = same_name(name)(name_col)
    scope = scope if other is None else scope & other
    found = hybrid(chunks, index, query, vector, replace(mode, vector=True) if vector else mode, scope=scope, vector_weight=R.VECTOR_WEIGHT if mode.vector else OVERRIDE_VECTOR_WEIGHT, **options)
    if depth <= 0 or other is not None or not found.isEmpty():
        return Hits(found)
    near = best_name(catalog, name, RESOLVE)
    if near and norm(chunks, near[0]) != norm(chunks, name):
        return replace_note(scoped_search(chunks, index, catalog, query, vector, mode, name=near[0], name_col=name_col, depth=0, **options), f"resolved_from={name}")
    return Hits(hybrid(chunks, index, query, vector, mode, **options), "fallback=name_absent")


def norm(df: DataFrame, value: str) -> str:
    return df.sparkSession.range(1).select(T.norm_name(F.lit(value))).first()[0]


def replace_note(hits: Hits, note: str) -> Hits:
    return Hits(hits.rows, note if hits.note is None else f"{note};{hits.note}")


def store_names(contexts: DataFrame) -> DataFrame:
    """'bot__context' of every context."""
    return contexts.select(F.concat_ws("__", "bot", "name").alias("store")).distinct()


def parse_store(store: Column) -> Column:
    parts = F.split(store, "__")
    return F.struct(F.get(parts, F.lit(0)).alias("bot"), F.get(parts, F.lit(1)).alias("context"))
