"""Field-weighted search."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions import text as T


@dataclass(frozen=True)
class Field:
    """A field of a search mode: a phrase counts exact * boost, single words partial * boost each; fuzzy words may miss by edits."""

    name: str
    exact: float = 0.0
    partial: float = 0.0
    boost: float = 1.0
    phrase: bool = False
    fuzzy: bool = False


def _edits(word: str) -> int:
    return 0 if len(word) < 3 else 1 if len(word) < 6 else 2


def field_score(fields: tuple[Field, ...], query: str) -> Column:
    """Sum over the fields of a query; null where no field has any of it."""
    words = [w for w in query.lower().split() if w]
    total = []
    for f in fields:
        terms = T.tokens(F.col(f.name))
        if f.phrase:
            if f.exact * f.boost > 0:
                held = F.contains(F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" ")), F.lit(f" {' '.join(words)} "))
                total.append(F.when(held, f.exact * f.boost))
        elif f.partial * f.boost > 0:
            near = lambda w: (lambda t: F.levenshtein(t, F.lit(w), _edits(w)) >= 0) if f.fuzzy else (lambda t: t == w)
            hits = sum((F.exists(terms, near(w)).cast("int") for w in words), F.lit(0))
            total.append(F.when(hits > 0, hits * (f.partial * f.boost)))
    return F.when(reduce(lambda a, b: a | b, [t.isNotNull() for t in total]), sum((F.coalesce(t, F.lit(0.0)) for t in total), F.lit(0.0)))


def field_weighted(docs: DataFrame, fields: tuple[Field, ...], query: str, k: int, *, id_col: str, min_score: float = 0.0) -> DataFrame:
    """id, score and rank of the k best documents; a min_score above 0 cuts lower ones."""
    rows = docs.select(F.col(id_col).alias("id"), field_score(fields, query).alias("score")).where("score is not null")
    rows = rows.where(F.col("score") >= min_score) if min_score > 0 else rows
    top = rows.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).cast("long"))
