"""Names in queries, for whole tables of queries at once: candidate spans, nearest catalog names, decisions on filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions import text as T
from corpusweave.operators import retrieve as R

MOST_WORDS = 3


def _words(query: Column) -> Column:
    return F.filter(F.split(query, r"\s+"), lambda w: w != "")


def spans(query: Column, prefixes: list[str], boundaries: list[str], marks: str) -> Column:
    """array<struct<mention, words>>: the one word that begins a name with one to three words behind it.

    Empty if no word, or more than one, begins a name. A boundary word ends a span before it, a mark at a word's end behind it.
    """
    raw = _words(query)
    bare = F.transform(raw, lambda w: F.btrim(w, F.lit(marks)))
    opens = lambda w: w.isin(prefixes) | F.substr(w, F.lit(2)).isin(prefixes)
    at = F.filter(F.transform(bare, lambda w, i: F.when(opens(w), i)), lambda i: i.isNotNull())

    def of(begin: Column) -> Column:
        steps = F.array(*[F.lit(k) for k in range(1, MOST_WORDS + 1)])
        word = lambda words, j: F.get(words, begin + j)
        inside = lambda j: F.coalesce((word(bare, j) != "") & ~word(bare, j).isin(boundaries), F.lit(False))
        open_end = lambda j: word(bare, j) == word(raw, j)
        fits = F.filter(steps, lambda k: F.forall(steps, lambda j: (j > k) | (inside(j) & ((j == k) | open_end(j)))))
        return F.transform(fits, lambda k: F.struct(F.array_join(F.slice(bare, begin + 1, k + 1), " ").alias("mention"), (k + 1).alias("words")))

    # transform over the one position holds it under a name
    return F.when(F.size(at) == 1, F.flatten(F.transform(at, of)))


def detect_names(queries: DataFrame, catalog: DataFrame, prefixes: list[str], boundaries: list[str], *, marks: str = "?,.!\"'():;", least: float = 0.55, dominance: float = 0.5, id_col: str = "id", query: str = "query") -> DataFrame:
    """id, name, similarity: the catalog name each query is about. Of its spans the most similar one counts (the shorter of
    equals), if it makes up enough of the query's words; queries about no name have no row."""
    content = F.size(F.filter(F.transform(_words(F.col(query)), lambda w: F.btrim(w, F.lit(marks))), lambda w: (w != "") & ~w.isin(boundaries)))
    asked = queries.select(id_col, content.alias("_content"), F.explode(spans(F.col(query), prefixes, boundaries, marks)).alias("s")).select(id_col, "_content", "s.*")
    near = R.similar_names(asked.select("mention"), catalog, least=least)
    best = asked.join(near, "mention").groupBy(id_col).agg(F.max_by(F.struct("name", "similarity", "words", "_content"), F.struct("similarity", -F.col("words"))).alias("b"))
    return best.where(F.col("b.words") / F.col("b._content") >= dominance).select(id_col, "b.name", "b.similarity")


def resolve_names(requests: DataFrame, catalog: DataFrame, *, wanted: str = "wanted", least: float = 0.45) -> DataFrame:
    """requests with name and decision: 'all' without a name filter, 'exact' if the catalog has it, 'resolved' to the most
    similar name, or 'absent', where a search goes on without the filter."""
    rows = requests.withColumn("_w", T.norm_name(F.col(wanted)))
    known = catalog.select(F.col("name").alias("_known"), T.norm_name(F.col("name")).alias("_w")).groupBy("_w").agg(F.min("_known").alias("_known"))
    open_ = rows.where(F.coalesce("_w", F.lit("")) != "").select("_w").distinct().join(known, "_w", "left_anti")
    near = R.similar_names(open_.withColumnRenamed("_w", "mention"), catalog, least=least).select(F.col("mention").alias("_w"), F.col("name").alias("_near"))
    out = rows.join(known, "_w", "left").join(near, "_w", "left")
    decision = F.when(F.coalesce("_w", F.lit("")) == "", "all").when(F.col("_known").isNotNull(), "exact").when(F.col("_near").isNotNull(), "resolved").otherwise("absent")
    return out.select(*requests.columns, F.coalesce("_known", "_near").alias("name"), decision.alias("decision"))
