"""Retrieval: exact vector search, lexical search, rank fusion, scoping, recency and expansion, as DataFrame plans.

Every ranking has a total order (score, then id), so results do not depend on partitioning. Top-k is per query: a global
sort with a limit for one query; for many, the best of each batch and a ranking window that merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from corpusweave.functions import text as T
from corpusweave.functions.lexical import PrefixQuery
from corpusweave.functions.vector import cosine
from corpusweave.operators.similarity import best_names
from corpusweave.scratch import cut

RRF_K, VECTOR_WEIGHT, LEXICAL_WEIGHT = 60, 1.0, 3.0
#: Weights of a term's place: title, summary fields, and body.
FIELD_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
#: About so many query vectors travel to every task at a time.
MOST_QUERIES = 10_000
#: Scores are made for so many queries, and sums for so many vectors, at a time.
QUERY_TILE, VECTOR_TILE = 64, 512


def knn(chunks: DataFrame, query: list[float], k: int, *, vec: str = "embedding", id_col: str = "id", scope: Column | None = None) -> DataFrame:
    """id, score and rank (from 0) of the k nearest by cosine; null vectors come last and only if there is room."""
    rows = chunks if scope is None else chunks.where(scope)
    scored = rows.select(F.col(id_col).alias("id"), cosine(F.col(vec), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    return ranked(scored.orderBy(F.desc_nulls_last("score"), "id").limit(k))


def ranked(top: DataFrame) -> DataFrame:
    """rank from 0 of an already limited list: its few rows are in one partition after the limit."""
    return top.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "id")) - 1).cast("long"))


def knn_many(chunks: DataFrame, queries: DataFrame, k: int, *, vec: str = "embedding", id_col: str = "id", block: int = MOST_QUERIES) -> DataFrame:
    """The k nearest of each query(query_id, query_vec), however many there are: query_id, id, score, rank (from 0).

    Queries go to the tasks in blocks of about `block` (by a hash of query_id, a key of its own for each query). A task keeps
    the k best of each batch of chunks, and a ranking by query merges them. Scores are those of cosine(), bit for bit.
    """
    spark = chunks.sparkSession
    blocks = -(-queries.count() // block)
    rows = chunks.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    asked = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("v"))
    schema = T_.StructType([T_.StructField("query_id", asked.schema["query_id"].dataType), T_.StructField("id", rows.schema["id"].dataType), T_.StructField("score", T_.DoubleType())])
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "id")
    out = None
    for b in range(max(1, blocks)):
        held = spark.sparkContext.broadcast(_by_length(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))) == b).toArrow()))
        best = rows.mapInArrow(_best(held, k), schema).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
        best = best.withColumn("rank", (F.col("rn") - 1).cast("long")).drop("rn")
        if blocks > 1:  # one block at a time is held
            best = cut(best, "knn-block")
            held.unpersist()
        out = best if out is None else out.union(best)
    return out


def _by_length(asked: pa.Table) -> tuple[pa.Array, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Query ids, and by length the places and vectors of the queries that have a score at all."""
    column = asked.column("v").combine_chunks()
    return asked.column("query_id").combine_chunks(), _vectors(column)


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (places, matrix) of the vectors that are neither null nor empty nor hold a null."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, parent = pc.list_flatten(column), pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    usable = lengths > 0
    usable[parent[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = False
    values = flat.to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths[usable]):
        at = np.flatnonzero(usable & (lengths == n))
        out[int(n)] = (at, values[(ends[at] - n)[:, None] + np.arange(n)])
    return out


def _lengths(m: np.ndarray) -> np.ndarray:
    total = np.zeros(len(m))
    for j in range(m.shape[1]):  # in the order of dot(), so that equal vectors have equal scores anywhere
        total += m[:, j] * m[:, j]
    return np.sqrt(total)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of some queries and all vectors of a batch, -inf where there is none; sums in the order of dot()."""
    out = np.zeros((len(q), len(v)))
    columns = np.ascontiguousarray(v.T)
    for at in range(0, len(v), VECTOR_TILE):
        tile = np.zeros((len(q), min(VECTOR_TILE, len(v) - at)))
        product = np.empty_like(tile)
        for j in range(q.shape[1]):
            np.multiply(q[:, j, None], columns[None, j, at : at + VECTOR_TILE], out=product)
            np.add(tile, product, out=tile)
        out[:, at : at + VECTOR_TILE] = tile
    size = _lengths(q)[:, None] * _lengths(v)[None, :]
    with np.errstate(all="ignore"):
        return np.where(size == 0, -np.inf, out / size)


def _best(held, k: int):
    """For each batch of (id, v) the k best of each query: score first (nulls last, NaN before all, as Spark sorts), then id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = held.value
        least = np.full((len(names), k), -np.inf)  # the k best scores that this task has given
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            batch = batch.take(pc.array_sort_indices(batch.column(0), null_placement="at_start"))
            vectors = _vectors(batch.column(1))
            for first in range(0, len(names), QUERY_TILE):
                last = min(first + QUERY_TILE, len(names))
                key = np.full((last - first, batch.num_rows), -np.inf)
                for n, (at, matrix) in vectors.items():
                    places, queries = asked.get(n, (np.zeros(0, int), None))
                    mine = np.flatnonzero((places >= first) & (places < last))
                    if len(mine):
                        key[np.ix_(places[mine] - first, at)] = _scores(queries[mine], matrix)
                key[np.isnan(key)] = np.inf
                bound = least[first:last].min(axis=1)
                if batch.num_rows > k:
                    bound = np.maximum(bound, np.partition(key, batch.num_rows - k, axis=1)[:, batch.num_rows - k])
                q, at = np.nonzero(key >= bound[:, None])
                score = key[q, at]
                order = np.lexsort((at, -score, q))
                q, at, score = q[order], at[order], score[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, at, score, place = (x[place < k] for x in (q, at, score, place))
                new = np.full((last - first, k), -np.inf)
                new[q, place] = score
                least[first:last] = -np.sort(-np.concatenate([least[first:last], new], axis=1), axis=1)[:, :k]
                shown = pa.array(np.where(score == np.inf, np.nan, score), mask=score == -np.inf)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q + first)), batch.column(0).take(pa.array(at)), shown], ["query_id", "id", "score"])

    return run


def postings(docs: DataFrame, *, id_col: str = "doc_id", fields: dict[str, str] | None = None) -> DataFrame:
    """Inverted index (id, term, weight, hits): how often a term stands in fields of one weight. fields: column -> weight letter."""
    fields = fields or {"text": "D"}
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.concat(*[_weighted(c, w) for c, w in fields.items()])).alias("t")).select("id", "t.term", "t.weight")
    return rows.groupBy("id", "term", "weight").agg(F.count("*").alias("hits"))


def _weighted(column: str, letter: str) -> Column:
    weight = FIELD_WEIGHTS[letter]
    return F.transform(T.tokens(F.col(column)), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))


def lexical(index: DataFrame, query: PrefixQuery, k: int) -> DataFrame:
    """id, score, rank of the k documents with the highest weighted count of hits. Each matching place counts once."""
    if not query.prefixes:
        return ranked(index.where(F.lit(False)).select("id", F.lit(0.0).alias("score")).limit(0))
    any_of = F.lit(False)
    for p in query.prefixes:
        any_of = any_of | F.startswith("term", F.lit(p))
    found = index.where(any_of)
    sums = [F.round(F.sum(F.col("weight") * F.col("hits")), 9).alias("score")]  # rounded: the order of a sum must not break ties
    if query.all:
        sums += [F.max(F.startswith("term", F.lit(p)).cast("int")).alias(f"_p{i}") for i, p in enumerate(query.prefixes)]
    scored = found.groupBy("id").agg(*sums)
    for i in range(len(query.prefixes) if query.all else 0):
        scored = scored.where(F.col(f"_p{i}") == 1)
    return ranked(scored.select("id", "score").orderBy(F.desc("score"), "id").limit(k))


def rrf(vector: DataFrame, words: DataFrame, n: int, *, k: int = RRF_K, vector_weight: float = VECTOR_WEIGHT, lexical_weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """Weighted reciprocal rank fusion of two lists (id, rank): id, score, vec_rank, lex_rank; ties go to the vector list's order."""
    part = lambda df, w, v, x: df.select("id", (F.lit(float(w)) / (k + F.col("rank") + 1)).alias("s"), v.cast("long").alias("vec_rank"), x.cast("long").alias("lex_rank"))
    none = F.lit(None)
    both = part(vector, vector_weight, F.col("rank"), none).union(part(words, lexical_weight, none, F.col("rank")))
    fused = both.groupBy("id").agg(F.sum("s").alias("score"), F.max("vec_rank").alias("vec_rank"), F.max("lex_rank").alias("lex_rank"))
    return fused.orderBy(F.desc("score"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("lex_rank"), "id").limit(n)


def recency(chunks: DataFrame, n: int, *, dates: list[Column], keys: list[Column], id_col: str = "id", order: Column | None = None) -> DataFrame:
    """The n newest documents: first chunk of each (by order, then id), with a plausible date, newest date string first."""
    rows = chunks.withColumn("doc_date", T.first_filled(*dates)).withColumn("_key", T.first_filled(*keys, F.col(id_col).cast("string")))
    rows = rows.where(T.is_plausible_date(F.col("doc_date")))
    w = Window.partitionBy("_key").orderBy(F.coalesce(order, F.lit(0)) if order is not None else F.lit(0), id_col)
    first = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_key")
    return first.orderBy(F.desc("doc_date"), F.desc(id_col)).limit(n)


def expand(hits: DataFrame, chunks: DataFrame, *, title: str = "title", pos: str = "chunk_index", content: str = "content", id_col: str = "id", most: int = 12, total: int = 40) -> DataFrame:
    """Hits (rank, title, content) with the whole document in place of a chunk, while the total of chunks lasts.

    The first hit of a title is expanded to its chunks in order (at most `most`); later hits of the title go. Once `total`
    chunks are used, hits pass through as they are; hits without a title always do.
    """
    near = chunks.join(hits.select(title).where(F.col(title).cast("string") != "").distinct(), title, "left_semi")
    near = near.select(title, F.coalesce(pos, F.lit(0)).alias("_p"), F.col(id_col).alias("_i"), F.col(content).alias("_c"))
    # Ranked first and counted apart: of a long document only the chunks that are shown are gathered.
    first = near.withColumn("_n", F.row_number().over(Window.partitionBy(title).orderBy("_p", "_i", "_c"))).where(F.col("_n") <= most)
    kept = first.groupBy(title).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.col("_c").alias("c")))), lambda x: F.struct(x["c"].alias("c"))).alias("_kept"))
    docs = kept.join(near.groupBy(title).agg((F.count("*") > most).alias("_more")), title)
    rows = hits.join(docs, title, "left")
    known = F.col("_kept").isNotNull()
    rows = rows.withColumn("_seen", F.when(known, F.row_number().over(Window.partitionBy(title).orderBy("rank"))).otherwise(F.lit(1))).where("_seen = 1")
    # hits are a top-n list, so its running sum is over few rows
    used = F.coalesce(F.sum(F.when(known, F.size("_kept")).otherwise(0)).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_open", known & (used < total))
    joined = F.array_join(F.filter(F.col("_kept.c"), lambda c: c != ""), "\n\n")
    return rows.select(
        *[c for c in hits.columns if c != content], F.when(F.col("_open"), joined).otherwise(F.col(content)).alias(content),
        F.when(F.col("_open"), F.size("_kept")).cast("long").alias("expanded_chunks"), F.when(F.col("_open"), F.col("_more")).alias("expanded_truncated"),
    )


def similar_names(mentions: DataFrame, catalog: DataFrame, *, mention: str = "mention", name: str = "name", least: float = 0.45) -> DataFrame:
    """The catalog name most like each mention by trigram sets: mention, name, similarity >= least."""
    return best_names(mentions, catalog, mention=mention, name=name, least=least)


def distribution(docs: DataFrame, key: Column, label: Column, date: Column) -> DataFrame:
    """Groups by key and label with counts and newest date, numeric keys in order; nothing when there are under two groups."""
    rows = docs.select(key.alias("group_key"), label.alias("group_label"), T.publish_date(date).alias("_d")).where("group_key is not null")
    groups = rows.groupBy("group_key", "group_label").agg(F.count("*").alias("doc_count"), F.max("_d").alias("latest_date"))
    return groups.where(groups.agg(F.count("*")).scalar() >= 2).orderBy(F.asc_nulls_last(F.expr("try_cast(group_key as int)")))
