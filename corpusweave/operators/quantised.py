"""Approximate vector search by product quantisation over inverted lists, with exact re-ranking of a short list.

build() fits on a bounded sample (FIT_ROWS, drawn by a hash of the id): centroids of the lists, and for each of SUBSPACES parts of
the dimensions a codebook of up to CODEWORDS residuals. Every vector is indexed as its list and one byte a part. search() puts a
table of inner products (part, codeword) for each query beside its nearest lists; a vector's approximate cosine is a sum of
table cells. The `short` best of each query are then scored exactly. Queries travel in blocks, tasks keep the best of each batch,
and one ranking by query merges them.

Null, empty and all-zero vectors are not indexed; the dimension is that of the sample, vectors of another one are left out.
Recall is measured in tests: at least 0.9 of the ten nearest while a tenth of the vectors at most is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.vector import cosine
from corpusweave.scratch import cut

FIT_ROWS, SUBSPACES, CODEWORDS, ROUNDS = 20_000, 16, 256, 12
#: Queries that travel to the tasks at a time: each has SUBSPACES x CODEWORDS table cells of four bytes there.
QUERY_BLOCK = 1000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Euclidean distance; an empty one keeps its place."""
    c = x[np.random.default_rng(seed).permutation(len(x))[: max(1, min(k, len(x)))]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)


class Codes:
    """Centroids and codebooks; what encodes vectors and queries."""

    def __init__(self, x: np.ndarray, lists: int, subspaces: int, codewords: int):
        self.centroids = kmeans(x, lists, 5)
        residual = x - self.centroids[nearest(x, self.centroids)]
        self.parts = np.array_split(np.arange(x.shape[1]), min(subspaces, x.shape[1]))
        self.books = [kmeans(residual[:, p], codewords, 7 + i).astype(np.float32) for i, p in enumerate(self.parts)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = nearest(x, self.centroids)
        residual = x - self.centroids[lists]
        return lists, np.stack([nearest(residual[:, p], b) for p, b in zip(self.parts, self.books)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(query, part, codeword) inner products."""
        out = np.zeros((len(q), len(self.books), max(len(b) for b in self.books)), np.float32)
        for m, (p, b) in enumerate(zip(self.parts, self.books)):
            out[:, m, : len(b)] = q[:, p] @ b.T
        return out


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit vectors of those that can be indexed."""
    values = [(i, v) for i, v in enumerate(column.to_pylist()) if v is not None and len(v) == size and None not in v]
    at, x = np.array([i for i, _ in values], np.int64), np.array([v for _, v in values], float).reshape(-1, size)
    some = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[some], _unit(x[some])


class QuantisedLists:
    """An index: id, list and code of every vector, and what they mean."""

    def __init__(self, codes: Codes, vectors: DataFrame, rows: DataFrame):
        self.codes, self.vectors, self.rows = codes, vectors, rows

    @staticmethod
    def build(vectors: DataFrame, *, id_col: str = "id", vec: str = "embedding", fit_rows: int = FIT_ROWS, subspaces: int = SUBSPACES, codewords: int = CODEWORDS, lists: int | None = None) -> QuantisedLists:
        kept = vectors.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).where("size(v) > 0")
        drawn = kept.orderBy(F.xxhash64("id", F.lit("fit")), "id").limit(fit_rows).select("v").toArrow()["v"].combine_chunks()
        _, x = _matrix(drawn, len(drawn[0])) if len(drawn) else (None, np.zeros((1, 1)))
        codes = Codes(x, lists or max(1, round(len(x) ** 0.5 / 2)), subspaces, codewords)
        size = x.shape[1]
        held = vectors.sparkSession.sparkContext.broadcast(codes)  # bounded by the parameters, not by the rows

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = _matrix(batch.column(1), size)
                lists, code = held.value.encode(x) if len(at) else (np.zeros(0, np.int64), np.zeros((0, 1), np.uint8))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], ["id", "list", "code"])

        kind = kept.schema["id"].dataType.simpleString()
        return QuantisedLists(codes, kept, cut(kept.mapInArrow(encode, f"id {kind}, list int, code binary"), "quantised"))

    def short_lists(self, queries: DataFrame, short: int, probes: int | None = None, block: int = QUERY_BLOCK) -> DataFrame:
        """query_id, id and approximate score of the `short` best of each query in its `probes` nearest lists (all, if not given)."""
        spark = self.rows.sparkSession
        asked = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("v"))
        blocks = max(1, -(-queries.count() // block))
        kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {self.rows.schema['id'].dataType.simpleString()}, approx float"
        w = Window.partitionBy("query_id").orderBy(F.desc("approx"), "id")
        out = None
        for b in range(blocks):
            held = spark.sparkContext.broadcast((self.codes, self._plan(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow(), probes)))
            best = self.rows.mapInArrow(_scan(held, short), kinds).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= short).drop("_rn")
            if blocks > 1:
                best = cut(best, "short-list")
                held.unpersist()
            out = best if out is None else out.union(best)
        return out

    def _plan(self, asked: pa.Table, probes: int | None) -> tuple[pa.Array, np.ndarray, dict[int, np.ndarray]]:
        """Query ids, unit vectors, and for each list the queries that look into it."""
        at, q = _matrix(asked["v"].combine_chunks(), self.codes.centroids.shape[1])
        near = np.argsort(-(q @ self.codes.centroids.T), axis=1, kind="stable")[:, : probes or len(self.codes.centroids)]
        return asked["query_id"].combine_chunks().take(pa.array(at)), q, {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}

    def search(self, queries: DataFrame, k: int, *, short: int | None = None, probes: int | None = None) -> DataFrame:
        """query_id, id, score, rank (from 0) of the k best by exact cosine among the short list (5 k, if not given) of each query."""
        near = self.short_lists(queries, short or 5 * k, probes).select("query_id", "id")
        asked = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("q"))
        scored = near.join(self.vectors, "id").join(asked, "query_id").select("query_id", "id", cosine(F.col("v"), F.col("q")).alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "id")
        return scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).select("query_id", "id", "score", (F.col("_rn") - 1).cast("long").alias("rank"))


def _scan(held, short: int):
    """For each batch of (id, list, code) the best of each query; a task gives only what beats its `short` best so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, (names, q, probing) = held.value
        tables, heads = codes.tables(q), (q @ codes.centroids.T).astype(np.float32)
        least = np.full((len(q), short), -np.inf, np.float32)
        for batch in batches:
            lists = batch.column(1).to_numpy(zero_copy_only=False)
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(lists), -1)
            score = np.full((len(q), len(lists)), -np.inf, np.float32)
            for c in np.unique(lists):
                mine, rows = probing.get(int(c)), np.flatnonzero(lists == c)
                if mine is None:
                    continue
                total = np.repeat(heads[mine, c, None], len(rows), 1)
                for m in range(code.shape[1]):
                    total += tables[mine, m][:, code[rows, m]]
                score[np.ix_(mine, rows)] = total
            bound = np.maximum(least[:, 0], -3.0e38)  # the least of the best ones so far
            if len(lists) > short:
                bound = np.maximum(bound, np.partition(score, len(lists) - short, axis=1)[:, len(lists) - short])
            which, at = np.nonzero((score >= bound[:, None]) & (score > -np.inf))
            found = score[which, at]
            new = np.full((len(q), short), -np.inf, np.float32)
            order = np.lexsort((-found, which))
            place = np.arange(len(order)) - np.searchsorted(which[order], which[order])
            few = place < short
            new[which[order][few], place[few]] = found[order][few]
            least = np.sort(np.concatenate([least, new], 1), 1)[:, -short:]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(which)), batch.column(0).take(pa.array(at)), pa.array(found)], ["query_id", "id", "approx"])

    return run
