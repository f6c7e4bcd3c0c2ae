"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents long, so plain MinHash banding would miss them. Items are partitioned by size (powers of two);
each partition keeps bottom-k MinHash sketches of one length k, n - ceil(t n) + 1 for the largest n of the partition. A document
that contains t of an item's n shingles must contain one of its k least hashes, so the search has full recall; every candidate is
then verified exactly on the whole text, on 64-bit shingle hashes. Items are taken in blocks of bounded size; a block is a stated query set that goes to
every document's task, so documents are never shuffled.

Defined cases: items without words match nothing; null or blank texts hold nothing; items shorter than the shingle size are
one shingle, and a document holds it only as its own whole sequence; items with equal text are reported each; a repeated
document row is reported once for each row; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import cut, small_batches
from corpusweave.llm.shingles import SHINGLE_WORDS, SIMILARITY_PERCENT, shingle_hashes, shingle_set

#: Shingles of one block of items at most (8 bytes each in a task), as long as no single item has more.
BLOCK_SHINGLES = 2_000_000
FOUND = "doc_id long, mark long, item_id long, n_shingles long, n_shared long"


def _item_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["item_id", "shingles", "n"])

    return run


class ItemIndex:
    """Items of one block: sketches under sorted keys, and whole sets."""

    def __init__(self, items: list[tuple[int, bytes]], percent: int):
        self.percent = percent
        self.ids = [i for i, _ in items]
        self.sets = [np.frombuffer(s, np.uint64) for _, s in items]
        largest: dict[int, int] = {}
        for s in self.sets:
            largest[len(s).bit_length()] = max(largest.get(len(s).bit_length(), 0), len(s))
        #: Sketch length by size partition.
        self.lengths = {c: n - -(-percent * n // 100) + 1 for c, n in largest.items()}
        keys, owners = [], []
        for k, s in enumerate(self.sets):
            own = s[: self.lengths[len(s).bit_length()]]
            keys.append(own)
            owners.append(np.full(len(own), k))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        #: A small bit map of key prefixes spares most look-ups.
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys >> np.uint64(44)] = True

    def search(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        h = hashes[self.bits[hashes >> np.uint64(44)]]
        lo, hi = np.searchsorted(self.keys, h), np.searchsorted(self.keys, h, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return []
        found = sorted({int(k) for i in hit for k in self.owners[lo[i] : hi[i]]})
        whole = np.unique(hashes)
        out = []
        for k in found:
            shared = int(np.isin(self.sets[k], whole, assume_unique=True).sum())
            if 100 * shared >= self.percent * len(self.sets[k]):
                out.append((self.ids[k], len(self.sets[k]), shared))
        return out


def _search(items, percent: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items.value, percent)
        for batch in batches:
            rows = [(doc, mark, *hit) for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)) for hit in index.search(shingle_hashes(text.as_py(), size))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) if rows else [[]] * 5)], ["doc_id", "mark", "item_id", "n_shingles", "n_shared"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row for each document and item of which the document holds percent of the distinct shingles."""
    return _found(docs, items, **options).drop("mark")


def _found(docs: DataFrame, items: DataFrame, *, size: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """contained_items() with mark, the hash of the document's text."""
    spark = docs.sparkSession
    small_batches(spark)
    sets = cut(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_item_sets(size), "item_id long, shingles binary, n long").where("n > 0"), "item-sets")
    total = sets.agg(F.sum("n")).first()[0]
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text)
    if not total:
        return spark.createDataFrame([], FOUND)
    blocks = -(-total // block_shingles)
    parts = []
    for k in range(blocks):  # each block is bounded; more items make more blocks
        block = sets if blocks == 1 else sets.where(F.pmod(F.xxhash64("shingles", "item_id"), F.lit(blocks)) == k)
        own = [(r["item_id"], bytes(r["shingles"])) for r in block.select("item_id", "shingles").collect()]
        if own:
            parts.append(texts.mapInArrow(_search(spark.sparkContext.broadcast(own), percent, size), FOUND))
    return reduce(DataFrame.union, parts)


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without those that hold a test item, all columns kept. Rows are told apart by doc_id (null too) and text."""
    found = _found(docs, items, **options).select(F.col("doc_id").alias("f_id"), F.col("mark").alias("f_mark")).distinct()
    given = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("f_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("f_mark"))
    return given.join(found, same, "left_anti").select("row.*")
