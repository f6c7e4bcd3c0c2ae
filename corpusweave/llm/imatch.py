"""Document fingerprints: I-Match over randomised lexicon subsets.

Terms are kept whose inverse document frequency lies in a band: ln(N / df) between IDF_LOW and IDF_HIGH. A term of the band is
in a fixed share of all documents, so the lexicon's size is bounded by (mean distinct terms of a document) * e**IDF_HIGH,
however many documents there are; only this lexicon is broadcast. Each of the random subsets draws its own part of the
lexicon; a document's distinct terms of the subset are sorted and hashed. Subsets come in several sampling rates, so that
short and long documents both have subsets that hold a few of their terms.

Likeness of two fingerprints: of the subsets in which either document has terms, the share whose hashes are equal. A document
without any term in the band is fingerprinted over all its terms; equal texts have equal fingerprints always.

Defined cases: null and blank texts have the empty fingerprint (like each other wholly, like others not at all); ids that
repeat are ordered by their texts' hashes; a single document follows itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import cut, n_parts, small_batches
from corpusweave.llm.shingles import words_of

IDF_LOW = 2.5
IDF_HIGH = 9.0
#: Sampling rates 2**-r of the lexicon subsets, and how many subsets have each.
RATES = {0: 1, 2: 1, 4: 5, 5: 5, 6: 6, 7: 6, 8: 6, 9: 6, 10: 6, 11: 6}
_CACHE = 300_000
FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of term hashes, summed within the task before the shuffle."""
    held: list[np.ndarray] = []
    total = 0

    def flush() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["term", "df"])

    for batch in batches:
        for text in batch.column(0):
            own = np.fromiter((term_hash(w) for w in set(words_of(text.as_py()))), np.uint64)
            held.append(own)
            total += len(own)
        if total > 2_000_000:
            yield flush()
            held, total = [], 0
    if held:
        yield flush()


_hashes: dict[bytes, int] = {}


def term_hash(word: bytes) -> int:
    h = _hashes.get(word)
    if h is None:
        if len(_hashes) > _CACHE:
            _hashes.clear()
        h = _hashes[word] = xxhash.xxh3_64_intdigest(word)
    return h


def lexicon(docs: DataFrame, low: float = IDF_LOW, high: float = IDF_HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band, from the counts over all documents."""
    n = docs.count()
    if not n:
        return np.empty(0, np.uint64)
    counts = docs.select(F.col("text").cast("string")).mapInArrow(_terms, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    found = counts.where(F.log(F.lit(float(n)) / F.col("df")).between(low, high)).select("term").toPandas()
    return np.sort(found["term"].to_numpy(np.int64).view(np.uint64))


class Fingerprinter:
    def __init__(self, terms: np.ndarray, rates: dict[int, int] = RATES):
        self.terms = terms
        self.rates = [r for r, n in rates.items() for _ in range(n)]
        self.masks = np.array([(1 << r) - 1 for r in self.rates], np.uint64)
        self.last: tuple[str, list[str]] = ("", [""] * len(self.rates))
        self.odd = np.array([int.from_bytes(hashlib.blake2b(b"subset%d" % i, digest_size=8).digest(), "little") | 1 for i in range(len(self.rates))], np.uint64)

    def hashes(self, text: str) -> list[str]:
        """One hash for each subset, empty where the document has no term of it. The last text's hashes are kept."""
        if text != self.last[0]:
            self.last = (text, self._hashes(text))
        return self.last[1]

    def _hashes(self, text: str) -> list[str]:
        words = set(words_of(text))
        if not words:
            return [""] * len(self.rates)
        own = np.sort(np.fromiter((term_hash(w) for w in words), np.uint64))
        if len(self.terms):
            at = np.searchsorted(self.terms, own)
            at[at == len(self.terms)] = 0
            banded = own[self.terms[at] == own]
            own = banded if len(banded) else own
        # one column for each subset: whether it draws the term
        drawn = ((own[:, None] * self.odd[None, :]) >> np.uint64(40)) & self.masks[None, :] == 0
        any_drawn = drawn.any(0).tolist()
        return [f"{xxhash.xxh3_64_intdigest(own[drawn[:, i]].tobytes(), seed=i) & 0xFFFFFFFF:08x}" if some else "" for i, some in enumerate(any_drawn)]


def likeness(a: list[str], b: list[str]) -> float:
    either = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in either) / len(either) if either else 1.0


def _compare(prints: Fingerprinter, doc: int | None, text: str, follower: str) -> list:
    half = len(text) // 2
    edited = (text[: len(text) - half] if half else text) + follower[:half]
    own, changed, after = prints.hashes(text), prints.hashes(edited), prints.hashes(follower)
    return [doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), ",".join(own), ",".join(changed), likeness(own, changed), likeness(own, after)]


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def _table(rows: list[list]) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(_KINDS), _KINDS)]


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts go through the shuffle compressed by themselves, which takes about half of what the shuffle's own codec leaves."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in texts], pa.int64()), pa.array(map(pack, texts), pa.binary())], ["doc_id", "h", "packed"])


def _neighbours(terms):
    """Rows in falling doc_id order: compares each with the next one; the first and the last text of a partition go out raw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprinter(terms.value)
        part, last, first = TaskContext.get().partitionId(), None, True
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, edge = [], []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(2)):
                text = unpack(t.as_py()).decode("utf-8", "surrogatepass")
                if first:
                    edge.append(("head", doc, text))
                    first = False
                else:
                    rows.append(_compare(prints, *last, text))
                last = (doc, text)
            yield _edged(rows, edge, part)
        if last:
            yield _edged([], [("tail", *last)], part)

    return run


def _edged(rows: list[list], edge: list[tuple], part: int) -> pa.RecordBatch:
    kinds = [None] * len(rows) + [e[0] for e in edge]
    rows = rows + [[e[1], None, None, None, None, None, None] for e in edge]
    texts = [None] * (len(rows) - len(edge)) + [e[2] for e in edge]
    return pa.RecordBatch.from_arrays([*_table(rows), pa.array(kinds, pa.string()), pa.array([part] * len(rows), pa.int32()), pa.array(texts, pa.string())], [*_NAMES, "edge", "part", "edge_text"])


def fingerprints(docs: DataFrame, *, low: float = IDF_LOW, high: float = IDF_HIGH) -> DataFrame:
    """Per document: its fingerprint, that of the text with its last half replaced by the next document's begin, and likenesses."""
    spark = docs.sparkSession
    small_batches(spark)
    terms = spark.sparkContext.broadcast(lexicon(docs, low, high))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    ordered = rows.mapInArrow(_compressed, "doc_id long, h long, packed binary").repartitionByRange(n_parts(spark), order[0]).sortWithinPartitions(*order)
    made = cut(ordered.mapInArrow(_neighbours(terms), f"{FIELDS}, edge string, part int, edge_text string"), "imatch")
    # The last document of a partition is followed by the first of the next one that has any; the numbers of these are few.
    used = sorted(r["part"] for r in made.where("edge = 'head'").select("part").collect())
    follows = spark.createDataFrame([(p, used[(i + 1) % len(used)]) for i, p in enumerate(used)], "part int, next int")
    tails = made.where("edge = 'tail'").select("doc_id", "edge_text", "part").join(F.broadcast(follows), "part")
    heads = made.where("edge = 'head'").select(F.col("part").alias("next"), F.col("edge_text").alias("follower"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprinter(terms.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_table([_compare(prints, r["doc_id"], r["edge_text"], r["follower"]) for r in batch.to_pylist()]), _NAMES)

    closed = tails.join(heads, "next").select("doc_id", "edge_text", "follower").mapInArrow(close, FIELDS)
    return made.where("edge is null").select(*_NAMES).union(closed)
