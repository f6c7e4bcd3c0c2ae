"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities and counts of learned lexicons (whole words, and stems for inflected ones), second-person words near
lexicon words, capitals, punctuation, obfuscation (masked, digit-for-letter and stretched words). Lexicons, trees and
calibration are learned from labelled rows outside the held-out fold (crc32 of the id, mod 5 = 0): a sample of about
TRAIN_ROWS of them, drawn by hash of the id. They are cross-fitted in two halves at every size: a row's features come from the
lexicon of the other half and its score for the calibration from the trees of the other half, so that nothing is fitted to what
it has learned by heart; the final lexicon and trees are those of both halves. A lexicon holds LEXICON_WORDS terms at most.

Defined cases: null and empty texts are scored (all features 0); several labels of one doc_id count once, toxic if any is;
null labels and labels without a document are ignored; with no usable labels, or of one class only, every score is that
class's rate (0 without labels); repeated rows and null ids are scored each (null ids are not held out); extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from corpusweave.llm.common import cut, forget, small_batches

TRAIN_ROWS = 20_000
FOLDS = 5
STEM = 5
LEXICON_WORDS = 2_000
#: Toxic documents of a half that a term of its lexicon is in, at least.
LEAST_DOCUMENTS = 3
_CACHE = 200_000
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split())
_LOOKS = str.maketrans("01345@$!7", "oieasasit")
_MASK = re.compile(r"[^\W\d_][*#@$%0-9]+[^\W\d_]|[*#@$%]{2,}")
_STRETCH = re.compile(r"(.)\1\1")
_EDGE = ".,;:!?\"'()[]{}<>«»“”„…-_*#"
N_FEATURES = 18


def fold(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS))


def plain(word: str) -> str:
    return word.lower().strip(_EDGE)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a word or a stem, by class and half, counted within the task first."""
    counts = {(c, h): Counter() for c in (0, 1) for h in (0, 1)}
    for batch in batches:
        for toxic, half, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words = {plain(w) for w in (text.as_py() or "").split()}
            terms = {"w:" + w for w in words if w} | {"s:" + w[:STEM] for w in words if len(w) > STEM}
            counts[toxic, half].update(terms)
        if sum(map(len, counts.values())) > 150_000:
            yield _terms(counts)
            counts = {k: Counter() for k in counts}
    yield _terms(counts)


def _terms(counts) -> pa.RecordBatch:
    terms = list(set().union(*counts.values()))
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([counts[k][t] for t in terms], pa.int64()) for k in counts]], ["term", *[f"{c}{h}" for c, h in counts]])


def count_terms(train: DataFrame) -> DataFrame:
    """Documents that hold a term, by class and half: term, 00, 01 (not toxic), 10, 11 (toxic)."""
    names = [f"{c}{h}" for c in (0, 1) for h in (0, 1)]
    rows = train.select("toxic", "half", "text").mapInArrow(_term_counts, "term string, " + ", ".join(f"`{n}` long" for n in names))
    return rows.groupBy("term").agg(*[F.sum(n).alias(n) for n in names])


def learn_lexicon(counts: DataFrame, n: dict[tuple[int, int], int], halves: tuple[int, ...]) -> list[str]:
    """Terms ("w:" words, "s:" stems) that are far likelier in toxic documents of these halves; at most LEXICON_WORDS of them."""
    pos, neg = (sum((F.col(f"{c}{h}") for h in halves), F.lit(0)) for c in (1, 0))
    n_pos, n_neg = (sum(n.get((c, h), 0) for h in halves) for c in (1, 0))
    ratio = ((F.col("pos") + 0.5) / (n_pos + 1)) / ((F.col("neg") + 0.5) / (n_neg + 1))
    found = counts.select("term", pos.alias("pos"), neg.alias("neg")).where(F.col("pos") >= LEAST_DOCUMENTS * len(halves)).withColumn("ratio", ratio).where("ratio >= 8")
    return [r["term"] for r in found.orderBy(F.desc(F.col("pos") * F.log("ratio")), "term").limit(LEXICON_WORDS).collect()]


class Features:
    def __init__(self, terms: list[str]):
        self.words = frozenset(t[2:] for t in terms if t[0] == "w")
        self.stems = frozenset(t[2:] for t in terms if t[0] == "s")
        self.cache: dict[str, int] = {}

    def code(self, word: str) -> int:
        """One bit for each kind of word."""
        w = plain(word)
        seen = w.translate(_LOOKS)
        seen = re.sub(r"(.)\1\1+", r"\1", seen) if _STRETCH.search(seen) else seen
        hidden = seen != w and (seen in self.words or seen.replace("*", "") in self.words)
        code = (w in self.words) | (len(w) > STEM and w[:STEM] in self.stems) << 1 | hidden << 2 | (w in SECOND_PERSON) << 3
        code |= (len(word) > 2 and word.isupper()) << 4 | bool(_MASK.search(word)) << 5 | bool(_STRETCH.search(w)) << 6
        if len(self.cache) > _CACHE:
            self.cache.clear()
        if len(word) <= 64:
            self.cache[word] = code
        return code

    def vector(self, text: str) -> list[float]:
        words = text.split()
        if not words:
            return [0.0] * N_FEATURES
        get = self.cache.get
        codes = list(map(get, words))
        if None in codes:
            codes = [c if c is not None else self.code(w) for c, w in zip(codes, words)]
        c = np.array(codes, np.uint8)
        n, chars = len(words), len(text)
        bits = [int(np.count_nonzero(c & (1 << b))) for b in range(7)]
        hits, you = np.flatnonzero(c & 7), np.flatnonzero(c & 8)
        near = 0
        if len(hits) and len(you):
            at = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(hits - you[np.minimum(at, len(you) - 1)]), np.abs(hits - you[np.maximum(at - 1, 0)]))
            near = int((gap <= 5).sum())
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        seen = np.bincount(raw, minlength=256)
        caps, marks = int(seen[65:91].sum()), int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum())
        return [
            math.log1p(n), bits[0] / n, math.log1p(bits[0]), bits[1] / n, math.log1p(bits[1]), bits[2] / n, math.log1p(bits[2]), len(hits) / n, math.log1p(len(hits)),
            bits[3] / n, near / n, bits[4] / n, bits[5] / n, bits[6] / n, caps / chars, marks / chars, int(seen[33]) / chars, int(seen[48:58].sum()) / chars,
        ]


def features(rows: DataFrame, terms: list[str], keep: list[str], text: str = "text") -> DataFrame:
    """The columns of keep, and x: the features of the text, a string column or a field ("row.text") of a kept struct."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(terms)
    inside = text.split(".", 1)[1] if "." in text else None
    given = rows.select(*keep) if inside else rows.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = StructType([*given.select(*keep).schema, StructField("x", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(shared.value)
        for batch in batches:
            texts = pc.struct_field(batch.column(0), inside) if inside else batch.column(len(keep))
            x = pa.array([made.vector(t.as_py() or "") for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], x], [*keep, "x"])

    return given.mapInArrow(run, schema)


class ToxicityModel:
    """terms, trees and calibration; without trees, a constant rate."""

    def __init__(self, terms: list[str], trees=None, calibration=None, rate: float = 0.0):
        self.terms, self.trees, self.calibration, self.rate = terms, trees, calibration, rate

    def scored(self, rows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        if self.trees is None:
            return rows.select(*keep).withColumn("score", F.lit(float(self.rate)))
        x = features(rows, self.terms, keep, text)
        raw = _raw(self.trees, x)
        return self.calibration.transform(raw).select(*keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))


def _raw(trees, x: DataFrame) -> DataFrame:
    out = trees.transform(x.withColumn("features", array_to_vector("x")))
    return out.withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))


def fit(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learns from labelled documents outside the held-out fold."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    known = known.where(fold() != 0)
    total = known.count()
    if not total:
        return ToxicityModel([])
    share = min(1.0, train_rows / total)
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # drawn has about train_rows short rows whatever the input's size
    train = cut(texts.join(F.broadcast(drawn), "doc_id").withColumn("half", F.when(fold() <= 2, 0).otherwise(1)), "toxic-train")
    n = {(r["toxic"], r["half"]): r["n"] for r in train.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    pos = sum(m for (toxic, _), m in n.items() if toxic)
    if not pos or pos == sum(n.values()):
        return ToxicityModel([], rate=float(pos > 0))
    counts = cut(count_terms(train), "toxic-terms")
    lexicons = [learn_lexicon(counts, n, (h,)) for h in (0, 1)]
    terms = learn_lexicon(counts, n, (0, 1))
    x = cut(features(train.where("half = 0"), lexicons[1], ["toxic", "half"]).unionByName(features(train.where("half = 1"), lexicons[0], ["toxic", "half"])), "toxic-x", parts=4)
    forget(train)
    forget(counts)
    rows = x.withColumn("features", array_to_vector("x"))
    both = [_grow(rows.where(f"half = {h}"), n.get((1, h), 0), n.get((0, h), 0)) for h in (0, 1)]
    checked = [_raw(both[1 - h], x.where(f"half = {h}")).select("p", F.col("toxic").cast("double")) for h in (0, 1) if both[1 - h] is not None]
    trees = _grow(rows, pos, sum(n.values()) - pos)
    # with toxic rows in one half only, nothing can be cross-fitted
    checked = checked[0].union(checked[1]) if len(checked) == 2 else _raw(trees, x).select("p", F.col("toxic").cast("double"))
    calibration = IsotonicRegression(labelCol="toxic", featuresCol="p", predictionCol="score").fit(checked)
    forget(x)
    return ToxicityModel(terms, trees, calibration)


def _grow(rows: DataFrame, pos: int, neg: int):
    """Boosted trees, or None with one class only."""
    return GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=10, maxDepth=3, stepSize=0.3, maxBins=64, seed=11, minInstancesPerNode=3).fit(rows) if pos and neg else None


def toxicity_scores(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = model or fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    out = model.scored(rows, ["doc_id"])
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """docs whose score is under the threshold, all columns kept."""
    model = fit(train_docs if train_docs is not None else docs, labels)
    rows = docs.withColumn("text", F.col("text").cast("string")).select(F.struct("*").alias("row"))
    return model.scored(rows, ["row"], "row.text").where(F.col("score") < threshold).select("row.*")
