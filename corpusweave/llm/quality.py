"""Quality classifier from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Each heuristic votes low (1) or fine (0) on a document, or abstains (null); they overlap and err. All documents are voted on,
and counted by vote pattern: at most 3**len(HEURISTICS) patterns, whose counts alone reach the driver. EM of the
one-coin model (each labeller's votes are right at a rate of its own) gives the labellers' accuracies and each pattern's
posterior. Posteriors of a bounded sample (about SAMPLE_ROWS rows, drawn by a hash of id and text) train a logistic scorer over
hashed features: words, their endings and shapes, and densities, so that it also scores documents that no heuristic votes on.
The sample is dealt into BLOCKS blocks by the same hash; each is fitted in a task of its own, and the scorer's weights are the
blocks' mean, so that the driver sees vectors of weights only. Neither draw, blocks nor the order inside a block depend on how
the rows are partitioned, and so the scores don't.

Defined cases: null and blank texts get all votes that need no words, and the score of an empty feature vector; repeated rows
and null ids are scored each, and vote each, but rows equal in id and text are drawn once; extra columns are ignored; an empty table gives an empty result; if all documents look alike
(one class only), every score is that class's posterior.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import cut, forget, small_batches

#: Nine labellers. The first seven say "low" or abstain, the last two say "fine" or abstain.
HEURISTICS = ("capitals", "marked_words", "odd_characters", "bare_symbols", "table", "repeated_lines", "repeated_words", "prose", "steady")
SAMPLE_ROWS, BLOCKS = 20_000, 8
#: Hashed places: densities, word shapes, then words and their endings (the last three characters).
SHAPES, PLACES = 1 << 12, 1 << 16
DIM = SHAPES + 2 * PLACES
ENDING = 3
_CACHE = 200_000
_ODD = np.frombuffer(b"|#$%&*@~^_=<>{}[]\\!", np.uint8)
_SYMBOL_END = re.compile(r"[^\w\s.,;:!?'\")\]}»”’%-]{2,}$|!!+$|\?\?+$")

_DIGIT, _ALNUM, _RUNS = re.compile(r"\d"), re.compile(r"[^\W_]"), re.compile(r"\d+|[^\W\d_]+")
_ALPHA_SHAPES = [xxhash.xxh32_intdigest(shape) % (SHAPES - 64) + 64 for shape in "aA"]


def _shape_of(run: re.Match) -> str:
    found = run.group()
    return "9" if found[0].isdigit() else "A" if len(found) > 1 and found.isupper() else "a"


class Reader:
    """Votes and hashed features of a text, through a bounded cache of word shapes."""

    def __init__(self):
        self.cache: dict[str, int] = {}
        self.plain: dict[str, int] = {}

    def _bits(self, w: str) -> int:
        """Upper, symbol end, no letter or digit, digit."""
        if w.isalpha():
            return len(w) > 1 and w.isupper()
        return (len(w) > 1 and w.isupper()) | (_SYMBOL_END.search(w) is not None) << 1 | (_ALNUM.search(w) is None) << 2 | (_DIGIT.search(w) is not None) << 3

    def _word(self, w: str) -> int:
        """Bits 0-3 as above; then the features of the word's shape, of itself, of its ending."""
        out, plain = self._bits(w), w.lower()
        shape = _ALPHA_SHAPES[out] if w.isalpha() else xxhash.xxh32_intdigest(_RUNS.sub(_shape_of, w)) % (SHAPES - 64) + 64
        return out | shape << 4 | xxhash.xxh32_intdigest(plain) % PLACES << 16 | xxhash.xxh32_intdigest(plain[-ENDING:], 1) % PLACES << 32

    def _codes(self, words: list[str], cache: dict[str, int], code) -> np.ndarray:
        codes = list(map(cache.get, words))
        if None in codes:
            if len(cache) > _CACHE:
                cache.clear()
            for i, c in enumerate(codes):
                if c is None:
                    w = words[i]
                    codes[i] = c = code(w)
                    if len(w) <= 64:
                        cache[w] = c
        return np.array(codes, np.int64)

    def read(self, text: str, with_features: bool = True) -> tuple[list[int | None], tuple[np.ndarray, np.ndarray]]:
        """Votes, and the features' places and values (empty if not asked for)."""
        words = text.split()
        n, chars = len(words), len(text)
        codes = self._codes(words, self.cache, self._word) if with_features else self._codes(words, self.plain, self._bits)
        upper, ends, bare, digit = (int(np.count_nonzero(codes & (1 << k))) for k in range(4))
        seen = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        lines = [x for x in text.split("\n") if x.strip()]
        line_repeat = 1 - len(set(lines)) / len(lines) if lines else 0.0
        distinct = len(set(words)) / n if n else 1.0
        mean = (chars - n) / n if n else 0.0
        odd = float(seen[_ODD].sum()) / chars if chars else 0.0
        bars = int(seen[ord("|")])
        says = lambda vote, when: vote if when else None
        votes = [
            says(1, n and upper > 0.4 * n),
            says(1, n and ends > 0.25 * n),
            says(1, odd > 0.04),
            says(1, n and bare > 0.12 * n),
            says(1, n and bars > 0.1 * n),
            says(1, len(lines) > 1 and line_repeat > 0.4),
            says(1, n > 20 and distinct < 0.3),
            says(0, n and odd < 0.01 and ends + bare + digit < 0.1 * n and upper < 0.2 * n and mean <= 12 and (distinct > 0.3 or n <= 20)),
            says(0, odd < 0.02 and upper < 0.3 * n and distinct > 0.45 and line_repeat < 0.2),
        ]
        if not with_features:
            return votes, (np.empty(0, np.int32), np.empty(0))
        codes, counts = np.unique(codes, return_counts=True)
        places = [(codes >> 4) & (SHAPES - 1), ((codes >> 16) & (PLACES - 1)) + SHAPES, (codes >> 32) + (SHAPES + PLACES)]
        dense = np.array([upper, ends, bare, digit]) / max(n, 1)
        at = np.concatenate([[0, 1, 2, 3, 8, 9, 10, 11, 12], *places]).astype(np.int32)
        share = np.log1p(counts) / math.log1p(max(n, 1))  # of a distinct word; words of one shape or ending add up
        x = np.concatenate([dense, [1.0, math.log1p(n) / 10, line_repeat, 1 - distinct, min(mean, 30) / 10], share, share, share])
        return votes, (at, x)


def _spelled(votes: list[int | None]) -> str:
    return "".join("-" if v is None else str(int(bool(v))) for v in votes)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash if drawn, text) to votes, and of drawn rows the features."""
    reader = Reader()
    for batch in batches:
        votes, at, values = [], [], []
        for drawn, t in zip(batch.column(0), batch.column(1)):
            v, (a, x) = reader.read(t.as_py() or "", drawn.is_valid)
            votes.append(_spelled(v))
            at.append(a if drawn.is_valid else None)
            values.append(x.astype(np.float32) if drawn.is_valid else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["h", "votes", "at", "x"])


READ = "h long, votes string, at array<int>, x array<float>"


def em(patterns: list[str], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of "low" of each vote pattern, each labeller's accuracy (of its votes that are right), and the share of low.

    Abstaining says nothing. Accuracies start at 0.85 and are smoothed towards it by a hundredth of all rows; a labeller is
    never taken for worse than 0.6, which keeps the classes from changing places.
    """
    low = np.array([[c == "1" for c in p] for p in patterns], float)
    fine = np.array([[c == "0" for c in p] for p in patterns], float)
    right, prior, weight = np.full(len(patterns[0]), 0.85), 0.2, counts[:, None]
    smooth = 0.01 * counts.sum() + 1
    for _ in range(rounds):
        odds = np.log(right) - np.log1p(-right)
        z = (low - fine) @ odds + math.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        prior = float(np.clip((counts * post).sum() / counts.sum(), 0.01, 0.9))
        agreed = (weight * (low * post[:, None] + fine * (1 - post[:, None]))).sum(0)
        right = np.clip((agreed + 0.85 * smooth) / ((weight * (low + fine)).sum(0) + smooth), 0.6, 0.99)
    return post, right, prior


def _views(table: pa.Table, name: str) -> list[np.ndarray]:
    """The lists of a column without copies."""
    column = table.column(name).combine_chunks()
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def train_linear(at: list, x: list, y: np.ndarray, rounds: int = 80, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels: full-gradient AdaGrad over the sample."""
    rows = np.repeat(np.arange(len(at), dtype=np.int32), [len(a) for a in at])
    cols, vals = np.concatenate(at), np.concatenate(x)
    w, seen = np.zeros(DIM), np.full(DIM, 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, vals * w[cols], len(at)), -500, 500)))
        g = np.bincount(cols, vals * (p - y)[rows], DIM) / len(at) + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


class QualityModel:
    def __init__(self, weights: np.ndarray, posteriors: dict[str, float], rates: np.ndarray | None, prior: float):
        self.weights, self.posteriors, self.rates, self.prior = weights, posteriors, rates, prior


def _fit_block(posteriors: dict[str, float], prior: float):
    """Weights of one block of the sample, and its number of rows; rows equal in id and text count once."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        h = table.column("h").to_numpy()
        table = table.filter(pa.array(np.concatenate([[True], h[1:] != h[:-1]])))
        y = np.array([posteriors.get(v, prior) for v in table.column("votes").to_pylist()], float)
        weights = train_linear(_views(table, "at"), _views(table, "x"), y)
        return pa.table({"block": pa.array([int(h[0]) % BLOCKS], pa.int32()), "n": pa.array([len(y)], pa.int64()), "w": pa.array([weights.tobytes()], pa.binary())})

    return run


def fit(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Votes of all documents fit the label model; the sample fits the scorer. Reads the texts once."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    share = min(1.0, sample_rows / max(1, docs.count()))
    drawn = F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))
    read = cut(rows.select(F.when(drawn, F.col("h")).alias("h"), "text").mapInArrow(_read, READ), "quality-votes")
    found = read.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()  # at most 3 ** len(HEURISTICS) patterns
    if not found:
        return QualityModel(np.zeros(DIM), {}, None, 0.0)
    counts = np.array([r["n"] for r in found], float)
    post, rates, prior = em([r["votes"] for r in found], counts)
    posteriors = {r["votes"]: float(p) for r, p in zip(found, post)}
    # Equal rows leave before the shuffle as far as a task holds them, the others in their block.
    sample = read.where("h is not null").dropDuplicates(["h"]).withColumn("block", F.pmod("h", F.lit(BLOCKS)))
    blocks = sample.groupBy("block").applyInArrow(_fit_block(posteriors, prior), "block int, n long, w binary").toArrow().sort_by("block").to_pylist()  # BLOCKS rows at most
    forget(read)
    total = sum(b["n"] for b in blocks)
    weights = sum((np.frombuffer(b["w"]) * (b["n"] / total) for b in blocks), np.zeros(DIM))
    return QualityModel(weights, posteriors, rates, prior)


def quality_scores(docs: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """doc_id, score (of fine quality, 0 to 1), keep (1 if score >= 0.5), votes and weak_label (posterior of "fine")."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.posteriors, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, posteriors, prior = shared.value
        reader = Reader()
        for batch in batches:
            votes, z = [], []
            for t in batch.column(1):
                said, (at, x) = reader.read(t.as_py() or "")
                votes.append(_spelled(said))
                z.append(float(w[at] @ x))
            score = 1 / (1 + np.exp(np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(votes, pa.string()), pa.array([1 - posteriors.get(v, prior) for v in votes], pa.float64())], ["doc_id", "score", "votes", "weak_label"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, votes string, weak_label double")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("keep"), "votes", "weak_label")
