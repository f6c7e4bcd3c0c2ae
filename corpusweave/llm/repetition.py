"""Quality rules from suffix arrays: maximal repeated substrings of a text's words, their covered share and the longest one.

Words are `[^\\x20\\x09-\\x0D]+`, case kept. The texts of an Arrow batch become one sequence of word numbers, each text closed by
a mark of its own, so that no common prefix runs over a text's end. Prefix doubling sorts its suffixes: each round sorts only
the suffixes that still tie, by the ranks twice as far ahead; in prose few do after three words. The ranks of all rounds give the
longest common prefix of neighbours by binary lifting. An LCP interval (neighbours that share l words, bounded by smaller
values) is a repeated substring that cannot be extended to the right; it is maximal if the words before its suffixes differ.
The spans of all maximal repeats are united: a suffix's longest repeat is the deepest interval that holds it, and a repeat that
is not maximal lies inside one that is.

A text fails if it has less than MIN_TEXT words or more than half of its words in three-word windows that come twice (the base
rules), if repeats of MIN_REPEAT words or more cover over MAX_COVERED percent of its words, or if one of them is longer than
MAX_REPEAT words. Copies of a repeat may overlap ("a a a a" holds "a a a" twice).

Defined cases: null text has no words and fails; texts are taken whole, memory is linear in the longest one (about 4 bytes a word
and round, rounds grow with the logarithm of its longest repeat); repeated rows and null ids are rows of their own; extra
columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import small_batches

MIN_TEXT = 50
BASE_WINDOW = 3
MAX_WINDOW_PERCENT = 50
MIN_REPEAT = 8
MAX_REPEAT = 100
MAX_COVERED = 30
SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest long, n_maximal long, spans array<struct<start:long,end:long>>"


def suffix_array(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the ranks by the first 1, 2, 4, ... words. Every text in keys must end with a key of its own."""
    sa = np.argsort(keys, kind="stable").astype(np.int32)
    rank = np.empty(len(keys), np.int32)
    active = np.arange(len(keys), dtype=np.int32)
    tied = _rerank(keys[sa], active, sa, rank)
    levels, ahead = [rank], 1
    while len(active := active[tied]):
        own = sa[active]
        pair = (rank[own].astype(np.int64) << 32) | rank[own + ahead]
        by = np.argsort(pair, kind="stable")
        sa[active] = own[by]
        rank = rank.copy()
        tied = _rerank(pair[by], active, sa, rank)
        levels.append(rank)
        ahead *= 2
    return sa, levels


def _rerank(keys: np.ndarray, places: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Suffixes at these places of sa, sorted by keys, get the first place of their equals as rank; says which ones tie."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    rank[sa[places]] = places[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
    return ~(new & np.append(new[1:], True)) if len(keys) else new


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """lcp[i]: words that the suffixes at places i - 1 and i share; lcp[0] is 0."""
    lcp = np.zeros(len(sa), np.int64)
    at = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b, shared = sa[at - 1].astype(np.int64), sa[at].astype(np.int64), np.zeros(len(at), np.int64)
    for h in range(len(levels) - 1, -1, -1):
        shared += (levels[h][a + shared] == levels[h][b + shared]).astype(np.int64) << h
    lcp[at] = shared
    return lcp


def lcp_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, last place and words of every LCP interval of `least` words or more."""
    lefts, rights, sizes = [], [], []
    stack: list[tuple[int, int]] = []  # (words, first place), words rising
    before = -1
    for i in np.flatnonzero(lcp >= least).tolist():
        size, left = int(lcp[i]), i - 1
        if i != before + 1:
            for words, first in stack:
                lefts.append(first), rights.append(before), sizes.append(words)
            stack.clear()
        while stack and stack[-1][0] > size:
            words, left = stack.pop()
            lefts.append(left), rights.append(i - 1), sizes.append(words)
        if not stack or stack[-1][0] < size:
            stack.append((size, left))
        before = i
    for words, first in stack:
        lefts.append(first), rights.append(before), sizes.append(words)
    return np.array(lefts, np.int64), np.array(rights, np.int64), np.array(sizes, np.int64)


def _united(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the spans cover."""
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1))[:n] > 0


def repeats_of(texts: list[list[bytes]], least: int = MIN_REPEAT, window: int = BASE_WINDOW) -> dict[str, np.ndarray]:
    """For the words of some texts: words under repeated windows, words covered by repeats, longest repeat, number of maximal ones, spans."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    words = np.zeros(int(ends[-1]), np.int64)  # 0 closes a text
    for t, begin in zip(texts, begins.tolist()):
        words[begin : begin + len(t)] = [numbers.setdefault(w, len(numbers) + 1) for w in t]
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    sa, levels = suffix_array(owner * (len(numbers) + 1) + words)
    lcp = common_prefixes(sa, levels)
    longest = np.zeros(len(words), np.int64)
    longest[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    per_text = lambda flags: np.add.reduceat(flags.astype(np.int64), begins)
    twice = np.flatnonzero(longest >= window)
    covering = np.flatnonzero(longest >= least)
    covered = _united(covering, longest[covering], len(words))
    left, right, _ = lcp_intervals(lcp, least)
    first = np.isin(sa, begins)
    before = np.where(first, -1 - np.arange(len(sa)), words[np.maximum(sa - 1, 0)])
    changes = np.cumsum(np.append(0, before[1:] != before[:-1]))
    maximal = changes[right] > changes[left] if len(left) else np.zeros(0, bool)
    edges = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    of = owner[starts]
    return {
        "n_repeat_words": per_text(_united(twice, np.full(len(twice), window), len(words))), "n_covered": per_text(covered), "longest": np.maximum.reduceat(longest, begins),
        "n_maximal": np.bincount(owner[sa[left[maximal]]], minlength=len(texts)), "starts": starts - begins[of], "stops": stops - begins[of], "n_spans": np.bincount(of, minlength=len(texts)),
    }


def _measure(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = [t or b"" for t in batch.column(1).to_pylist()]
            texts = [t.split() for t in raw]
            counts = np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in raw])
            lines = [[x for x in t.split(b"\n") if x.strip()] if b"\n" in t else [] for t in raw]
            found = repeats_of(texts, least)
            chars = counts.sum(1) - counts[:, 128:192].sum(1) - counts[:, list(_BLANKS)].sum(1)
            spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(found["n_spans"])), pa.int32()), pa.StructArray.from_arrays([pa.array(found["starts"]), pa.array(found["stops"])], ["start", "end"]))
            columns = [[len(t) for t in texts], chars, counts[:, list(SYMBOLS)].sum(1), [len(x) - len(set(x)) for x in lines], *(found[k] for k in ("n_repeat_words", "n_covered", "longest", "n_maximal"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), spans], [f.split(" ")[0] for f in SCHEMA.split(", ")])

    return run


def repeated_spans(docs: DataFrame, least: int = MIN_REPEAT) -> DataFrame:
    """One row per row of docs: the counts of the base rules; n_covered, longest and n_maximal of repeats of `least` words or more
    (longest: of any length); spans of words they cover (end exclusive)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_measure(least), SCHEMA)


def quality_rules(docs: DataFrame, *, least: int = MIN_REPEAT, max_repeat: int = MAX_REPEAT, max_covered: int = MAX_COVERED) -> DataFrame:
    """repeated_spans() with base_failed and kept."""
    rows = repeated_spans(docs, least)
    failed = (F.col("n_words") < MIN_TEXT) | (100 * F.col("n_repeat_words") > MAX_WINDOW_PERCENT * F.col("n_words"))
    fine = (100 * F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest") <= max_repeat)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
