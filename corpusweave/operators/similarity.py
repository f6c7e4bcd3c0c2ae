"""Joins of names by trigram similarity, exact, in cells.

Each mention can be like each name, and common trigrams meet nearly all pairs, so no rows of pairs are made. Mentions and names
are dealt into groups by a hash; a cell is a group of mentions and one of names, about GROUP_CHARS characters each at most, and one
task's work. It counts the trigrams that a mention shares with all names of its cell in one vector and returns only what passes. Each
name goes to as many cells as there are groups of mentions, each mention to as many as there are groups of names: LEAST_GROUPS up
to LEAST_GROUPS x GROUP_CHARS characters of names, more beyond that.

candidate_pairs() is the same join by prefixes in rows. Trigrams have one order for all names there: rarest in the catalog first, ties by the
trigram. Two sets of sizes a and b with intersection over union of t or more share at least t / (1 + t) x (a + b) trigrams, so their
first common one stands among the first a - ceil(t a) + 1 of the one and b - ceil(t b) + 1 of the other. Only these meet; sizes that
cannot agree and positions behind which too few trigrams are left are dropped in the join.

Defined cases: null names are left out; names without a trigram are like none; repeated names count once.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions import text as T
from corpusweave.scratch import cut

#: Against rounding in bounds: a pair at the threshold is never lost; what is let in is verified.
SLACK = 1e-9
#: Characters of names, and of mentions, in a cell.
GROUP_CHARS = 1 << 20
#: Groups of names at least, so that small catalogs keep many tasks busy.
LEAST_GROUPS = 32
#: Places that are looked at in one vector.
VECTOR = 1 << 20


def _sets(names: DataFrame, column: str) -> DataFrame:
    return names.select(F.col(column).alias("name")).where("name is not null").distinct().withColumn("grams", T.trigrams(F.col("name")))


def _frequencies(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("freq"))


def _ordered(sets: DataFrame, freq: DataFrame) -> DataFrame:
    """name, size, and its trigrams rarest first."""
    rows = sets.select("name", F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(freq, "gram", "left")
    return rows.groupBy("name", "size").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("f"), "gram"))), lambda g: g["gram"]).alias("ordered"))


def _first(size: Column, least: float) -> Column:
    """How many of a set's first trigrams can hold the first one it shares."""
    return F.greatest(F.lit(1), F.least(size, size - F.ceil(least * size - SLACK) + 1)).cast("int")


def candidate_pairs(mentions: DataFrame, catalog: DataFrame, *, mention: str = "mention", name: str = "name", least: float = 0.45) -> DataFrame:
    """Rows (mention, name) that meet in their prefixes and pass the size and position filters; a pair may come more than once."""
    left, right = _sets(mentions, mention), _sets(catalog, name)
    freq = _frequencies(right)
    side = lambda sets, c: _ordered(sets, freq).select(F.col("name").alias(c), F.col("size").alias(f"{c}_size"), F.posexplode(F.slice("ordered", F.lit(1), _first(F.col("size"), least))).alias(f"{c}_pos", "gram"))
    a, b = F.col("m_size"), F.col("n_size")
    left_over = F.least(a - F.col("m_pos"), b - F.col("n_pos"))  # this trigram and those behind it, if it is the first shared one
    fits = (a >= least * b - SLACK) & (b >= least * a - SLACK) & (left_over >= least / (1 + least) * (a + b) - SLACK)
    return side(left, "m").join(side(right, "n"), "gram").where(fits).select(F.col("m").alias(mention), F.col("n").alias(name))


def _groups(rows: DataFrame, column: str, least: int) -> int:
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(column)), F.lit(0)).alias("chars")).first()
    return max(1, min(least, found["n"]), -(-found["chars"] // GROUP_CHARS))


def _in_cells(asked: DataFrame, held: DataFrame, grams, of_cell, schema: str) -> DataFrame:
    """What of_cell makes of each cell of asked (q and more) and held (text and more); grams(text) is added as grams behind the shuffle.

    Shuffled by a number of partitions, small tables are not joined to a few tasks: a cell's work is not told by its size.
    """
    asked, held = cut(asked, "asked"), cut(held, "held")
    across, down = _groups(held, "text", LEAST_GROUPS), _groups(asked, "q", 1)
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = asked.withColumn("_other", each(across)).withColumn("cell", of("q", down) * across + F.col("_other"))
    met = held.withColumn("_other", each(down)).withColumn("cell", F.col("_other") * across + of("text", across))
    side = lambda rows: rows.drop("_other").repartition(across * down, "cell")
    dealt, met = side(dealt).withColumn("grams", T.trigrams(F.col("q"))), side(met).withColumn("grams", grams(F.col("text")))
    return dealt.groupBy("cell").cogroup(met.groupBy("cell")).applyInArrow(of_cell, schema)


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and where each list begins and the last one ends."""
    lists = column.combine_chunks()
    return lists.flatten(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)


class _Postings:
    """The texts of a cell by their trigrams."""

    def __init__(self, grams: pa.ChunkedArray):
        values, self.begin = _lists(grams)
        named = values.dictionary_encode()
        self.known, self.codes, self.n = named.dictionary, named.indices.to_numpy().astype(np.int64), len(self.begin) - 1
        held = np.unique(self.codes * max(self.n, 1) + np.repeat(np.arange(self.n), np.diff(self.begin)))
        self.text, self.at = held % max(self.n, 1), np.searchsorted(held, np.arange(len(self.known) + 1) * max(self.n, 1))
        self.sizes = np.bincount(self.text, minlength=self.n)

    def asked(self, grams: pa.ChunkedArray):
        """For each list of distinct trigrams its length and the codes of those that a text has."""
        values, begin = _lists(grams)
        codes = pc.fill_null(pc.index_in(values, value_set=self.known), -1).to_numpy().astype(np.int64)
        for i, j in zip(begin[:-1], begin[1:]):
            own = codes[i:j]
            yield j - i, own[own >= 0]

    def shared(self, codes: np.ndarray) -> np.ndarray:
        """How many of the codes each text has."""
        parts = [self.text[self.at[c] : self.at[c + 1]] for c in codes]
        return np.bincount(np.concatenate(parts), minlength=self.n) if parts else np.zeros(self.n, np.int64)


def _joined(parts: list[np.ndarray], kind: type) -> pa.Array:
    return pa.array(np.concatenate([np.empty(0, kind), *parts]).astype(kind))


def _similar_of_cell(asked: pa.Table, held: pa.Table, *, least: float) -> pa.Table:
    index, who, what, how = _Postings(held["grams"]), [], [], []
    for q, (size, codes) in enumerate(index.asked(asked["grams"])):
        both = index.shared(codes)
        found = np.flatnonzero(both)
        share = both[found] / (size + index.sizes[found] - both[found])
        kept = share >= least
        who.append(np.full(int(kept.sum()), q))
        what.append(found[kept])
        how.append(share[kept])
    return pa.table({"q": asked["q"].take(_joined(who, np.int64)), "text": held["text"].take(_joined(what, np.int64)), "similarity": _joined(how, np.float64)})


def similar_pairs(mentions: DataFrame, catalog: DataFrame, *, mention: str = "mention", name: str = "name", least: float = 0.45) -> DataFrame:
    """All pairs (mention, name, similarity) with a trigram in common and a similarity of `least` or more."""
    side = lambda names, column, c: names.select(F.col(column).alias(c)).where(F.col(c).isNotNull()).distinct()
    found = _in_cells(side(mentions, mention, "q"), side(catalog, name, "text"), T.trigrams, partial(_similar_of_cell, least=least), "q string, text string, similarity double")
    return found.select(F.col("q").alias(mention), F.col("text").alias(name), "similarity")


def best_names(mentions: DataFrame, catalog: DataFrame, *, mention: str = "mention", name: str = "name", least: float = 0.45) -> DataFrame:
    """The catalog name most like each mention: mention, name, similarity; ties go to the lesser name."""
    w = Window.partitionBy(mention).orderBy(F.desc("similarity"), name)
    return similar_pairs(mentions, catalog, mention=mention, name=name, least=least).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _best_extents(have: np.ndarray, begin: np.ndarray, earlier: np.ndarray, texts: np.ndarray, wanted: np.ndarray, n: int) -> np.ndarray:
    """For each of texts the greatest share of trigrams in common between a set of n, marked in wanted by code, and a stretch of the text.

    have: codes of all texts in order, text t from begin[t] on; earlier: place of the same trigram before each place of its text, or -1. A
    best stretch begins and ends with a wanted trigram; from each place that has one, running sums count the distinct wanted (c) and
    other (d) trigrams up to each place: share c / (n + d).
    """
    best, sizes = np.zeros(len(texts)), begin[texts + 1] - begin[texts]
    place = np.arange(sizes.max(initial=0))
    inside = place < sizes[:, None]
    at = np.where(inside, begin[texts][:, None] + place, 0)
    hit, before = wanted[have[at]] & inside, np.where(inside, earlier[at], len(place))  # nothing is new behind a text's end
    text, start = np.nonzero(hit)
    step = max(1, VECTOR // max(1, len(place)))
    for i in range(0, len(text), step):
        t, s = text[i : i + step], start[i : i + step, None]
        new, hits = (before[t] < s) & (place >= s), hit[t]
        c, d = np.cumsum(new & hits, axis=1, dtype=np.int32), np.cumsum(new & ~hits, axis=1, dtype=np.int32)
        row, end = np.nonzero(hits & (place >= s))
        np.maximum.at(best, t[row], c[row, end] / (n + d[row, end]))
    return best


def _place_before(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each place of each list the last place of that list before it with the same code, or -1."""
    place = np.arange(len(codes)) - np.repeat(begin[:-1], np.diff(begin))
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((place, codes, owner))
    same = (codes[order][1:] == codes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    before = np.full(len(codes), -1)
    before[order[1:][same]] = place[order[:-1][same]]
    return before


def _words_of_cell(asked: pa.Table, held: pa.Table, *, k: int, least: float) -> pa.Table:
    """q, id, score of the k best rows of the cell for each query; ids: the k least ids of a text.

    The score is at most the share of the query's trigrams that the text has at all. Texts are scored from the greatest of these on, until
    k rows are better than all that can follow.
    """
    index, (ids, first) = _Postings(held["grams"]), _lists(held["ids"])
    earlier, lengths, copies = _place_before(index.codes, index.begin), np.diff(index.begin), np.diff(first)
    order = np.empty(len(ids), np.int64)  # ids are numbered in their order, so that ties go by number
    order[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    wanted, who, what, how = np.zeros(len(index.known), bool), [], [], []
    for q, (size, codes) in enumerate(index.asked(asked["grams"])):
        both = index.shared(codes)
        near = np.flatnonzero((both > 0) & (both >= least * size - SLACK))
        near = near[np.lexsort((lengths[near], -both[near]))]
        wanted[codes] = True
        scores, done, step = np.empty(0), 0, 64
        while done < len(near):
            rows = np.repeat(scores, copies[near[:done]])
            if len(rows) >= k and np.partition(rows, len(rows) - k)[len(rows) - k] > both[near[done]] / size:
                break
            some = near[done : done + step]
            some = some[: max(1, int(np.searchsorted(np.maximum.accumulate(lengths[some]) * np.arange(1, len(some) + 1), VECTOR, "right")))]
            scores = np.append(scores, _best_extents(index.codes, index.begin, earlier, some, wanted, size))
            done, step = done + len(some), step * 2
        wanted[codes] = False
        near, kept = near[:done], scores >= least
        near, scores = near[kept], np.repeat(scores[kept], copies[near[kept]])
        rows = np.repeat(first[near] - np.append(0, np.cumsum(copies[near])[:-1])[: len(near)], copies[near]) + np.arange(len(scores))
        best = np.lexsort((order[rows], -scores))[:k]
        who.append(np.full(len(best), q))
        what.append(rows[best])
        how.append(scores[best])
    return pa.table({"q": asked["q"].take(_joined(who, np.int64)), "id": ids.take(_joined(what, np.int64)), "score": _joined(how, np.float64)})


def ordered_trigrams(c: Column) -> Column:
    """Trigrams of lower-case words in order, repeats included, each word padded with two blanks before and one behind."""
    return F.flatten(F.transform(T.tokens(c), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))


def word_similar(queries: DataFrame, texts: DataFrame, k: int, *, least: float = 0.6, query: str = "query_text", text: str = "text", query_id: str = "query_id", id_col: str = "id") -> DataFrame:
    """query_id, id, score, rank of the k texts with the best extent for each query, of those with a score of `least` or more.

    Distinct texts are indexed and scored once. Meant for names, titles and lines: a pair that is scored costs its hits times the text's
    length. query_id and id must be keys.
    """
    keyed = texts.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text is not null")
    # Equal texts have equal scores: the k best ids are among the k least ids of each text.
    few = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy("text").orderBy("id"))).where(F.col("_rn") <= k)
    held = few.groupBy("text").agg(F.transform(F.collect_list(F.struct("id")), lambda x: x["id"]).alias("ids"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query).alias("q")).where("q is not null")
    schema = f"q string, id {keyed.schema['id'].dataType.simpleString()}, score double"
    best = asked.join(_in_cells(asked.select("q").distinct(), held, ordered_trigrams, partial(_words_of_cell, k=k, least=least), schema), "q")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).select("query_id", "id", "score", (F.col("_rn") - 1).cast("long").alias("rank"))
