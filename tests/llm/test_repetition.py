import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusweave.llm import repetition


def _plain(words, least):
    """(words under three-word windows that come twice, covered by repeats of `least` or more, longest repeat, maximal repeats)."""
    n = len(words)
    longest, maximal = 0, 0
    covered = {}
    for size in range(1, n):
        seen = Counter(tuple(words[i : i + size]) for i in range(n - size + 1))
        twice = {w for w, c in seen.items() if c > 1}
        if not twice:
            break
        longest = size
        covered[size] = {j for i in range(n - size + 1) if tuple(words[i : i + size]) in twice for j in range(i, i + size)}
        if size >= least:
            for w in twice:
                at = [i for i in range(n - size + 1) if tuple(words[i : i + size]) == w]
                before = {words[i - 1] if i else (i,) for i in at}
                after = {words[i + size] if i + size < n else (i,) for i in at}
                maximal += len(before) > 1 and len(after) > 1
    return len(covered.get(3, ())), len(covered.get(least, ())), longest, maximal


def test_repeats_against_brute_force():
    rng = random.Random(3)
    texts = [[], [b"a"], [b"a"] * 40, [b"a", b"b"] * 20, [b"x"] * 3 + [b"y"]]
    for _ in range(120):
        words = [b"%d" % rng.randrange(rng.choice([2, 4, 30])) for _ in range(rng.randrange(0, 60))]
        if words and rng.random() < 0.5:
            words += words[rng.randrange(len(words)) :]
        texts.append(words)
    for least in (3, 5):
        got = repetition.repeats_of(texts, least)
        at = 0
        for i, words in enumerate(texts):
            want = _plain(words, least)
            assert (got["n_repeat_words"][i], got["n_covered"][i], got["longest"][i], got["n_maximal"][i]) == want, words
            n = got["n_spans"][i]
            spans = list(zip(got["starts"][at : at + n].tolist(), got["stops"][at : at + n].tolist()))
            at += n
            assert sum(b - a for a, b in spans) == want[1] and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_suffixes_are_in_order():
    rng = np.random.default_rng(1)
    keys = np.append(rng.integers(1, 4, 300), 0)
    sa, levels = repetition.suffix_array(keys)
    suffixes = [keys[i:].tolist() for i in sa]
    assert suffixes == sorted(suffixes)
    lcp = repetition.common_prefixes(sa, levels)
    for i in range(1, len(sa)):
        a, b = suffixes[i - 1], suffixes[i]
        assert lcp[i] == next(k for k in range(len(a) + 1) if k >= len(a) or k >= len(b) or a[k] != b[k])


def test_rules_and_odd_rows(spark, odd, none):
    rows = {r.doc_id: r for r in repetition.quality_rules(odd).collect()}
    assert repetition.quality_rules(odd).count() == 10 and repetition.quality_rules(none).count() == 0
    assert rows[2].n_words == rows[3].n_words == rows[4].n_words == 0 and rows[2].base_failed and not rows[2].kept and rows[None].word_chars == 15
    fresh = lambda n, k: " ".join(f"{k}w{i}" for i in range(n))
    texts = {1: fresh(200, "a"), 2: fresh(120, "b") + " " + fresh(300, "c") + " " + fresh(120, "b"), 3: "\n".join(fresh(10, f"d{i % 10}") for i in range(20)), 4: fresh(40, "e"), 5: fresh(300, "f") + " " + fresh(20, "g") + " " + fresh(20, "g") + " ##|", 6: fresh(300, "h") + "\n" + "\n".join([fresh(9, "h")] * 8)}
    got = {r.doc_id: r for r in repetition.quality_rules(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {i: r.kept for i, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: True} and not got[2].base_failed and got[3].base_failed
    assert (got[2].longest, got[2].n_covered, got[2].n_maximal) == (120, 240, 1) and [tuple(s) for s in got[2].spans] == [(0, 120), (420, 540)]
    assert (got[3].n_dup_lines, got[5].n_symbols, got[6].n_dup_lines) == (10, 3, 7)


def test_result_does_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = repetition.quality_rules(docs).drop("spans")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, repetition.quality_rules(docs.repartition(7, F.col("lang"))).drop("spans").collect()))


def test_a_long_text_of_one_word(spark):
    rows = repetition.repeated_spans(spark.createDataFrame([(1, "la " * 300_000)], "doc_id long, text string")).first()
    assert (rows.n_words, rows.longest, rows.n_covered) == (300_000, 299_999, 300_000)
