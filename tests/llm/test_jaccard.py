import random

import numpy as np

from corpusweave.llm import jaccard_join as J
from corpusweave.llm.common import cut
from corpusweave.llm.components import connected_components
from corpusweave.llm.shingles import shingle_set


def brute(rows):
    sets = [(d, frozenset(shingle_set(t).tolist())) for d, t in rows]
    up, mates = list(range(len(sets))), [set() for _ in sets]

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, (_, x) in enumerate(sets):
        for j, (_, y) in enumerate(sets[:i]):
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                up[find(i)] = find(j)
                if x != y:
                    mates[i].add(y)
                    mates[j].add(x)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(x), least[find(i)], len(mates[i])) for i, (d, x) in enumerate(sets))


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in J.jaccard_components(df, **options).collect())
    assert got == brute(rows)


def crowd(seed, groups, copies, edits, length=120):
    """Groups of copies with changes, around the threshold."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(3000)}"
    rows = []
    for g in range(groups):
        base = [word() for _ in range(length)]
        for i in range(copies):
            t = list(base)
            for _ in range(rng.choice(edits)):
                t[rng.randrange(len(t))] = word()
            rows.append((10_000 * g + i, " ".join(t)))
    return rows


def test_regions_split_and_blocks_join_what_cannot_be_split(spark):
    passage = " ".join(f"p{i}" for i in range(400))
    # groups around one long passage hang together as one group of distant clusters, so pivots split it
    rows = [(d, t + " " + passage) for d, t in crowd(1, 6, 12, [0, 1, 2, 4, 6, 9], 130)]
    check(spark, rows + crowd(2, 3, 25, [1, 3, 5, 6]) + [(70_000 + d, t) for d, t in crowd(3, 1, 60, [1, 2, 3])], region_members=8, cell_members=8, cell_shingles=4000)


def test_pivots_split_with_production_parameters(spark, monkeypatch):
    written = {}

    def watched(df, name, **options):
        out = cut(df, name, **options)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(J, "cut", watched)
    said = lambda g, i: " ".join(f"s{g % 6}x{i}x{k}" for k in range(8))
    # six clusters of distant texts, whose members quote one of the next cluster each: one group, split by its pivots
    rows = [(d, f"{t} {said(d // 10_000, d % 10_000)} {said(d // 10_000 + 1, d % 10_000)}") for d, t in crowd(1, 6, 12, [0, 1, 2, 4, 6, 9], 300)]
    check(spark, rows + [(70_000 + d, t) for d, t in crowd(2, 2, 40, [1, 3])])
    assert written["jaccard-split"] > 0 and written["jaccard-big"] > written["jaccard-split"]


def test_screen_keeps_every_link():
    for n in (*range(1, 60), 97, 250, 1001):
        for m in range(-(-75 * n // 100), min(100 * n // 75, 1400) + 1):
            common = J.overlap(n, m, 75)
            # worst places of what is not shared: first in both lists
            shared = set(range(10_000, 10_000 + common))
            for a_low, b_low in ((0, 0), (0, 20_000), (20_000, 0)):
                a = sorted(shared | set(range(a_low, a_low + n - common)))[: int(J.sent(n, 75))]
                b = sorted(shared | set(range(b_low + 5000, b_low + 5000 + m - common)))[: int(J.sent(m, 75))]
                assert len(set(a) & set(b)) >= J.least_shared(n, 75)


def test_overlaps():
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 4000, n).astype(np.uint64)) for n in sizes] for sizes in ([1, 50, 900], [1, 3, 2000, 400]))
    assert J.overlaps(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


def test_near_copies_chains_and_shared_passages(spark):
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(3000)}"
    passage = [word() for _ in range(30)]
    rows, base = [], [word() for _ in range(120)]
    for i in range(90):  # a crowded group: copies with changes, around the threshold
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            t[rng.randrange(len(t))] = word()
        rows.append((1000 - i, " ".join(t)))
    chain = [word() for _ in range(60)]
    for i in range(12):  # each is near the next only
        chain = chain[1:] + [word()]
        rows.append((2000 + i, " ".join(chain)))
    rows += [(3000 + i, " ".join([word() for _ in range(rng.randrange(2, 40))] + passage)) for i in range(60)]
    rows += [(4000 + i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    check(spark, rows)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    check(spark, rows)
    got = {r.doc_id: r for r in J.jaccard_components(odd).collect()}
    assert got[2].n_shingles == 0 and got[2].component_id == 2 and got[7].component_id == 1 and got[6].class_id == 5 and None in got
    assert J.jaccard_components(none).count() == 0


def test_keep_first_keeps_columns(odd, none):
    kept = J.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, 5, 8, None]
    assert J.keep_first(none).count() == 0


def test_components(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1)] + [(100, i) for i in range(101, 150)], "a long, b long")
    got = {r.node: r.comp for r in connected_components(df).collect()}
    assert got[3] == 1 and got[9] == 7 and 5 not in got and {got[i] for i in range(100, 150)} == {100}
    assert connected_components(df.limit(0)).count() == 0


def test_shingles():
    assert len(shingle_set("a b c")) == 1 and len(shingle_set(None)) == 0 and len(shingle_set("a b c d e f")) == 2
    assert (shingle_set("A B c D e") == shingle_set("a b C d E")).all() and (shingle_set("É b c") != shingle_set("é b c")).all()


def test_keep_first_without_ids_and_with_repeated_ids(spark):
    said = [f"text {i} of many words that differ from all others {i} {i * i} {i + 7} and so on" for i in range(4)]
    rows = [(None, said[0]), (None, said[0]), (None, said[1]), (7, said[2]), (7, said[2]), (7, said[3]), (9, said[2]), (None, said[2])]
    kept = J.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(None, said[0]), (None, said[1]), (7, said[2]), (7, said[3])], key=str)


def test_very_long_word_and_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(spark.createDataFrame([(1, long), (2, long + " end"), (3, "x" * 3_000_000)], "doc_id long, text string")).collect()}
    assert got == {1: (299_996, 1), 2: (299_997, 1), 3: (1, 3)}
