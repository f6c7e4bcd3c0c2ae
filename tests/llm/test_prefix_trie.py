import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from corpusweave.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs string"


def _plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == p).encode()).hexdigest()) for p, m in members.items()), key=str
    )


def _rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 130), *range(250, 260), -5, -105, 1000, 1001]:
        if rng.random() < 0.1:
            continue
        n = rng.choice([1, 1, 2, 3, 5, 8])
        rows += [(c, rng.choice([i, i, i, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "no", None, "", "naïve \U0001f600"]), "x", "y") for i in range(n)]
    return rows + [(None, 0, "user", "hi", "x", "y")] + rows[:5]


@pytest.mark.parametrize("limit", [3, 200_000])
def test_trie_against_brute_force(spark, limit):
    for seed in (1, 2):
        rows = _rows(seed)
        got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), limit)
        assert sorted(map(tuple, got.collect()), key=str) == _plain(rows)


def test_hot_turns_copies_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURN_BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "TEXT_CHUNK", 20)
    rows = [(c, i, "user", "same" if i < 5 else f"t{c % 3}", "", "") for c in range(300) for i in range(6)]
    rows += [(c, i, "user", f"long {i}", "", "") for c in (900, 1000) for i in range(150)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), 5)
    assert sorted(map(tuple, got.collect()), key=str) == _plain(rows)


def test_no_rows_and_one_conversation(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    for rows in ([(7, 0, "user", "a", "", "")], [(100, 0, None, None, "", ""), (101, 0, "user", "a", "", "")]):
        assert sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == _plain(rows)


def test_queue_spills_and_keeps_order():
    rng = random.Random(6)
    queue, sums = prefix_trie.SpillingQueue(10), defaultdict(lambda: [0, 0])
    for _ in range(500):
        key, n, m = (rng.randrange(-9, 0), rng.randrange(-5, 5), rng.randrange(3)), rng.randrange(9), rng.randrange(10**12)
        queue.push((*key, n, m))
        sums[key][0] += n
        sums[key][1] += m
    assert queue.files and [list(queue.take(k)) for k in sorted(sums)] == [sums[k] for k in sorted(sums)]
