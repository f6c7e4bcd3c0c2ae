import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusweave.llm import decontaminate, imatch, mixing, quality, registry, token_counts, toxicity
from corpusweave.llm.shingles import shingle_set, words_of
from tests.oracle import compare, connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, sf_dir, name):
    compare(registry.queries()[name](spark, sf_dir), connection(sf_dir), registry.oracle_sql()[name])


# --- token counts


def test_counts_equal_library(spark, sf_dir, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = sorted(((d, len(t.encode()), len(tok.encode(t, add_special_tokens=False))) for d, t in texts), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path).collect()), key=str) == want
    assert token_counts.token_counts(none, path).count() == 0


def test_chunk_maps_compose_at_any_cut():
    random.seed(4)
    machine = token_counts.transducer(public_tokenizers.path("word_bpe_49k.json"))
    parts = ["a", "'s", "don't", "X1", "\n", "Ü", "<|endoftext|>", "\t", "!", "'ve", "I'LL", "Straße", "\x1c", "İ", "ΣΑΣ", "word,"]
    for _ in range(1500):
        s = "".join(random.choice(parts + [" "] * 5) for _ in range(random.randint(0, 12)))
        assert machine.count(s, chunk=random.choice([1, 2, 3, 1000])) == len(machine.library.encode(s, add_special_tokens=False)), s


def test_random_runs_equal_library():
    random.seed(8)
    machine = token_counts.transducer(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(200):
        s = "".join(random.choice("abcdefghijklmnopqrstuvwxyz" * 8 + "ABC0123456789'!-.,") for _ in range(random.randint(60, 900)))
        assert machine.count(s, chunk=random.choice([90, 200, 1000])) == len(machine.library.encode(s, add_special_tokens=False)), s


def test_long_texts_are_dealt_over_tasks(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    random.seed(9)
    word = lambda: random.choice(["stone", "RIVER", "don't", "x1", "naïve", "12,5", "...", "<|endoftext|>"])
    texts = [" ".join(word() for _ in range(3000)), "".join(word() for _ in range(3000)), "ab1-" * 9000, "z" * 30_000, "short", None]
    rows = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, long_chars=2000)
    tok = Tokenizer.from_file(path)
    assert {r.doc_id: r.n_tokens for r in rows.collect()} == {i: len(tok.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}


# --- mixing


def test_targets_fill_up(spark):
    s = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(s).collect()}
    assert got["a"] == 200 and abs(sum(got.values()) - 1.5 * 2150) < 1e-6 and all(got[k] <= 2 * n + 1e-9 for k, n in (("a", 100), ("b", 1000), ("c", 1000), (None, 50)))
    assert abs(got["c"] / got["b"] - 2) < 1e-9 or got["c"] == 2000


def test_mix_is_near_targets_and_repeats(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.substring("source", 1, 4))
    rows = mixing.mix(docs).collect()
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(5)).collect())
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.target, []).append(r.taken)
    assert all(abs(sum(v) - int(t)) <= 1 for t, v in by.items())


def test_mix_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 10 and all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix(none).count() == 0
    kept = mixing.mixed_documents(odd)
    assert kept.columns == odd.columns and all(r.text and r.text.strip() for r in kept.collect()) and mixing.mixed_documents(none).count() == 0


def test_schedule_is_ordered_and_cut(spark, sf_dir):
    rows = mixing.schedule(mixing.queue(spark.read.parquet(f"{sf_dir}/documents.parquet"))).collect()
    finish = [r.virtual_finish for r in rows if r.virtual_finish is not None]
    assert finish == sorted(finish) and all(r.words == 0 for r in rows if r.virtual_start is not None and r.virtual_start > 1) and all(r.words == r.size for r in rows if r.virtual_finish is not None and r.virtual_finish <= 1 - 1e-9)


# --- decontamination


def test_containment_against_brute_force(spark, odd, none):
    rng = random.Random(1)
    word = lambda: f"q{rng.randrange(500)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 50)))) for i in range(30)] + [(90, None), (91, ""), (92, "two words")]
    docs = []
    for d in range(60):
        t = [word() for _ in range(rng.randrange(0, 400))]
        for i in rng.sample(range(30), 2):
            own = items[i][1].split()
            t[0:0] = own[: max(1, int(len(own) * rng.choice([0.5, 0.8, 0.9, 1])))]
        docs.append((d, " ".join(t)))
    docs += [(r.doc_id, r.text) for r in odd.collect()]
    want = set()
    for d, t in docs:
        have = set(shingle_set(t).tolist())
        for i, x in items:
            s = set(shingle_set(x).tolist())
            if s and 100 * len(s & have) >= 75 * len(s):
                want.add((d, i, len(s), len(s & have)))
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (2_000_000, 100):
        assert {tuple(r) for r in decontaminate.contained_items(ddf, idf, block_shingles=block).collect()} == want
    kept = decontaminate.drop_contaminated(odd, idf)
    assert kept.columns == odd.columns and 8 not in [r.doc_id for r in kept.collect()] and kept.count() == 9
    assert decontaminate.contained_items(none, idf).count() == 0 and decontaminate.contained_items(ddf, idf.limit(0)).count() == 0


# --- fingerprints


def test_fingerprints_of_edits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    order = sorted(docs.collect(), key=lambda r: -r.doc_id)
    for a, b in zip(order, [*order[1:], order[0]]):
        half = len(a.text) // 2
        edited = a.text[: len(a.text) - half] + b.text[:half]
        assert rows[a.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[a.doc_id].n_chars == len(a.text)
    assert np.mean([r.near_edited > r.near_next for r in rows.values()]) > 0.85
    by = {}
    for r in order:
        by.setdefault(r.text, set()).add(rows[r.doc_id].fingerprint)
    assert all(len(v) == 1 for v in by.values())


def test_fingerprints_odd_rows(odd, none):
    rows = imatch.fingerprints(odd).collect()
    assert len(rows) == 10 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert imatch.fingerprints(none).count() == 0
    assert imatch.fingerprints(odd.where("doc_id = 5")).first().near_next == 1.0


def test_fingerprints_against_brute_force(spark, odd):
    """Document frequencies, band, subsets, hashes and likeness in plain Python."""
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice(["the", "of", *[f"t{rng.randrange(400)}" for _ in range(6)]]) for _ in range(rng.randrange(0, 120)))) for i in range(80)]
    docs += [(200, docs[5][1]), (201, docs[5][1]), (202, None), (203, "naïve \U0001f600 " * 9), (204, "word" * 50_000)]
    low, high = 1.0, 4.0
    sets = {i: set(words_of(t)) for i, t in docs}
    df = {}
    for s in sets.values():
        for w in s:
            df[w] = df.get(w, 0) + 1
    band = {imatch.term_hash(w) for w, n in df.items() if low <= math.log(len(docs) / n) <= high}
    ddf = spark.createDataFrame(docs, "doc_id long, text string")
    assert set(imatch.lexicon(ddf, low, high).tolist()) == band
    odds = [int.from_bytes(hashlib.blake2b(b"subset%d" % i, digest_size=8).digest(), "little") | 1 for i in range(sum(imatch.RATES.values()))]
    rates = [r for r, n in imatch.RATES.items() for _ in range(n)]

    def plain(text):
        own = sorted({imatch.term_hash(w) for w in words_of(text)})
        own = [h for h in own if h in band] or own
        out = []
        for i, (odd_number, rate) in enumerate(zip(odds, rates)):
            drawn = [h for h in own if ((h * odd_number & (2**64 - 1)) >> 40) % 2**rate == 0]
            out.append(f"{xxhash.xxh3_64_intdigest(b''.join(h.to_bytes(8, 'little') for h in drawn), seed=i) % 2**32:08x}" if drawn else "")
        return out

    def like(a, b):
        either = [x == y for x, y in zip(a, b) if x or y]
        return sum(either) / len(either) if either else 1.0

    got = {r.doc_id: r for r in imatch.fingerprints(ddf, low=low, high=high).collect()}
    order = sorted(((i, t or "") for i, t in docs), reverse=True)
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]]):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, changed, follower = plain(t), plain(edited), plain(after)
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (",".join(own), ",".join(changed)), i
        assert r.near_edited == like(own, changed) and r.near_next == like(own, follower), i


def test_fingerprints_of_one_id_with_different_texts(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (1, None), (None, "g h")], "doc_id long, text string")
    first = sorted(map(str, imatch.fingerprints(df).collect()))
    assert len(first) == 4 and sorted(map(str, imatch.fingerprints(df.repartition(3)).collect())) == first


# --- classifiers


def test_toxicity_on_held_out_rows(spark, sf_dir):
    d = f"{sf_dir[:-5]}0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right / len(rows) > 0.85 and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_with_many_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    assert labels.where("toxic = 1").count() > 300
    rows = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    caught = [r.predicted for r in rows if r.toxic]
    assert np.mean(caught) > 0.8 and np.mean([r.predicted for r in rows if not r.toxic]) < 0.02


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (5, 0, 0), (8, None, None), (None, 1, 1), (1, 0, 0), (99, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(odd, labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity_scores(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect()} == {0.0}
    kept = toxicity.drop_toxic(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == 10


def test_quality_follows_labels_it_never_saw(spark, sf_dir):
    d = f"{sf_dir[:-5]}0.01"
    rows = quality.quality_scores(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.keep == r.quality for r in rows]) > 0.9
    assert np.mean([r.keep for r in rows if r.quality == 1]) > 0.97


def test_quality_where_labellers_abstain(spark):
    d = "/root/testdata/sf0.1"
    rows = quality.quality_scores(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    silent = [r for r in rows if r.weak_label == pytest.approx(np.median([x.weak_label for x in rows if set(x.votes) == {"-"}] or [-1]))]
    assert np.mean([r.keep == r.quality for r in rows]) > 0.95
    if len(silent) >= 20:  # better than one answer for all of them
        assert np.mean([r.keep == r.quality for r in silent]) >= max(np.mean([r.quality for r in silent]), 1 - np.mean([r.quality for r in silent]))


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    truth, rates = rng.random(40_000) < 0.3, [0.95, 0.8, 0.7, 0.9]
    votes = np.where(rng.random((len(truth), 4)) < rates, truth[:, None], ~truth[:, None])
    spoken = rng.random(votes.shape) < 0.8
    patterns, n = np.unique(["".join("-" if not s else str(int(v)) for v, s in zip(vs, ss)) for vs, ss in zip(votes, spoken)], return_counts=True)
    post, found, prior = quality.em(list(patterns), n.astype(float))
    assert abs(prior - 0.3) < 0.05 and all(abs(a - b) < 0.05 for a, b in zip(found, rates)) and all(0 <= p <= 1 for p in post)


def test_linear_scorer_learns():
    at, x = [np.array([i % 2, 7]) for i in range(40)], [np.ones(2)] * 40
    w = quality.train_linear(at, x, np.array([i % 2 for i in range(40)], float))
    assert w[1] > 0.5 > -0.5 > w[0]


def test_sample_is_bounded_under_copies(spark):
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "one text of many copies").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30))
    assert 700 < rows.where(h < int(1000 / 60_000 * (1 << 30))).count() < 1300  # as fit() draws


def test_quality_does_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[:-5]}0.01/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(400)).drop("id"))  # a third of the rows alike
    models = [quality.fit(d, sample_rows=300) for d in (docs, docs.repartition(7), docs.repartition(3, "source"))]
    assert models[0].posteriors == models[1].posteriors == models[2].posteriors
    assert all(np.array_equal(models[0].weights, m.weights) for m in models[1:]) and models[0].weights.any()


def test_quality_against_brute_force(spark, sf_dir):
    """Votes counted, labels weighed and blocks fitted by plain loops give the query's scores."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    hashes = {r.doc_id: r.h for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h")).collect()}
    reader, read = quality.Reader(), {}
    for i, text in rows:
        votes, (at, x) = reader.read(text or "")
        read[i] = "".join("-" if v is None else str(int(bool(v))) for v in votes), at, x.astype(np.float32)
    patterns = sorted({v for v, _, _ in read.values()})
    counts = np.array([sum(v == p for v, _, _ in read.values()) for p in patterns], float)
    posterior = dict(zip(patterns, quality.em(patterns, counts)[0]))
    weights = np.zeros(quality.DIM)
    for block in range(quality.BLOCKS):
        ids = sorted((i for i in read if hashes[i] % quality.BLOCKS == block), key=hashes.get)
        if ids:
            w, seen = np.zeros(quality.DIM), np.full(quality.DIM, 1e-6)
            for _ in range(80):
                g = 1e-4 * w
                for i in ids:
                    v, at, x = read[i]
                    error = 1 / (1 + np.exp(-(w[at] * x).sum())) - posterior[v]
                    np.add.at(g, at, x * error / len(ids))
                seen += g * g
                w -= 0.5 * g / np.sqrt(seen)
            weights += w * len(ids) / len(rows)
    for r in quality.quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        _, (at, x) = reader.read(dict(rows)[r.doc_id] or "")
        assert r.score == pytest.approx(1 / (1 + np.exp(float(weights[at] @ x))), abs=1e-3)
        assert r.weak_label == pytest.approx(1 - posterior[read[r.doc_id][0]])


def test_quality_odd_rows(odd, none):
    rows = quality.quality_scores(odd).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.score, r.votes))
    assert all(len(v) == 1 for v in by.values()) and by[5] == by[6] and by[1] == by[7] and by[2] == by[3]
    assert quality.quality_scores(none).count() == 0
