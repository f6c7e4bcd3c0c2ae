import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from corpusweave.llm import mixing, toxicity
from corpusweave.llm.shingles import shingle_set


def test_run_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if scored[r.doc_id] < 0.5)
    sets = {d: set(shingle_set(t).tolist()) for d, t, _ in rows}
    group = {d: d for d in sets}
    for i, (a, _, _) in enumerate(rows):
        for b, _, _ in rows[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    rows = [r for r in rows if group[r[0]] == r[0]]
    items = [set(shingle_set(r.text).tolist()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(s and 100 * len(s & sets[r[0]]) >= 75 * len(s) for s in items)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    times = {m.doc_id: int(m.taken / m.size + 0.5) for m in mixed if m.size}
    tok, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for d, t, _ in rows:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for _ in range(times.get(d, 0)):
            want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert sorted(tuple(r) for r in P.run(spark, sf_dir).collect()) == want


def test_stages_take_odd_rows(spark, sf_dir, odd):
    from pyspark.sql import functions as F

    docs = odd.select(*P.COLUMNS, F.lit(1).alias("_mixed_id"), F.lit(2).alias("component_id"))
    every = sorted((r.doc_id for r in docs.collect()), key=str)
    # near copies: 7 repeats 1, 6 repeats 5, the second row of 1 goes; blank rows and null ids stay
    want = {"toxicity": every, "near_copies": [1, 2, 3, 4, 5, 8, None], "decontamination": every, "token_output": every}
    want["mixing"] = sorted((r.doc_id for r in mixing.mixed_documents(docs).collect()), key=str)
    assert want["mixing"] and all(d not in want["mixing"] for d in (2, 3, 4))
    for name, stage in P.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, sf_dir)
            got = sorted((r.doc_id for r in out.collect()), key=str)
            assert got == ([] if rows is not docs else want[name]), name
            if name != P.STAGES[-1][0]:
                assert out.columns == P.COLUMNS
