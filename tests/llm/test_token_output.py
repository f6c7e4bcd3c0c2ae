import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusweave.llm import token_output as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows, end=0):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_equal_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(tuple(r) for r in T.token_output(docs, PATH).collect())
    assert got == brute(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_odd_rows(odd, none):
    got = [tuple(r) for r in T.token_output(odd, PATH).collect()]
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(got, key=lambda r: r[1]) == brute(rows)
    assert T.token_output(none, PATH).count() == 0


def test_pieces_equal_whole_texts():
    random.seed(3)
    enc = T.encoder(PATH)
    parts = ["a", "'s", "don't", "X1", "\n", "  ", "ü", "<|endoftext|>", "\t", "!", " b", "word,", "naïve.", "\xa0", "…"]
    for _ in range(3000):
        s = "".join(random.choice(parts + [" "] * 6) for _ in range(random.randint(0, 9)))
        assert np.frombuffer(enc.encode(s), "<u4").tolist() == enc.tok.encode(s, add_special_tokens=False).ids, s


@pytest.mark.parametrize("limit", [4, 7, 16])
def test_code_lengths_are_optimal_and_limited(limit):
    rng = np.random.default_rng(limit)
    counts = np.zeros(40, np.int64)
    counts[rng.choice(40, 13, replace=False)] = rng.integers(1, 10_000, 13)
    lengths = T.code_lengths(counts, limit)
    used = lengths[counts > 0].astype(float)
    assert lengths.max() <= limit and (lengths[counts == 0] == 0).all() and abs((2.0**-used).sum() - 1) < 1e-12
    if limit == 16:  # without a binding limit: as good as Huffman's
        import heapq

        heap = [int(c) for c in counts if c]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        assert int((counts * lengths).sum()) == cost


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 999)
    lengths = T.code_lengths(np.bincount(ids, minlength=1000))
    codes, _ = T.canonical_codes(lengths)
    bits, checks = T.pack(ids, codes, lengths)
    twice = T.unpack([bits, bits], [checks, checks], [n, n], T.decode_table(lengths))
    assert (twice[0] == ids).all() and (twice[1] == ids).all()
    lone = T.unpack([bits], [checks], [n], T.decode_table(lengths))[0]
    assert (lone == ids).all()
