import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpusweave.llm import alignment
from corpusweave.llm.token_output import byte_level

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _plain(texts):
    tok, sp, plain = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), {c: b for b, c in byte_level().items()}
    tok.encode_special_tokens = True
    found = []
    for text in texts:
        groups, links = [], []
        ids_a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = sp.encode(text) if text else []
        own = [bytes(plain[c] for c in tok.id_to_token(i)) for i in ids_a]
        other = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if text and b"".join(own) == b"".join(other) == b" " + text.encode():
            ends_a, ends_b = np.cumsum([len(x) for x in own]).tolist(), np.cumsum([len(x) for x in other]).tolist()
            a0 = b0 = 0
            for cut in sorted(set(ends_a) & set(ends_b)):
                a1, b1 = ends_a.index(cut) + 1, ends_b.index(cut) + 1
                groups.append((ids_a[a0:a1], ids_b[b0:b1]))
                links.append((ids_a[a1 - 1], ids_b[b1 - 1]))
                a0, b0 = a1, b1
        else:
            ids_a = ids_b = []
        found.append((ids_a, ids_b, groups, links))
    count = Counter(x for *_, links in found for x in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for ids_a, ids_b, groups, links in found:
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out


ODD = ["", "a", " ", "\n", "\n\n", " x", "x ", "  two  spaces ", "a\nb", "a \nb", "a\n b", "tab\there", "</s><s>[INST] <0x41> <|endoftext|>", "▁under", "a▁b", "naïve café \U0001f600\U0001f468‍\U0001f469 d'été", "\x00\x01", "１２３ Ａ", "it's 12,345.67!?", "　wide space", "x" * 5000, "\r\n line \r\n", "日本語のテキスト 漢字", "é", "\nab", "ab\n", "\n x"]


def test_alignment_against_brute_force(spark):
    rng = random.Random(5)
    parts = [*ODD, "river", "Stone", ",", ".", "don't", "日本", "ß", "1234", "\n", " ", "  "]
    texts = ODD + ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 30))) for _ in range(150)] + [None, "river " * 3000]
    rows = alignment.token_alignment(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3), A, B)
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in rows.collect()}
    for i, want in enumerate(_plain(texts)):
        assert got[i] == want, (i, texts[i])


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in alignment.token_alignment(docs, A, B).collect()}
    assert [got[r.doc_id] for r in rows] == _plain([r.text for r in rows])


def test_shared_cuts_are_the_common_ends():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        ends = [np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(0, n + 1))), n)) for _ in "ab"]
        cut_a, cut_b = alignment.shared_cuts(*ends)
        assert ends[0][cut_a].tolist() == ends[1][cut_b].tolist() == np.intersect1d(*ends).tolist()


def test_odd_rows_and_outputs(odd, none):
    rows = alignment.token_alignment(odd, A, B)
    assert rows.count() == 10 and alignment.token_alignment(none, A, B).count() == 0
    assert {r.doc_id: r.n_a for r in rows.collect()}[2] == 0
    files = {r.doc_id: r for r in alignment.align(odd, A, B).collect()}
    ids = np.frombuffer(files[8].a_ids, "<u2").tolist()
    assert Tokenizer.from_file(A).decode(ids) == " two words" and len(files[2].a_ids) == 0
    assert alignment.link_counts(alignment.align(odd, A, B), A, B).count() <= alignment.pair_bound(A, B)
