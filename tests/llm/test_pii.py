import hashlib
import random
import re

import pytest

from corpusweave.llm import pii


def base(text):
    out = []
    for k, (pattern, _) in enumerate(pii.BASE.values()):
        for m in re.finditer(pattern, text):
            raw, kind = m.group(), pii.KINDS[k]
            digits = re.sub("[^0-9]", "", raw)
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            ok = {"email": True, "ip": all(int(p) <= 255 for p in raw.split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    "mail a.b+c@x-y.example.com_d@e.org now", "\U0001f600 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "+1 (988) 555-2485 +12 +1 () 2",
    "a@b c@d.e@f.g", "", "no data", "00000000000000000000001.2.3.4 x@y.z", "1" * 5000 + " " + "a" * 5000 + "@", "tel: 030 1234567 password=hunter22x token: abcdef0123456789", "+1 555 123 4567, +1 555 123 4567 " * 400,
]


def shown(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans_equal_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "doc_id long, text string")
    for r in pii.find_pii(df, pii.Selector(None, {})).collect():
        want = base(TEXTS[r.doc_id]) if r.doc_id < 99 else []
        assert r.base_sha256 == hashlib.sha256(shown(want).encode()).hexdigest(), TEXTS[r.doc_id][:60]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4)) and r.spans == shown(want)


def test_method_adds_and_keeps_base(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[:-5]}0.01/documents.parquet")
    found = pii.find_pii(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sum(r.n_added for r in found) > 0
    for r in found:
        assert set(filter(None, shown(base(texts[r.doc_id])).split(","))) <= set(r.spans.split(","))


def test_native_plan(spark, sf_dir):
    plan = pii.find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_odd_rows(odd, none):
    rows = pii.find_pii(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.spans, r.base_sha256, r.n_added) == ("", empty, 0) and r.n_email + r.n_ip + r.n_card + r.n_phone == 0 for r in rows)
    assert pii.find_pii(none).count() == 0


@pytest.mark.parametrize(("digits", "want"), [("4111111111111111", True), ("4111111111111112", False), ("79927398713", True)])
def test_luhn(spark, digits, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(digits,)], "d string").select(pii.luhn(F.col("d")).alias("x")).first().x is want


def test_generators_have_no_upper_bound(spark):
    from pyspark.sql import functions as F

    listed = [f"030 555000{i}" for i in range(6)]
    secret, far = "token=" + "aB3-" * 250, "a" * 90 + "@" + ".".join(["label"] * 12)
    texts = ["call " + " ".join(listed) + " now", "call " + "/".join(listed) + ", now", "call " + " ".join(listed) + " 77x", f"x {secret} y", "key sk-" + "z9" * 500, f"to {far} or", "7" * 5000, "1234567 8x", "030 1234567", "1 " * 500, "😀 " + ". ".join(listed)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {g: [(c.span.start, c.span.end, c.span.raw) for c in r[g]] for g in pii.GENERATORS} for r in df.select("doc_id", *[pii.candidates(F.col("text"), g).alias(g) for g in pii.GENERATORS]).collect()}
    for i, text in enumerate(texts):
        assert all(text[s:e] == raw for found in got[i].values() for s, e, raw in found), text[:60]
    for i in (0, 1, 2, 10):
        assert set(listed) <= {raw for _, _, raw in got[i]["number"]}
    assert not any("77" in raw for _, _, raw in got[2]["number"])
    assert [raw for _, _, raw in got[3]["secret"]] == [secret] and got[4]["secret"][0][2] == "sk-" + "z9" * 500
    assert [raw for _, _, raw in got[5]["contact"]] == [far]
    assert got[6]["number"] == [(0, 5000, "7" * 5000)] and [raw for _, _, raw in got[7]["number"]] == ["1234567"] and [raw for _, _, raw in got[8]["number"]] == ["030 1234567"]
    assert len(got[9]["number"]) < 13 * 500


def test_written_out_addresses_are_candidates(spark):
    from pyspark.sql import functions as F

    texts = ["at 10[.]0[.]0[.]1 and 192 . 168 . 1 . 20, 10(dot)1(dot)2(dot)3", "1.2.3.4.5 1234.5.6.7", "1.2.3.4", "9." * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [c.span.raw for c in r.c] for r in df.select("doc_id", pii.candidates(F.col("text"), "address").alias("c")).collect()}
    assert got[0] == ["10[.]0[.]0[.]1", "192 . 168 . 1 . 20", "10(dot)1(dot)2(dot)3"] and got[1] == ["1.2.3.4"] and got[2] == ["1.2.3.4"] and len(got[3]) == 1


def test_context_is_what_stands_on_both_sides(spark):
    from pyspark.sql import functions as F

    texts = ["call 030 5550001 030 5550002 030 5550003 030 5550004 (mobile), x", "token: 1234567 is my code", "\n1234567 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {(r.doc_id, r.c.span.raw): r.c.f for r in df.select("doc_id", F.explode(pii.candidates(F.col("text"), "number")).alias("c")).collect()}
    first, last = rows[0, "030 5550001"], rows[0, "030 5550004"]
    assert first.cue == 1 and first.cue_behind == 0 and last.cue == 0 and last.cue_behind == 1
    assert first.digits_near == 20 and last.digits_near == 20
    assert rows[1, "1234567"].lead == 1 and rows[1, "1234567"].cue_behind == 1 and rows[2, "1234567 12"].line == 1


def test_corruptions_are_refused_by_validators(spark):
    from pyspark.sql import functions as F

    raws = {"email": "a.bc@mail.example.org", "phone": "+1 (017) 555-7713", "card": "4111111111111111", "ip": "10.20.30.40", "secret": 'token = "46d6a7e6a8a7bb8c02c2"'}
    for kind, raw in raws.items():
        forms = spark.createDataFrame([(raw,)], "raw string").select(F.explode(pii.corrupted(kind, F.col("raw"))).alias("form")).collect()
        assert len(forms) >= 2 and all(not base(r.form) for r in forms if kind != "secret"), (kind, forms)


def test_every_generator_is_calibrated_on_corruptions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[:-5]}0.1/documents.parquet")
    chosen = pii.fit_selector(docs)
    assert all(chosen.thresholds[g] is not None for g in pii.GENERATORS)
    rows = {r.generator: r for r in pii.held_out(docs, chosen).collect()}
    for g in pii.GENERATORS:
        r = rows[g]
        assert r.selected >= 0.9 * r.planted and r.selected >= 0.9 * (r.selected + r.false_picks), r


def test_sample_does_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[:-5]}0.01/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(400)).drop("id"))
    kept = [sorted(pii.planted(d, 500).collect()) for d in (docs, docs.repartition(5))]
    assert kept[0] == kept[1] and kept[0]


def test_trees_carry_context_to_what_fails_the_validator(spark):
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    texts = []
    for _ in range(600):
        texts += [f"please call +{digits(rng.randint(9, 11))} today", f"we sold part {digits(rng.randint(7, 11))} today"]
    chosen = pii.fit_selector(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    new = ["please call 0305550001 today", "we sold part 0305550001 today", "please call 0305550001 today"]
    rows = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), chosen).collect()}
    assert rows[0].spans == "number:12:22" == rows[2].spans and rows[1].spans == "" and rows[0].n_added == 1 and rows[0].n_phone == 0


def test_fit_takes_every_span_of_every_document(spark):
    texts = [f"call +1555000{i:04} or write to a{i}@mail{i}.org" for i in range(300)] + [" ".join(f"see +1777000{i:04} now" for i in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plants = pii.planted(docs).where("label = 1").groupBy("generator").count().collect()
    assert {pii.KINDS[r.generator]: r["count"] for r in plants} == {"contact": 3 * 300, "number": 3 * 340}
    rows = pii._scored_plants(docs, None)
    assert rows.where("label = 1").agg({"n": "sum"}).first()[0] == 3 * 640 and rows.count() < 1000
