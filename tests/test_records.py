import json
import random

import pytest
from pyspark.sql import functions as F

from corpusweave.operators import containment as C
from corpusweave.operators import records
from corpusweave.operators.turns import segment

RULES = [
    ('{"a": 1, "b": [1, {"c": "x", "d": 2}]}', '{"b": [{"c": "x"}]}', True),
    ('{"a": 1, "b": [1, {"c": "x", "d": 2}]}', '{"b": [{"c": "x", "e": 2}]}', False),
    ('{"a": {"b": {"c": null}}}', '{"a": {"b": {"c": null}}}', True),
    ('{"a": {"b": {}}}', '{"a": {"b": {"c": null}}}', False),
    ('["foo", "bar"]', '"bar"', True),
    ('{"a": ["foo"]}', '{"a": "foo"}', False),
    ('"bar"', '["bar"]', False),
    ("[1, 2, [1, 3]]", "[1, 3]", False),
    ("[1, 2, [1, 3]]", "[[3]]", True),
    ("[[1]]", "1", False),
    ("[1, 1, 2]", "[2, 2, 1, 1]", True),
    ('{"a": 1.0}', '{"a": 1}', True),
    ('{"a": 1}', '{"a": true}', False),
    ('{"a": "1"}', '{"a": 1}', False),
    ('{"a": 9007199254740993}', '{"a": 9007199254740992}', False),
    ('{"a": []}', '{"a": {}}', False),
    ('{"a": {"x": 1}}', '{"a": {}}', True),
    ('{"it\'s": {"b.c": 1}}', '{"it\'s": {"b.c": 1}}', True),
    ("{}", "{}", True),
    ('{"a": 1, "a": 2}', "{}", False),
    ("no json", "{}", False),
    (None, "{}", False),
    ("[NaN]", "[]", False),
]


def test_rules_in_both_forms(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(RULES)], "id int, meta string").repartition(1)
    got = rows.select("id", *[C.contains(F.col("meta"), json.loads(b)).alias(f"c{i}") for i, (_, b, _) in enumerate(RULES)]).collect()
    assert [r[f"c{r.id}"] for r in sorted(got)] == [w for _, _, w in RULES]
    assert all(C.holds(C.parsed(a), json.loads(b)) == w for a, b, w in RULES)
    # every text against every pattern: the two forms agree
    assert all(r[f"c{i}"] == C.holds(C.parsed(RULES[r.id][0]), json.loads(b)) for r in got for i, (_, b, _) in enumerate(RULES))


def value(rng, depth):
    kind = rng.randrange(6 if depth else 3)
    if kind < 3:
        return rng.choice([0, 1, 1.5, "a", "", None, True, False])
    size = rng.randrange(3)
    return [value(rng, depth - 1) for _ in range(size)] if kind == 3 else {rng.choice("xyz"): value(rng, depth - 1) for _ in range(size)}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, json.dumps(value(rng, 3))) for i in range(250)] + [(7, '{"x": 1}'), (None, "{}"), (300, None), (301, "{")]
    patterns = [(f"p{i}", json.dumps(value(rng, 2))) for i in range(60)] + [("p3", "[]"), (None, "[]"), ("null", None), ("bad", "]")]
    df = spark.createDataFrame(rows, "id int, meta string").withColumn("key", F.lit(1))
    asked = spark.createDataFrame(patterns, "name string, pattern string").withColumn("id", F.lit(5))
    got = C.contained_pairs(df, asked, id_col="id", json_col="meta", pattern_id="name", pattern_col="pattern")
    want = {(p, i) for p, b in patterns for i, a in rows if p and i is not None and C.parsed(b) is not C.NoJson and C.parsed(a) is not C.NoJson and C.holds(C.parsed(a), C.parsed(b))}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 100
    assert C.contained_pairs(df.limit(0), asked, id_col="id", json_col="meta", pattern_id="name", pattern_col="pattern").count() == 0


def test_patterns_meet_rows_by_their_rarest_key_only(spark, monkeypatch):
    df = spark.range(4000).select("id", F.to_json(F.struct(F.lit("all").alias("kind"), (F.col("id") % 100).alias("k"))).alias("meta"))
    asked = spark.range(50).select(F.col("id").alias("p"), F.to_json(F.struct(F.lit("all").alias("kind"), F.col("id").alias("k"))).alias("pattern"))
    count = spark.sparkContext.accumulator(0)
    plain = C._verified

    def watched(batches):
        def seen():
            for b in batches:
                count.add(b.num_rows)
                yield b

        yield from plain(seen())

    monkeypatch.setattr(C, "_verified", watched)
    met = C.contained_pairs(df, asked, id_col="id", json_col="meta", pattern_id="p", pattern_col="pattern").collect()
    assert len(met) == 2000 and count.value == 2000


LINES = [
    ("b", 1, False, None, "before"), ("b", 2, False, "first item", "x"), ("b", 3, True, None, "Ann:"), ("b", 4, False, None, "one"), ("b", 5, False, "second item", "y"), ("b", 6, False, None, None), ("b", 7, False, None, "two"),
    ("b", 8, True, None, "Bo:"), ("b", 9, False, None, "  "), ("b", 10, True, "third", "Cy:"), ("b", 11, False, None, "three"),
    ("a", 1, True, None, "Di:"), ("a", 2, False, None, "four"), (None, 1, True, None, "Ed:"), (None, 2, None, None, "five"), ("c", 1, False, None, "no header"),
]


def test_table_function_equals_windows(spark):
    random.Random(1).shuffle(LINES)
    lines = spark.createDataFrame(LINES, "doc string, pos int, header boolean, agenda string, text string").withColumn("speaker", F.lit("clash"))
    got = sorted(map(tuple, records.turns(lines).collect()), key=repr)
    known = lines.fillna({"header": False})
    want = segment(known, by="doc", pos="pos", header=F.col("header"), text=F.col("text"), agenda=F.col("agenda")).select("doc", "turn_no", "speaker", "agenda", "text", "n_paragraphs")
    assert got == sorted(map(tuple, want.collect()), key=repr) and len(got) == 4
    assert records.turns(lines.limit(0)).count() == 0


def test_table_function_in_sql(spark):
    records.register(spark)
    spark.createDataFrame(LINES, "doc string, pos int, header boolean, agenda string, text string").createOrReplaceTempView("lines")
    assert {r.speaker for r in spark.sql("SELECT * FROM turns(TABLE(lines))").collect()} == {"Ann:", "Cy:", "Di:", "Ed:"}
    with pytest.raises(Exception, match="missing: header"):
        spark.sql("SELECT * FROM turns(TABLE(SELECT doc, pos, agenda, text FROM lines))").collect()
