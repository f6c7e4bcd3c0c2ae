import json

import pytest
from pyspark.sql import functions as F

from corpusweave.operators import evaluate as E
from corpusweave.operators import turns as N
from corpusweave.operators.index import EmptyUpstream
from corpusweave.sources import feeds, files


def test_csv_blocks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('name,url,upstream_hash,note\nA,http://u,zz,"two\nlines"\nB,,yy,\n')
    got = files.csv_blocks(spark, str(tmp_path / "x.csv")).collect()
    assert got[0].content == "name:\nA\n\nnote:\ntwo\nlines\n\n" and got[0].metadata == {"source_url": "http://u"}
    assert got[1].metadata == {}


def test_split_and_glob(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\n---\ntwo\n---\nthree")
    assert [r.content for r in files.split_file(spark, str(tmp_path / "a.md"), "ctx").orderBy("filename").collect()] == ["one", "two", "three"]
    assert files.whole_files(spark, str(tmp_path / "*.md")).first().filename == "a.md"
    with pytest.raises(ValueError):
        feeds.read_source(spark, "other", "x", "c")


def test_trees_and_render(spark, tmp_path):
    tree = {"metadata": {"document_name": "Doc"}, "structure": [{"depth": 0, "section_name": "P", "content": "", "children": [{"depth": 1, "section_name": "S", "content": "body", "children": []}]}]}
    (tmp_path / "t.json").write_text(json.dumps(tree))
    r = files.section_trees(spark, str(tmp_path / "*.json"))
    got = r.select(N.render_section(F.col("doc"), F.col("path"), F.col("content")).alias("m")).collect()
    assert [x.m for x in got] == ["# Doc\n\n# P\n\n## S\n\nbody"]


def test_marked_sections(spark):
    blob = "intro <!-- SECTION_KEY: a --> one\n---\n<!-- SECTION_KEY: b -->two"
    s = spark.createDataFrame([(blob,)], "t string").select(files.marked_sections(F.col("t")).alias("s")).first().s
    assert [tuple(x) for x in s] == [("a", "one"), ("b", "two")]


def test_odata_cursor_and_manifest(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"value": [{"id": 1}], "odata.nextLink": "p2"}))
    (tmp_path / "p2.json").write_text(json.dumps({"d": {"results": [{"id": 2}]}}))
    assert {r.id for r in feeds.odata_rows(spark, str(tmp_path / "p*.json"), "id:int").collect()} == {1, 2}
    (tmp_path / "m.json").write_text(json.dumps({"resources": [{"path": "a.csv", "hash": "x"}, {"path": "b.csv", "hash": "y"}]}))
    assert feeds.manifest_hash(spark, str(tmp_path / "m.json"), "b.csv").first()["hash"] == "y"
    item = "array<struct<ItemId:int,DocumentPath:string,FileFormat:string,DecisionDate:string,DocumentTitle:string>>"
    pages = spark.createDataFrame([(0, [(1, "a\\b.pdf", "PDF", "2024-01-02T00:00:00", "t"), (2, "c.doc", "doc", "2024-01-01T00:00:00", "u")]), (1, [(3, "a/b.pdf", "pdf", "2023-01-01T00:00:00", "v")])], f"page int, Items {item}")
    assert [(r.url, r.filename) for r in feeds.cursor_items(pages).collect()] == [("a/b.pdf", "1.pdf")]
    assert feeds.next_cursor(pages).first().cursor == "2022-12-31T23:59:59"


def test_windows_and_links(spark):
    assert feeds.live_window("2024-01-01", "2024-01-01") == ("2024-01-01", "2024-01-02")
    with pytest.raises(ValueError):
        feeds.live_window("2024-02-01", "2024-01-01")
    df = spark.createDataFrame([('<a href="x/y.pdf">1</a><A class=b HREF=\'http://h/z.pdf\'>2</A>',)], "h string")
    assert df.select(feeds.links(F.col("h")).alias("l")).first().l == ["x/y.pdf", "http://h/z.pdf"]
    assert spark.range(1).select(feeds.link_file_name(F.lit("http://h/%20")).alias("n")).first().n == spark.range(1).select(F.substring(F.md5(F.lit("http://h/%20")), 1, 16)).first()[0]


def test_write_refuses_empty(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    feeds.write_csv(df, str(tmp_path / "out"))
    with pytest.raises(EmptyUpstream):
        feeds.write_csv(df.limit(0), str(tmp_path / "out"))
    assert files.csv_rows(spark, str(tmp_path / "out")).count() == 1


def test_turns(spark):
    rows = [(1, 0, "agenda", "A1"), (1, 1, "head", "Ann (X):"), (1, 2, "body", "hi"), (1, 3, "body", "there"), (1, 4, "head", "Bob:"), (1, 5, "agenda", "A2"), (1, 6, "head", "Cy:"), (1, 7, "body", "yes")]
    df = spark.createDataFrame(rows, "d int, p int, k string, t string")
    got = N.segment(df, by="d", pos="p", header=F.col("k") == "head", text=F.col("t"), agenda=F.when(F.col("k") == "agenda", F.col("t"))).orderBy("turn_no").collect()
    assert [(r.speaker, r.agenda, r.text, r.n_paragraphs) for r in got] == [("Ann (X):", "A1", "hi\nthere", 2), ("Cy:", "A2", "yes", 1)]
    assert tuple(df.where("p = 1").select(N.speaker(F.regexp_replace("t", ":$", "")).alias("s")).first().s) == ("Ann", "X")


def test_evaluation(spark):
    exp = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "z")], "question_id string, doc string")
    got = spark.createDataFrame([("q", "a", 1, 0.9), ("q", "c", 2, 0.5), ("q", "a", 3, 0.4)], "question_id string, doc string, rank int, score double")
    m = {r.question_id: r for r in E.retrieval_metrics(exp, got).collect()}
    assert abs(m["q"].total_score - 0.9) < 1e-9 and abs(m["q"].query_score - 0.4 / 0.9) < 1e-9 and m["q"].num_results == 3 and m["q"].num_correct == 2
    assert m["r"].query_score == 0 and m["r"].recall == 0
    s = E.summary(E.retrieval_metrics(exp, got)).first()
    assert s.n_expected == 3 and abs(s.retrieval_rate - 1 / 3) < 1e-9
    v = spark.createDataFrame([("NEW", "PASS1"), ("OLD", "FAIL"), (None, "XFAIL"), ("NEW", "INFRA")], "choice string, grade string").withColumn("b", F.lit(1))
    r = E.verdicts(v, ["b"]).first()
    assert (r.new_wins, r.old_wins, r.ties, r.pass_rate) == (2, 1, 1, 0.5)
    assert spark.range(1, 101).agg(E.p95("id").alias("p")).first().p == 95


def test_alerts(spark):
    rows = [(f"2024-01-0{i}", p, o, n, f) for i, (p, o, n, f) in enumerate([(0.95, 0, 1, 0), (0.95, 0, 1, 0), (0.95, 0, 1, 0), (0.80, 0, 1, 1), (0.90, 2, 1, 0), (0.92, 1, 1, 1)], 1)]
    df = spark.createDataFrame(rows, "d string, pass_rate double, old_wins int, new_wins int, infra int").withColumn("at", F.to_timestamp("d"))
    assert [r.severity for r in E.alerts(df, at="at").orderBy("at").collect()] == [None, None, None, "red", "red", "orange"]
