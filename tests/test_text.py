import pytest
from pyspark.sql import functions as F

from corpusweave.functions import text as T
from corpusweave.functions.lexical import prefix_query, word_similarity
from corpusweave.functions.vector import best_cosine, blended, cosine


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize("raw", ["חוק-יסוד הכנסת", "חוק־יסוד  הכנסת ", "חוק־יסוד:הכנסת"])
def test_norm_name(spark, raw):
    assert one(spark, T.norm_name, raw) == "חוק-יסוד הכנסת"


def test_norm_name_null_and_marks(spark):
    assert one(spark, T.norm_name, None) is None
    assert one(spark, T.norm_name, 'א״ב ג׳') == "א\"ב ג'"


def test_html_order_of_entities(spark):
    assert one(spark, T.html_to_text, "<p>a &amp;lt; b</p><div>x&nbsp;&nbsp;y</div>c<br/>d&copy;") == "a < b\nx y\nc\nd"
    assert one(spark, T.html_to_text, None) == ""


def test_small_functions(spark):
    assert one(spark, T.strip_controls, "a\x00b\x1fc\nd") == "abc\nd"
    assert one(spark, T.base_title, "law - part - x") == "law"
    assert one(spark, lambda c: T.ellipsis(c, 3), "abcd") == "abc..."
    assert one(spark, T.publish_date, "03.02.2024").isoformat() == "2024-02-03"
    assert one(spark, T.publish_date, "2024-02-31") is None
    assert one(spark, T.display_time, "2024-05-06T07:08:09Z") == "06/05/2024 07:08"
    assert one(spark, T.display_time, "soon") == "soon"
    assert one(spark, T.safe_file_name, ' a/b: "c" ') == "a_b_c"
    assert one(spark, T.error_kind, "Limit of requests per day reached") == "daily_quota"
    assert tuple(one(spark, T.header_and_body, "h\n\nb\n\nc")) == ("h", "b\n\nc")


@pytest.mark.parametrize(("kind", "url", "path", "want"), [("wikitext", "https://h/wiki/%D7%90%D7%91_c#d", None, "אב_c"), ("lexicon", None, "x/y.csv", "lexicon"), ("pdf", None, "x/y.csv", "y"), (None, None, "d/e.md", "e"), (None, None, None, "unknown")])
def test_source_id(spark, kind, url, path, want):
    assert one(spark, T.source_id, kind, url, path) == want


def test_dates_by_pattern(spark):
    kept = ["2026-04-25", "2026-03-25", "1999-05-31", "2025-04-03T10:00:00"]
    dropped = ["3390-06-91", "1850-01-01", "2040-12-31", "2025-13-01", "2025-04-32", "25-04-2025", "תשפ״ה"]
    df = spark.createDataFrame([(x,) for x in kept + dropped], "d string")
    assert {r.d for r in df.where(T.is_plausible_date(F.col("d"))).collect()} == set(kept)


def test_direction(spark):
    he = "\\u05D0-\\u05EA"
    text = "םולש ךל " * 6
    assert one(spark, lambda c: T.is_visual_order(c, he, "ךםןףץ"), text)
    assert one(spark, lambda c: T.reverse_words(c, he), "םולש abc\nonly latin") == "שלום abc\nonly latin"


def test_prefix_query():
    assert prefix_query("what is committee 202 2026?", frozenset({"what"})).prefixes == ("committee", "committe", "2026")
    long = prefix_query("one two three four five six seven")
    assert long.all and len(long.prefixes) == 7
    assert prefix_query("a of !").prefixes == ()


def test_word_similarity():
    assert word_similarity("budget", "the budget law") == 1.0
    assert word_similarity("budget", "zzz") == 0.0
    assert 0.2 < word_similarity("budgetary", "a budget") < 1


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [[0.0, 1.0], [1.0, 1.0]], [0.0, 0.0])], "a array<float>, vs array<array<float>>, z array<float>")
    r = df.select(best_cosine(F.col("a"), F.col("vs")).alias("b"), cosine(F.col("a"), F.col("z")).alias("z"), blended(F.lit(1.0), F.lit(0.5)).alias("m")).first()
    assert abs(r.b - 0.70710678) < 1e-6 and r.z is None and abs(r.m - 0.7) < 1e-9
