import random

from pyspark.sql import functions as F

from corpusweave.functions import text as T
from corpusweave.functions.proximity import cover_density
from corpusweave.operators.turns import heads


def plain(words, prefixes, weight=0.1):
    """All stretches that hold every prefix and hold no shorter such stretch, tried one by one."""
    whole = lambda a, b: all(any(w.startswith(p) for w in words[a : b + 1]) for p in prefixes)
    covers = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if whole(a, b) and not whole(a + 1, b) and not whole(a, b - 1)]
    hit = lambda w: any(w.startswith(p) for p in prefixes)
    return sum(weight / (1 + sum(not hit(w) for w in words[a : b + 1])) for a, b in covers)


def test_cover_density_against_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ab", "abc", "b", "ba", "x", "y", "c"]) for _ in range(rng.randrange(0, 25))) for _ in range(150)] + [None, "", "ab", "c b ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for prefixes in (["ab"], ["a", "b"], ["a", "ab"], ["b", "c", "ab"]):
        for r in df.select("id", cover_density(T.tokens(F.col("text")), prefixes).alias("d")).collect():
            want = None if texts[r.id] is None else plain(texts[r.id].split(), prefixes)
            assert (r.d is None) if want is None else abs(r.d - want) < 1e-9, (texts[r.id], prefixes)
    assert df.select(cover_density(T.tokens(F.col("text")), []).alias("d")).first().d == 0.0


def test_protocol_heads(spark):
    lines = ["הכנסת העשרים-וחמש", "", "מושב שני", "פרוטוקול מס' 7", "מישיבת ועדת החוקה חוק ומשפט של היום", "יום שני, 3 במאי 2023", "נכחו:", "דנה כהן", "  יוסי לוי ", "מוזמנים:", "רון בר", "<< דובר >>", "ועדת אחרת"]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(lines)] + [("q", 0, "<< דובר >>"), ("r", 0, "שלום"), ("s", 0, None)], "file string, pos int, line string")
    got = {r.file: r for r in heads(df, by="file", pos="pos", text="line", header=F.startswith("line", F.lit("<<"))).collect()}
    p = got["p"]
    assert (p.number, p.label, p.committee, p.date) == ("עשרים-וחמש", "פרוטוקול מס' 7", "ועדת החוקה חוק ומשפט של", "יום שני, 3 במאי 2023")
    assert p.participants == ["דנה כהן", "יוסי לוי"]
    assert set(got) == {"p", "r"} and got["r"].number is None and got["r"].participants == []
