"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Strict patterns with validators give the base spans, which always stay. High-recall generators propose further, overlapping
candidates (numbers in groups, written-out mail and network addresses, keys and passwords); boosted trees score them on format and
context features, and one calibrated threshold a generator selects what is added. The trees are fitted by Spark ML on all documents, as
counts of equal features, then compiled to CASE expressions, so scoring is one narrow projection: no shuffle, no collected group,
whole texts.

Labels come from corruptions. Spans that a validator accepts are written again as people write them and validators refuse them
(signs and dots spelled out, the plus sign dropped, other grouping with the check digit kept, shortened keys), in their own
context: these are the positives. Negatives are strings of like shape (plain counts, dates, ranges, amounts, words at words,
section numbers, settings with a plain word), placed elsewhere in the same texts where no cue stands, and numbers of the texts
themselves that no validator accepts and no cue announces. Each generator's threshold is calibrated on a half of the texts that
the trees did not see; held_out() tells recall and precision there.

Patterns are written so that long runs cost linear time and no recursion (possessive loops, starts only at the begin of a run
or at the end of the last match); their matches are those of the plain forms in BASE.

Defined cases: null and empty texts have no spans; offsets count code points, end exclusive; equal rows give equal results;
extra columns are ignored; an empty table gives an empty result; documents without both labels add nothing to the base spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.common import cut, n_parts, text_of

KINDS = ("email", "ip", "card", "phone", "contact", "number", "secret", "address")
#: The contract's patterns, and the same matches without quadratic time or recursion.
BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: High-recall generators: pattern and what a text must hold for it to be tried.
GENERATORS = {
    "contact": (r"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{2,}+ ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{2,}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,}+)*+", r"(?i)@|[(\[{]at[)\]}]"),
    # A chain of digits of any length, and the letter that touches its end: see _numbers().
    "number": (r"(?<![0-9A-Za-z])(?:\+|00|\()?[0-9](?:[ ().\/-]{0,2}[0-9]){6,}+[A-Za-z]?+", "[0-9]"),
    "secret": (r"(?:(?i:password|passwd|passwort|secret|token|api[_-]?key|pwd) ?[=:] ?[^\s]{4,}+|\b(?:AKIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{12,}+)", r"(?i)=|:|AKIA|ghp_|sk-|xox"),
    "address": (r"(?<![0-9.])[0-9]{1,3}+(?: ?(?:\.|\[\.\]|\(\.\)|(?i:\[dot\]|\(dot\))) ?[0-9]{1,3}+){3}+(?![0-9])", r"[0-9] ?[.\[(]"),
}
CUES = r"(?i)(?:tel|phone|call|fax|mobil|handy|mail|contact|kontakt|card|iban|konto|account|ssn|passport|password|secret|token|key|ip|address|user|name)[^A-Za-z]{0,3}$"
CUES_BEHIND = r"(?i)^[^A-Za-z0-9]{0,3}(?:tel|phone|fax|mobil|handy|cell|mail|ext|is my|ist meine|card|konto|account|password|secret|token|key|ip|address)"
CONTEXT = 24
PRECISION = 0.9
BLOCK = 256
#: Digits of a number-sized candidate, and of a chain that can be one number as a whole.
NUMBER_DIGITS, CHAIN_DIGITS = (7, 19), 31
FEATURES = ("digits", "letters", "length", "spaces", "dashes", "dots", "brackets", "equals", "upper", "cue", "cue_behind", "lead", "line", "digits_near", "g_contact", "g_number", "g_secret", "g_address")
#: Spark ML takes its split points from all rows up to the square of this.
BINS = 256


def _has(text: Column, what: str) -> Column:
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(what, F.rlike(text, F.lit("[0-9]")))


def matches(text: Column, pattern: str, kind: str, tried: Column) -> Column:
    """array<struct<start, kind, end, raw>> of the leftmost non-overlapping matches; kind as its number in KINDS.

    Starts are running sums of the lengths of gaps and matches, in blocks, so that the cost stays near linear.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda m, g: F.struct(F.length(g).alias("g"), m.alias("m")))
    blocks = lambda p: F.transform(F.sequence(F.lit(0), F.ceil(F.size(p) / BLOCK).cast("int") - 1), lambda b: F.slice(p, b * BLOCK + 1, BLOCK))
    width = lambda z: z["g"] + F.length(z["m"])
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,raw:string>>)")

    def offsets(bs: Column) -> Column:
        return F.aggregate(bs, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + F.aggregate(b, F.lit(0), lambda a, z: a + width(z))))

    def inside(block: Column, at: Column) -> Column:
        def add(acc: Column, z: Column) -> Column:
            start = acc["at"] + z["g"]
            end = start + F.length(z["m"])
            return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), z["m"].alias("raw"))).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), add, lambda acc: acc["out"])

    # transform over one element holds a value under a name inside an expression
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    spans = let(pairs, lambda p: F.when(F.size(p) == 0, none).otherwise(let(blocks(p), lambda bs: let(offsets(bs), lambda off: F.flatten(F.transform(bs, lambda b, i: inside(b, F.get(off, i))))))))
    return F.when(tried, spans).otherwise(none)


def digits_of(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn check of a string of digits."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.struct(F.ascii(F.substr(digits, F.length(digits) - i + 1, F.lit(1))).alias("c"), i.alias("i")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x["i"] % 2 == 0, doubled(x["c"] - 48)).otherwise(x["c"] - 48)) % 10 == 0


def valid(kind: str, raw: Column) -> Column:
    n = F.length(digits_of(raw))
    if kind == "ip":
        return F.forall(F.split(raw, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(999)) <= 255)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits_of(raw))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(matches(text, BASE[kind][1], kind, _has(text, kind)), lambda s: valid(kind, s["raw"]))


def candidates(text: Column, kind: str) -> Column:
    """Candidates of one generator with their features: array<struct<span, f>>."""
    pattern, tried = GENERATORS[kind]
    before = lambda s: F.substr(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
    behind = lambda s: F.substr(text, s["end"] + 1, F.lit(CONTEXT))
    found = F.transform(matches(text, pattern, kind, F.rlike(text, F.lit(tried))), lambda s: F.struct(s.alias("span"), before(s).alias("before"), behind(s).alias("behind")))
    if kind == "number":
        found = F.flatten(F.transform(found, _numbers))
    return F.transform(found, lambda c: F.struct(c["span"].alias("span"), _features(kind, c["span"], c["before"], c["behind"]).alias("f")))


def _numbers(chain: Column) -> Column:
    """Number-sized candidates of a chain of digits: array<struct<span, before, behind>>, overlapping, in time linear in the chain.

    A digit run that a letter touches is no part of a number. A chain of up to CHAIN_DIGITS digits is a candidate as a whole; one of more
    digits than a number has also gives every sequence of whole digit runs that is number-sized, and longer runs by themselves.
    """
    least, most = NUMBER_DIGITS
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    none = F.expr("cast(array() as array<struct<span:struct<start:int,kind:int,end:int,raw:string>,before:string,behind:string>>)")
    number = F.lit(KINDS.index("number"))
    made = lambda start, raw, before, behind: F.struct(F.struct(start.cast("int").alias("start"), number.alias("kind"), (start + F.length(raw)).cast("int").alias("end"), raw.alias("raw")).alias("span"), before.alias("before"), F.left(behind, F.lit(CONTEXT)).alias("behind"))
    start, raw, before = chain["span"]["start"], chain["span"]["raw"], chain["before"]
    after = lambda kept: F.concat(F.substr(raw, F.length(kept) + 1), chain["behind"])

    def windows(kept: Column) -> Column:
        # Runs with what stands before them, so that they lie end to end.
        runs = matches(kept, r"[^0-9]*+[0-9]++", "number", F.lit(True))

        def beginning(rs: Column, run: Column, i: Column) -> Column:
            first = F.regexp_extract(run["raw"], r"[+(]?[0-9]+$", 0)
            at = start + run["end"] - F.length(first)
            past = F.concat(before, F.array_join(F.transform(F.slice(rs, F.greatest(i - CONTEXT + 1, F.lit(1)), F.least(i, F.lit(CONTEXT))), lambda r: r["raw"]), ""), F.substr(run["raw"], F.lit(1), F.length(run["raw"]) - F.length(first)))

            rest = lambda k: F.concat(F.array_join(F.transform(F.slice(rs, i + k + 2, CONTEXT), lambda r: r["raw"]), ""), after(kept))

            def grow(acc: Column, run: Column) -> Column:
                said = F.when(acc["n"] == 0, first).otherwise(F.concat(acc["said"], run["raw"]))
                n = acc["n"] + F.length(digits_of(run["raw"]))
                fits = n.between(least, most) | ((acc["n"] == 0) & (n > most))
                return F.struct(n.alias("n"), said.alias("said"), F.when(fits, F.array_append(acc["out"], made(at, said, F.right(past, F.lit(CONTEXT)), rest(acc["k"])))).otherwise(acc["out"]).alias("out"), (acc["k"] + 1).alias("k"))

            return F.aggregate(F.slice(rs, i + 1, most), F.struct(F.lit(0).alias("n"), F.lit("").alias("said"), none.alias("out"), F.lit(0).alias("k")), grow, lambda acc: acc["out"])

        return let(runs, lambda rs: F.flatten(F.transform(rs, lambda run, i: beginning(rs, run, i))))

    def parts(kept: Column) -> Column:
        whole, n = F.array(made(start, kept, before, after(kept))), F.length(digits_of(kept))
        split = F.when(n <= CHAIN_DIGITS, F.concat(whole, F.filter(windows(kept), lambda c: c["span"]["raw"] != kept))).otherwise(windows(kept))
        return F.when(n < least, none).when(n <= most, whole).otherwise(split)

    free = F.when(F.rlike(raw, F.lit("[A-Za-z]$")), F.regexp_replace(raw, r"[ ().\/-]{0,2}(?<![0-9])[0-9]++[A-Za-z]$", "")).otherwise(raw)
    return let(free, parts)


def _features(kind: str, span: Column, before: Column, behind: Column) -> Column:
    raw = span["raw"]
    count = lambda chars: (F.length(raw) - F.length(F.translate(raw, chars, ""))).cast("double")
    only = lambda c, pattern: F.length(F.regexp_replace(c, pattern, "")).cast("double")
    flag = lambda c, pattern: F.rlike(c, F.lit(pattern)).cast("double")
    values = {
        "digits": F.length(digits_of(raw)).cast("double"), "letters": only(raw, "[^A-Za-z]"), "length": F.length(raw).cast("double"),
        "spaces": count(" "), "dashes": count("-/"), "dots": count("."), "brackets": count("()[]{}"), "equals": count("=:"), "upper": only(raw, "[^A-Z]"),
        "cue": flag(before, CUES), "cue_behind": flag(behind, CUES_BEHIND), "lead": flag(before, r"[=:#]\s*$"), "line": flag(before, r"(?:^|\n)\s*$"),
        "digits_near": only(F.concat(before, behind), "[^0-9]"), **{f"g_{g}": F.lit(float(g == kind)) for g in GENERATORS},
    }
    return F.struct(*[values[f].alias(f) for f in FEATURES])


def validated(raw: Column, kind: Column) -> Column:
    """A validator's verdict on a candidate's characters; kind as its number in KINDS."""
    value = F.regexp_replace(raw, r"^(?i:[a-z]+[_-]?[a-z]*) ?[=:] ?", "")
    mix = sum(F.rlike(value, F.lit(c)).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    verdicts = {
        "contact": F.rlike(raw, F.lit(f"^(?:{BASE['email'][0]})$")), "number": (F.rlike(raw, F.lit(r"^\+")) & valid("phone", raw)) | valid("card", raw),
        "secret": F.rlike(raw, F.lit("^(?:AKIA|ghp_|sk-|xox)")) | ((F.length(value) >= 12) & (mix >= 2)), "address": F.rlike(raw, F.lit(f"^(?:{BASE['ip'][0]})$")) & valid("ip", raw),
    }
    return reduce(lambda other, g: F.when(kind == KINDS.index(g), verdicts[g]).otherwise(other), verdicts, F.lit(False))


def _trees(model) -> list[tuple[float, object]]:
    return [(w, t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees)]


def _case(node, f: Column) -> Column:
    """A tree as nested CASE expressions over the fields of f."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    return F.when(f[FEATURES[node.split().featureIndex()]] <= float(node.split().threshold()), _case(node.leftChild(), f)).otherwise(_case(node.rightChild(), f))


class Selector:
    """Boosted trees as an expression, and a threshold of the margin for each generator (None: nothing is selected)."""

    def __init__(self, trees: list | None, thresholds: dict[str, float | None]):
        self.trees, self.thresholds = trees, thresholds

    def margin(self, f: Column) -> Column:
        return sum((F.lit(w) * _case(root, f) for w, root in self.trees), F.lit(0.0))


def corrupted(kind: str, raw: Column) -> Column:
    """Forms of a validated span that its validator refuses: array<string>. A key is no base span, so it counts as it stands, too."""
    digits = digits_of(raw)
    put = lambda *steps: reduce(lambda c, step: F.regexp_replace(c, *step), steps, raw)
    forms = {
        "email": [put(("@", " (at) ")), put((r"\.(?=[^@]*$)", " [dot] "), ("@", "[at]")), put(("@", " @ "))],
        "phone": [put((r"^\+", "")), F.concat(F.lit("00"), digits), F.regexp_replace(digits, "([0-9]{3})(?=[0-9]{3})", "$1-")],
        "card": [F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1/"), F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1.")],
        "ip": [put((r"\.", "[.]")), put((r"\.", "(dot)")), put((r"\.", " . "))],
        "secret": [raw, F.regexp_extract(raw, r"^((?i:[a-z]+[_-]?[a-z]*) ?[=:] ?[^\s]{8,11})", 1), F.translate(F.regexp_extract(raw, r"^((?i:[a-z]+[_-]?[a-z]*) ?[=:] ?.*)", 1), '0123456789"', "ghijklmnop")],
    }
    return F.filter(F.array(*forms[kind]), lambda form: F.length(form) > 0)


def harmless(generator: str, before: Column, behind: Column, h: Column) -> Column:
    """Strings of a generator's shape that are nobody's data, of the hash's digits and the words on both sides: array<string>."""
    d = F.lpad(F.pmod(h, F.lit(10**15)).cast("string"), 15, "3")
    of = lambda a, n: F.substring(d, a, n)
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    left, right = F.regexp_extract(before, r"([A-Za-z]{2,})[^A-Za-z]*$", 1), F.regexp_extract(behind, r"^[^A-Za-z]*([A-Za-z]{2,})", 1)
    forms = {
        "contact": [said(left, " @ ", right), said(left, "@", right), said(left, " (at) ", right)],
        "number": [of(1, 7), said("4", of(1, 8)), said("20", of(1, 2), "-0", of(3, 1), "-1", of(4, 1), " 1", of(5, 1)), said("19", of(1, 2), "-20", of(3, 2)), said(of(1, 3), ".", of(4, 3), ".", of(7, 3)), said(of(1, 5), ".", of(6, 4))],
        "secret": [said("token: ", right), said("password = ", right), said("secret=", left)],
        "address": [said(of(1, 1), ".", of(2, 1), ".9", of(3, 2), ".", of(5, 1)), said(of(1, 1), ". ", of(2, 1), ". ", of(3, 1), ". ", of(4, 1)), said("7", of(1, 2), ".", of(3, 3), ".", of(6, 3), ".", of(9, 3))],
    }
    return F.array(*forms[generator])


def planted(docs: DataFrame, rows: int | None = None) -> DataFrame:
    """Corruptions and harmless strings in short contexts of all texts: generator, label, half, before, form, behind.

    With rows, of about so many texts, drawn by a hash of id and text, rows equal in both once, so that they do not depend on partitions.
    """
    h = F.xxhash64(F.col("doc_id").cast("string"), "text")
    texts = docs.select("doc_id", text_of(F.col("text").cast("string")).alias("text")).select(h.alias("h"), "text").where(F.rlike("text", F.lit("[0-9@=:]")))
    if rows is not None:
        share = int(min(1.0, rows / max(1, docs.count())) * (1 << 30))
        texts = texts.where(F.pmod(F.shiftrightunsigned("h", 8), F.lit(1 << 30)) < share).dropDuplicates(["h"])
    text, width = F.col("text"), 2 * CONTEXT
    before = lambda at: F.substr(text, F.greatest(at - width + 1, F.lit(1)), F.least(at, F.lit(width)))
    behind = lambda at: F.substr(text, at + 1, F.lit(width))

    def plants(kind: str, generator: str, spans: Column) -> Column:
        def both(s: Column, i: Column) -> Column:
            key = F.xxhash64("h", F.lit(kind), i)
            place = F.pmod(key, F.length(text) + 1).cast("int")
            l, r = F.regexp_replace(before(place), r"\S*$", ""), F.regexp_replace(behind(place), r"^\S*", "")
            made = lambda label, b, forms, e: F.struct(F.lit(KINDS.index(generator)).alias("generator"), F.lit(label).alias("label"), b.alias("before"), forms.alias("forms"), e.alias("behind"))
            cued = F.rlike(l, F.lit(CUES)) | F.rlike(r, F.lit(CUES_BEHIND))
            return F.array(made(1.0, before(s["start"]), corrupted(kind, s["raw"]), behind(s["end"])), made(0.0, l, F.when(~cued, harmless(generator, l, r, key)), r))

        return F.flatten(F.transform(spans, both))

    secret = F.lit(KINDS.index("secret"))
    keys = F.filter(matches(text, GENERATORS["secret"][0], "secret", F.rlike(text, F.lit(GENERATORS["secret"][1]))), lambda s: validated(s["raw"], secret))
    own = F.concat(*[plants(k, g, base_spans(text, k)) for k, g in (("email", "contact"), ("phone", "number"), ("card", "number"), ("ip", "address"))], plants("secret", "secret", keys))
    refused = lambda c: ~reduce(lambda a, g: a | validated(c["span"]["raw"], F.lit(KINDS.index(g))), ("number", "address"), F.lit(False))
    plain = F.filter(candidates(text, "number"), lambda c: refused(c) & (c["f"]["cue"] == 0) & (c["f"]["cue_behind"] == 0))
    number = F.lit(KINDS.index("number"))
    natural = F.transform(plain, lambda c: F.struct(number.alias("generator"), F.lit(0.0).alias("label"), before(c["span"]["start"]).alias("before"), F.array(c["span"]["raw"]).alias("forms"), behind(c["span"]["end"]).alias("behind")))
    found = texts.select(F.pmod("h", F.lit(2)).alias("half"), F.explode(F.concat(own, natural)).alias("p"))
    return found.select("half", "p.generator", "p.label", "p.before", "p.behind", F.explode("p.forms").alias("form"))


def _scored_plants(docs: DataFrame, rows: int | None) -> DataFrame:
    """generator, label, half, features f and n, how often: of a corruption the candidate that is it (null: none is), of a harmless string each one that touches it."""
    plants = cut(planted(docs, rows).repartition(n_parts(docs.sparkSession), F.xxhash64("before", "form", "behind")), "pii-plants")  # a small shuffle, so that the scan keeps its tasks
    start, end = F.length("before"), F.length("before") + F.length("form")
    plants = plants.withColumn("text", F.concat("before", "form", "behind"))
    of = [F.when(F.col("generator") == KINDS.index(g), candidates(F.col("text"), g)) for g in GENERATORS]
    same = lambda c: F.when(F.col("label") == 1, (c["span"]["start"] == start) & (c["span"]["end"] == end)).otherwise((c["span"]["start"] < end) & (c["span"]["end"] > start))
    found = plants.select("generator", "label", "half", F.explode_outer(F.transform(F.filter(F.coalesce(*of), same), lambda c: c["f"])).alias("f"))
    return found.groupBy("generator", "label", "half", "f").agg(F.count("*").alias("n"))


def fit_selector(docs: DataFrame, *, sample_rows: int | None = None, precision: float = PRECISION) -> Selector:
    """Trees from one half of the documents; thresholds from the other: the lowest margin from which on precision holds."""
    rows = cut(_scored_plants(docs, sample_rows).where("f is not null").sortWithinPartitions("half", "generator", "label", "f"), "pii-fit")
    n = {(r["half"], r["label"]): r["n"] for r in rows.groupBy("half", "label").agg(F.sum("n").alias("n")).collect()}
    if min(n.get((0, 0.0), 0), n.get((0, 1.0), 0)) < 5:
        return Selector(None, {})
    x = rows.select("half", "label", F.col("n").cast("double").alias("n"), array_to_vector(F.array(*[F.col(f"f.{f}") for f in FEATURES])).alias("features"))
    model = GBTClassifier(labelCol="label", weightCol="n", maxIter=12, maxDepth=3, maxBins=BINS, stepSize=0.3, seed=5).fit(x.where("half = 0"))
    trees = _trees(model)
    margins = rows.where("half = 1").select("generator", F.round(Selector(trees, {}).margin(F.col("f")), 6).alias("m"), "label", "n")
    # One row for each combination of leaves: bounded by the trees.
    sums = margins.groupBy("generator", "m").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum("n").alias("n"))
    from_here = Window.partitionBy("generator").orderBy(F.desc("m"))
    ranked = sums.select("generator", "m", F.sum("pos").over(from_here).alias("pos"), F.sum("n").over(from_here).alias("n"))
    least = {KINDS[r["generator"]]: r["m"] - 1e-6 for r in ranked.where((F.col("pos") > 0) & (F.col("pos") >= precision * F.col("n"))).groupBy("generator").agg(F.min("m").alias("m")).collect()}
    return Selector(trees, {g: least.get(g) for g in GENERATORS})


def held_out(docs: DataFrame, selector: Selector, *, sample_rows: int | None = None) -> DataFrame:
    """By generator, of the half that the trees did not see: planted corruptions, those proposed, those selected, and harmless strings selected."""
    names = F.array(*[F.lit(k) for k in KINDS])
    least = reduce(lambda other, g: F.when(F.col("generator") == KINDS.index(g), F.lit(selector.thresholds.get(g))).otherwise(other), GENERATORS, F.lit(None).cast("double"))
    picked = F.coalesce((selector.margin(F.col("f")) >= least) & F.col("f").isNotNull(), F.lit(False)) if selector.trees else F.lit(False)
    rows = _scored_plants(docs, sample_rows).where("half = 1").withColumn("picked", picked)
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    positive = F.col("label") == 1
    out = rows.groupBy("generator").agg(count(positive).alias("planted"), count(positive & F.col("f").isNotNull()).alias("proposed"), count(positive & F.col("picked")).alias("selected"), count(~positive & F.col("picked")).alias("false_picks"))
    return out.select(F.get(names, F.col("generator")).alias("generator"), "planted", "proposed", "selected", "false_picks")


def _selected(selector: Selector, generator: str) -> Column:
    least = selector.thresholds[generator]
    return F.transform(F.filter(F.col(f"c_{generator}"), lambda c: selector.margin(c["f"]) >= least), lambda c: c["span"])


def find_pii(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added (spans the method added)."""
    selector = selector or fit_selector(docs)
    rows = docs.select("doc_id", text_of(F.col("text").cast("string")).alias("text"))
    text = F.col("text")
    rows = rows.withColumns({k: base_spans(text, k) for k in BASE})
    rows = rows.withColumn("base", F.sort_array(F.concat(*[F.col(k) for k in BASE])))
    picked = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,raw:string>>)")
    used = [g for g in GENERATORS if selector.trees and selector.thresholds.get(g) is not None]
    if used:
        rows = rows.withColumns({f"c_{g}": candidates(text, g) for g in used})
        picked = F.concat(*[_selected(selector, g) for g in used])
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    # An added span that only repeats a base span is none.
    rows = rows.withColumn("bounds", F.transform("base", lambda s: F.struct(s["start"], s["end"]))).withColumn("added", picked)
    rows = rows.withColumn("added", F.when(F.size("added") > 0, F.filter("added", lambda s: ~F.array_contains("bounds", F.struct(s["start"], s["end"])))).otherwise(F.col("added")))
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
