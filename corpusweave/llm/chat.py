"""Chat formatting in budgeted windows, in DataFrame operations; what is read back is digested in Arrow batches.

Prefix sums of turn tokens cut a conversation into turn-aligned spans: a turn belongs to the span in which its last token
falls. Each window holds the conversation's system turn, limited history (whole turns before the span that begin at most
`history` tokens before it) and the span's own turns. Only assistant turns of the span itself are under the loss mask, so
every assistant text is a target once, however often it is repeated. A span is half the room that system turn and history
leave, so windows keep the budget as long as no single turn needs more than that half; a longer turn is kept whole in a
window of its own length.

Template: <s>ROLE[/ROLE]TEXT</s> for each turn. Inside roles and texts every < and [ is followed by a backslash and a
backslash is doubled, so no control string can arise there; the escape is reversed exactly.

Prefix sums go in two levels (by conversation and block of turns, then over blocks), so one conversation that holds a third
of all rows is spread over tasks. Defined cases: null text and role are empty; a null conv_id or turn is a value of its own
(null turns first); turns that tie are ordered by role and text; repeated rows are turns of their own; extra columns are
ignored; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.common import small_batches, text_of

BUDGET = 1024
HISTORY = 256
SYSTEM_ROLE, TARGET_ROLE = "system", "assistant"
#: Control strings of the template.
BEGIN, MIDDLE, END = "<s>", "[/ROLE]", "</s>"
TURN_BLOCK = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\|\\(\\)", "$1$2")


def turn_tokens(text: Column) -> Column:
    """Estimate of a formatted turn's tokens: a quarter of its bytes, and four for the marks."""
    return (F.ceil(F.octet_length(text) / 4) + 4).cast("long")


def _numbered(turns: DataFrame) -> DataFrame:
    """Adds pos (place in the conversation) and start (tokens before the turn) by two-level sums."""
    rows = turns.select("conv_id", F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), text_of().alias("text"))
    rows = rows.withColumn("block", F.floor(F.coalesce("turn", F.lit(-(2**62))) / TURN_BLOCK)).withColumn("tokens", turn_tokens(F.col("text")))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("place", F.row_number().over(inside)).withColumn("within", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("m"), F.sum("tokens").alias("t"))
    blocks = blocks.select(F.col("conv_id").alias("bc"), F.col("block").alias("bb"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    rows = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("bc")) & (F.col("block") == F.col("bb")))
    return rows.select("conv_id", "role", "text", "tokens", (F.col("m0") + F.col("place")).alias("pos"), (F.col("t0") + F.col("within")).alias("start"))


def chat_windows(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, n_turns (in the window), n_repeated (leading turns shown before), n_tokens, loss (array of spans in
    code points, end exclusive)."""
    rows = _numbered(turns)
    first = rows.where((F.col("pos") == 1) & (F.col("role") == SYSTEM_ROLE)).select(F.col("conv_id").alias("sc"), F.struct("pos", "role", "text", "tokens").alias("system"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("sc")), "left").drop("sc")
    room = F.greatest(F.lit(1), F.floor((budget - history - F.coalesce("system.tokens", F.lit(0))) / 2))
    rows = rows.withColumn("room", room).withColumn("window", F.floor((F.col("start") + F.col("tokens") - 1) / F.col("room")))
    spans = rows.groupBy("conv_id", "window").agg(F.min("start").alias("head"), F.first("system").alias("system"))
    keyed = lambda own: F.struct("pos", "role", "text", "tokens", F.lit(own).alias("own"))
    own = rows.select("conv_id", "window", keyed(True).alias("t"))
    # A turn is history of the later spans that begin at most `history` tokens after it: they lie in its bucket of positions or the next.
    step = max(1, history)
    late = rows.where(~((F.col("pos") == 1) & (F.col("role") == SYSTEM_ROLE))).select(F.col("conv_id").alias("hc"), "start", F.col("window").alias("mine"), keyed(False).alias("t"))
    late = late.withColumn("near", F.explode(F.array(F.floor(F.col("start") / step), F.floor(F.col("start") / step) + 1)))
    heads = spans.select("conv_id", "window", "head", F.floor(F.col("head") / step).alias("bucket"))
    past = late.join(heads, F.col("hc").eqNullSafe(F.col("conv_id")) & (F.col("near") == F.col("bucket")))
    past = past.where((F.col("window") > F.col("mine")) & (F.col("head") - F.col("start") <= history)).select("conv_id", "window", "t")
    lead = spans.where(F.col("system").isNotNull() & (F.col("window") > 0)).select("conv_id", "window", F.struct("system.pos", "system.role", "system.text", "system.tokens", F.lit(False).alias("own")).alias("t"))
    # The first span that has a turn holds the system turn itself.
    lead = lead.join(own.where("t.pos = 1").select(F.col("conv_id").alias("oc"), F.col("window").alias("ow")), F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("window") == F.col("ow")), "left_anti")
    packed = own.union(past).union(lead).groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    packed = packed.withColumn("parts", F.transform("turns", lambda t: F.struct(F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(MIDDLE)).alias("open"), escape(t["text"]).alias("body"), (t["own"] & (t["role"] == TARGET_ROLE)).alias("target"))))
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["open"], p["body"], F.lit(END))), "")
    # Running length of the text before each turn, then the spans of the targets.
    ends = F.aggregate("parts", F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p["open"]) + F.length(p["body"]) + len(END))))
    packed = packed.withColumn("at", ends)
    loss = F.filter(F.transform("parts", lambda p, i: F.struct((F.get("at", i) + F.length(p["open"])).alias("start"), (F.get("at", i) + F.length(p["open"]) + F.length(p["body"])).alias("end"), p["target"].alias("target"))), lambda s: s["target"] & (s["end"] > s["start"]))
    return packed.select(
        "conv_id", F.col("window").cast("long"), whole.alias("text"), F.size("turns").alias("n_turns"), F.size(F.filter("turns", lambda t: ~t["own"])).alias("n_repeated"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"), F.transform(loss, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """From windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (each turn counted once)."""
    # A text ends with END: what follows its last one is empty and goes.
    raw = F.split("text", F.lit("</s>"))
    own = F.slice(raw, F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    pair = lambda s: F.split(F.substring(s, len(BEGIN) + 1, 2**31 - 1), r"\[/ROLE\]", 2)
    said = F.array_join(F.transform(own, lambda s: F.concat(unescape(F.get(pair(s), F.lit(0))), F.lit("\n"), unescape(F.get(pair(s), F.lit(1))), F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))), "")
    rows = windows.select("conv_id", "window", (F.col("n_turns") - F.col("n_repeated")).cast("long").alias("n"), F.length("text").cast("long").alias("chars"), said.alias("said"), masked.alias("masked"))
    small_batches(windows.sparkSession)
    kind = windows.schema["conv_id"].dataType.simpleString()
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInArrow(_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id and window: of a conversation only counts and the state of its digests are held."""
    conv, state = None, None
    for batch in batches:
        done = []
        for key, n, chars, said, masked in zip(batch.column(0), *(batch.column(i) for i in range(2, 6))):
            if state is None or key != conv:
                if state is not None:
                    done.append((conv, state))
                conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            said, masked = said.as_py(), masked.as_py()
            state[0] += n.as_py()
            state[1].update(said.encode())
            state[2] += len(masked)
            state[3].update(masked.encode())
            state[4] += chars.as_py()
        if done:
            yield _digest_rows(done)
    if state is not None:
        yield _digest_rows([(conv, state)])


def _digest_rows(done: list) -> pa.RecordBatch:
    hexed = [[s.hexdigest() if hasattr(s, "hexdigest") else s for s in state] for _, state in done]
    columns = [pa.array([c.as_py() for c, _ in done], done[0][0].type), *[pa.array(x, t) for x, t in zip(zip(*hexed), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
