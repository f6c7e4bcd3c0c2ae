"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a source, in a shuffled order, gets a virtual start and finish time: the source's tokens before it and up to
it, divided by the source's target. The targets sum to the budget, so at virtual time 1 every source has been served its
target and the budget is used up: the schedule, range-sorted by virtual finish over all sources, is truncated there; the
document a source is being served at that moment is taken in part. A source whose target exceeds its size is queued a second
time (EPOCHS at most).

Running sums go in two levels: by source and a hash bucket, then over the buckets, so a source with a third of all rows is
spread over BUCKETS partitions. Only the table of sources (one row each) is looked at as a whole.

Defined cases: null text has size 0 and is never taken; a null source is a source of its own, sorted last; equal ids are told
apart by their size only, so repeated rows get one share each in some order; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.common import WORD, cut

WEIGHTS = (3, 1, 2)
EPOCHS = 2
BUDGET = 1.5


def shuffle_key(id_col: str = "doc_id", seed: int = 0) -> Column:
    """The shuffled order: 32 hex digits; their first three are the bucket."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def source_targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """sources(source, source_size) -> with target: budget x all sizes shared by weight, none above epochs x its size.

    Water-filling: by falling need of a cap (cap / weight ascending), a source is capped as long as its fair share of what is
    left exceeds its cap; the others share the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * epochs)
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("share", (budget * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    free = F.col("cap") / F.col("w") > F.col("share")
    rows = rows.withColumn("level", F.min_by("share", F.when(free, F.col("cap") / F.col("w"))).over(everything))
    return rows.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("level"))).alias("target"))


def queue(docs: DataFrame, *, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """One row per row of docs with its source's size and target, and before: the words of its source queued before it."""
    sized = cut(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), shuffle_key("doc_id", seed).alias("k")).withColumn("bucket", F.substring("k", 1, 3)), "mix-sizes")
    sums = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, epochs)
    heads = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(F.col("o.source").alias("hs"), F.col("o.bucket").alias("hb"), "offset", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("k", "size")
    rows = sized.withColumn("seq", F.row_number().over(inside)).withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(heads, F.col("source").eqNullSafe(F.col("hs")) & (F.col("bucket") == F.col("hb")))
    return rows.select("doc_id", "source", "bucket", "seq", "size", "source_size", "target", (F.col("offset") + F.col("within")).cast("long").alias("before"))


def schedule(queued: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """The fair queue in order: each row of queue() once for each epoch, range-sorted by virtual finish.

    The truncation at the total budget is the cut at virtual time 1: words is what the mix takes of the row (0 behind it).
    """
    rows = queued.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    start = F.col("before") + F.col("epoch") * F.col("source_size")
    words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor("target") - start)).cast("long")
    rows = rows.withColumns({"words": words, "virtual_start": F.try_divide(start, "target"), "virtual_finish": F.try_divide(start + F.col("size"), "target")})
    return rows.repartitionByRange("virtual_finish", "doc_id").sortWithinPartitions("virtual_finish", "doc_id")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target and taken (words the mix takes, repeats counted)."""
    taken = schedule(queue(docs, **options), options.get("epochs", EPOCHS))
    rows = taken.groupBy("source", "bucket", "seq", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, all columns kept: a document comes as often as the mix takes it, to the nearest whole copy.

    Rows that repeat one doc_id each come as often as all of them together are taken on average.
    """
    copies = mix(docs, **options).groupBy("doc_id").agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("times")).where("times >= 0.5")
    copies = copies.select(F.col("doc_id").alias("id"), F.floor(F.col("times") + 0.5).cast("int").alias("n"))
    rows = docs.select(F.struct("*").alias("row"))  # no name of docs can clash
    out = rows.join(copies, F.col("row.doc_id").eqNullSafe(F.col("id"))).select("row", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return out.select("row.*")
