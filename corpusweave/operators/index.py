"""Keeping a chunk table current: chunking, delta plans by content hash, reconciliation, caches, snapshots, fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from corpusweave.scratch import cut


def token_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` white-space tokens, each starting size - overlap after the last, ending with the one that reaches the end."""
    step = size - overlap

    def windows(words: Column) -> Column:
        last = F.greatest(F.ceil((F.size(words) - size) / step), F.lit(0))
        starts = F.sequence(F.lit(0), (last * step).cast("int"), F.lit(step))
        return F.when(F.size(words) > 0, F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))).otherwise(F.array().cast("array<string>"))

    # transform over one element holds the split text under a name, so that it is made once
    return F.get(F.transform(F.array(F.filter(F.split(text, r"\s+"), lambda w: w != "")), windows), F.lit(0))


def split_sections(text: str) -> list[str]:
    import re

    parts = [s for s in re.split(r"(?m)(?=^##\s)", text) if s.strip()]
    return parts if len(parts) > 1 else [s for s in re.split(r"\n\s*\n", text) if s.strip()]


@dataclass
class Run:
    """Sections first to end (exclusive) that make one chunk, with `carried` tokens of the chunk before; or one section to be cut."""

    first: int
    end: int
    carried: int
    tokens: int
    wide: bool = False


def plan_runs(lengths: list[int], size: int, overlap: int) -> list[Run]:
    """How sections of these lengths are packed, from the lengths alone."""
    runs: list[Run] = []
    for i, n in enumerate(lengths):
        last = runs[-1] if runs else None
        if n > size or last is None or last.wide:
            runs.append(Run(i, i + 1, 0, n, n > size))
        elif last.tokens + n <= size:
            last.end, last.tokens = i + 1, last.tokens + n
        else:
            carried = min(overlap, last.tokens)
            runs.append(Run(i, i + 1, carried, carried + n))
    return runs


def pack_sections(text: str, size: int, overlap: int, encode: Callable = str.split, decode: Callable = " ".join) -> list[str]:
    """Sections packed in order up to `size` tokens; a packed chunk hands its last `overlap` tokens to the next; a section that is
    too long by itself is cut into windows. A chunk can exceed `size` by the handed tokens."""
    if len(encode(text)) <= size:
        return [text]
    sections = split_sections(text)
    coded = list(map(encode, sections))
    chunks: list[str] = []
    for run in plan_runs(list(map(len, coded)), size, overlap):
        if run.wide:
            step, ids = size - overlap, coded[run.first]
            chunks += [decode(ids[at : at + size]) for at in range(0, len(ids) - overlap, step)]
        else:
            head = [decode(encode(chunks[-1])[-run.carried :])] if run.carried else []
            chunks.append("\n\n".join(head + sections[run.first : run.end]))
    return chunks


#: Texts that chunk() takes up at once.
CHUNK_ROWS = 128


def chunk(files: DataFrame, *, size: int = 400, overlap: int = 50, text: str = "content") -> DataFrame:
    """One row per chunk: the file's columns, content, chunk_index, total_chunks, content_hash. Arrow batches, no shuffle; of a batch
    only CHUNK_ROWS texts and their chunks are Python objects at once."""
    kept = [c for c in files.columns if c != text]
    schema = StructType([*(f for f in files.schema.fields if f.name != text), StructField("_c", ArrayType(StringType()))])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                few = batch.slice(at, CHUNK_ROWS)
                chunks = pa.array([pack_sections(t.as_py() or "", size, overlap) for t in few.column(len(kept))], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*few.columns[: len(kept)], chunks], [*kept, "_c"])

    rows = files.select(*kept, text).mapInArrow(packed, schema).withColumn("total_chunks", F.size("_c")).select(*kept, "total_chunks", F.posexplode("_c").alias("chunk_index", text))
    return rows.withColumn("content_hash", F.sha2(F.col(text), 256))


def delta_plan(stored: DataFrame, incoming: DataFrame, *, key: tuple[str, ...] = ("context", "content_hash"), order: str = "position") -> DataFrame:
    """incoming with action: 'insert' for the first of each unknown key, 'unchanged' otherwise."""
    first = Window.partitionBy(*key).orderBy(order)
    known = stored.select(*key).distinct().withColumn("_known", F.lit(True))
    rows = incoming.withColumn("_rn", F.row_number().over(first)).join(known, list(key), "left")
    return rows.withColumn("action", F.when(F.col("_known").isNull() & (F.col("_rn") == 1), "insert").otherwise("unchanged")).drop("_rn", "_known")


def reconcile_plan(stored: DataFrame, incoming: DataFrame, *, context: str = "context", file: str = "filename", digest: str = "content_hash") -> DataFrame:
    """stored with orphan: its file was processed in this run, but its content no longer came. An empty run makes no orphans."""
    done = incoming.select(context, file).distinct().withColumn("_done", F.lit(True))
    seen = incoming.select(context, digest).distinct().withColumn("_seen", F.lit(True))
    rows = stored.join(done, [context, file], "left").join(seen, [context, digest], "left")
    return rows.withColumn("orphan", F.col("_done").isNotNull() & F.col("_seen").isNull()).drop("_done", "_seen")


def next_state(stored: DataFrame, incoming: DataFrame, *, order: str = "position") -> DataFrame:
    """The table after a sync: survivors and inserts, in the columns of stored."""
    kept = reconcile_plan(stored, incoming).where("not orphan").select(*stored.columns)
    new = delta_plan(stored, incoming, order=order).where("action = 'insert'").select(*stored.columns)
    return kept.unionByName(new)


def sync_counters(stored: DataFrame, incoming: DataFrame, *, order: str = "position") -> DataFrame:
    """unchanged, inserted, orphaned, and churn in percent (null without inserts)."""
    plan = delta_plan(stored, incoming, order=order).agg(F.count_if(F.col("action") == "unchanged").alias("unchanged"), F.count_if(F.col("action") == "insert").alias("inserted"))
    gone = reconcile_plan(stored, incoming).agg(F.count_if("orphan").alias("orphaned"))
    return plan.crossJoin(F.broadcast(gone)).withColumn("churn_percent", F.when(F.col("inserted") > 0, F.bround(100 * F.col("orphaned") / F.col("inserted")).cast("long")))  # one row each


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last writer wins: of rows with one key the one with the highest order stays, changes before stored rows on ties."""
    rows = stored.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def cache_lookup(requests: DataFrame, cache: DataFrame, version: str, *, key: str = "content_hash") -> DataFrame:
    """requests with the cache's version and payload and outcome: 'exact', 'stale' (newest other version) or 'miss'."""
    ranked = cache.withColumn("_exact", F.col("extractor_version") == version)
    w = Window.partitionBy(key).orderBy(F.desc("_exact"), F.desc("extracted_at"), F.desc("extractor_version"))
    best = ranked.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(key, "extractor_version", "payload", "_exact")
    rows = requests.join(best, key, "left")
    return rows.withColumn("outcome", F.when(F.col("extractor_version").isNull(), "miss").when(F.col("_exact"), "exact").otherwise("stale")).drop("_exact")


def within_budget(rows: DataFrame, wanted: Column, budget: int, *, by: list[str], order: list[str]) -> DataFrame:
    """granted: the first `budget` wanted rows of each group in order; budget 0 grants all."""
    w = Window.partitionBy(*by, wanted).orderBy(*order)
    return rows.withColumn("granted", wanted & ((F.row_number().over(w) <= budget) | (F.lit(budget) == 0)))


def purge(cache: DataFrame, scope: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """What stays of a cache without the rows of a scope (column: value), and one row with how many went."""
    hit = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in scope.items()])
    return cache.where(~hit), cache.agg(F.count_if(hit).alias("purged"))


def force_rebuild(stored: DataFrame, incoming: DataFrame, context: str = "context") -> DataFrame:
    """stored with every context that comes anew replaced as a whole."""
    return stored.join(incoming.select(context).distinct(), context, "left_anti").unionByName(incoming)


def upsert_ids(known: DataFrame, names: DataFrame, keys: list[str], now: str) -> DataFrame:
    """known(keys, id, updated_at) with names: a known key keeps its id and gets a new time, new ones follow in order of the keys.

    New ids go on from the greatest known one.
    """
    came = names.select(*keys).distinct()
    both = known.join(came.withColumn("_came", F.lit(True)), keys, "left")
    kept = both.select(*keys, "id", F.when(F.col("_came"), F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"))
    new = numbered(came.join(known.select(*keys), keys, "left_anti"), keys, "_rn")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    return kept.unionByName(new.crossJoin(F.broadcast(top)).select(*keys, (F.col("_top") + F.col("_rn")).alias("id"), F.lit(now).alias("updated_at")))  # top is one row


def backfill(rows: DataFrame, column: str, constants: dict[str, str], *, context: str = "context", content: str = "content", pattern: str = r"^# (\S+)") -> DataFrame:
    """Nulls of a column filled: a fixed value for each listed context, else what the pattern captures; filled rows stay."""
    fixed = F.lit(None).cast("string")
    for name, value in constants.items():
        fixed = F.when(F.col(context) == name, F.lit(value)).otherwise(fixed)
    return rows.withColumn(column, F.coalesce(column, fixed, F.nullif(F.regexp_extract(content, pattern, 1), F.lit(""))))


def latest_runs(events: DataFrame, *, run: str = "run_id", order: tuple[str, ...] = ("at", "event_id"), kind: str = "kind") -> DataFrame:
    """Run lifecycle rows from appended events (created, finalized, failed): the latest state, and when it began. Partial aggregation."""
    at = F.struct(*order)
    return events.groupBy(run).agg(F.max_by(kind, at).alias("state"), F.min(order[0]).alias("started_at"), F.max(F.when(F.col(kind) != "created", F.col(order[0]))).alias("ended_at"), F.count("*").alias("n_events"))


def reseed(stored: DataFrame, sections: DataFrame, group: str, *, position: str, force: bool = False) -> DataFrame:
    """stored(group, ordinal, body, active) with new active sections, ordinals from 1. Active rows of such a group are turned off
    with force and refused without."""
    came = sections.select(group).distinct()
    if not force and not stored.where("active").join(came, group, "left_semi").isEmpty():
        raise ActiveRows(f"active rows exist for a {group} that comes anew; force turns them off")
    old = stored.join(came.withColumn("_came", F.lit(True)), group, "left").withColumn("active", F.col("active") & F.col("_came").isNull()).drop("_came")
    ordinal = F.row_number().over(Window.partitionBy(group).orderBy(position)).cast("long")
    return old.unionByName(sections.select(group, ordinal.alias("ordinal"), "body", F.lit(True).alias("active")))


def cache_counters(found: DataFrame, *, outcome: str = "outcome", granted: str = "granted") -> DataFrame:
    """exact, stale, rewarmed, missed and skipped of a cache run: stale and missing rows are extracted only within the budget."""
    wanted = F.col(outcome)
    return found.agg(F.count_if(wanted == "exact").alias("exact"), F.count_if((wanted == "stale") & ~F.col(granted)).alias("stale"), F.count_if((wanted == "stale") & F.col(granted)).alias("rewarmed"), F.count_if((wanted == "miss") & F.col(granted)).alias("missed"), F.count_if((wanted == "miss") & ~F.col(granted)).alias("skipped"))


def append_snapshot(counts: DataFrame, path: str, at: str) -> None:
    """Adds a snapshot under its time; a repeated one replaces itself."""
    counts.write.mode("overwrite").parquet(f"{path}/snapshot_at={at}")


def guard_cold_start(stored: int, upstream: int, most: int = 1000) -> None:
    """Refuses a first scrape of more than `most` items when nothing is stored yet."""
    if not stored and upstream > most:
        raise ColdStart(f"{upstream} items upstream and none stored; load a base first")


def selected_contexts(slugs: list[str], replace: str | None, reindex: bool = False) -> list[str]:
    """Contexts to be rebuilt: 'none', 'all' or one slug; reindex takes all."""
    if reindex or replace == "all":
        return list(slugs)
    if replace in (None, "none"):
        return []
    if replace not in slugs:
        raise ValueError(f"unknown context {replace!r}")
    return [replace]


def snapshot_counts(docs: DataFrame, *, levels: list[str], source: str, doc: Column) -> DataFrame:
    """Distinct documents by levels and source, and by levels alone under source '*'; documents without a name do not count."""
    rows = docs.select(*levels, F.coalesce(source, F.lit("(unknown)")).alias("source_id"), doc.alias("_doc")).where("_doc is not null")
    sets = rows.groupingSets([[*map(F.col, levels), F.col("source_id")], [*map(F.col, levels)]], *levels, "source_id").agg(F.grouping("source_id").alias("_all"), F.count_distinct("_doc").alias("doc_count"))
    return sets.select(*levels, F.when(F.col("_all") == 1, "*").otherwise(F.col("source_id")).alias("source_id"), "doc_count")


def fingerprint(rows: DataFrame, by: list[str], line: Column) -> DataFrame:
    """SHA-256 over the sorted lines of each group, null lines left out: the same for every order of rows.

    Lines are sorted within hash partitions of the groups and digested as they come: only a running state is held of a group.
    """
    lines = rows.select(*by, line.cast("string").alias("_line")).repartition(*by).sortWithinPartitions(*by, "_line")
    kinds = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in by)
    return lines.mapInArrow(_digests(len(by)), f"{kinds}, fingerprint string, n_lines long")


def _digests(width: int):
    import hashlib

    import pyarrow as pa

    def run(batches):
        key, state, n, any_line, done, schema = None, None, 0, False, [], None

        def flush() -> pa.RecordBatch:
            cells = list(zip(*done)) or [()] * (width + 2)
            kinds = [*schema.types[:width], pa.string(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], [*schema.names[:width], "fingerprint", "n_lines"])

        for batch in batches:
            schema = batch.schema
            for *now, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if key is not None:
                        done.append((*key, state.hexdigest(), n))
                    key, state, n, any_line = now, hashlib.sha256(), 0, False
                n += 1
                if text is not None:
                    state.update(b"\n" * any_line + text.encode())
                    any_line = True
            if len(done) > 10_000:
                yield flush()
        if key is not None:
            done.append((*key, state.hexdigest(), n))
        if done:
            yield flush()

    return run


def numbered(rows: DataFrame, order: list[str], name: str = "_n") -> DataFrame:
    """rows with their place in order, from 1: places inside range partitions, and the counts of the partitions before."""
    placed = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    heads = placed.groupBy("_part").agg(F.count("*").alias("_rows")).withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).select("_part", "_before")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_in", inside).join(F.broadcast(heads), "_part").select(*rows.columns, (F.col("_before") + F.col("_in")).alias(name))


def link_fingerprint(links: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(F.filter(links, lambda x: x != ""))), "\n"), 256)


def live_or_seed(live: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Live rows, and seed rows whose key is not among them."""
    return live.unionByName(seed.join(live.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def reuse_split(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """rows with reuse: whether stored has all of the keys already."""
    known = stored.select(*keys).distinct().withColumn("_k", F.lit(True))
    return rows.join(known, keys, "left").withColumn("reuse", F.col("_k").isNotNull()).drop("_k")


class CoverageShrunk(RuntimeError):
    """A source came back with far fewer rows than before."""


class ActiveRows(RuntimeError):
    """Active rows would be replaced without being asked to."""


class ColdStart(RuntimeError):
    """Too much to fetch with nothing stored."""


class EmptyUpstream(RuntimeError):
    """A source came back empty, so nothing may be overwritten with it."""


def guard_coverage(n: int, floor: int, before: int | None = None, share: float = 0.9) -> int:
    if n < floor or (before is not None and n < share * before):
        raise CoverageShrunk(f"{n} rows; expected at least {max(floor, int(share * (before or 0)))}")
    return n
