"""Transcripts and section trees: turns from lines, carried-over agenda, nesting by depth, section bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment(lines: DataFrame, *, by: str, pos: str, header: Column, text: Column, agenda: Column) -> DataFrame:
    """One row per turn: a header line starts it, the lines up to the next header are its body; the last agenda line carries over.

    Lines before the first header and turns with a blank body are dropped.
    """
    w = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumns({"_h": header.cast("boolean"), "_t": text, "_a": agenda})
    rows = rows.withColumn("turn_no", F.sum(F.when(F.col("_h"), 1).otherwise(0)).over(w)).withColumn("agenda", F.last("_a", ignorenulls=True).over(w))
    rows = rows.where("turn_no > 0")
    body = F.sort_array(F.collect_list(F.when(~F.col("_h") & F.col("_a").isNull(), F.struct(pos, "_t"))))
    turns = rows.groupBy(by, "turn_no").agg(F.max(F.when(F.col("_h"), F.col("_t"))).alias("speaker"), F.max_by("agenda", F.when(F.col("_h"), F.lit(1)).otherwise(F.lit(0))).alias("agenda"), F.array_join(F.transform(body, lambda s: s["_t"]), "\n").alias("text"), F.size(body).alias("n_paragraphs"))
    return turns.where(F.trim("text") != "")


def forward_fill(rows: DataFrame, *, by: str, pos: str, value: str, out: str) -> DataFrame:
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))


def bounds(rows: DataFrame, *, by: str, start: str, out: str = "next_start") -> DataFrame:
    """Where the next section starts; null for the last."""
    return rows.withColumn(out, F.lead(start).over(Window.partitionBy(by).orderBy(start)))


def parents(items: DataFrame, *, by: str, pos: str, depth: str, most: int | None = None) -> DataFrame:
    """parent_pos: the last earlier item with a smaller depth. One running maximum per depth level, no self-join.

    most is the number of levels; without it, it is taken from the data.
    """
    most = most or max(items.agg(F.coalesce(F.max(depth), F.lit(0))).first()[0] + 1, 1)
    w = Window.partitionBy(by).orderBy(pos).rangeBetween(Window.unboundedPreceding, -1)
    seen = [F.max(F.when(F.col(depth) == d, F.col(pos))).over(w) for d in range(most)]
    rows = items.withColumn("_seen", F.array(*seen))
    return rows.withColumn("parent_pos", F.array_max(F.slice("_seen", 1, F.least(F.greatest(F.col(depth), F.lit(0)), F.lit(most))))).drop("_seen")


def speaker(line: Column) -> Column:
    """struct<name, party> of 'Name (party):', titles in front removed by the caller."""
    bare = F.regexp_replace(F.regexp_replace(line, "<<[^>]*>>", ""), r"^[\s:\-]+|[\s:\-]+$", "")
    return F.struct(F.trim(F.regexp_replace(bare, r"\s*\([^)]*\)\s*$", "")).alias("name"), F.nullif(F.regexp_extract(bare, r"\(([^)]*)\)\s*$", 1), F.lit("")).alias("party"))


def render_section(doc: Column, path: Column, content: Column) -> Column:
    """Markdown: '# doc', a heading for each ancestor (array<struct<name, depth>>), then the content."""
    heads = F.transform(path, lambda p: F.concat(F.repeat(F.lit("#"), F.least(p["depth"] + 1, F.lit(6))), F.lit(" "), p["name"]))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), doc), F.array_join(heads, "\n\n"), content)


@dataclass(frozen=True)
class HeadRules:
    """Patterns of a protocol's head, tried on trimmed lines. The defaults are the wording of the protocols."""

    number: str = r"הכנסת\s+ה?(\S+)"
    not_number: str = "מושב"
    label: str = "^פרוטוקול|ישיבה"
    committee: str = r"(ועדת\s+\S+(?:\s+\S+){0,3})"
    date: str = r"(?=.*\d{4})(?:.*תשפ|.*\d{1,2}\s+ב[א-ת]+)"
    block: str = "נכחו|חברי הוועדה"
    longest_name: int = 60


def heads(lines: DataFrame, *, by: str, pos: str, text: str, header: Column, rules: HeadRules = HeadRules()) -> DataFrame:
    """number, label, committee, date (of the first line that has each) and participants, from the lines before the first turn header.

    A block of names begins after a line that names it and ends with a line that is too long or ends with a colon. Blank lines say
    nothing; a document without lines before its first header has no row; fields that are not found are null, participants then empty.
    The names of a document are gathered, its lines are not.
    """
    whole, so_far = Window.partitionBy(by), Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("_t")
    rows = lines.select(by, pos, F.regexp_replace(text, r"^\s+|\s+$", "").alias("_t"), header.alias("_h")).where("_t <> ''")
    rows = rows.withColumn("_body", F.min(F.when(F.col("_h"), F.col(pos))).over(whole)).where(F.col("_body").isNull() | (F.col(pos) < F.col("_body")))
    turn = F.when(F.rlike(t, F.lit(rules.block)), True).when((F.length(t) > rules.longest_name) | F.endswith(t, F.lit(":")), False)
    rows = rows.withColumn("_turn", turn).withColumn("_in", F.last("_turn", ignorenulls=True).over(so_far))
    first = lambda value, found: F.min_by(value, F.when(found, F.col(pos)))
    number = F.rlike(t, F.lit(rules.number)) & ~F.rlike(t, F.lit(rules.not_number))
    names = F.sort_array(F.collect_list(F.when(F.col("_in") & F.col("_turn").isNull(), F.struct(pos, "_t"))))
    return rows.groupBy(by).agg(
        first(F.regexp_extract(t, rules.number, 1), number).alias("number"), first(t, F.rlike(t, F.lit(rules.label))).alias("label"),
        first(F.regexp_extract(t, rules.committee, 1), F.rlike(t, F.lit(rules.committee))).alias("committee"),
        first(t, F.rlike(t, F.lit(rules.date))).alias("date"), F.transform(names, lambda n: n["_t"]).alias("participants"),
    )
