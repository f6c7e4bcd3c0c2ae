"""Queries of deep containment, and of documents that become many records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.catalogue import query, read
from corpusweave.operators import containment, records


def _metadata(events: DataFrame) -> DataFrame:
    """Events with their metadata as nested JSON: kind, user with the event's own properties, tags."""
    props = F.from_json("props", "k long")
    tags = F.array(F.col("event_type"), F.concat(F.lit("v"), F.floor("value").cast("string")))
    user = F.struct(F.col("user_id").alias("id"), props.alias("props"))
    return events.select("event_id", "event_type", props["k"].alias("k"), F.to_json(F.struct(F.col("event_type").alias("type"), user.alias("user"), tags.alias("tags"))).alias("meta"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n_events FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2")
def contained_patterns(spark, sf_dir):
    """For each tag and property that occur together, the events whose nested metadata contains both."""
    rows = _metadata(read(spark, sf_dir, "events"))
    asked = rows.where("k is not null").select("event_type", "k").distinct()
    asked = asked.withColumn("pattern", F.to_json(F.struct(F.array("event_type").alias("tags"), F.struct(F.struct("k").alias("props")).alias("user"))))
    pairs = containment.contained_pairs(rows, asked, id_col="event_id", json_col="meta", pattern_id="pattern", pattern_col="pattern")
    return pairs.groupBy("pattern").agg(F.count("*").alias("n_events")).join(asked, "pattern").select("event_type", "k", "n_events")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND floor(value) = 12 AND CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL")
def contained_filter(spark, sf_dir):
    """Events whose metadata contains one nested pattern, tested in built-in functions."""
    rows = _metadata(read(spark, sf_dir, "events"))
    return rows.where(containment.contains(F.col("meta"), {"type": "click", "tags": ["v12", "click"], "user": {"props": {}}})).select("event_id")


@query("""WITH t AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no, role || ':' AS speaker, text FROM conversations)
SELECT doc, turn_no, speaker, text, len(string_split(text, chr(10))) AS n_paragraphs FROM t WHERE trim(text, ' ' || chr(10)) <> ''""")
def turn_records(spark, sf_dir):
    """Turns of all conversations, from their lines, by the table function."""
    c = read(spark, sf_dir, "conversations")
    said = F.concat(F.array(F.concat("role", F.lit(":"))), F.split("text", "\n"))
    lines = c.select(F.col("conv_id").alias("doc"), "turn", F.posexplode(said).alias("line", "text"))
    lines = lines.select("doc", F.struct("turn", "line").alias("pos"), (F.col("line") == 0).alias("header"), F.lit(None).cast("string").alias("agenda"), "text")
    return records.turns(lines).where(F.trim("text", F.lit(" \n")) != "").select("doc", "turn_no", "speaker", "text", "n_paragraphs")
