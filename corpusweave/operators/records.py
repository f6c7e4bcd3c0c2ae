"""One document to many records as a table function: turns of a transcript from its ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

LINE = ("doc", "pos", "header", "agenda", "text")


@udtf
class Turns:
    """Lines (doc, pos, header, agenda, text) to turns (doc, turn_no, speaker, agenda, text, n_paragraphs).

    Its analysis asks for lines of one document together, by pos, and gives doc the type that it came with. A task
    holds the lines of one turn. In SQL: SELECT * FROM turns(TABLE(lines)) after register().
    """

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable:
            raise ValueError("turns() takes a table of lines")
        given = {f.name: f.dataType for f in lines.dataType.fields}
        missing = [c for c in LINE if c not in given]
        if missing:
            raise ValueError(f"turns() needs the columns {', '.join(LINE)}; missing: {', '.join(missing)}")
        schema = T.StructType().add("doc", given["doc"]).add("turn_no", "long").add("speaker", "string").add("agenda", "string").add("text", "string").add("n_paragraphs", "integer")
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc")], orderBy=[OrderingColumn("pos")])

    def __init__(self):
        self.turn_no, self.agenda, self.head, self.body = 0, None, None, []

    def _turn(self):
        text = "\n".join(t for t in self.body if t is not None)
        if self.turn_no and text.strip(" "):
            doc, speaker, agenda = self.head
            yield doc, self.turn_no, speaker, agenda, text, len(self.body)

    def eval(self, line):
        if line["agenda"] is not None:
            self.agenda = line["agenda"]
        if line["header"]:
            yield from self._turn()
            self.turn_no, self.head, self.body = self.turn_no + 1, (line["doc"], line["text"], self.agenda), []
        elif line["agenda"] is None:
            self.body.append(line["text"])

    def terminate(self):
        yield from self._turn()


def turns(lines: DataFrame) -> DataFrame:
    """Turns of the lines (doc, pos, header, agenda, text; more columns are ignored), as operators.turns.segment() gives them.

    A header line starts a turn, the lines up to the next one are its body; the last agenda line carries over. Lines before the
    first header and turns with a blank body are dropped, but counted in turn_no; null texts add no line, but count as paragraphs.
    Lines of one pos come in any order.
    """
    return Turns(lines.select(*LINE).withColumn("header", F.col("header").cast("boolean")).asTable())


def register(spark, name: str = "turns") -> None:
    """Make the table function known to SQL."""
    spark.udtf.register(name, Turns)
