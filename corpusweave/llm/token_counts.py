"""Token counts by compiled finite-state transducers whose chunk maps compose in a parallel prefix scan.

WordTransducer is compiled from the vocabulary and the merges of a BPE file, one state and one transition at a time as texts ask
for them. A state is what the next symbols can depend on: the longest end of the word so far that begins a vocabulary piece, and
for each place in it the piece that ends there and the tokens up to it. A transition reads one symbol and is annotated with the
change of the number of tokens; the last symbol of a word has transitions of its own. It is deterministic because a sequence of
pieces is what the merges make of a word exactly if each two neighbours are what the merges make of the two alone.

FieldTransducer takes the transitions of whole fields (what lies between ASCII white space, which leads back to the start
state) as composed ones and keeps them in a bounded table. A chunk of text cut anywhere is a map (head, count, tail): head still
needs the state that the chunk before it ends in, and tail is the state it leaves; a chunk without a place where the state is
known is a bare string. Maps form a monoid and compose in a tree. Texts over LONG_CHARS are dealt chunk by chunk over the tasks.

The library normalizes and splits fields that are not plain ASCII, and counts fields with special strings.

Defined cases: null text is an empty one (no tokens); long texts are counted whole; special strings inside a text count as the
library's default has it; repeated rows, null ids and extra columns pass through; an empty table gives none. A run of one class
of characters without any break is read in one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import cut, small_batches

CHUNK_CHARS = 1 << 16
LONG_CHARS = 1 << 20
LIMIT = 2048
_TABLE_ROWS = 300_000
_MAX_STATES = 500_000
_END = "</w>"
_LAST = 0x10000
_MACHINES: dict = {}
#: Pieces of an ASCII field in lower case, as the file's own split has them.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Between these two, a piece ends and another begins whatever stands before: letter and mark, digit and anything.
_BREAK = re.compile(r"(?<=[A-Za-z])(?=[!-/:-@\[-`{-~])|(?<=[0-9])(?=[!-~])|(?<=[!-~])(?=[0-9])")


class WordTransducer:
    """Token counts of one word (a piece of the pre-tokenizer, in its byte alphabet)."""

    def __init__(self, vocabulary: list[str], merges: list):
        single = lambda piece: piece[: -len(_END) - 1] + chr(ord(piece[-len(_END) - 1]) + _LAST) if piece.endswith(_END) and len(piece) > len(_END) else piece
        self.pieces = {single(p) for p in vocabulary}
        self.begins = {p[:i] for p in self.pieces for i in range(len(p) + 1)}
        self.rank = {tuple(map(single, m if isinstance(m, list) else m.split(" "))): i for i, m in enumerate(merges)}
        self.clear()

    def clear(self) -> None:
        self.neighbours: dict[tuple[str, str], bool] = {}
        self.number = {("", (None,), (0,)): 0}
        self.states = [("", (None,), (0,))]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def merged(self, symbols: str) -> list[str]:
        """What the merges make of a few symbols: the best ranked pair first, the leftmost of equal ones."""
        out = list(symbols)
        while len(out) > 1:
            best = min(range(len(out) - 1), key=lambda i: self.rank.get((out[i], out[i + 1]), 1 << 40))
            if (out[best], out[best + 1]) not in self.rank:
                break
            out[best : best + 2] = [out[best] + out[best + 1]]
        return out

    def fit(self, a: str | None, b: str) -> bool:
        """Whether b may follow a."""
        if a is None:
            return self.merged(b) == [b]
        found = self.neighbours.get((a, b))
        if found is None:
            found = self.neighbours[a, b] = self.merged(a + b) == [a, b]
        return found

    def move(self, state: int, symbol: str) -> tuple[int, int]:
        """Compiles a transition: the next state, and by how many the number of tokens changes."""
        end, last, counts = self.states[state]
        text = end + symbol
        piece, at = next((text[i:], i) for i in range(len(text)) if text[i:] in self.pieces and self.fit(last[i], text[i:]))
        more = counts[at] + 1
        drop = next(i for i in range(len(text) + 1) if text[i:] in self.begins)
        key = (text[drop:], (*last[drop:], piece), tuple(c - more for c in (*counts[drop:], more)))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][symbol] = (to, more)
        return to, more

    def count(self, word: str) -> int:
        if len(self.states) > _MAX_STATES:
            self.clear()
        state = total = 0
        moves = self.moves
        for symbol in (*word[:-1], chr(ord(word[-1]) + _LAST)):
            step = moves[state].get(symbol) or self.move(state, symbol)
            state = step[0]
            total += step[1]
        return total


class FieldTransducer:
    """Emitted-token counts of fields for one word-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        parts = json.loads(self.library.to_str())
        self.words = WordTransducer(list(parts["model"]["vocab"]), parts["model"]["merges"])
        self.special = [t["content"] for t in parts["added_tokens"]]
        self.emits: dict[str, int] = {"": 0}

    def compile(self, fields: set[str]) -> None:
        if len(self.emits) > _TABLE_ROWS:
            self.emits = {"": 0}
        for field in fields:
            self.emits[field] = self._steps(field)

    def _steps(self, field: str) -> int:
        if any(s in field for s in self.special):
            return len(self.library.encode(field, add_special_tokens=False))
        if field.isascii() and field.isprintable():  # the byte alphabet leaves these as they are
            pieces = _PIECES.findall(field.lower())
        else:
            pieces = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(field))]
        return sum(map(self.words.count, pieces))

    def emitted(self, fields: list[str]) -> int:
        try:
            return sum(map(self.emits.__getitem__, fields))
        except KeyError:
            missing = {f for f in fields if f not in self.emits}
            before = self.emits
            self.compile(missing)
            if before is not self.emits:  # the table was renewed
                self.compile(set(fields) - missing - {""})
            return sum(map(self.emits.__getitem__, fields))

    def chunk_map(self, chunk: str) -> str | tuple[str, int, str]:
        """A bare string has no white space or break; else (head, tokens between the first and the last of them, tail)."""
        fields = _flat(chunk).split(" ")
        if len(fields) > 1:
            return fields[0], self.emitted(fields[1:-1]), fields[-1]
        if len(chunk) > 64 and chunk.isascii() and chunk.isprintable() and not any(s[0] in chunk for s in self.special):
            breaks = [m.start() for m in _BREAK.finditer(chunk)]
            if len(breaks) > 1:
                return chunk[: breaks[0]], self._steps(chunk[breaks[0] : breaks[-1]]), chunk[breaks[-1] :]
        return chunk

    def compose(self, a, b):
        if isinstance(a, str):
            return a + b if isinstance(b, str) else (a + b[0], b[1], b[2])
        if isinstance(b, str):
            return a[0], a[1], a[2] + b
        return a[0], a[1] + self.emitted([a[2] + b[0]]) + b[1], b[2]

    def scan(self, maps: list):
        """Composes neighbours level by level: the tree of a parallel prefix scan, whose root is the map of the whole text."""
        while len(maps) > 1:
            paired = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = paired + maps[len(maps) - len(maps) % 2 :]
        return maps[0]

    def total(self, found) -> int:
        return self.emitted([found]) if isinstance(found, str) else self.emitted([found[0], found[2]]) + found[1]

    def count(self, text: str, chunk: int = CHUNK_CHARS) -> int:
        return self.total(self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)] or [""]))


def _flat(text: str) -> str:
    for blank in "\n\t\r\x0b\x0c":
        text = text.replace(blank, " ")
    return text


def transducer(path: str) -> FieldTransducer:
    if path not in _MACHINES:
        _MACHINES[path] = FieldTransducer(path)
    return _MACHINES[path]


def _counts_of_long_texts(rows: DataFrame, tokenizer: str, long_chars: int) -> DataFrame:
    """Chunk maps of texts of many chunks, made chunk by chunk over the tasks, and composed in order for each text."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            found = [machine.scan([machine.chunk_map(t[i : i + CHUNK_CHARS]) for i in range(0, len(t), CHUNK_CHARS)]) for t in map(str, batch.column("chunk"))]
            cells = [(m, None, None) if isinstance(m, str) else m for m in found]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("rid", "doc_id", "n_bytes", "i")], *[pa.array([c[k] for c in cells], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))]], ["rid", "doc_id", "n_bytes", "i", "head", "n", "tail"])

    def composed(table: pa.Table) -> pa.Table:
        machine = transducer(tokenizer)
        rows = table.sort_by("i").to_pylist()
        n = machine.total(machine.scan([r["head"] if r["n"] is None else (r["head"], r["n"], r["tail"]) for r in rows]))
        return pa.table({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "n_bytes": [rows[0]["n_bytes"]], "n_tokens": [n]})

    own = cut(rows.where(F.length("text") > long_chars).withColumn("rid", F.monotonically_increasing_id()), "long-texts")
    chunks = own.select("rid", "doc_id", "n_bytes", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / long_chars)), lambda i: F.substr("text", (i * long_chars + 1).cast("int"), F.lit(long_chars)))).alias("i", "chunk"))
    made = chunks.repartition(F.col("rid"), F.col("i")).mapInArrow(maps, "rid long, doc_id long, n_bytes long, i int, head string, n long, tail string")
    return made.groupBy("rid").applyInArrow(composed, "doc_id long, n_bytes long, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, long_chars: int = LONG_CHARS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            counts = [machine.count(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    short = rows.where(F.col("text").isNull() | (F.length("text") <= long_chars)).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return short.unionByName(_counts_of_long_texts(rows, tokenizer, long_chars)).withColumn("over_limit", F.col("n_tokens") > limit)
