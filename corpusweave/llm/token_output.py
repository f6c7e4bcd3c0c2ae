"""Token-ID / binary output: canonical, length-limited Huffman coding of token ids from global counts.

File format (two Parquet folders, written through Spark's committers, so a lost task is simply run again):
  codebook/  one row: version, max_len, lengths (one byte a token id: bits of its code, 0 = unused id)
  blocks/    one row a block, in ascending doc_id order over (part, block): the documents of the block (ids and numbers of
             tokens), first_token (of all tokens before the block in its part), the bit offset of every CHECKPOINT-th token
             and the bit string. Blocks decode independently; checkpoints let one block decode in parallel lanes.
Codes are canonical (ordered by length, then id), so the lengths alone rebuild the coding and decoding tables.

Defined cases: null text is an empty one (only the end id); a null doc_id sorts first and is kept; repeated rows and ids
are all written (ties in the order of their tokens); extra columns are ignored; an empty table gives empty files.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm.common import cut, forget, n_parts, shared_dir, small_batches

END_ID = 0
MAX_LEN = 16
CHECKPOINT = 128
BLOCK_TOKENS = 1 << 17
_CACHE_PIECES = 350_000
_ODD_SPACE = re.compile(r"[^\S \n]")
_TOKENIZERS: dict = {}


def byte_level() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 and up, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


_BYTE_LEVEL = byte_level()


class PieceEncoder:
    """Ids of a byte-level BPE file of the tokenizers library, as little-endian uint32 bytes.

    The library's byte-level pre-tokenizer never joins text across a single space or line break between other characters, nor a
    run of letters with what follows it. So such pieces go to the library's BPE model by themselves, once each, and are kept
    in a bounded cache of two generations; texts with any other white space or special strings go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        parts = json.loads(self.tok.to_str())
        split = parts["pre_tokenizer"] or {}
        self.by_pieces = parts["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        #: Ids of pieces at the start of a line, and of pieces behind a space (kept without it).
        self.first, self.spaced = PieceCache(self._first), PieceCache(self._spaced)
        self.newline = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        written = word if word.isascii() and word[0] != " " else word.encode().decode("latin-1").translate(_BYTE_LEVEL)
        return array("I", [t.id for t in self.tok.model.tokenize(written)]).tobytes()

    def _first(self, piece: str) -> bytes:
        return self._word(piece) if piece.isalpha() else self._whole(piece)

    def _spaced(self, piece: str) -> bytes:
        """Letters, or letters and one mark behind them, or anything else through the whole library."""
        if piece.isalpha():
            return self._word(" " + piece)
        if piece[-1] in ",.;:!?" and piece[:-1].isalpha():
            return self.spaced[piece[:-1]] + self.first[piece[-1]]
        return self._whole(" " + piece)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_pieces or _ODD_SPACE.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        out = []
        spaced = self.spaced.__getitem__
        for line in text.split("\n"):
            words = line.split(" ")
            if "" in words:  # spaces side by side, at an end, or an empty line
                return self._whole(text)
            out.append(self.newline)
            out.append(self.first[words[0]])
            out.extend(map(spaced, words[1:]))
        return b"".join(out[1:])


class PieceCache(dict):
    """Values made on demand; of the pieces made before the last _CACHE_PIECES, those used since are kept."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.pop(piece, None)
        if found is None:
            found = self.make(piece)
        if len(self) >= _CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


def encoder(path: str) -> PieceEncoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PieceEncoder(path)
    return _TOKENIZERS[path]


def _tokenize(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = []
            for t in batch.column(1):
                raw = np.frombuffer(enc.encode(t.as_py() or "") + end, "<u4")
                ids.append(raw.astype("<u2").tobytes() if enc.size <= 65536 else raw.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids: little-endian, 2 bytes an id if the vocabulary has at most 65,536 ids, else 4."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_tokenize(tokenizer, end_id), "doc_id long, ids binary")


def _width(tokenizer: str) -> str:
    return "<u2" if encoder(tokenizer).size <= 65536 else "<u4"


def _counts(width: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_py(), width), minlength=vocabulary) if len(ids.as_py()) > 40_000 else 0
            small = b"".join(x for x in batch.column(0).to_pylist() if len(x) <= 40_000)
            total += np.bincount(np.frombuffer(small, width), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["id", "n"])

    return run


def code_lengths(counts: np.ndarray, max_len: int = MAX_LEN) -> np.ndarray:
    """Optimal code lengths of at most max_len bits (package-merge); unused ids get 0. One used id gets 1 bit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    max_len = max(max_len, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    # The packages of each level are kept as the number of symbols (the lightest first) they hold: a prefix always.
    level, kinds = weights, []
    for _ in range(max_len - 1):
        packed = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weights, packed])
        by = np.argsort(merged, kind="stable")
        kinds.append(by < len(weights))
        level = merged[by]
    take = 2 * len(used) - 2
    bits = np.zeros(len(used), np.int64)
    for kind in reversed(kinds):
        own = int(kind[:take].sum())
        bits[:own] += 1
        take = 2 * (take - own)
    bits[:take] += 1
    lengths[order] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order of (length, id), and the ids in that order."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    ls = lengths[order].astype(np.int64)
    top = int(ls.max()) if len(ls) else 1
    starts = np.concatenate([[0], np.cumsum(np.int64(1) << (top - ls))])[:-1]
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (starts >> (top - ls)).astype(np.uint64)
    return codes, order


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit string (big-endian 32-bit words) and the bit offset of each CHECKPOINT-th id. Codes have at most 32 bits."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    word = at >> 5
    value = codes[ids] << (np.uint64(64) - (n + (at & 31)).astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(int(ends[-1] + 31) // 32 + 2, np.uint64)
    out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes(), at[::CHECKPOINT]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the next top bits: the id and its code's length."""
    _, order = canonical_codes(lengths)
    ls = lengths[order].astype(np.int64)
    top = int(ls.max()) if len(ls) else 1
    repeat = np.int64(1) << (top - ls)
    ids = np.zeros(1 << top, np.uint32)
    bits = np.ones(1 << top, np.uint8)
    ids[: repeat.sum()] = np.repeat(order, repeat)
    bits[: repeat.sum()] = np.repeat(ls, repeat)
    return ids, bits, top


def unpack(blobs: list[bytes], checks: list[np.ndarray], totals: list[int], table) -> list[np.ndarray]:
    """Decodes blocks side by side: each checkpoint starts a lane, all lanes step through the table together."""
    ids, bits, top = table
    if not blobs:
        return []
    words = np.frombuffer(b"".join(blobs), ">u4").astype(np.uint64)
    base = np.concatenate([[0], np.cumsum([len(b) * 8 for b in blobs])[:-1]]).astype(np.int64)
    at = np.concatenate([c.astype(np.int64) + o for c, o in zip(checks, base)])
    out = np.zeros((len(at), CHECKPOINT), np.uint32)
    last = len(words) - 2
    shift = np.uint64(64 - top)
    for k in range(CHECKPOINT):
        w = np.minimum(at >> 5, last)
        pair = (words[w] << np.uint64(32)) | words[w + 1]
        look = ((pair << (at & 31).astype(np.uint64)) >> shift).astype(np.int64)
        out[:, k] = ids[look]
        at += bits[look]
    lanes = np.concatenate([[0], np.cumsum([len(c) for c in checks])])
    return [out[lanes[i] : lanes[i + 1]].reshape(-1)[: totals[i]] for i in range(len(blobs))]


BLOCKS = "part int, block int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, checkpoints binary, bits binary"


def _write_blocks(book, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.frombuffer(book.value, np.uint8)
        codes, _ = canonical_codes(lengths)
        part, block, first = TaskContext.get().partitionId(), 0, 0
        held, names, sizes, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), width)
            bits, checks = pack(ids, codes, lengths)
            cols = [[part], [block], [first], [total], [list(names)], [list(sizes)], [checks.astype("<u4").tobytes()], [bits]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in BLOCKS.split(", ")])

        step = np.dtype(width).itemsize
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = ids.as_py()
                held.append(raw)
                names.append(doc)
                sizes.append(len(raw) // step)
                total += sizes[-1]
                if total >= BLOCK_TOKENS:
                    yield flush()
                    block, first = block + 1, first + total
                    held, names, sizes, total = [], [], [], 0
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = END_ID, max_len: int = MAX_LEN) -> str:
    """Tokenizes every whole text once, counts ids over all documents, and writes codebook/ and blocks/ under path."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = max(encoder(tokenizer).size, end_id + 1)
    width = _width(tokenizer)
    ids = cut(tokenize(docs, tokenizer, end_id), "token-ids", codec="zstd")
    rows = ids.select("ids").mapInArrow(_counts(width, vocabulary), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    counts = np.zeros(vocabulary, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    lengths = code_lengths(counts, max_len)
    spark.createDataFrame([(1, int(lengths.max()) if len(lengths) else 0, bytearray(lengths.tobytes()))], "version int, max_len int, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast(lengths.tobytes())
    ordered = ids.repartitionByRange(n_parts(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(_write_blocks(book, width), BLOCKS).write.parquet(f"{path}/blocks")
    forget(ids)
    return path


def _digest(book, starts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(np.frombuffer(book.value, np.uint8))
        for rows in (batch.slice(i, 16).to_pylist() for batch in batches for i in range(0, batch.num_rows, 16)):
            decoded = unpack([r["bits"] for r in rows], [np.frombuffer(r["checkpoints"], "<u4") for r in rows], [r["n_tokens"] for r in rows], table)
            docs, start, n, crc = [], [], [], []
            for r, ids in zip(rows, decoded):
                raw = memoryview(ids.astype("<u4").tobytes())
                at, base = 0, starts[r["part"]] + r["first_token"]
                for doc, size in zip(r["doc_ids"], r["doc_tokens"]):
                    docs.append(doc)
                    start.append(base + at)
                    n.append(size)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, start, n, crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, bytes, dict[int, int]]:
    """The blocks, the code lengths, and the tokens before each part (one number a part, from the blocks' headers)."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    lengths = bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"])
    starts, total = {}, 0
    for part, n in sorted(blocks.groupBy("part").agg(F.sum("n_tokens")).collect()):
        starts[part], total = total, total + n
    return blocks, lengths, starts


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the files: doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian uint32) of every document."""
    small_batches(spark)
    blocks, lengths, starts = read_blocks(spark, path)
    return blocks.mapInArrow(_digest(spark.sparkContext.broadcast(lengths), starts), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    spark = docs.sparkSession
    return read_digests(spark, write_token_files(docs, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", tokenizer, **options))
