"""Cross-tokenizer alignment: two encodings of the same bytes, cut into groups wherever tokens of both end.

Shared cuts are found by divide and conquer. In an interval of tokens of A, the ends of tokens of B are searched by bisection for
the end of the middle token, then for those next to it on either side, until one is common; there the interval is cut and both
halves are treated in the same way. An interval without a common end is a leaf group. All intervals of one depth are searched
at once, and all texts of an Arrow batch are one interval at first (a text's end is a common end).

align() writes what the other operators and other programs read: ids of both encodings and a bit for each token that ends
a group. Links are pairs of tokens that end together. link_counts() counts them over the corpus by pair of ids. When two
tokens end together, the bytes of one are the end of the other's, so there are at most as many pairs as the two vocabularies
have (piece, end of it) pairs (pair_bound()), whatever the corpus; only this table is broadcast.

A is a byte-level BPE file of the tokenizers library over space and text; B a sentencepiece file, which adds that space.
Words between spaces are encoded once and kept in bounded caches where the files allow that (no piece of B joins text over a
space, A's pre-tokenizer neither).

Defined cases: a text that is null or empty, or whose joined bytes of A or B differ from space and text, has no tokens; special
strings inside texts are plain text; texts are taken whole, a task's memory is linear in the longest; null ids and repeated rows
are rows of their own; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import cut, small_batches
from corpusweave.llm.token_output import _BYTE_LEVEL, _ODD_SPACE, PieceCache, PieceEncoder

ALIGNED = "doc_id long, a_ids binary, b_ids binary, a_ends binary, b_ends binary"
#: Longer words are not kept.
MOST_CHARS = 64
_CHUNK = re.compile(" +[^ ]*")
_ENCODERS: dict = {}


class WordCache(PieceCache):
    """Longer words are made anew each time."""

    def __missing__(self, piece: str) -> bytes:
        return super().__missing__(piece) if len(piece) <= MOST_CHARS else self.make(piece)


class SpacedEncoder(PieceEncoder):
    """Ids of a space and a text by a byte-level file, special strings as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tok.encode_special_tokens = True
        self.special = []
        self.first, self.spaced = WordCache(self._first), WordCache(self._spaced)
        plain = {c: b for b, c in _BYTE_LEVEL.items()}
        pieces = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        self.bytes = [bytes(plain[c] for c in p) if all(c in plain for c in p) else p.encode() for p in pieces]
        self.lengths = np.array([len(p) for p in self.bytes], np.int64)

    def encode(self, text: str) -> bytes:
        if not self.by_pieces or _ODD_SPACE.search(text):
            return self._whole(" " + text)
        out = []
        lines = text.split("\n")
        for i, line in enumerate(lines):
            words = line.split(" ")
            if "" in words:
                return self._whole(" " + text)
            if i:
                out += (self.newline, self.first[words[0]])
                out.extend(map(self.spaced.__getitem__, words[1:]))
            else:
                out.extend(map(self.spaced.__getitem__, words))
        return b"".join(out)


class SentenceEncoder:
    """Ids of a text by a sentencepiece file that adds a space in front; None if its bytes are not space and text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=path)
        self.size = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(p) for p in self.bytes], np.int64)
        self.by_words = not any(re.search("[^▁]▁", p) for p in pieces)
        self.by_lines = not any("\n" in p for p in pieces)
        #: Marks that no piece joins to a letter before them.
        self.marks = "".join(m for m in ",.;:!?" if not any(re.search(rf"[^\W\d_]{re.escape(m)}", p) for p in pieces))
        self.spaced, self.first = WordCache(self._spaced), WordCache(self._first)
        self.blank, self.newline = self._ids("\n")[:4], self._ids("\n")[4:]

    def _ids(self, text: str) -> bytes:
        return array("I", self.sp.encode(text, num_threads=1)).tobytes()

    def _checked(self, text: str) -> bytes:
        ids = self.sp.encode(text, num_threads=1)
        if b"".join(map(self.bytes.__getitem__, ids)) != b" " + text.encode():
            raise ValueError
        return array("I", ids).tobytes()

    def _spaced(self, word: str) -> bytes:
        if word[-1:] in self.marks and word[:-1].isalpha():
            return self.spaced[word[:-1]] + self.first[word[-1]]
        return self._checked(word)

    def _first(self, word: str) -> bytes:
        return self._checked("\n" + word)[4 + len(self.newline) :] if word else b""

    def encode(self, text: str) -> bytes | None:
        try:
            if not self.by_words:
                return self._checked(text)
            if not self.by_lines or text[0] in " \n" or text[-1] == " " or any(x in text for x in ("  ", " \n", "\n ")):
                return b"".join([self._checked(c[1:]) if len(c) > 1 else self.blank for c in _CHUNK.findall(" " + text)])
            out = []
            for i, line in enumerate(text.split("\n")):
                words = line.split(" ")
                if i:
                    out += (self.newline, self.first[words[0]])
                    out.extend(map(self.spaced.__getitem__, words[1:]))
                else:
                    out.extend(map(self.spaced.__getitem__, words))
            return b"".join(out)
        except ValueError:
            return None


def encoders(a: str, b: str) -> tuple[SpacedEncoder, SentenceEncoder]:
    if (a, b) not in _ENCODERS:
        _ENCODERS[a, b] = SpacedEncoder(a), SentenceEncoder(b)
    return _ENCODERS[a, b]


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of A and of B that end where a token of the other ends. Ends rise strictly; the last ones are equal."""
    if not len(ends_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts_a, cuts_b = [np.array([len(ends_a) - 1])], [np.array([len(ends_b) - 1])]
    # Intervals of tokens that may end inside: [a0, a1) of A and [b0, b1) of B.
    a0, a1, b0, b1 = (np.array([x]) for x in (0, len(ends_a) - 1, 0, len(ends_b) - 1))
    while True:
        some = (a0 < a1) & (b0 < b1)
        a0, a1, b0, b1 = a0[some], a1[some], b0[some], b1[some]
        if not len(a0):
            break
        middle = (a0 + a1) // 2
        at_a, at_b = np.full(len(a0), -1), np.full(len(a0), -1)
        open_, step = np.arange(len(a0)), 0
        while len(open_):
            for way in (1, -1) if step else (1,):
                tried = middle[open_] + way * step
                inside = (tried >= a0[open_]) & (tried < a1[open_])
                asked, tried = open_[inside], tried[inside]
                found = np.searchsorted(ends_b, ends_a[tried])  # the last ends are equal: a place always
                hit = ends_b[found] == ends_a[tried]
                at_a[asked[hit]], at_b[asked[hit]] = tried[hit], found[hit]
                open_ = open_[at_a[open_] < 0]
            step += 1
            open_ = open_[(middle[open_] + step < a1[open_]) | (middle[open_] - step >= a0[open_])]
        cut_ = at_a >= 0
        a0, a1, b0, b1, at_a, at_b = (x[cut_] for x in (a0, a1, b0, b1, at_a, at_b))
        cuts_a.append(at_a)
        cuts_b.append(at_b)
        # Both halves side by side: intervals stay in the order of the text.
        a0, a1, b0, b1 = (np.stack(halves, 1).ravel() for halves in ((a0, at_a + 1), (at_a, a1), (b0, at_b + 1), (at_b, b1)))
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = encoders(path_a, path_b)
        for batch in batches:
            a, b = [], []
            for text in batch.column(1).to_pylist():
                other = two.encode(text) if text else None
                own = one.encode(text) if other is not None else b""
                if other is not None and int(one.lengths[np.frombuffer(own, "<u4")].sum()) != 1 + len(text.encode()):
                    own, other = b"", b""
                a.append(own)
                b.append(other or b"")
            ids_a, ids_b = np.frombuffer(b"".join(a), "<u4"), np.frombuffer(b"".join(b), "<u4")
            cut_a, cut_b = shared_cuts(np.cumsum(one.lengths[ids_a]), np.cumsum(two.lengths[ids_b]))
            columns = [batch.column(0)]
            for parts, ids, cuts, size in ((a, ids_a, cut_a, len(one.bytes)), (b, ids_b, cut_b, two.size)):
                to = np.cumsum([len(p) // 4 for p in parts])
                narrow, flags = ids.astype(width(size)), np.zeros(len(ids), bool)
                flags[cuts] = True
                rows = list(zip([0, *to[:-1].tolist()], to.tolist()))
                columns.append((pa.array([narrow[i:j].tobytes() for i, j in rows], pa.binary()), pa.array([np.packbits(flags[i:j]).tobytes() for i, j in rows], pa.binary())))
            yield pa.RecordBatch.from_arrays([columns[0], columns[1][0], columns[2][0], columns[1][1], columns[2][1]], [f.split(" ")[0] for f in ALIGNED.split(", ")])

    return run


def width(size: int) -> str:
    return "<u2" if size <= 65536 else "<u4"


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """doc_id, ids of both encodings (little-endian, 2 bytes an id up to 65,536 ids, else 4), and a bit for each token: a group ends here."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_align(tokenizer_a, tokenizer_b), ALIGNED)


class _Rows:
    """The tokens of a batch of align() as flat arrays: ids, group ends, and the number of tokens of each row."""

    def __init__(self, batch: pa.RecordBatch, widths: tuple[str, str]):
        self.ids, self.ends, self.sizes = [], [], []
        for kind, name in zip(widths, "ab"):
            raw, bits = batch.column(f"{name}_ids").to_pylist(), batch.column(f"{name}_ends").to_pylist()
            sizes = [len(r) // int(kind[2:]) for r in raw]
            self.ids.append(np.frombuffer(b"".join(raw), kind))
            self.ends.append(np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(bits, sizes))]).astype(bool))
            self.sizes.append(np.array(sizes, np.int64))

    def links(self) -> np.ndarray:
        """A's id in the upper, B's in the lower half: tokens that end together."""
        return (self.ids[0][self.ends[0]].astype(np.int64) << 32) | self.ids[1][self.ends[1]]

    def per_row(self, of: int, values: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(values))
        to = np.cumsum(self.sizes[of])
        return total[to] - total[to - self.sizes[of]]


def link_counts(aligned: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """pair (A's id in the upper 32 bits, B's in the lower) and n, how many links of the corpus it has; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = encoders(tokenizer_a, tokenizer_b)
        widths = width(len(one.bytes)), width(two.size)
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new, n = np.unique(_Rows(batch, widths).links(), return_counts=True)
            merged, place = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            pairs, counts = merged, np.bincount(place, np.concatenate([counts, n]), len(merged)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    return aligned.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_bound(tokenizer_a: str, tokenizer_b: str) -> int:
    """How many pairs of ids can be linked at all: the bytes of one are an end of the other's."""
    one, two = encoders(tokenizer_a, tokenizer_b)
    return sum(len(p) for p in one.bytes) * max(1, _most_alike(two.bytes)) + sum(len(p) for p in two.bytes) * max(1, _most_alike(one.bytes))


def _most_alike(pieces: list[bytes]) -> int:
    """The most ids that share their bytes (a byte of its own and a character, say)."""
    count: dict[bytes, int] = {}
    for p in pieces:
        count[p] = count.get(p, 0) + 1
    return max(count.values(), default=1)


def alignment_digests(aligned: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of align()."""
    # Sorted by pair, with the highest count of each B id beside it: one row a pair, at most pair_bound() of them.
    table = link_counts(aligned, tokenizer_a, tokenizer_b).toArrow()
    if table.num_rows > pair_bound(tokenizer_a, tokenizer_b):
        raise RuntimeError("more linked pairs than the two vocabularies allow: the files of the tasks differ")
    by = np.argsort(pairs := table["pair"].to_numpy())
    pairs, counts = pairs[by], table["n"].to_numpy()[by]
    highest = np.zeros(1 + int((pairs & 0xFFFFFFFF).max(initial=0)), np.int64)
    np.maximum.at(highest, pairs & 0xFFFFFFFF, counts)
    shared = aligned.sparkSession.sparkContext.broadcast((pairs, counts, counts == highest[pairs & 0xFFFFFFFF]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = encoders(tokenizer_a, tokenizer_b)
        pairs, counts, best = shared.value
        n_a = len(one.bytes)
        words = [f"{i}{mark}" for mark in ",|;" for i in range(max(n_a, two.size))]
        word = np.array([0, 1, 0, 2]) * max(n_a, two.size)  # A inside, A at a group's end, B inside, B at a group's end
        for batch in batches:
            rows = _Rows(batch, (width(n_a), width(two.size)))
            (ids_a, ids_b), (ends_a, ends_b), (size_a, size_b) = rows.ids, rows.ends, rows.sizes
            # A group's tokens of A stand before those of B: a token moves on by the other's tokens before its group, or up to its end.
            cut_a, cut_b = np.flatnonzero(ends_a) + 1, np.flatnonzero(ends_b) + 1
            group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
            line = np.empty(len(ids_a) + len(ids_b), np.int64)
            line[np.arange(len(ids_a)) + np.append(0, cut_b)[group_a]] = ids_a + word[ends_a.astype(int)]
            line[np.arange(len(ids_b)) + cut_a[group_b]] = ids_b + word[2 + ends_b.astype(int)]
            to = np.cumsum(size_a + size_b).tolist()
            digests = ["" if i == j else hashlib.sha256("".join(map(words.__getitem__, line[i:j].tolist()))[:-1].encode()).hexdigest() for i, j in zip([0, *to[:-1]], to)]
            at = np.searchsorted(pairs, rows.links())
            n_groups = rows.per_row(0, ends_a)
            spread = lambda v: rows.per_row(0, _put(ends_a, v))
            columns = [size_a, size_b, n_groups, n_groups, spread(best[at]), spread(counts[at])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string())], names)

    return aligned.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _put(where: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(where), np.int64)
    out[where] = values
    return out


def token_alignment(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """Alignments of all texts, written once to the shared folder, and their digests."""
    return alignment_digests(cut(align(docs, tokenizer_a, tokenizer_b), "aligned", codec="zstd"), tokenizer_a, tokenizer_b)
