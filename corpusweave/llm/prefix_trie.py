"""Conversation prefix trie by time-forward processing.

A node is a distinct sequence of turns (role and text), known by its depth and a 128-bit fingerprint: the XOR of hashes of
(depth, role, text) over the sequence, so prefixes come from running XORs in two levels (by block of turns, then over blocks)
and one conversation with a third of all rows is spread over tasks. Texts are dropped once they are hashed. Members of a node
are combined before the shuffle, so a first turn or a copy that most conversations share is one row a task.

Totals of subtrees go from children to parents through time: the nodes of a shard (a range of conversations, with all nodes on
their paths) are sorted externally in reverse level order; each takes the messages of its children from a priority queue that
spills sorted runs to the task's disk, adds its own, and sends the total to its parent. Nodes that several shards hold, the
roots and tops of their tries, get one partial total from each; these are added up by node across the shards. A node with one
member needs no message: its subtree is a path with one leaf and nothing saved, so long unshared tails never enter a queue. A
path of shared turns is handled by one task in bounded memory.

rebuild() makes the conversations of the contract: the first h = crc32(conv_id) % 6 turns of conversation conv_id - conv_id % 100,
then the own turns after the first h.

Defined cases: null role and text are empty; turns are ordered null first, ties by role and text; rows with a null conv_id belong
to no conversation and are left out; repeated rows are turns of their own; texts of any length are hashed in the JVM; extra
columns are ignored; an empty table gives no node, not even the root.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.chat import _numbered
from corpusweave.llm.common import cut

HEAD_TURNS = 6
FAMILY = 100
TURN_BLOCK = 1024
QUEUE_MESSAGES = 200_000
TEXT_CHUNK = 1 << 16
PARTIAL = "depth long, ka long, kb long, n_leaves long, saved long"
_EMPTY = hashlib.sha256().hexdigest()


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, chars, ha, hb) of every turn of the rebuilt conversations, depths from 1; and (conv_id, n_turns) of all."""
    rows = _numbered(turns.where(F.col("conv_id").isNotNull()).withColumn("conv_id", F.col("conv_id").cast("long")))
    hashed = lambda salt: F.xxhash64(F.lit(salt), "role", "text")
    rows = cut(rows.select("conv_id", F.col("pos").cast("long").alias("pos"), F.length("text").cast("long").alias("chars"), hashed("a").alias("ha"), hashed("b").alias("hb")), "trie-turns")
    h = F.crc32(F.col("conv_id").cast("string")) % HEAD_TURNS
    convs = rows.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    # At most HEAD_TURNS - 1 rows of a base conversation, gathered into one row.
    heads = rows.where((F.col("pos") < HEAD_TURNS) & (F.col("conv_id") % FAMILY == 0)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "chars", "ha", "hb"))).alias("head"))
    convs = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
    convs = cut(convs.select("conv_id", "h", "head", F.size("head").cast("long").alias("m"), (F.size("head") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).cast("long").alias("n_turns")), "trie-convs")
    first = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.chars", "t.ha", "t.hb")
    own = rows.join(convs.select("conv_id", "h", "m"), "conv_id").where("pos > h").select("conv_id", (F.col("m") + F.col("pos") - F.col("h")).alias("depth"), "chars", "ha", "hb")
    return first.unionByName(own), convs.select("conv_id", "n_turns")


def memberships(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each conversation and node on its path, root included: conv_id, depth, ka, kb (the node), pa, pb (its parent),
    chars of the node's last text, last (the path ends here)."""
    own = lambda c: F.xxhash64(F.lit(c), "depth", f"h{c}")
    rows = turns.select("conv_id", "depth", "chars", own("a").alias("ha"), own("b").alias("hb")).withColumn("block", F.floor((F.col("depth") - 1) / TURN_BLOCK))
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"))
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"x{c}").over(before), zero).alias(f"x{c}") for c in "ab"])
    rows = rows.select("*", *[F.bit_xor(f"h{c}").over(upto).alias(f"w{c}") for c in "ab"]).join(blocks, ["conv_id", "block"]).join(convs, "conv_id")
    keys = {f"k{c}": F.col(f"w{c}").bitwiseXOR(F.col(f"x{c}")) for c in "ab"}
    rows = rows.withColumns(keys).withColumns({f"p{c}": F.col(f"k{c}").bitwiseXOR(F.col(f"h{c}")) for c in "ab"})
    nothing = F.lit(None).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), nothing.alias("pa"), nothing.alias("pb"), zero.alias("chars"), (F.col("n_turns") == 0).alias("last"))
    return roots.unionByName(rows.select("conv_id", "depth", "ka", "kb", "pa", "pb", "chars", (F.col("depth") == F.col("n_turns")).alias("last")))


class SpillingQueue:
    """Messages (time, ka, kb, leaves, saved) in rising order; those beyond `limit` wait in sorted runs on the task's own disk."""

    def __init__(self, limit: int = QUEUE_MESSAGES):
        self.limit, self.heap, self.files = limit, [], []
        self.fronts: list[tuple[tuple, int]] = []  # the least message of each run, and the run
        self.runs: list[Iterator[tuple]] = []

    def push(self, message: tuple) -> None:
        if len(self.heap) >= self.limit:
            self._spill()
        heapq.heappush(self.heap, message)

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()  # deleted with the task, or with its worker
        np.array(sorted(self.heap), np.int64).tofile(file)
        file.seek(0)
        self.heap.clear()
        self.files.append(file)
        self.runs.append(self._read(file))
        self._front(len(self.runs) - 1)

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        while raw := file.read(40 << 10):
            yield from map(tuple, np.frombuffer(raw, np.int64).reshape(-1, 5).tolist())
        file.close()

    def _front(self, run: int) -> None:
        message = next(self.runs[run], None)
        if message is not None:
            heapq.heappush(self.fronts, (message, run))

    def take(self, key: tuple) -> tuple[int, int]:
        """The sum of all messages to this key. Keys are asked for in rising order; earlier messages are gone by then."""
        leaves = saved = 0
        while self.heap and self.heap[0][:3] <= key:
            message = heapq.heappop(self.heap)
            leaves, saved = leaves + message[3], saved + message[4]
        while self.fronts and self.fronts[0][0][:3] <= key:
            message, run = heapq.heappop(self.fronts)
            self._front(run)
            leaves, saved = leaves + message[3], saved + message[4]
        return leaves, saved


def _forward(limit: int):
    """Rows (depth, ka, kb, pa, pb, leaf, saved) of one shard by falling depth and key; a node's rows stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, node, own, done = SpillingQueue(limit), None, (0, 0), []

        def close() -> None:
            depth, ka, kb, up_a, up_b = node
            leaves, saved = queue.take((-depth, ka, kb))
            leaves, saved = leaves + own[0], saved + own[1]
            if leaves or saved:
                done.append((depth, ka, kb, leaves, saved))
                if up_a is not None:
                    queue.push((1 - depth, up_a, up_b, leaves, saved))

        for batch in batches:
            for depth, ka, kb, up_a, up_b, leaf, saved in zip(*(c.to_pylist() for c in batch.columns)):
                now = depth, ka, kb, up_a, up_b
                if now != node:
                    if node is not None:
                        close()
                    node, own = now, (0, 0)
                own = own[0] + leaf, own[1] + saved
            if len(done) > 10_000:
                yield _partials(done)
                done.clear()
        if node is not None:
            close()
        if done:
            yield _partials(done)

    return run


def _partials(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], ["depth", "ka", "kb", "n_leaves", "saved"])


def subtree_totals(members: DataFrame, nodes: DataFrame, limit: int = QUEUE_MESSAGES) -> DataFrame:
    """depth, ka, kb, n_leaves and saved (over the subtree) of all nodes with two or more members, and of tops of tails."""
    # A node stands once, with its smallest member; on other paths of a shard it only passes messages on.
    values = nodes.select("conv_id", "depth", F.col("n_children").isNull().cast("long").alias("leaf"), "own", "tail", "top")
    paths = members.select("conv_id", "depth", "ka", "kb", "pa", "pb").join(values, ["conv_id", "depth"], "left").where(F.col("tail").isNull() | ~F.col("tail") | F.col("top"))
    # The first node of a tail has one leaf below it.
    leaf = F.when(F.col("tail"), F.lit(1)).otherwise(F.coalesce("leaf", F.lit(0))).cast("long")
    shards = paths.select("conv_id", "depth", "ka", "kb", "pa", "pb", leaf.alias("leaf"), F.coalesce("own", F.lit(0)).cast("long").alias("saved")).repartitionByRange("conv_id")
    shards = shards.sortWithinPartitions(F.col("depth").desc(), "ka", "kb").drop("conv_id")
    partial = shards.mapInArrow(_forward(limit), PARTIAL)
    return partial.groupBy("depth", "ka", "kb").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, ka, kb, conv_id) in order -> (depth, ka, kb, conv_id of the first, comma-joined ids) of TEXT_CHUNK characters or so."""
    node, first, ids, size, done = None, None, [], 0, []
    for batch in batches:
        for depth, ka, kb, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, ka, kb) != node or size > TEXT_CHUNK:
                if ids:
                    done.append((*node, first, ",".join(ids)))
                node, first, ids, size = (depth, ka, kb), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if len(done) > 10_000:
            yield _joined(done)
            done.clear()
    if ids:
        done.append((*node, first, ",".join(ids)))
    if done:
        yield _joined(done)


def _joined(done: list[tuple]) -> pa.RecordBatch:
    *numbers, texts = zip(*done)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(texts, pa.string())], ["depth", "ka", "kb", "first", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a node in order -> one digest; only its running state is held."""
    node, state = None, None
    for batch in batches:
        done = []
        for depth, ka, kb, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "ka", "kb", "ids"))):
            if (depth, ka, kb) == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (depth, ka, kb), hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield _digested(done)
    if node is not None:
        yield _digested([(*node, state.hexdigest())])


def _digested(done: list[tuple]) -> pa.RecordBatch:
    *keys, hexes = zip(*done)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in keys), pa.array(hexes, pa.string())], ["depth", "ka", "kb", "ends_sha256"])


def end_digests(members: DataFrame) -> DataFrame:
    """depth, ka, kb, ends_sha256 of nodes at which conversations end. Ids are joined in range partitions first, so a node at which
    a third of all conversations end reaches its digest in few rows; SHA-256 itself reads them in order."""
    ends = members.where("last").select("depth", "ka", "kb", "conv_id").repartitionByRange("depth", "ka", "kb", "conv_id").sortWithinPartitions("depth", "ka", "kb", "conv_id")
    chunks = ends.mapInArrow(_chunks, "depth long, ka long, kb long, first long, ids string")
    return chunks.repartition("depth", "ka", "kb").sortWithinPartitions("depth", "ka", "kb", "first").mapInArrow(_digest, "depth long, ka long, kb long, ends_sha256 string")


def trie_nodes(members: DataFrame, limit: int = QUEUE_MESSAGES) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    key = ["depth", "ka", "kb"]
    found = cut(members.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("chars").alias("chars")), "trie-nodes")
    above = found.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb"))
    children = above.groupBy(*key).agg(F.count("*").alias("n_children"))
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_convs"))
    nodes = found.join(children, key, "left").join(parents, ["depth", "pa", "pb"], "left")
    tail = F.col("n_convs") == 1
    # With one conversation only, the root itself is the top of its tail.
    nodes = nodes.select(*key, "conv_id", "parent_conv_id", "n_convs", "n_children", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), tail.alias("tail"), (tail & F.coalesce(F.col("parent_convs") > 1, F.lit(True))).alias("top"))
    nodes = cut(nodes, "trie-linked")
    totals = subtree_totals(members, nodes, limit)
    rows = nodes.join(totals, key, "left").join(end_digests(members), key, "left")
    whole = lambda c, one: F.when(F.col("tail"), F.lit(one)).otherwise(F.col(c)).cast("long")
    return rows.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n_convs").cast("long").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        whole("n_leaves", 1).alias("n_leaves"), whole("saved", 0).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, limit: int = QUEUE_MESSAGES) -> DataFrame:
    """The trie of the rebuilt conversations: one row for each node."""
    return trie_nodes(cut(memberships(*rebuild(turns)), "trie-members"), limit)
