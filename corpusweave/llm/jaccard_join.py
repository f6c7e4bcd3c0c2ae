"""Exact n-gram Jaccard join at 0.75: classes, number of links and connected components, in time linear in the texts.

Jaccard distance is a metric, but nearly all pairs of documents lie at distance 1, where no pivot can tell them apart. So the
join first finds the groups inside which distances say something, and joins these by pivots:

1. Screening. A document sends a third of its shingles, the least hashes, to the shuffle, each shingle once for a block of
   documents however many hold it. A document with a link shares at least least_shared() of them with others; most share less
   and are done.
2. Groups. Documents left are ordered by exact shingle frequencies among them. Two linked ones share one of their first
   quarter of shingles, rare ones first; what hangs together by these is a group, and no link leaves it.
3. Voronoi regions. A group of more than REGION_MEMBERS documents takes pivots. A document belongs to the region of its nearest pivot, or to the
   rest region if all are farther than twice the threshold distance, and is copied to every region where the triangle
   inequality leaves room for a link. Regions recurse with new pivots. A region that pivots cannot split (all its documents
   are alike) is joined in blocks of CELL_MEMBERS documents, mostly one.
4. Every region is joined exactly in its own task; each document is counted in its own region only.

Rows that carry pairs are never made. Hot shingles are combined within blocks of documents, exact copies are one node, and
memory is bounded by BLOCK_SHINGLES and CELL_MEMBERS (a text larger than that is a block of its own).

Defined cases: null or blank text has an empty set and links with nothing (component_id is its own doc_id, n_links 0); fewer
words than the shingle size form one shingle; equal sets are one class, told by 128 bits; shingles are 64-bit hashes; repeated
rows and ids are kept, one row out for each row in; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.common import cut, forget, n_parts, small_batches
from corpusweave.llm.components import connected_components
from corpusweave.llm.shingles import SHINGLE_WORDS, SIMILARITY_PERCENT, shingle_set

#: Shingles that a task holds at once while it combines equal ones.
BLOCK_SHINGLES = 500_000
#: A region of more documents, or shingles, than this takes pivots.
REGION_MEMBERS, CELL_SHINGLES = 32, 2_000_000
#: Documents in a block of a region that pivots cannot split.
CELL_MEMBERS = 1024
#: Pivots of a region: twice the root of its size, within these bounds.
PIVOTS = 16, 256
#: Pivots split a region if its largest part has less than this share of it and the parts together no more than so many times its rows.
SHRINK, COPIES = 0.7, 3
#: The screen sends one shingle in so many of a set beyond those that a prefix filter needs.
EXTRA = 12
#: Lists of ids up to this length (16 bytes each) are broadcast, longer ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
ROWS_OUT = 1 << 17

DOC = pa.struct([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int32()), ("twin", pa.int64()), ("local", pa.int32()), ("least", pa.int32())])
DOC_SQL = "struct<doc_id: long, mark: long, n: int, twin: long, local: int, least: int>"
MEMBER = "cell long, node long, n int, role int, shingles binary"
QUERY, TARGET = 1, 2


def _up(a, b):
    """a / b, rounded up."""
    return -(-a // b)


def overlap(a, b, percent: int):
    """Shingles that sets of a and b shingles must share to be linked."""
    return _up(percent * (a + b), 100 + percent)


def sent(n, percent: int):
    """Shingles of a set of n that the screen sends."""
    return np.minimum(n, n - _up(percent * n, 100) + 1 + _up(n, EXTRA))


@lru_cache(100_000)
def least_shared(n: int, percent: int) -> int:
    """Of what a set of n sends, the shingles at least that it shares with what a linked set sends.

    Of the two ordered lists sent, the one that ends first meets in the other all it shares with the other set.
    """
    m = np.arange(_up(percent * n, 100), 100 * n // percent + 1)
    need = overlap(n, m, percent)
    return max(1, int(min((sent(n, percent) - n + need).min(), (sent(m, percent) - m + need).min())))


def _identity(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set; the first is never 0."""
    raw = shingles.tobytes()
    node, twin = xxhash.xxh3_64_intdigest(raw) or 1, xxhash.xxh3_64_intdigest(raw, seed=1)
    return node - (node >> 63 << 64), twin - (twin >> 63 << 64)


# ---- 1. screening


def _send(size: int, percent: int):
    """Rows (key, node, -) of shingles, node 0 if several sets of the block hold it, and (-, node, doc) of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        docs, nodes, held, total = [], {}, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            local = np.zeros(len(nodes), np.int32)
            if held:
                keys, owner = np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])
                order = np.argsort(keys, kind="stable")
                keys, owner = keys[order], owner[order]
                start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                many = np.diff(np.append(start, len(keys))) > 1
                local += np.bincount(owner[np.repeat(many, np.diff(np.append(start, len(keys))))], minlength=len(nodes)).astype(np.int32)
                keys, owner = keys[start].view(np.int64), np.where(many, 0, np.fromiter(nodes, np.int64, len(nodes))[owner[start]])
                for i in range(0, len(keys), ROWS_OUT):
                    k = keys[i : i + ROWS_OUT]
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(owner[i : i + ROWS_OUT]), pa.nulls(len(k), DOC)], ["key", "node", "doc"])
            spread = [((made + i) * 0x9E3779B97F4A7C15 + part * 0xD6E8FEB86659FD93) % 2**63 for i in range(len(docs))]
            made += len(docs)
            rows = [(*d[:4], int(local[d[4]]) if d[4] is not None else 0, least_shared(d[2], percent) if d[2] else 0) for d in docs]
            ids = list(nodes)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), DOC)]
            yield pa.RecordBatch.from_arrays([pa.array(spread, pa.int64()), pa.array([ids[d[4]] if d[4] is not None else None for d in docs], pa.int64()), pa.StructArray.from_arrays(columns, fields=list(DOC))], ["key", "node", "doc"])

        for batch in batches:
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingle_set(text.as_py(), size)
                if not len(s):
                    docs.append((doc, mark, 0, 0, None))
                    continue
                node, twin = _identity(s)
                at = nodes.setdefault(node, len(nodes))
                docs.append((doc, mark, len(s), twin, at))
                if at == len(held):
                    held.append(s[: int(sent(len(s), percent))])
                    total += len(held[-1])
                if total >= BLOCK_SHINGLES:
                    yield from flush()
                    docs, nodes, held, total = [], {}, [], 0
        if docs:
            yield from flush()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: how many keys of a node were sent by others too, summed within the task; documents pass."""
    tail = np.empty((2, 0), np.int64)
    credit, waiting = [], 0

    def shared(rows: np.ndarray) -> np.ndarray:
        keys, nodes = rows
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        often = np.minimum.reduceat(nodes, start) != np.maximum.reduceat(nodes, start)
        inside = np.repeat(often, np.diff(np.append(start, len(keys)))) & (nodes != 0)
        keys, nodes = keys[inside], nodes[inside]
        order = np.lexsort((nodes, keys))  # copies in several blocks send a key for one node each
        keys, nodes = keys[order], nodes[order]
        return nodes[np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])] if len(keys) else nodes

    def counted() -> pa.RecordBatch:
        nodes, n = np.unique(np.concatenate(credit), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(n.astype(np.int32)), pa.nulls(len(nodes), DOC)], ["node", "shared", "doc"])

    for batch in batches:
        doc = batch.column("doc")
        of_docs = doc.is_valid()
        if batch.num_rows != doc.null_count:
            docs = batch.filter(of_docs)
            yield pa.RecordBatch.from_arrays([docs.column("node"), pa.nulls(docs.num_rows, pa.int32()), docs.column("doc")], ["node", "shared", "doc"])
        keep = ~of_docs.to_numpy(zero_copy_only=False)
        rows = np.stack([batch.column("key").to_numpy()[keep], batch.column("node").to_numpy(zero_copy_only=False)[keep].astype(np.int64)])
        rows = np.concatenate([tail, rows], axis=1)
        if not rows.shape[1]:
            continue
        cutoff = np.searchsorted(rows[0], rows[0, -1])
        tail = rows[:, cutoff:]
        if cutoff:
            credit.append(shared(rows[:, :cutoff]))
            waiting += len(credit[-1])
            if waiting > BLOCK_SHINGLES:
                yield counted()
                credit, waiting = [], 0
    if tail.shape[1]:
        credit.append(shared(tail))
    if credit:
        yield counted()


def _screen(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (node, shared, -) and (node, -, doc)."""
    rows = texts.mapInArrow(_send(size, percent), f"key long, node long, doc {DOC_SQL}")
    rows = rows.repartition(n_parts(texts.sparkSession), "key").sortWithinPartitions("key")
    return cut(rows.mapInArrow(_meet, f"node long, shared int, doc {DOC_SQL}"), "jaccard-screen")


# ---- 2. groups


def _pack(size: int):
    """Sets of texts, many in a row: block, and the sets' nodes, sizes and shingles end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, total = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pa.RecordBatch:
            nodes = np.array([_identity(s)[0] for s in held], np.int64)
            cells = [nodes.tobytes(), np.array([len(s) for s in held], np.int32).tobytes(), np.concatenate(held).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]], ["block", "nodes", "sizes", "shingles"])

        for batch in batches:
            for text in batch.column(0):
                held.append(shingle_set(text.as_py(), size))
                total += len(held[-1])
                if total >= BLOCK_SHINGLES:
                    yield packed()
                    block, held, total = block + 1, [], 0
        if total:
            yield packed()

    return run


PACKED = "block long, nodes binary, sizes binary, shingles binary"


def _opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["nodes"].as_py(), np.int64), np.frombuffer(row["sizes"].as_py(), np.int32), np.frombuffer(row["shingles"].as_py(), np.uint64)


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    for i in range(table.num_rows):
        yield {name: table.column(name)[i] for name in table.schema.names}


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in _rows(batch):
            keys, n = np.unique(_opened(row)[2], return_counts=True)
            for i in range(0, len(keys), ROWS_OUT):
                k = keys[i : i + ROWS_OUT].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), row["block"].as_py())), pa.array(k), pa.array(n[i : i + ROWS_OUT].astype(np.int32))], ["block", "key", "n"])


def _prefixes(percent: int):
    """Of each set of a block, the shared shingles among its first ones in the order (frequency, shingle).

    first: whether the set can be the smaller one of a pair whose first common shingle this is.
    """

    def run(own: pa.Table, often: pa.Table) -> pa.Table:
        out = []
        keys, df = often.column("key").to_numpy().view(np.uint64), often.column("df").to_numpy()
        order = np.argsort(keys)
        keys, df = keys[order], df[order]
        for row in _rows(own) if len(keys) else ():
            nodes, sizes, s = _opened(row)
            at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
            f = np.where(keys[at] == s, df[at], 1)
            owner = np.repeat(np.arange(len(nodes)), sizes)
            order = np.lexsort((s, f, owner))
            n = sizes[owner].astype(np.int64)
            pos = np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            s, f = s[order], f[order]
            keep = (f > 1) & (pos <= n - _up(percent * n, 100))
            first = pos <= n - overlap(n, n, percent)
            out.append((s[keep].view(np.int64), nodes[owner[keep]], first[keep]))
        key, node, first = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        return pa.table({"key": key, "node": node, "first": first})

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in _rows(batch):
            nodes, sizes, s = _opened(row)
            ends = np.cumsum(sizes)
            for i in range(0, len(nodes), 64):
                sets = [s[b - a : b].tobytes() for a, b in zip(sizes[i : i + 64], ends[i : i + 64])]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 64]), pa.array(sizes[i : i + 64]), pa.array(sets, pa.binary())], ["node", "n", "shingles"])


def _groups(own: DataFrame, percent: int) -> DataFrame:
    """(node, comp) of the sets that hang together by a shared rare shingle."""
    counts = own.mapInArrow(_block_counts, "block long, key long, n int")  # a key has at most one row for a block
    often = counts.withColumn("df", F.sum("n").over(Window.partitionBy("key"))).where("df > 1").select("block", "key", "df")
    prefixes = own.groupBy("block").cogroup(often.groupBy("block")).applyInArrow(_prefixes(percent), "key long, node long, first boolean")
    prefixes = cut(prefixes, "jaccard-prefixes")
    hubs = prefixes.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other"), F.bool_or("first").alias("first")).where("hub <> other and first")
    edges = prefixes.join(hubs.select("key", "hub"), "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    found = cut(connected_components(edges), "jaccard-groups")
    forget(prefixes)
    return found


# ---- 3. Voronoi regions


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets a with sets b, by products of incidence matrices, some columns at a time."""
    both = a + b
    ids = np.unique(np.concatenate(both), return_inverse=True)[1]
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    in_a = row < len(a)
    n = ids.max() + 1
    used = (np.bincount(ids[in_a], minlength=n) > 0) & (np.bincount(ids[~in_a], minlength=n) > 0)
    keep = used[ids]
    ids, row = (np.cumsum(used) - 1)[ids[keep]], row[keep]
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], row[order]
    out = np.zeros((len(a), len(b)), np.float32)
    width = max(64, (1 << 22) // len(both))
    for lo in range(0, int(used.sum()), width):
        i, j = np.searchsorted(ids, [lo, lo + width])
        m = np.zeros((len(both), width), np.float32)
        m[row[i:j], ids[i:j] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out.astype(np.int64)


def _sets_of(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(s.as_py(), np.uint64) for s in table.column("shingles")]


def _regions(percent: int, level: int):
    """One chunk of a region with the region's pivots: every document's row in its own part and in those it may link into."""
    tau = 1 - percent / 100
    radius = 2 * tau

    def run(table: pa.Table) -> pa.Table:
        is_pivot = table.column("pivot").to_numpy(zero_copy_only=False)
        pivots, rows = table.filter(pa.array(is_pivot)).sort_by("node"), table.filter(pa.array(~is_pivot))
        parent = table.column("cell")[0].as_py()
        ids, sizes, sets = pivots.column("node").to_numpy(), pivots.column("n").to_numpy(), _sets_of(pivots)
        net: list[int] = []  # pivots nearer than the threshold to an earlier one split nothing
        if sets:
            among = overlaps(sets, sets)
            for i in range(len(sets)):
                if all(among[i, j] < (1 - tau) * (sizes[i] + sizes[j] - among[i, j]) for j in net):
                    net.append(i)
        roles = rows.column("role").to_numpy()
        d = np.ones((rows.num_rows, len(net)))
        if net and rows.num_rows:
            both = overlaps(_sets_of(rows), [sets[i] for i in net])
            d = 1 - both / (rows.column("n").to_numpy()[:, None] + sizes[net][None, :] - both)
        nearest = d.min(1, initial=1.0)
        home = np.where(nearest <= radius, d.argmin(1) if net else 0, len(net))  # the last part is the rest region
        room = np.concatenate([d <= np.minimum(radius, nearest + tau)[:, None] + tau + 1e-9, (nearest > radius - tau - 1e-9)[:, None]], axis=1)
        room[np.arange(len(home)), home] = True
        at, part = np.nonzero(room)
        role = np.where(home[at] == part, roles[at], TARGET)
        cells = [xxhash.xxh3_64_intdigest(f"{parent}:{level}:{ids[net[k]] if k < len(net) else 'rest'}") >> 1 for k in range(len(net) + 1)]
        taken = rows.take(pa.array(at))
        columns = {"cell": pa.array(np.array(cells, np.int64)[part]), "parent": pa.array(np.full(len(at), parent))}
        return pa.table(columns | {"node": taken.column("node"), "n": taken.column("n"), "role": pa.array(role.astype(np.int32)), "shingles": taken.column("shingles")})

    return run


def _sizes(members: DataFrame, *more: str) -> DataFrame:
    return members.groupBy("cell", *more).agg(F.count("*").alias("k"), F.sum("n").alias("weight"))


def _too_big(members: int, shingles: int) -> Column:
    return (F.col("k") > members) | (F.col("weight") > shingles)


def _cells(members: DataFrame, percent: int, region_members: int, cell_members: int, cell_shingles: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """members in cells small enough for a task each; and the written tables that these are read from."""
    done, written, level = [], [members], 0
    while True:
        big = cut(_sizes(members).where(_too_big(region_members, cell_shingles)).select("cell", "k", F.greatest(F.ceil(F.col("k") / cell_members), F.ceil(F.col("weight") / cell_shingles)).cast("int").alias("chunks")), "jaccard-big")
        done.append(members.join(big, "cell", "left_anti"))
        if big.isEmpty():
            return done, written
        rows = members.join(big, "cell").withColumn("h", F.xxhash64("node", F.lit(level)))
        spread = rows.withColumn("chunk", F.pmod("h", "chunks")).withColumn("pivot", F.lit(False))
        pivots = rows.where(F.col("role") == QUERY | TARGET).where(F.pmod(F.shiftrightunsigned("h", 8), "k") < F.least(F.lit(PIVOTS[1]), F.greatest(F.lit(PIVOTS[0]), F.ceil(2 * F.sqrt("k")))))
        pivots = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("pivot", F.lit(True))
        both = spread.unionByName(pivots).select("cell", "chunk", "pivot", "node", "n", "role", "shingles")
        parts = cut(both.groupBy("cell", "chunk").applyInArrow(_regions(percent, level), f"parent long, {MEMBER}"), "jaccard-regions")
        made = _sizes(parts, "parent").groupBy("parent").agg(F.max("k").alias("largest"), F.sum("k").alias("all")).join(big.withColumnRenamed("cell", "parent"), "parent")
        split = cut(made.where((F.col("largest") <= SHRINK * F.col("k")) & (F.col("all") <= COPIES * F.col("k"))).select(F.col("parent").alias("cell")), "jaccard-split")
        # What pivots cannot split is joined chunk by chunk: queries of one chunk with targets of another.
        dense = rows.join(split, "cell", "left_anti").withColumn("own", F.pmod("h", "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        asks = dense.where(F.col("role").bitwiseAND(QUERY) > 0).select("cell", F.col("own").alias("i"), F.col("other").alias("j"), "node", "n", F.when(F.col("own") == F.col("other"), QUERY | TARGET).otherwise(QUERY).alias("role"), "shingles")
        told = dense.where((F.col("own") != F.col("other")) | (F.col("role") == TARGET)).select("cell", F.col("other").alias("i"), F.col("own").alias("j"), "node", "n", F.lit(TARGET).alias("role"), "shingles")
        done.append(asks.unionByName(told).select(F.xxhash64("cell", "i", "j", F.lit(level)).alias("cell"), "node", "n", "role", "shingles"))
        members = parts.join(split.withColumnRenamed("cell", "parent"), "parent", "left_semi").select("cell", "node", "n", "role", "shingles")
        written += [parts, big, split]
        level += 1


# ---- 4. join


def _links(percent: int):
    """Of one cell: each linked document, the least node it hangs together with here, and (for queries) its number of links."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes, n, role, sets = table.column("node").to_numpy(), table.column("n").to_numpy(), table.column("role").to_numpy(), _sets_of(table)
        q, t = np.flatnonzero(role & QUERY), np.flatnonzero(role & TARGET)
        linked = np.zeros((len(q), len(t)), bool)
        if len(q) and len(t):
            both = overlaps([sets[i] for i in q], [sets[i] for i in t])
            linked = (100 * both >= percent * (n[q][:, None] + n[t][None, :] - both)) & (nodes[q][:, None] != nodes[t][None, :])
        x, y = np.nonzero(linked)
        x, y = q[x], t[y]
        root = np.arange(len(nodes))
        while True:  # least label of the neighbours, with pointer jumping
            new = root.copy()
            np.minimum.at(new, x, root[y])
            np.minimum.at(new, y, root[x])
            new = new[new]
            if (new == root).all():
                break
            root = new
        seen = np.unique(np.concatenate([x, y]))
        return pa.table({"node": nodes[seen], "root": nodes[root[seen]], "links": np.bincount(x, minlength=len(nodes))[seen].astype(np.int64)})

    return run


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT, region_members: int = REGION_MEMBERS, cell_members: int = CELL_MEMBERS, cell_shingles: int = CELL_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """The join, as two written tables: one row for each row of docs, and one for each set with links.

    Rows of docs: doc_id, mark (hash of the text), n (size of the set), node and twin (identity of the set; node null if empty).
    Sets: node, comp (the component's least node), links (different sets that it is linked with).
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    screened = _screen(texts, size, percent)
    rows = screened.where("doc is not null").select("doc.doc_id", "doc.mark", "doc.n", "node", "doc.twin")

    likely = screened.where("node is not null").groupBy("node").agg(F.sum("shared").alias("shared"), F.max("doc.local").alias("local"), F.max("doc.least").alias("least"), F.min(F.when(F.col("doc").isNotNull(), F.struct("doc.doc_id", "doc.mark"))).alias("of"))
    likely = cut(likely.where(F.coalesce("shared", F.lit(0)) + F.col("local") >= F.col("least")).select("of.*"), "jaccard-likely")
    few = likely.count() <= BROADCAST_ROWS
    found = (F.broadcast(likely) if few else likely).withColumnsRenamed({"doc_id": "of_id", "mark": "of_mark"})
    left = texts.join(found, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")), "left_semi")
    own = cut(left.select("text").mapInArrow(_pack(size), PACKED), "jaccard-own")
    forget(likely)

    groups = _groups(own, percent)
    few = groups.count() <= BROADCAST_ROWS
    members = own.mapInArrow(_unpack, "node long, n int, shingles binary").join(F.broadcast(groups) if few else groups, "node").dropDuplicates(["node"])
    members = cut(members.select(F.col("comp").alias("cell"), "node", "n", F.lit(QUERY | TARGET).alias("role"), "shingles"), "jaccard-members")
    forget(own)
    forget(groups)

    cells, written = _cells(members, percent, region_members, cell_members, cell_shingles)
    links = [c.groupBy("cell").applyInArrow(_links(percent), "node long, root long, links long") for c in cells]
    linked = links[0]
    for more in links[1:]:
        linked = linked.unionByName(more)
    linked = cut(linked, "jaccard-links")
    for t in written:
        forget(t)
    comps = connected_components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sets = cut(linked.groupBy("node").agg(F.sum("links").alias("links")).join(comps, "node"), "jaccard-sets")
    forget(linked)
    return rows, sets


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links), class_id (smallest
    doc_id with the same set) and n_links (different sets that its set is linked with)."""
    rows, sets = jaccard_classes(docs, **options)
    classes = rows.where("n > 0").groupBy("node", "twin").agg(F.min("doc_id").alias("class_id")).join(sets, "node", "left")
    classes = classes.withColumn("comp", F.coalesce("comp", "node"))
    least = classes.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    classes = classes.join(least, "comp").select(F.col("node").alias("c_node"), F.col("twin").alias("c_twin"), "class_id", "component_id", "links")
    out = rows.join(classes, (F.col("node") == F.col("c_node")) & (F.col("twin") == F.col("c_twin")), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """docs without the near copies: of each component one row stays, the one with the smallest doc_id, all columns kept.

    A null doc_id comes after all others. Rows are told apart by doc_id and text: of rows that repeat both, one stays; rows
    without words stay as they are.
    """
    rows, sets = jaccard_classes(docs, **options)
    rows = rows.where("n > 0").join(sets.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = rows.withColumn("who", F.struct(F.col("doc_id").isNull(), "doc_id", "mark"))
    best = rows.groupBy("comp").agg(F.min("who").alias("best"), F.count("*").alias("all")).where("all > 1")
    # Kept rows go through a join with what leaves: rows of a larger component that are not its first, and repeats of a first.
    spare = rows.join(best, "comp").groupBy("doc_id", "mark").agg(F.max(F.col("who") == F.col("best")).alias("first"), F.count("*").alias("times"))
    spare = cut(spare.where("not first or times > 1").select(F.col("doc_id").alias("s_id"), F.col("mark").alias("s_mark"), "first"), "jaccard-spare")
    given = docs.select(F.struct("*").alias("row"))
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    same = F.col(f"row.{id_col}").cast("long").eqNullSafe(F.col("s_id")) & (F.xxhash64(F.col(f"row.{text_col}").cast("string")) == F.col("s_mark"))
    repeats = spare.where("first")
    few = spare.count() <= BROADCAST_ROWS
    kept = given.join(F.broadcast(spare) if few else spare, same, "left_anti")
    once = given.join(F.broadcast(repeats) if few else repeats, same, "inner").groupBy("s_id", "s_mark").agg(F.first("row").alias("row")).select("row")
    return kept.unionByName(once).select("row.*")
