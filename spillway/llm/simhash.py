"""SimHash near-dedup by a hierarchical index over fingerprints in Gray order.

All fingerprints are sorted by Gray rank, so that neighbours share most of their bits. The index is a tree over that order: leaves of
``LEAF`` fingerprints, upper nodes over ``FAN`` children, chunks of ``chunk`` fingerprints, and above these nodes of ``TOP``
children. A node is a mask of bits that all fingerprints below it share, and their pattern; within a chunk a child keeps only what it
shares beyond its parent. The levels above chunks are small tables: pairs of nodes that differ by too much in the bits both share are
pruned, the others give way to their children, down to pairs of chunks, each a task of its own. There, each leaf's group searches with
the bits it shares and adds up the differences on its way down; a group whose sum is above the limit is pruned as a whole. So is
a group that is linked with the searching one already, since only components are asked for: a dense group of near copies costs one
search, not all its pairs. The leaves that are left are compared bit by bit. Every task returns a forest of links.

The limit may depend on how many bits have been looked at (``limits``): constant, it finds every pair within that distance.

Defined results: a null or empty text, or one of white space, has fingerprint zero, linked like any other; equal
fingerprints are one component; rows with a null ``doc_id`` get a fingerprint, and a component shared with rows that
have an id takes the smallest such id (null if there is none); repeated rows stay; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spillway.llm.common import documents, small_batches, table
from spillway.llm.components import components

WORDS, SEED, DISTANCE = 3, 42, 3
#: Fingerprints of a leaf, children of an upper node within a chunk, fingerprints of a chunk, children of a node above chunks. Larger chunks
#: mean fewer copies of a fingerprint: each goes to the tasks of all chunks that its own isn't pruned against.
LEAF, FAN, CHUNK, TOP = 32, 8, 1 << 18, 64
#: Tasks that pairs of chunks are dealt to at most; pairs of leaves looked at once; shingles hashed at once.
MAX_TASKS, PAIRS, RUN = 20_000, 256, 1 << 16


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> bytes:
    """Eight bytes, the first bit being the highest."""
    own = text.lower().split()
    if not own:
        return bytes(8)
    joined = b" ".join(own)
    start = list(accumulate((len(w) + 1 for w in own), initial=0))
    ends = start[words:] if len(own) >= words else start[-1:]
    ones, n, digest = np.zeros(64, np.int64), len(ends), xxhash.xxh64_digest
    for at in range(0, n, RUN):
        hashes = b"".join([digest(joined[a : b - 1], seed) for a, b in zip(start[at : at + RUN], ends[at : at + RUN])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long)."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = b"".join([fingerprint(x.as_py() or b"") for x in b.column(1).cast(pa.large_binary())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(made, ">i8").astype("<i8"))], ["doc_id", "fp"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the sequence in which neighbours differ by one bit."""
    rank = fp.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_rank_column(fp: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


class Forest:
    """Disjoint sets over 0..n-1, many links at a time; the root is the smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


class Index:
    """The nodes over one array of fingerprints in Gray order, level by level from the leaves."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        both, either = fps, fps
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        width = LEAF
        while True:
            cut = np.arange(0, len(both), width)
            both, either = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(either, cut)
            levels.append((both, ~(both ^ either)))
            width = FAN
            if len(both) == 1:
                break
        self.leaves = levels[0]
        self.levels = []  # from the root: pattern, mask less the parent's mask
        for depth, (pattern, mask) in enumerate(reversed(levels)):
            above = levels[len(levels) - depth][1][np.arange(len(mask)) // FAN] if depth else np.uint64(0)
            self.levels.append((pattern, mask & ~above))

    def members(self, leaf: np.ndarray) -> np.ndarray:
        """Places of the fingerprints of leaves; the last leaf is filled up with its last one."""
        return np.minimum(leaf[:, None] * LEAF + np.arange(LEAF), len(self.fps) - 1)

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each node, its members' common label or -1."""
        low = high = label
        out, width = [], LEAF
        for _ in self.levels:
            cut = np.arange(0, len(low), width)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            out.append(np.where(low == high, low, -1))
            width = FAN
        return out[::-1]

    def search(self, pattern: np.ndarray, mask: np.ndarray, own: np.ndarray, label: np.ndarray, limits: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, leaf) that may hold a pair of fingerprints within the limits and of different labels.

        A query is a group of fingerprints, too: the bits that they share, with their pattern. own: its common label, or -1. With ``first``,
        only leaves from there on are asked for.
        """
        q, node = np.arange(len(pattern)), np.zeros(len(pattern), np.int64)
        differ, seen = np.zeros(len(pattern), np.int64), np.zeros(len(pattern), np.int64)
        uniform, width = self.uniform(label), FAN ** (len(self.levels) - 1)
        for depth, (shared, more) in enumerate(self.levels):
            if depth:
                q, differ, seen = np.repeat(q, FAN), np.repeat(differ, FAN), np.repeat(seen, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < len(shared)
                if first is not None:
                    there &= (node + 1) * width > first[q]
                q, node, differ, seen = q[there], node[there], differ[there], seen[there]
            bits = more[node] & mask[q]
            differ, seen = differ + np.bitwise_count((pattern[q] ^ shared[node]) & bits), seen + np.bitwise_count(bits)
            stays = (differ <= limits[seen]) & ((uniform[depth][node] != own[q]) | (own[q] < 0))
            q, node, differ, seen = q[stays], node[stays], differ[stays], seen[stays]
            width //= FAN
        return q, node


def linked(a: np.ndarray, b: np.ndarray | None, limits: np.ndarray, more: np.ndarray | None = None, both: int = 128) -> np.ndarray:
    """For ``a`` (each against the others) or ``a`` and ``b`` (each of b against those of a), one after the other: each one's root among them.

    ``more``: 64 further bits of each, with which at most ``both`` bits may differ.
    """
    order = np.argsort(gray_rank(a), kind="stable")
    index, at = Index(a[order]), 0
    queries = index
    if b is not None:
        other = np.argsort(gray_rank(b), kind="stable")
        queries, at = Index(b[other]), len(a)
        order = np.concatenate([order, len(a) + other])
    forest, most = Forest(len(order)), np.uint8(limits[64])
    more = more[order] if more is not None else None
    lo, step = 0, 1
    while lo < len(queries.leaves[0]):
        group = np.arange(lo, min(lo + step, len(queries.leaves[0])))
        label = forest.root[at + queries.members(group)]
        own = np.where((label == label[:, :1]).all(1), label[:, 0], -1)
        q, leaf = index.search(queries.leaves[0][group], queries.leaves[1][group], own, forest.root[: len(a)], limits, group if b is None else None)
        for k in range(0, len(q), PAIRS):  # what is left is looked at as it is
            x, y = queries.members(group[q[k : k + PAIRS]]), index.members(leaf[k : k + PAIRS])
            near = np.flatnonzero(np.bitwise_count(queries.fps[x][:, :, None] ^ index.fps[y][:, None, :]) <= most)
            if len(near):
                pair, i, j = np.unravel_index(near, (len(x), LEAF, LEAF))
                u, v = at + x[pair, i], y[pair, j]
                if more is not None:
                    near = np.bitwise_count(queries.fps[x[pair, i]] ^ index.fps[v]).astype(int) + np.bitwise_count(more[u] ^ more[v]) <= both
                    u, v = u[near], v[near]
                forest.link(u, v)
        lo, step = lo + step, min(16, 2 * step)
    out = np.empty(len(order), np.int64)
    out[order] = order[forest.root]
    return out


def chunks_linked(batches: Iterator[pa.RecordBatch], limits: np.ndarray, both: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (t, a, b, part, id, fp, more), sorted by the first three: a forest of links ``u, v`` between ids for each pair of chunks."""

    def work(a: int, b: int, part: np.ndarray, own: np.ndarray, fp: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        sides = (np.flatnonzero(part == a), np.flatnonzero(part == b)) if a != b else (np.arange(len(fp)),)
        place = np.concatenate(sides)
        root = linked(fp[sides[0]], fp[sides[1]] if a != b else None, limits, more[place] if both is not None else None, both or 0)
        out = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(own[place[out]]), pa.array(own[place[root[out]]])], ["u", "v"])

    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        t, a, b, *rest = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
        rest[2:] = [x.view(np.uint64) for x in rest[2:]]
        new = np.flatnonzero((np.diff(t) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
        for lo, hi in zip([0, *new], [*new, len(t)]):
            if (t[lo], a[lo], b[lo]) != key:
                if held:
                    yield work(*key[1:], *(np.concatenate(x) for x in zip(*held)))
                key, held = (t[lo], a[lo], b[lo]), []
            held.append([x[lo:hi] for x in rest])
    if held:
        yield work(*key[1:], *(np.concatenate(x) for x in zip(*held)))


def in_chunks(points: DataFrame, chunk: int) -> DataFrame:
    """``t, part, id, fp, more`` for rows ``t, id, fp, more``: each table t in Gray order, cut into parts of ``chunk`` fingerprints."""
    rank = gray_rank_column(F.col("fp")).bitwiseXOR(F.lit(-(1 << 63)))  # in unsigned order
    dealt = points.select("t", "id", "fp", "more", rank.alias("rank")).repartitionByRange(max(1, math.ceil(points.count() / chunk)), "t", "rank", "id")
    dealt = dealt.sortWithinPartitions("t", "rank", "id")
    held = table(dealt.select("t", "id", "fp", "more", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i")), "gray-order")
    counts = held.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    earlier = Window.partitionBy("t").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("t", "p", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = held.join(table(counts, "gray-counts"), ["t", "p"])
    return table(placed.select("t", F.floor((F.col("before") + F.col("i") - F.col("first")) / chunk).cast("int").alias("part"), "id", "fp", "more"), "gray-chunks")


def chunk_pairs(parts: DataFrame, limits: np.ndarray) -> DataFrame:
    """``t, a, b`` (a <= b): the pairs of chunks that the levels above chunks don't prune."""
    allowed = F.array(*(F.lit(int(x)) for x in limits))

    def masked(nodes: DataFrame) -> DataFrame:
        return table(nodes.select("t", "node", "both", "either", F.bitwise_not(F.col("both").bitwiseXOR(F.col("either"))).alias("mask")), "gray-nodes")

    levels = [masked(parts.groupBy("t", F.col("part").alias("node")).agg(F.bit_and("fp").alias("both"), F.bit_or("fp").alias("either")))]
    while (last := levels[-1].agg(F.max("node")).first()[0] or 0) >= TOP:
        up = levels[-1].groupBy("t", F.expr(f"node div {TOP}").cast("int").alias("node")).agg(F.bit_and("both").alias("both"), F.bit_or("either").alias("either"))
        levels.append(masked(up))
    pairs = levels[-1].select("t", F.col("node").alias("a"), F.explode(F.sequence("node", F.lit(last))).alias("b"))
    for depth, nodes in enumerate(reversed(levels)):
        if depth:
            above = F.expr(f"node div {TOP}").cast("int")
            down = [nodes.select("t", above.alias(c), F.col("node").alias(f"{c}2")) for c in ("a", "b")]
            pairs = pairs.join(down[0], ["t", "a"]).join(down[1], ["t", "b"]).where("a2 <= b2").select("t", F.col("a2").alias("a"), F.col("b2").alias("b"))
        x, y = (nodes.select("t", F.col("node").alias(c), F.col("both").alias(f"{c}_both"), F.col("mask").alias(f"{c}_mask")) for c in ("a", "b"))
        common = F.expr("a_mask & b_mask")
        differ = F.bit_count(F.expr("a_both ^ b_both").bitwiseAND(common))
        pairs = pairs.join(x, ["t", "a"]).join(y, ["t", "b"]).where(differ <= F.get(allowed, F.bit_count(common))).select("t", "a", "b")
        pairs = table(pairs, "gray-pairs")
    return pairs


def links(points: DataFrame, limits: np.ndarray, chunk: int = CHUNK, both: int | None = None) -> DataFrame:
    """``u, v`` over rows ``t int, id long, fp long, more long``: in each table t, a forest of links between ids for each pair of chunks.

    ``limits[n]``: how many of n bits may differ. What is within ``limits[64]`` and, on its way through the tree, within all the
    others is found; with equal limits that is every pair. ``both``: how many bits of ``fp`` and ``more`` together may differ, in the
    end; None: ``more`` is not looked at.
    """
    spark = points.sparkSession
    parts = in_chunks(points, chunk)
    pairs = chunk_pairs(parts, limits)
    tasks = min(MAX_TASKS, max(1, pairs.count()))
    ends = pairs.select("t", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("part"))
    dealt = parts.join(ends, ["t", "part"]).select("t", "a", "b", "part", "id", "fp", "more").repartition(tasks, "t", "a", "b").sortWithinPartitions("t", "a", "b")
    small_batches(spark)
    return dealt.mapInArrow(lambda batches: chunks_linked(batches, limits, both), "u long, v long")


def within(distance: int) -> np.ndarray:
    """Limits that find every pair of at most ``distance`` differing bits."""
    return np.full(65, distance, np.int64)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, fp, component_id, kept``: a row for each row of ``df``; kept where the row's id is its component's."""
    docs = table(fingerprints(df, id_col, text_col), "fingerprints")
    first = table(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    points = first.select(F.lit(0).alias("t"), F.col("fp").alias("id"), "fp", F.lit(0).cast("long").alias("more"))
    roots = components(links(points, within(distance), chunk))
    named = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = table(named, "named")
    smallest = table(named.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    classes = table(named.join(smallest, "root").select("fp", "component_id"), "classes")
    return docs.join(classes, "fp").select("doc_id", "fp", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
