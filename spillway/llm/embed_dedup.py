"""Embedding near-dedup by lattice hashing.

A table of the hash projects the unit vectors at random onto blocks of eight coordinates and decodes each block to its
nearest point of the lattice E8; the points of all blocks name the vector's cell. Besides its own cell, a vector probes, for
each block, the cell that differs there by the nearest neighbouring lattice point. Two vectors meet if one's cell is the
other's or probed by it, in any table; then their cosine is taken in double precision. The number of blocks follows
from the number of vectors, so that cells stay small, and the number of tables from the chance, measured on
random pairs at the threshold, that a table misses a pair.

Equal vectors are one class with a multiplicity. What is exchanged first is a class and a cell, without vectors; only where a cell
has a row of its own and another one do vectors follow. A pair of classes is counted in the first table and cell where it meets,
which the workers tell from both vectors. A cell with more than ``chunk`` rows is cut into parts, and each
two parts are a task of their own. Only sums and forests of links leave a task.

Defined results: labels that are null, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing; nor do vectors of different length. Labels of any type are compared as they are (texts by 64-bit hashes), vectors of floats as
floats, others as doubles. Every row counts as a vector: repeated rows are copies that link with each other, rows with one ``vec_id`` but
different vectors are different vectors, and so are rows with a null one. A component is named by the smallest id in it, null if there
is none; two vectors are taken for equal by 128-bit hashes. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spillway.llm.common import small_batches, table
from spillway.llm.components import components
from spillway.llm.simhash import Forest

BLOCK, SEED = 8, 20
#: Bits that a block tells apart at this width; the width of a cell, in typical differences of a pair at the threshold.
BLOCK_BITS, WIDTH = 9, 8.5
CHUNK, GATHER, RECALL = 8192, 1 << 14, 0.995


def nearest_d8(y: np.ndarray) -> np.ndarray:
    out = np.rint(y)
    off = y - out
    odd = np.flatnonzero(out.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    out[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return out


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The closest point of E8: of the even integer points or of those shifted by a half."""
    whole, half = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    return np.where((((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1))[:, None], whole, half)


def neighbour_e8(y: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Of the 240 lattice points around ``point``, that closest to ``y``."""
    off = y - point
    size, sign, rows = np.abs(off), np.where(off >= 0, 1.0, -1.0), np.arange(len(off))
    two = np.argsort(-size, axis=1, kind="stable")[:, :2]
    whole = np.zeros_like(off)
    np.put_along_axis(whole, two, np.take_along_axis(sign, two, 1), 1)
    half = 0.5 * sign
    odd, least = ((sign < 0).sum(1) & 1) == 1, size.argmin(1)
    half[rows[odd], least[odd]] *= -1
    better = (whole * off).sum(1) >= (half * off).sum(1)
    return point + np.where(better[:, None], whole, half)


class Lattice:
    def __init__(self, dim: int, blocks: int, tables: int, threshold: float, seed: int = SEED):
        rng = np.random.default_rng([seed, dim])
        self.blocks, self.tables = blocks, tables
        width = WIDTH * math.sqrt(max(1e-9, 2 - 2 * threshold))
        self.project = rng.normal(size=(dim, tables * blocks * BLOCK)) / width
        self.mix = rng.integers(1, 1 << 62, size=(tables, blocks, BLOCK), dtype=np.int64) | 1

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + blocks): each vector's own cell, then those it probes."""
        y = (unit @ self.project).reshape(-1, BLOCK)
        own = nearest_e8(y)
        beside = neighbour_e8(y, own)
        shape = (len(unit), self.tables, self.blocks, BLOCK)
        with np.errstate(over="ignore"):
            part = ((2 * own).astype(np.int64).reshape(shape) * self.mix).sum(3)
            other = ((2 * beside).astype(np.int64).reshape(shape) * self.mix).sum(3)
            base = part.sum(2, keepdims=True)
            return np.concatenate([base, base - part + other], 2)


def met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs, given both sides' cells: the first table where they meet and the cell, a's own one if it can be."""
    common = (a[:, :, :1] == b).any(2)
    back = (b[:, :, :1] == a).any(2)
    first = (common | back).argmax(1)
    rows = np.arange(len(a))
    return first, np.where(common[rows, first], a[rows, first, 0], b[rows, first, 0])


@lru_cache(64)
def lattice(dim: int, blocks: int, tables: int, threshold: float) -> Lattice:
    return Lattice(dim, blocks, tables, threshold)


def tables_needed(blocks: int, threshold: float, recall: float = RECALL, dim: int = 64, tries: int = 4000) -> int:
    """So many that a pair at the threshold is missed with a chance of at most 1 - recall."""
    rng = np.random.default_rng(SEED)
    a, b = rng.normal(size=(tries, dim)), rng.normal(size=(tries, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    one = Lattice(dim, blocks, 8, threshold)
    x, y = one.cells(a), one.cells(threshold * a + math.sqrt(1 - threshold**2) * b)
    hit = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).mean()
    return max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-9, 1 - hit))))


def units(vectors: pa.Array, n: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    top = np.abs(flat).max(1, keepdims=True)
    flat = flat / top
    return flat / np.sqrt((flat**2).sum(1, keepdims=True))


def near(batches: Iterator[pa.RecordBatch], threshold: float, blocks: int, tables: int) -> Iterator[pa.RecordBatch]:
    """Rows (label, dim, t, cell, a, b, part, own, id, mult, vec) sorted by the first six: ``id, n, root`` for each linked row."""

    def group(g: dict[str, np.ndarray], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        own, part, one = g["own"], g["part"], g["a"][0] == g["b"][0]
        cells, made = np.zeros((len(own), tables, 1 + blocks), np.int64), np.zeros(len(own), bool)
        left = np.arange(len(own)) if one else np.flatnonzero(part == g["a"][0])
        right = left if one else np.flatnonzero(part == g["b"][0])
        count, forest = np.zeros(len(own), np.int64), Forest(len(own))
        step = max(1, (4 << 20) // max(1, len(right)))
        for at in range(0, len(left), step):
            x = left[at : at + step]
            i, j = np.nonzero(unit[x] @ unit[right].T >= threshold)
            i, j = x[i], right[j]
            keep = (own[i] | own[j]) & ((i < j) if one else True) & (g["id"][i] != g["id"][j])
            i, j = i[keep], j[keep]
            for s in range(0, len(i), 1 << 16):
                p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                swap = g["id"][p] > g["id"][q]
                p, q = np.where(swap, q, p), np.where(swap, p, q)
                new = np.unique(np.concatenate([p, q]))
                new = new[~made[new]]
                cells[new], made[new] = lattice(int(g["dim"][0]), blocks, tables, threshold).cells(unit[new]), True
                first, cell = met(cells[p], cells[q])
                here = (first == g["t"][0]) & (cell == g["cell"][0])
                p, q = p[here], q[here]
                np.add.at(count, p, g["mult"][q])
                np.add.at(count, q, g["mult"][p])
                forest.link(p, q)
        out = np.flatnonzero(count)
        return (g["id"][out], count[out], g["id"][forest.root[out]]) if len(out) else None

    names = ["label", "dim", "t", "cell", "a", "b", "part", "own", "id", "mult"]

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        g = {c: rows.column(c).to_numpy() for c in names}
        new = np.flatnonzero(np.logical_or.reduce([np.diff(g[c]) != 0 for c in names[:6]])) + 1
        found = []
        for lo, hi in zip([0, *new], [*new, len(rows)]):
            if hi - lo > 1:
                part = {c: v[lo:hi] for c, v in g.items()}
                if not part["own"].any():
                    continue
                unit = units(rows.column("vec").slice(lo, hi - lo).combine_chunks(), hi - lo)
                if (out := group(part, unit)) is not None:
                    found.append(out)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["id", "n", "root"])

    held: pa.Table | None = None
    due = GATHER
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if len(held) < due:
            continue
        last = np.logical_and.reduce([(c := held.column(x).to_numpy()) == c[-1] for x in names[:6]])
        cut = 0 if last.all() else len(last) - int(np.argmin(last[::-1]))
        if cut:
            yield from work(held.slice(0, cut))
            held = held.slice(cut).combine_chunks()
        due = len(held) + GATHER
    if held is not None:
        yield from work(held)


def dedup(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", chunk: int = CHUNK, recall: float = RECALL, blocks: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: a row for each row of ``df``. ``blocks``: of a cell, by default as many as the number of vectors asks for."""
    spark = df.sparkSession
    small_batches(spark)
    label = F.lit(0) if label_col is None else df[label_col]
    vector = df[vector_col]
    if not (isinstance(kind := df.schema[vector_col].dataType, T.ArrayType) and isinstance(kind.elementType, T.FloatType)):
        vector = vector.cast("array<double>")
    # A hash of up to eight bytes tells all their values apart.
    rows = df.select(df[id_col].cast("long").alias("id"), F.when(label.isNotNull(), F.xxhash64(label)).alias("label"), vector.alias("vec"))
    sound = F.col("label").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    same = ["label", "h1", "h2", "sound"]
    keyed = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit("second"), "vec"))
    places = table(keyed.select("id", *same), "vectors")
    classes = keyed.where("sound").groupBy(*same).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("mult"), F.first("vec").alias("vec"))
    # As a table, so that the numbers stay.
    classes = table(classes.select("*", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("node")), "vector-classes")
    n, low, high = classes.agg(F.count(F.lit(1)), F.min("dim"), F.max("dim")).first()
    blocks = blocks or max(1, math.ceil((math.log2(max(2, n)) - 4) / BLOCK_BITS))
    tables = max(tables_needed(blocks, threshold, recall, dim) for dim in {low or 64, high or 64})

    @F.arrow_udf("array<long>")
    def cells_of(vec: pa.Array) -> pa.Array:
        sizes = np.diff(vec.offsets.to_numpy()) if len(vec) else np.zeros(0, np.int64)
        out = np.zeros((len(vec), tables * (1 + blocks)), np.int64)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            out[at] = lattice(int(dim), blocks, tables, threshold).cells(units(vec.take(pa.array(at)), len(at))).reshape(len(at), -1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(vec) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))

    spread = classes.select("label", "dim", "node", cells_of("vec").alias("cells")).select("label", "dim", "node", F.posexplode("cells").alias("k", "cell"))
    spread = table(spread.select("label", "dim", F.expr(f"k div {1 + blocks}").cast("int").alias("t"), "cell", (F.col("k") % (1 + blocks) == 0).alias("own"), "node"), "cells")
    key = ["label", "dim", "t", "cell"]
    met_in = spread.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.max("own").alias("any")).where("rows > 1 and any").select(*key, "rows")
    zero = F.lit(0).cast("int")
    parts = F.ceil(F.col("rows") / chunk).cast("int")
    cut = spread.join(table(met_in, "live-cells"), key).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(zero, F.col("parts") - 1)))
    cut = cut.select(*key, F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "own", "node")
    tasks = cut.join(classes.select("node", "mult", "vec"), "node")
    order = [*key, "a", "b"]
    dealt = tasks.select(*order, "part", "own", F.col("node").alias("id"), "mult", "vec").repartition(*order).sortWithinPartitions(*order)
    found = table(dealt.mapInArrow(lambda batches: near(batches, threshold, blocks, tables), "id long, n long, root long"), "vector-links")
    counts = found.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found, "id", "root")
    named = classes.select("node", "least", "mult").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = table(named.join(counts, "node", "left").select("node", "root", "least", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "vector-results")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.join(smallest, "root").join(classes.select("node", *same), "node").select(*same, "n_links", "component_id")
    out = places.join(table(by_class, "vector-components"), same, "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
