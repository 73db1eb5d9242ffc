"""Near copies by exact Jaccard similarity of word shingles; SimHash fingerprints in the Gray-order index find the candidates.

A text is the set of its runs of ``words`` lower-cased words (of all its words, if they are fewer), each known by 64 bits.
Texts with the same set are one class, known by 64 bits of the set. A class has several fingerprints, one for each of a few independent
mixings of its shingles' hashes, each in a table of the index of ``simhash.links`` of its own. Bits of two sets at similarity s differ
with a chance of arccos(2 s / (1 + s)) / pi at most, so the index lets as many differ, of those it has looked at, as that makes likely;
64 further bits, the same in all tables, keep chance neighbours out. The number of tables follows from the chance, measured on random
bits, that one table misses a pair (``tables_needed``).

Candidates come as components, and whole sets decide: classes of a component are compared with each other in one task, or, beyond
``chunk`` classes, in parts. First each part's own links are found, then those between one class of each group so found; what
isn't in a component's largest group after that is held against all of it, part by part. Within a task, classes that are
linked already aren't compared, and only a forest of links leaves it. What is linked is always at or above the limit.

Defined results: a null or empty text, or one of white space, has the empty set, a copy of any other such and of nothing else; an
empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spillway.llm import simhash
from spillway.llm.common import small_batches, table
from spillway.llm.components import components
from spillway.llm.simhash import Forest

WORDS, SIMILARITY, SEED, RECALL = 5, 0.8, 42, 0.999
#: Likelihood of a pair at the limit to stay within the allowed differences of up to 6 bits, of up to 32, of all 64, and of 128.
FEW_BITS, SOME_BITS, ALL_BITS, BOTH = 0.9, 0.8, 0.9, 0.97
#: Classes of a part; shingles whose hashes are mixed at once.
CHUNK, RUN = 1024, 1 << 13


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the different shingles, sorted."""
    own = [w.encode() for w in text.lower().split()]
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    start = list(accumulate((len(w) + 1 for w in own), initial=0))
    ends, digest = start[words:] if len(own) >= words else start[-1:], xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(start, ends)]), np.uint64))


def label(own: bytes) -> int:
    """The class of a set."""
    return xxhash.xxh64_intdigest(own, SEED) - (1 << 63)


def fingerprints(own: np.ndarray, tables: int) -> list[int] | None:
    """A set's fingerprint in each table; none for the empty set."""
    if not len(own):
        return None
    start = np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * tables, np.int64)
    for at in range(0, len(own), RUN):
        x = own[at : at + RUN, None] + start
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint16)
    return np.packbits(2 * ones > len(own)).view("<i8").tolist()


def share(similarity: float) -> float:
    """The chance that a bit of two sets' fingerprints differs."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def quantile(n: int, p: float, q: float) -> int:
    """So many of n bits differ with a likelihood of at least q, or fewer."""
    total = 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total >= q:
            return k
    return n


@lru_cache(16)
def limits(similarity: float) -> tuple[np.ndarray, int]:
    """How many of n bits may differ, and how many of 128, for ``simhash.links``."""
    p = share(similarity)
    most = quantile(64, p, ALL_BITS)
    each = [most if n > 32 else min(most, quantile(n, p, FEW_BITS if n <= 6 else SOME_BITS)) for n in range(65)]
    return np.maximum.accumulate(np.array(each, np.int64)), quantile(128, p, BOTH)


@lru_cache(16)
def tables_needed(similarity: float, recall: float = RECALL, tries: int = 20_000) -> int:
    """So many that all tables miss a pair at the limit with a chance of at most 1 - recall, if every number of bits is looked at."""
    allowed, both = limits(similarity)
    bits = np.random.default_rng(SEED).random((tries, 128)) < share(similarity)
    differ = np.cumsum(bits[:, :64], 1)
    hit = ((differ <= allowed[1:]).all(1) & (bits.sum(1) <= both)).mean()
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit))) if hit < 1 else 1


def linked(sets: list[np.ndarray], side: np.ndarray | None = None, similarity: float = SIMILARITY, known: np.ndarray | None = None) -> np.ndarray:
    """Each set's root among them; with ``side``, only sets of different sides are compared; sets of one ``known`` label are linked already."""
    size = np.array([len(s) for s in sets])
    forest = Forest(len(sets))
    if known is not None:
        _, first, place = np.unique(known, return_index=True, return_inverse=True)
        forest.root = first[place]
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        if common >= similarity * (size.sum() - common) - 1e-9:
            forest.link(np.array([0]), np.array([1]))
        return forest.root
    order = np.argsort(size, kind="stable")
    size = size[order]
    start = np.concatenate([[0], np.cumsum(size)])
    all_, place = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    mine = np.zeros(len(all_), np.int32)
    last = np.searchsorted(size, size / similarity + 1e-9, "right")  # longer ones can't be similar
    for i in range(len(order) - 1):
        j = np.arange(i + 1, last[i])
        open_ = forest.root[order[j]] != forest.root[order[i]]
        if side is not None:
            open_ &= side[order[j]] != side[order[i]]
        if not open_.any():
            continue
        lo, hi = j[open_][0], j[open_][-1] + 1
        mine[place[start[i] : start[i + 1]]] = 1
        common = np.add.reduceat(mine[place[start[lo] : start[hi]]], start[lo:hi] - start[lo])
        mine[place[start[i] : start[i + 1]]] = 0
        near = np.flatnonzero((common >= similarity * (size[i] + size[lo:hi] - common) - 1e-9) & open_[lo - i - 1 : hi - i - 1]) + lo
        forest.link(np.full(len(near), order[i]), order[near])
    return forest.root


def groups_linked(batches: Iterator[pa.RecordBatch], similarity: float = SIMILARITY) -> Iterator[pa.RecordBatch]:
    """Rows (node, a, b, part, class, known, own), sorted by the first three: a forest of links ``u, v`` of each group, beyond what is known."""

    def work(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        part, classes, known = (np.array([r[k] for r in rows]) for k in range(3))
        if len(rows) < 2 or (known == known[0]).all() or (key[1] != key[2] and (part == part[0]).all()):
            return
        root = linked([np.frombuffer(r[3], np.uint64) for r in rows], part if key[1] != key[2] else None, similarity, known)
        out = np.flatnonzero(known[root] != known)
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(classes[out]), pa.array(classes[root[out]])], ["u", "v"])

    key, held = None, []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(7)]
        for node, a, b, *row in zip(*columns):
            if (node, a, b) != key:
                if held:
                    yield from work(key, held)
                key, held = (node, a, b), []
            held.append(row)
    if held:
        yield from work(key, held)


def signed(docs: DataFrame, tables: int, words: int = WORDS) -> DataFrame:
    """For rows ``doc_id, text, h1, h2``: all but the text, with the class of each and its fingerprints."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py() or "", words) for x in b.column(3)]
            classes = pa.array([label(s.tobytes()) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], classes, pa.array([fingerprints(s, tables) for s in sets], pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "class", "fps"])

    return docs.select("doc_id", "h1", "h2", "text").mapInArrow(run, "doc_id long, h1 long, h2 long, class long, fps array<long>")


def sets_of(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``class, root, n, own`` for rows ``class, root, n, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py() or "", words).tobytes() for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets, pa.binary())], ["class", "root", "n", "own"])

    return texts.select("class", "root", "n", "text").mapInArrow(run, "class long, root long, n long, own binary")


def _found(rows: DataFrame, similarity: float, name: str) -> DataFrame:
    """Links within each group of rows ``node, a, b, part, class, known, own``."""
    dealt = rows.select("node", "a", "b", "part", "class", "known", "own").repartition("node", "a", "b").sortWithinPartitions("node", "a", "b")
    return table(dealt.mapInArrow(lambda batches: groups_linked(batches, similarity), "u long, v long"), name)


def _parts(n: F.Column, chunk: int, salt: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(salt), "class"), F.ceil(n / chunk)).cast("int")


def _relabelled(held: DataFrame, edges: DataFrame) -> DataFrame:
    """``held`` (root, class, known) with what the edges between known labels come to."""
    roots = components(edges).withColumnRenamed("node", "known").withColumnRenamed("root", "to")
    return table(held.join(roots, "known", "left").select("root", "class", F.coalesce("to", "known").alias("known")), "near-labels")


def verified(sets: DataFrame, similarity: float = SIMILARITY, chunk: int = CHUNK) -> list[DataFrame]:
    """Tables of links ``u, v`` of rows ``class, root, n, own`` (n: classes with that root): all links between classes of one root, up to components."""
    zero = F.lit(0).cast("int")
    in_parts = lambda rows, n, salt: rows.withColumn("part", _parts(n, chunk, salt)).select(F.col("root").alias("node"), F.col("part").alias("a"), F.col("part").alias("b"), "part", "class", "known", "own")
    links = [_found(in_parts(sets.withColumn("known", F.col("class")), F.col("n"), 2), similarity, "near-links")]
    large = table(sets.where(F.col("n") > chunk), "large-groups")
    if large.isEmpty():
        return links
    own = links[0].join(large.select(F.col("class").alias("u")), "u", "left_semi")
    held = _relabelled(large.select("root", "class", F.col("class").alias("known")), own)
    count = lambda: held.select("root", "known").distinct().count()
    left = count()
    for salt in range(3, 8):  # one class of each label, until their number doesn't fall much
        one = held.groupBy("root", "known").agg(F.min("class").alias("class"))
        sizes = one.groupBy("root").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        rows = one.join(sizes, "root").join(large.select("class", "own"), "class")
        found = _found(in_parts(rows, F.col("m"), salt), similarity, "near-links")
        links.append(found)
        names = [held.select(F.col("class").alias(c), F.col("known").alias(f"k{c}")) for c in ("u", "v")]
        held = _relabelled(held, found.join(names[0], "u").join(names[1], "v").select(F.col("ku").alias("u"), F.col("kv").alias("v")))
        before, left = left, count()
        if left > 0.8 * before:
            break
    by_label = held.groupBy("root", "known").agg(F.count(F.lit(1)).alias("size"))
    top = by_label.groupBy("root").agg(F.max_by("known", F.struct("size", "known")).alias("largest"), F.max("size").alias("big"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    rows = held.join(table(top, "near-largest"), "root").withColumn("small", F.ceil((F.col("all") - F.col("big")) / chunk).cast("int"))
    rows = rows.withColumn("large", F.ceil(F.col("big") / chunk).cast("int")).withColumn("rest", F.col("known") != F.col("largest"))
    part = F.when(F.col("rest"), F.pmod(F.xxhash64(F.lit(9), "class"), F.col("small"))).otherwise(F.col("small") + F.pmod(F.xxhash64(F.lit(9), "class"), F.col("large"))).cast("int")
    rows = rows.withColumn("part", part)
    # A part of the rest meets every part; parts of the largest label meet none of their own.
    with_all = F.sequence(zero, F.col("small") + F.col("large") - 1)
    rows = rows.withColumn("other", F.explode(F.when(F.col("rest"), with_all).otherwise(F.sequence(zero, F.col("small") - 1))))
    rows = rows.select(F.col("root").alias("node"), F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "class", "known")
    links.append(_found(rows.join(large.select("class", "own"), "class"), similarity, "near-links"))
    return links


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, h1, h2, component``: a row for each row of ``df``; h1 and h2 are ``text_keys`` of its text."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    docs = docs.withColumns(text_keys())
    allowed, both = limits(similarity)
    tables = tables_needed(similarity, recall)
    rows = table(signed(docs, tables + 1, words), "signed")  # the last fingerprint is that of the further bits
    classes = table(rows.groupBy("class").agg(F.first("fps").alias("fps"), F.min("h1").alias("h1")), "classes")
    points = classes.select(F.col("class").alias("id"), F.get("fps", F.lit(tables)).alias("more"), F.posexplode(F.slice("fps", 1, tables)).alias("t", "fp"))
    near = components(table(simhash.links(points, allowed, both=both), "candidates")).withColumnRenamed("node", "class")
    sizes = near.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    asked = table(near.join(sizes, "root").join(classes.select("class", "h1"), "class").select("h1", "class", "root", "n"), "asked")
    # One text of each class asked for; the others move only where that list is too long to broadcast.
    texts = docs.join(asked, "h1").groupBy("h1", "h2", "class", "root", "n").agg(F.first("text").alias("text"))
    links = verified(table(sets_of(texts, words), "sets"), similarity, chunk)
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    roots = components(edges)
    return rows.join(roots.withColumnRenamed("node", "class"), "class", "left").select("doc_id", "h1", "h2", F.coalesce("root", "class").alias("component"))


def text_keys(text_col: str = "text") -> dict:
    """128 bits by which a text is known."""
    return {"h1": F.xxhash64(text_col), "h2": F.xxhash64(F.lit(1), text_col)}
