"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

The reference-count table holds, for each line key (its 128-bit hash), the number of documents that have it.
A key found in at least ``min_docs`` documents is *active*: its lines are dropped everywhere. The active keys of
each shard stand in a cuckoo filter with 32-bit fingerprints, so that documents can be cleaned without moving
them. What a filter says wrongly is known exactly: the inactive rows of the table are held against the filters, and
the few that pass are listed beside them. Inserting or deleting documents adds to or takes from the counts, and
keys that cross the threshold enter or leave their filter; the state after a deletion is that without the documents.

Filters and exceptions are broadcast only while they are within ``MAX_FILTER_BYTES`` and ``MAX_EXCEPTIONS``;
beyond that the documents' keys are joined with the active rows of the table, with the same result.

Defined results: a null or empty text is one empty line and stays an empty text; keys below ``min_chars`` code points are
never dropped; every row counts as a document of its own, ids repeated or null or not; a text whose lines all go
becomes empty; an empty table gives an empty table. Extra columns pass through; ``n_lines`` and ``n_dropped`` are set.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm.common import small_batches, table, unused

SPACE = b" \t\n\x0b\x0c\r"
MAX_FILTER_BYTES, MAX_EXCEPTIONS = 64 << 20, 1_000_000
#: Active keys that a shard is laid out for.
SHARD_KEYS = 1 << 17
SLOTS = 4
KICKS = 500


def key_of(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z in lower case."""
    return line.strip(SPACE).lower()


def hashed(keys: list[bytes]) -> np.ndarray:
    """A row of two longs for each key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">i8").astype("<i8").reshape(-1, 2)


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


class Cuckoo:
    """A cuckoo filter over 128-bit hashes: bucket from the low long, fingerprint from the high one."""

    def __init__(self, bits: int, slots: np.ndarray | None = None):
        self.bits = bits
        self.slots = np.zeros((1 << bits, SLOTS), np.uint32) if slots is None else slots.reshape(-1, SLOTS).copy()

    @staticmethod
    def places(hi: np.ndarray, lo: np.ndarray, bits: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (hi.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        mark = np.where(mark == 0, np.uint32(1), mark)
        mask = (np.uint64(1) << np.asarray(bits).astype(np.uint64)) - np.uint64(1)
        first = (lo.view(np.uint64) >> np.uint64(20)) & mask
        return mark, first, first ^ Cuckoo._step(mark, bits)

    @staticmethod
    def _step(mark: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
        """What parts a mark's two buckets."""
        mask = (np.uint64(1) << np.asarray(bits).astype(np.uint64)) - np.uint64(1)
        return (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)) & mask

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """All keys at once; False if there is no room: the filter must then be built anew, larger."""
        mark, first, second = self.places(np.ascontiguousarray(hi), np.ascontiguousarray(lo), self.bits)
        rest = self._settled(mark, first.astype(np.int64), np.arange(len(mark)))
        at = second.astype(np.int64)
        rest = self._settled(mark, at, rest)
        for turn in range(KICKS):
            if not len(rest):
                return True
            # Of those that wait at one bucket one takes the place of a mark there, which then waits at its other bucket.
            kicker = rest[np.unique(at[rest], return_index=True)[1]]
            bucket, slot = at[kicker], (turn * 7 + mark[kicker].astype(np.int64)) % SLOTS
            mark[kicker], self.slots[bucket, slot] = self.slots[bucket, slot], mark[kicker]
            at[kicker] = bucket ^ self._step(mark[kicker], self.bits).astype(np.int64)
            rest = self._settled(mark, at, rest)
        return not len(rest)

    def _settled(self, mark: np.ndarray, at: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Puts as many of ``rest`` as there is room for into the buckets ``at``; returns the others."""
        rest = rest[np.argsort(at[rest], kind="stable")]
        bucket = at[rest]
        place = np.arange(len(rest)) - np.searchsorted(bucket, bucket)
        taken = self.slots[bucket] != 0
        fits = place < SLOTS - taken.sum(1)
        slot = np.argsort(taken, axis=1, kind="stable")[np.arange(len(rest)), np.minimum(place, SLOTS - 1)]
        self.slots[bucket[fits], slot[fits]] = mark[rest[fits]]
        return rest[~fits]

    def delete(self, hi: int, lo: int) -> bool:
        """Only for keys that were inserted."""
        mark, first, second = (int(x[0]) for x in self.places(np.array([hi], "<i8"), np.array([lo], "<i8"), self.bits))
        for place in (first, second):
            held = np.flatnonzero(self.slots[place] == mark)
            if len(held):
                self.slots[place, held[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> Cuckoo:
        bits = max(4, int(np.ceil(np.log2(max(1, len(hi)) / (SLOTS * 0.6)))))
        while True:
            made = cls(bits)
            if made.insert(hi, lo):
                return made
            bits += 1


class Filters:
    """All shards' filters in one array, asked for many keys at once."""

    def __init__(self, shards: int, rows: list[tuple[int, int, bytes]], exceptions: list[tuple[int, int]]):
        self.shards = shards
        self.bits, self.start = np.zeros(shards, np.int64), np.full(shards, -1, np.int64)
        parts, at = [np.zeros((1, SLOTS), np.uint32)], 1
        for shard, bits, slots in rows:
            self.bits[shard], self.start[shard] = bits, at
            parts.append(np.frombuffer(slots, "<u4").reshape(-1, SLOTS))
            at += len(parts[-1])
        self.slots = np.concatenate(parts)
        self.exceptions = set(exceptions)

    def maybe(self, hash2: np.ndarray) -> np.ndarray:
        """What the filters say."""
        hi, lo = np.ascontiguousarray(hash2[:, 0]), np.ascontiguousarray(hash2[:, 1])
        shard = lo & (self.shards - 1)
        start = self.start[shard]
        mark, first, second = Cuckoo.places(hi, lo, self.bits[shard])
        both = [np.where(start < 0, 0, start + x.astype(np.int64)) for x in (first, second)]
        return (start >= 0) & np.logical_or.reduce([(self.slots[x] == mark[:, None]).any(1) for x in both])

    def active(self, hash2: np.ndarray) -> np.ndarray:
        """The truth: the filters less their exceptions."""
        out = self.maybe(hash2)
        if self.exceptions:
            for i in np.flatnonzero(out):
                out[i] = (int(hash2[i, 0]), int(hash2[i, 1])) not in self.exceptions
        return out


def key_counts(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """``hi, lo, n``: the number of rows that have each line key."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter[bytes] = Counter()
            for x in b.column(0).cast(pa.large_binary()):
                found.update({k for k in set(map(key_of, (x.as_py() or b"").split(b"\n"))) if long_enough(k, min_chars)})
            hash2 = hashed(list(found))
            yield pa.RecordBatch.from_arrays([pa.array(hash2[:, 0]), pa.array(hash2[:, 1]), pa.array(list(found.values()), pa.int64())], ["hi", "lo", "n"])

    return docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


class LineIndex:
    """The state: ``counts`` (hi, lo, n) and ``filters`` (shard, bits, slots) as tables in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, max_filter_bytes: int = MAX_FILTER_BYTES):
        self.spark, self.min_docs, self.min_chars, self.max_filter_bytes = spark, min_docs, max(1, min_chars), max_filter_bytes
        self.shards = 0
        self.counts = spark.createDataFrame([], "hi long, lo long, n long")
        self.filters = spark.createDataFrame([], "shard int, bits int, slots binary")

    def _shard(self) -> F.Column:
        return F.col("lo").bitwiseAND(F.lit(self.shards - 1)).cast("int").alias("shard")

    def active(self) -> DataFrame:
        return self.counts.where(F.col("n") >= self.min_docs)

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._change(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Takes back rows that were inserted before; refuses, without any change, rows of which a line was never inserted so often."""
        return self._change(docs, text_col, -1)

    def _change(self, docs: DataFrame, text_col: str, sign: int) -> LineIndex:
        delta = key_counts(docs, text_col, self.min_chars)
        if not self.shards:
            if sign < 0 and not delta.isEmpty():
                raise ValueError("nothing was inserted that could be deleted")
            self.counts = table(delta, "line-counts")
            self._build()
            return self
        both = self.counts.withColumn("d", F.lit(0).cast("long")).unionByName(delta.select("hi", "lo", F.lit(0).cast("long").alias("n"), (F.col("n") * sign).alias("d")))
        changed = table(both.groupBy("hi", "lo").agg(F.sum("n").alias("old"), F.sum(F.col("n") + F.col("d")).alias("n")), "line-counts")
        if sign < 0 and not changed.where("n < 0").isEmpty():
            raise ValueError("documents were deleted that weren't inserted")
        self.counts = changed.where("n > 0").select("hi", "lo", "n")
        crossing = changed.where((F.col("old") >= self.min_docs) != (F.col("n") >= self.min_docs)).select(self._shard(), "hi", "lo", (F.col("n") >= self.min_docs).alias("enters"))

        def update(held: pa.Table, moves: pa.Table) -> pa.Table:
            rows = held.to_pylist()
            shard = rows[0]["shard"] if rows else moves.column("shard")[0].as_py()
            made = Cuckoo(rows[0]["bits"], np.frombuffer(rows[0]["slots"], "<u4")) if rows else Cuckoo(6)
            hi, lo, enters = (moves.column(c).to_numpy().astype(kind) for c, kind in (("hi", "<i8"), ("lo", "<i8"), ("enters", bool)))
            for a, b in zip(hi[~enters], lo[~enters]):
                made.delete(int(a), int(b))
            full = not made.insert(hi[enters], lo[enters])
            return pa.table({"shard": pa.array([shard], pa.int32()), "bits": pa.array([made.bits], pa.int32()), "slots": pa.array([made.slots.tobytes()], pa.binary()), "full": [full]})

        new = table(self.filters.groupBy("shard").cogroup(crossing.groupBy("shard")).applyInArrow(update, "shard int, bits int, slots binary, full boolean"), "line-filters")
        self.filters = new.drop("full")
        if not new.where("full").isEmpty():
            self._build()
        return self

    def _build(self) -> None:
        """Filters from the active rows."""
        n = self.active().count()
        self.shards = 1 << max(4, int(np.ceil(np.log2(max(1, n / SHARD_KEYS)))))

        def build(key: tuple, rows: pa.Table) -> pa.Table:
            made = Cuckoo.of(rows.column("hi").to_numpy(), rows.column("lo").to_numpy())
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([made.bits], pa.int32()), "slots": pa.array([made.slots.tobytes()], pa.binary())})

        self.filters = table(self.active().select(self._shard(), "hi", "lo").groupBy("shard").applyInArrow(build, "shard int, bits int, slots binary"), "line-filters")

    def _broadcast(self):
        """The filters and their exceptions, or None beyond the size bounds."""
        size = self.filters.agg(F.coalesce(F.sum(F.length("slots")), F.lit(0))).first()[0]
        if size > self.max_filter_bytes:
            return None
        rows = [(r["shard"], r["bits"], bytes(r["slots"])) for r in self.filters.toLocalIterator()]
        plain = self.spark.sparkContext.broadcast(Filters(self.shards, rows, []))

        def wrong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(plain.value.maybe(np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))))

        found = table(self.counts.where(F.col("n") < self.min_docs).select("hi", "lo").mapInArrow(wrong, "hi long, lo long"), "line-exceptions")
        if found.count() > MAX_EXCEPTIONS:
            return None
        return self.spark.sparkContext.broadcast(Filters(self.shards, rows, [(r["hi"], r["lo"]) for r in found.collect()]))

    def apply(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` without the lines of active keys, and with ``n_lines`` (before dropping) and ``n_dropped``."""
        small_batches(self.spark)
        min_chars = self.min_chars
        kind = "struct<text: string, n_lines: long, n_dropped: long>"

        def cleaned(values: pa.Array, active) -> pa.Array:
            lines = [(x.as_py() or b"").split(b"\n") for x in values.cast(pa.large_binary())]
            keys = [[key_of(x) for x in own] for own in lines]
            flat = list({k for own in keys for k in own if long_enough(k, min_chars)})
            gone = {k for k, out in zip(flat, active(hashed(flat))) if out} if flat else set()
            kept = [own if gone.isdisjoint(k) else [x for x, key in zip(own, k) if key not in gone] for own, k in zip(lines, keys)]
            text = pa.array([b"\n".join(x) for x in kept], pa.binary()).cast(pa.string())
            return pa.StructArray.from_arrays([text, pa.array([len(x) for x in lines], pa.int64()), pa.array([len(x) - len(y) for x, y in zip(lines, kept)], pa.int64())], ["text", "n_lines", "n_dropped"])

        known = self._broadcast()
        rest = [docs[f"`{c}`"] for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
        made = unused(docs, "cleaned")
        if known is not None:

            @F.arrow_udf(kind)
            def clean(text: pa.Array) -> pa.Array:
                return cleaned(text, known.value.active)

            out = docs.select(*rest, clean(docs[text_col].cast("string")).alias(made))
        else:
            out = self._joined(docs, text_col, cleaned, kind, made)
        back = [F.col(f"`{c}`") if c != text_col else F.col(f"{made}.text").alias(text_col) for c in docs.columns if c not in ("n_lines", "n_dropped")]
        return out.select(*back, f"{made}.n_lines", f"{made}.n_dropped")

    def _joined(self, docs: DataFrame, text_col: str, cleaned, kind: str, made: str) -> DataFrame:
        """Beyond the bounds of a broadcast: each row's keys meet the active rows of the table in a join.

        A row is known by the hash of its text: equal texts lose equal lines. Both sides of the joins are tables, so
        that AQE splits the partitions of hot keys.
        """

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for t, x in zip(b.column(0), b.column(1).cast(pa.large_binary())):
                    own = hashed(list(set(map(key_of, (x.as_py() or b"").split(b"\n")))))
                    yield pa.RecordBatch.from_arrays([pa.array([t.as_py()] * len(own), pa.string()), pa.array(own[:, 0]), pa.array(own[:, 1])], ["h", "hi", "lo"])

        h = F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)
        own = table(docs.select(h.alias("h"), docs[text_col].cast("string").alias("text")).mapInArrow(keys, "h string, hi long, lo long").distinct(), "line-keys")
        hits = own.join(table(self.active().select("hi", "lo"), "line-active"), ["hi", "lo"]).groupBy("h").agg(F.collect_list(F.struct("hi", "lo")).alias("hits"))

        @F.arrow_udf(kind)
        def clean(text: pa.Array, hits: pa.Array) -> pa.Array:
            gone = {(k["hi"], k["lo"]) for own in hits if own.as_py() for k in own.as_py()}
            return cleaned(text, lambda hash2: np.array([(int(a), int(b)) in gone for a, b in hash2], bool))

        by, of = unused(docs, "line_h"), unused(docs, "line_hits")
        joined = docs.withColumn(by, h).join(table(hits, "line-hits").withColumnsRenamed({"h": by, "hits": of}), by, "left")
        return joined.withColumn(made, clean(F.col(f"`{text_col}`").cast("string"), of)).drop(by, of)


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` without the lines whose key is found in at least ``min_docs`` rows; see the module."""
    return LineIndex(docs.sparkSession, min_docs, min_chars).insert(docs, text_col).apply(docs, text_col)
