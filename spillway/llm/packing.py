"""Packing of token pieces into sequences: shortest-pack-first over the histogram of lengths.

A document's ids are cut into pieces of at most ``capacity``. The histogram of piece lengths, at most ``capacity`` numbers,
goes to the driver. There, lengths are placed longest first, all pieces of a length at once: they go to the packs
with most room, whose pattern counts are split and updated; what no open pack holds opens new ones. Patterns are
then joined back to the pieces by rank: the k-th piece of a length takes the k-th place that the patterns have for it.
Ranks are counts over (length, bucket) plus a running sum over the buckets. A length has as many buckets as it has ``BUCKET_ROWS`` pieces, so
one that a third of all pieces have is spread over many tasks, at any size; equal pieces fall into different buckets, too.

The tables that are joined with the pieces are broadcast only while they are within ``MAX_BROADCAST`` rows: the numbers of buckets
(a row for each length), what lies before each bucket (pieces / BUCKET_ROWS rows more than that), and the runs of places.

Defined results: a null or empty text is the end mark alone; a row is one document, repeated ids included (their
pieces are ranked by a hash of what they hold); rows with a null id are packed too; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spillway.llm.common import documents, small_batches, table, unused

#: Pieces of one length that are ranked together, about; rows and runs of places of a table that is broadcast at most.
BUCKET_ROWS, MAX_BROADCAST = 1 << 16, 500_000
#: Fixed value: how a byte-level pre-tokenizer splits a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def plain_byte_level(spec: dict) -> bool:
    """Whether a tokenizers file is byte-level BPE and nothing else, with merges in the order of their ids: then its ranks say it all."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [spec.get(k) for k in ("normalizer", "truncation", "padding", "post_processor")] + [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")]
    added = any(x.get(k) for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if model.get("type") != "BPE" or any(odd) or added or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    return None not in made and all(x < y for x, y in zip(made, made[1:])) and len(made) + 256 == len(set(model["vocab"]) - {x["content"] for x in spec["added_tokens"]})


def encoder(raw: bytes):
    """A function from a text to its ids by a tokenizers JSON file, special texts included; plain byte-level BPE is done by tiktoken, faster."""
    spec = json.loads(raw)
    if not plain_byte_level(spec):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(raw.decode())
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    import tiktoken

    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    of_char = _byte_of_char()
    ranks = {bytes(of_char[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    made = tiktoken.Encoding(hashlib.sha256(raw).hexdigest(), pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: made.encode(text, allowed_special="all")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself and the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_encoders: dict[str, object] = {}


def tokenize(df: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids binary (little-endian unsigned 32-bit), doc_tokens``: the pieces of each row's ids and the end mark."""
    spark = df.sparkSession
    small_batches(spark)
    with open(tokenizer_path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    names = ["doc_id", "start", "length", "ids", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(raw.value).hexdigest()
        if key not in _encoders:
            _encoders[key] = encoder(raw.value)
        encode, end = _encoders[key], np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for i, x in zip(b.column(0), b.column(1)):
                ids = encode(x.as_py() or "")
                packed = (array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()) + end
                rows += [(i, s // 4, (t := min(s + 4 * capacity, len(packed))) // 4 - s // 4, packed[s:t], len(packed) // 4) for s in range(0, len(packed), 4 * capacity)]
            own, start, length, ids, total = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in own], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())], names)

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in the order they are placed) and the number of sequences of each."""
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("a piece must have 1 to capacity tokens")
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # free tokens -> pattern -> count
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max((r for r, p in room.items() if p and r >= length), default=0)
            if not most:
                each = capacity // length  # new packs hold as many of this length as they can
                full, over = divmod(left, each)
                for k, n in ((each, full), (over, 1)):
                    if k and n:
                        pattern = (length,) * k
                        at = room[capacity - k * length]
                        at[pattern] = at.get(pattern, 0) + n
                left = 0
                continue
            pattern, n = next(iter(room[most].items()))
            take = min(n, left)
            if take == n:
                del room[most][pattern]
            else:
                room[most][pattern] = n - take
            new, at = (*pattern, length), room[most - length]
            at[new] = at.get(new, 0) + take
            left -= take
    return [(pattern, n) for r in sorted(room) for pattern, n in room[r].items()]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Runs of places: (length, first rank, count, per sequence, first sequence, offset of the first, step of offsets)."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, n in patterns:
        at = i = 0
        while i < len(pattern):
            j = i
            while j < len(pattern) and pattern[j] == pattern[i]:
                j += 1
            length, per = pattern[i], j - i
            out.append((length, used[length], n * per, per, sequence, at, length))
            used[length] += n * per
            at, i = at + per * length, j
        sequence += n
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (columns ``length`` and any others) with ``sequence_id`` and ``offset``, gapless from 0 in each sequence."""
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    own = [F.col(f"`{c}`") for c in names]
    row, bucket, key, n, rank, run, k = (unused(pieces, c) for c in ("row", "bucket", "key", "n", "rank", "run", "k"))
    held = table(pieces.select(*own, F.monotonically_increasing_id().alias(row)), "pieces")
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    runs = places(plan(histogram, capacity))

    def joined(rows: DataFrame, other: DataFrame, size: int, *by: str) -> DataFrame:
        return rows.join(F.broadcast(other) if size <= MAX_BROADCAST else other, list(by))

    shares = spark.createDataFrame([(x, -(-c // BUCKET_ROWS)) for x, c in histogram.items()], f"length long, {n} long")
    keyed = joined(held.withColumn("length", F.col("length").cast("long")), shares, len(histogram), "length")
    keyed = keyed.withColumn(key, F.xxhash64(*own, row)).withColumn(bucket, F.pmod(F.xxhash64(F.lit(1), key), n).cast("int"))
    counts = table(keyed.groupBy("length", bucket).agg(F.count(F.lit(1)).alias(n)), "length-counts")
    earlier = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", bucket, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(rank))
    within = Window.partitionBy("length", bucket).orderBy(key, row)
    ranked = keyed.withColumn(k, F.row_number().over(within))
    ranked = joined(ranked, before, sum(-(-c // BUCKET_ROWS) for c in histogram.values()), "length", bucket)
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(k) - 1)
    # Each length's runs, sorted by first rank: a row looks its run up in arrays of its own length only.
    by_length: dict[int, list] = defaultdict(list)
    for length, first, _, per, sequence, at, step in runs:
        by_length[length].append((first, per, sequence, at, step))
    rows = [(length, [x[0] for x in v], [tuple(x) for x in v]) for length, v in by_length.items()]
    lookup = spark.createDataFrame(rows, f"length long, {n} array<long>, {run} array<struct<first: long, per: long, sequence: long, at: long, step: long>>")
    found = joined(ranked.drop(n), lookup, len(runs), "length")
    found = found.withColumn(run, F.element_at(run, F.size(F.filter(n, lambda x: x <= F.col(rank))))).withColumn(k, F.col(rank) - F.col(f"{run}.first"))
    sequence = F.col(f"{run}.sequence") + F.expr(f"{k} div {run}.per")
    offset = F.col(f"{run}.at") + (F.col(k) % F.col(f"{run}.per")) * F.col(f"{run}.step")
    return found.select(*own, sequence.alias("sequence_id"), offset.alias("offset"))
