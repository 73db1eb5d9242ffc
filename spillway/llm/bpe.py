"""Byte-level BPE as a monoid: halves are encoded on their own and joined at the boundary.

``encode`` splits a text with the tokenizer's pattern and reduces each match as a tree over its bytes: both
halves of a span are encoded recursively, down to single bytes and spans that are one token, then joined. Joining two token lists re-encodes a window around
the boundary that grows until the tokens outside provably stay: a sequence of tokens is what BPE makes of its
bytes exactly if every two neighbours are what BPE makes of theirs, so the window is final once its outer
tokens fit the tokens beside it. ``decode`` concatenates the bytes of both halves up the same kind of tree.

Defined results: a null or empty text has no tokens; decoding no ids gives empty bytes; null ids decode to null;
an id outside the vocabulary raises ValueError. Repeated rows, null ids of documents and extra columns pass
unharmed: every input row gives one output row.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm.common import documents, small_batches

#: Spans up to so many bytes are merged without a heap.
SHORT = 64
#: Distinct matches a worker remembers in each of two generations, and the longest one worth it; spans and pairs of tokens, and the longest span.
MEMO, MEMO_CHARS = 250_000, 64
SPANS, SPAN = 100_000, 16
#: Ids joined at once at the leaves of decoding.
RUN = 4096


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self._fits: dict[tuple[int, int], bool] = {}
        self._spans: dict[bytes, list[int]] = {}

    @classmethod
    def parse(cls, raw: bytes) -> Bpe:
        """From the lines ``base64-token rank`` of a vocabulary file."""
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())})

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: the pair of lowest rank is merged, the leftmost of equal ones, until none is left."""
        n, ranks = len(data), self.ranks
        if n <= SHORT:
            return self._merge_short(data)
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if (j := end[i]) == 0 or j >= n or ranks.get(data[i : end[j]]) != r:
                continue
            end[i], end[j] = end[j], 0
            if end[i] < n:
                before[end[i]] = i
                if (r := ranks.get(data[i : end[end[i]]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p : end[i]])) is not None:
                heapq.heappush(heap, (r, p))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _merge_short(self, data: bytes) -> list[int]:
        if not data:
            return []
        ranks, none = self.ranks, len(self.bytes_of)
        cuts = list(range(len(data) + 1))
        rank = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while rank and (r := min(rank)) < none:
            i = rank.index(r)
            del rank[i], cuts[i + 1]
            if i:
                rank[i - 1] = ranks.get(data[cuts[i - 1] : cuts[i + 1]], none)
            if i < len(rank):
                rank[i] = ranks.get(data[cuts[i] : cuts[i + 2]], none)
        return [ranks[data[a:b]] for a, b in zip(cuts, cuts[1:])]

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE makes just these two tokens of their bytes."""
        if (known := self._fits.get((a, b))) is None:
            if len(self._fits) >= SPANS:
                self._fits.clear()
            known = self._fits[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded spans together."""
        if not left or not right:
            return left or right
        if self.fits(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            window = self.merge(b"".join(self.bytes_of[i] for i in left[-a:] + right[:b]))
            left_holds = a >= len(left) or self.fits(left[-a - 1], window[0])
            right_holds = b >= len(right) or self.fits(window[-1], right[b])
            if left_holds and right_holds:
                return left[: max(0, len(left) - a)] + window + right[b:]
            a, b = a if left_holds else 2 * a, b if right_holds else 2 * b

    def encode(self, data: bytes) -> list[int]:
        """One match of the pattern; a match that is a token is that."""
        if (i := self.ranks.get(data)) is not None:
            return [i]
        return self.tree(data)

    def tree(self, data: bytes) -> list[int]:
        """A span: both halves on their own, joined; down to single bytes, or spans that BPE makes one token of."""
        if (known := self._spans.get(data)) is not None:
            return known
        n = len(data)
        if n < 2:
            return [self.ranks[data]] if n else []
        i = self.ranks.get(data)
        out = [i] if i is not None and self.merge(data) == [i] else self.join(self.tree(data[: n // 2]), self.tree(data[n // 2 :]))
        if n <= SPAN:
            if len(self._spans) >= SPANS:
                self._spans.clear()
            self._spans[data] = out
        return out

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) > RUN:
            mid = len(ids) // 2
            return self.decode(ids[:mid]) + self.decode(ids[mid:])
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        except (IndexError, TypeError) as e:
            raise ValueError("an id is outside the vocabulary") from e


class Memo(dict):
    """Packed ids of matches seen lately: a full generation becomes the old one. Long matches are encoded afresh."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.old = bpe, {}

    def __missing__(self, word: str) -> bytes:
        if (packed := self.old.get(word)) is None:
            packed = array("I", self.bpe.encode(word.encode())).tobytes() if LITTLE else np.array(self.bpe.encode(word.encode()), "<u4").tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed


LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


class Splitter:
    r"""Matches of a pattern as tiktoken finds them, by the standard library's faster ``re``.

    What \p{L}, \p{N} and \s hold is asked of tiktoken itself, whose Unicode version counts. ``re`` is fast only for
    classes below U+10000: a rarer character stands in the matched text as one of its class, place by place.
    """

    def __init__(self, pattern: str):
        import tiktoken

        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        self.sets = {}
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            found = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            self.sets[name] = _ranges(found.decode_bytes(found.encode_ordinary(every)).decode())
        self.pattern = self._written_out(pattern)

    def _written_out(self, pattern: str) -> str:
        sets = {k: "".join(f"\\u{lo:04x}-\\u{min(hi, 0xFFFF):04x}" for lo, hi in v if lo <= 0xFFFF) for k, v in self.sets.items()}
        out, inside, i = [], False, 0
        while i < len(pattern):
            name = next((t for t in (*sets, r"\S") if pattern.startswith(t, i)), None)
            step = name or pattern[i : i + (2 if pattern[i] == "\\" else 1)]
            if name == r"\S":
                if inside:
                    raise ValueError(r"\S inside a class")
                out.append(f"[^{sets[r'\s']}]")
            elif name:
                out.append(sets[name] if inside else f"[{sets[name]}]")
            else:
                inside = True if step == "[" else False if step == "]" else inside
                out.append(step)
            i += len(step)
        return "".join(out)

    def compiled(self) -> Callable[[str], list[str]]:
        found = re.compile(self.pattern)
        find, spans = found.findall, found.finditer
        high = [(lo, hi, stand_in) for name, stand_in in ((r"\p{L}", "b"), (r"\p{N}", "1"), (r"\s", " ")) for lo, hi in self.sets[name] if hi > 0xFFFF]

        @functools.lru_cache(1 << 16)
        def stand_in(c: str) -> str:
            return next((s for lo, hi, s in high if lo <= ord(c) <= hi), "!")

        def split(text: str) -> list[str]:
            if text.isascii() or not ASTRAL.search(text):
                return find(text)
            return [text[m.start() : m.end()] for m in spans(ASTRAL.sub(lambda m: stand_in(m[0]), text))]

        return split


def _ranges(chars: str) -> list[tuple[int, int]]:
    points = np.array([ord(c) for c in chars])
    cut = np.flatnonzero(np.diff(points) != 1) + 1
    return [(int(p[0]), int(p[-1])) for p in np.split(points, cut) if len(p)]


_loaded: dict[str, tuple[Bpe, Memo]] = {}


def load(raw: bytes) -> tuple[Bpe, Memo]:
    """Once in each Python worker."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _loaded:
        bpe = Bpe.parse(raw)
        _loaded[key] = bpe, Memo(bpe)
    return _loaded[key]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file (about 1 MB) as a broadcast, so that executors need no copy of it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens long, ids binary`` (little-endian unsigned 32-bit) for each row of ``df``."""
    spark = df.sparkSession
    small_batches(spark)
    raw, splitter = vocabulary(spark, vocab_path), Splitter(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, split = load(raw.value)[1].__getitem__, splitter.compiled()
        for b in batches:
            packed = [b"".join(map(get, split(t))) if t else b"" for t in (x.as_py() for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decoder(spark: SparkSession, vocab_path: str) -> Callable[[Column | str], Column]:
    """A function from a column of packed ids to a column of their bytes."""
    small_batches(spark)
    raw = vocabulary(spark, vocab_path)

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        bpe = load(raw.value)[0]
        return pa.array([None if (x := v.as_py()) is None else bpe.decode(np.frombuffer(x, "<u4").tolist()) for v in ids], pa.binary())

    return decode
