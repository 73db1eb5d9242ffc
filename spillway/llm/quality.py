"""Quality by ordinal cumulative-link regression on graded ratings.

A text becomes a vector of hashed features: its byte trigrams, and a few shapes (how many of its words differ, repeat the word
before, hold no letter or only capitals, and how many lines repeat) as hashed tokens. All grades share one vector of
weights; ordered thresholds part them: P(grade > k) = sigmoid(x w - threshold k). From that come the expected grade and the
chance of at least a given grade, by which texts are selected.

Defined results: null and empty texts have the zero vector, so the thresholds alone decide; with fewer than two grades in the
sample, every text gets that grade (grade 0 without labels) with certainty; null ids and repeated rows pass; an empty table gives an empty table.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spillway.llm.common import small_batches
from spillway.llm.labelled import sample

#: Hashed features, and labelled rows that are learned from at most.
DIM, MAX_ROWS = 2048, 4_000
STEPS, RATE, RIDGE = 400, 0.05, 1e-4
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def shapes(text: bytes) -> list[bytes]:
    words = text.split()
    if not words:
        return []
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = {
        "differ": len(set(words)) / n, "again": sum(map(operator.eq, words, words[1:])) / n, "capitals": sum(map(bytes.isupper, words)) / n,
        "signs": len(text.translate(None, b"#*$%&|<>!{}[]=_~^")) / len(text), "lines": len(set(lines)) / len(lines),
    }
    return [f"{name} {int(10 * share)}".encode() for name, share in shares.items()]


def features(text: bytes, dim: int = DIM) -> np.ndarray:
    """Logarithms of counts, scaled to length one; shapes weigh as much as all trigrams."""
    out = np.zeros(dim, np.float32)
    if len(text) >= 3:
        b = np.frombuffer(text, np.uint8).astype(np.uint32)
        code = b[:-2] * _MIX[0] + b[1:-1] * _MIX[1] + b[2:] * _MIX[2]
        out = np.log1p(np.bincount((code ^ (code >> np.uint32(15))) * _MIX[1] >> np.uint32(32 - (dim - 1).bit_length()), minlength=dim)).astype(np.float32)
        out /= np.sqrt(out @ out)
    for token in shapes(text):
        out[zlib.crc32(token) % dim] += 0.5
    norm = np.sqrt(out @ out)
    return out / norm if norm else out


@dataclass
class Model:
    grades: tuple[int, ...]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.thresholds, -30, 30)))

    def judged(self, x: np.ndarray, at_least: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the chance of a grade of at least ``at_least``."""
        above = self.above(x)
        steps = np.diff(np.array(self.grades, float))
        expected = self.grades[0] + above @ steps
        k = int(np.searchsorted(self.grades, at_least))  # the first grade that is high enough
        tail = np.ones(len(x)) if k == 0 else np.zeros(len(x)) if k == len(self.grades) else above[:, k - 1]
        return expected, tail


def fit(x: np.ndarray, grade: np.ndarray, steps: int = STEPS) -> Model:
    """Maximum likelihood with a ridge, by Adam; the gaps between thresholds are exponentials, so their order holds."""
    grades = tuple(sorted(set(map(int, grade)))) or (0,)
    k = len(grades) - 1
    if k == 0:
        return Model(grades, np.zeros(x.shape[1]), np.zeros(0))
    y = np.searchsorted(grades, grade)
    share = np.clip([(y > j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    cut = np.log((1 - share) / share)
    p = np.concatenate([np.zeros(x.shape[1]), cut[:1], np.log(np.maximum(1e-2, np.diff(cut)))])
    m, v, d, rows = np.zeros_like(p), np.zeros_like(p), x.shape[1], np.arange(len(x))
    for t in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([p[d : d + 1], np.exp(np.clip(p[d + 1 :], -8, 8))]))
        s = 1 / (1 + np.exp(-np.clip((x @ p[:d].astype(x.dtype))[:, None] - theta, -30, 30)))
        up = np.column_stack([np.ones(len(x)), s])  # P(grade >= j)
        down = np.column_stack([s, np.zeros(len(x))])
        each = np.maximum(up[rows, y] - down[rows, y], 1e-9)
        slope = np.column_stack([np.zeros(len(x)), s * (1 - s), np.zeros(len(x))])
        by_score = (slope[rows, y] - slope[rows, y + 1]) / each
        by_theta = np.zeros(k)
        np.add.at(by_theta, np.maximum(y - 1, 0), np.where(y > 0, -slope[rows, y] / each, 0))
        np.add.at(by_theta, np.minimum(y, k - 1), np.where(y < k, slope[rows, y + 1] / each, 0))
        by_first = np.concatenate([[by_theta.sum()], [by_theta[j:].sum() * np.exp(np.clip(p[d + j], -8, 8)) for j in range(1, k)]])
        g = -np.concatenate([x.T @ by_score.astype(x.dtype) / len(x), by_first / len(x)])
        g[:d] += RIDGE * p[:d]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(grades, p[:d], np.cumsum(np.concatenate([p[d : d + 1], np.exp(np.clip(p[d + 1 :], -8, 8))])))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS, dim: int = DIM) -> Model:
    """From at most ``max_rows`` labelled rows; their vectors (2 * dim bytes each) are fitted on the driver."""
    if dim & (dim - 1):
        raise ValueError("dim must be a power of two")
    small_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def packed(text: pa.Array) -> pa.Array:
        return pa.array([features((x.as_py() or "").encode(), dim).astype("<f2").tobytes() for x in text], pa.binary())

    rows = sample(docs, labels, label_col, max_rows).select("doc_id", "label", packed("text").alias("x")).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])  # the same sums at every run
    x = np.array([np.frombuffer(r["x"], "<f2") for r in rows], np.float32).reshape(-1, dim)
    return fit(x, np.array([r["label"] for r in rows], int))


def judge(docs: DataFrame, model: Model, at_least: int = 1, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality``: a struct of ``expected_grade`` and ``tail_prob``, the chance of a grade of at least ``at_least``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected_grade: double, tail_prob: double>")
    def judged(text: pa.Array) -> pa.Array:
        own, expected, tail = shared.value, [], []
        dim = len(own.weights)
        held = [(x.as_py() or "").encode() for x in text]
        for at in range(0, len(held), 256):
            a, b = own.judged(np.array([features(t, dim) for t in held[at : at + 256]], np.float64), at_least)
            expected.append(a)
            tail.append(b)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(v) if v else [], pa.float64()) for v in (expected, tail)], ["expected_grade", "tail_prob"])

    return docs.withColumn("quality", judged(docs[text_col].cast("string")))
