"""Near copies against Jaccard similarity of all pairs, and the pipeline's stage that uses them."""

import collections
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from spillway.llm import near_copies  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows):
    """Sets of the rows' places."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common) > 0:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    out = collections.defaultdict(set)
    for i, r in enumerate(root):
        out[r].add(i)
    return {frozenset(x) for x in out.values()}


def copies(seed, groups=30, per=5, words=120, changes=5):
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((3, 5, 7, words)))]
        for k in range(per):
            own = list(base)
            for _ in range(rng.randrange(changes) if k else 0):
                own[rng.randrange(len(own))] = f"W{rng.randrange(5000)}"
            out.append(" ".join(own))
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate([*out, None, "", " \n", out[0].upper(), out[1]])]


@pytest.mark.parametrize(("groups", "per", "chunk"), [(30, 5, 1024), (2, 80, 16)])
def test_components_as_brute_force(spark, groups, per, chunk):
    rows = copies(groups, groups, per)
    found = collections.defaultdict(set)
    for r in near_copies.dedup(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).collect():
        found[r["component"]].add(r["doc_id"])
    want = plain_components(rows)
    assert any(len(x) > 2 for x in want)
    assert {frozenset(x) for x in found.values()} == want


def test_sides_are_compared_across():
    s = [np.arange(k, k + 40, dtype=np.uint64) for k in (0, 1, 2, 100)]
    assert near_copies.linked(s).tolist() == [0, 0, 0, 3]
    assert near_copies.linked(s, np.array([0, 0, 0, 1])).tolist() == [0, 1, 2, 3]
    assert near_copies.linked(s, np.array([0, 1, 0, 1])).tolist() == [0, 0, 0, 3]


def test_stage_drops_near_copies_more_than_three_bits_apart(spark):
    rows = copies(7)
    out = corpus_pipeline.distinct(spark, spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA), "unused")
    assert {r["doc_id"] for r in out.collect()} == {min(x) for x in plain_components(rows)}


def test_stage_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = corpus_pipeline.distinct(spark, docs, "unused")
    assert {r["doc_id"] for r in out.collect()} == {min(rows[i][0] for i in x) for x in plain_components(rows)}


def test_stage_decides_by_row(spark):
    long = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcd"]
    near = [x.replace(f"{c}39", "end") for c, x in zip("abcd", long)]
    rows = [(1, long[0]), (5, near[0]), (5, long[1]), (None, long[0]), (None, near[1]), (None, long[2]), (None, near[2]), (None, long[3]), (None, long[3])]
    out = corpus_pipeline.distinct(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA), "unused")
    have = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(have) == 4 and have.count((None, long[3])) == 1
    assert {x for x in have if x[0] is not None} == {(1, long[0]), (5, long[1])}
    assert len([x for x in have if x in ((None, long[2]), (None, near[2]))]) == 1
