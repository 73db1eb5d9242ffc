"""Operators against plain versions on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import time
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("public_tokenizers")

from spillway.llm import bpe, chat, components, embed_dedup, labelled, line_dedup, packing, quality, rules, simhash, toxicity, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "One two three"), (3, "One two three"), (None, "no id"), (4, "é " * 40_000), (5, "x" * 100_000), (6, "🙂 tail 1a'll\r\n\n  end"), (7, "\x1c   odd\u0085")]

# ---------------------------------------------------------------- components


def brute_components(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {a: find(a) for a in parent}


@pytest.mark.parametrize("edges", [[], [(5, 5)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(9, 3), (3, 9), (3, 7), (20, 21)], [(random.Random(1).randrange(60), random.Random(i).randrange(60)) for i in range(50)]])
def test_components(spark, edges):
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame([*edges, (None, 1)], "u long, v long")).collect()}
    assert found == {k: v for k, v in brute_components([e for e in edges if e[0] != e[1]]).items()}


# ---------------------------------------------------------------- byte-level BPE

MULTI = tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def multi():
    import tiktoken

    own = bpe.Bpe.parse(open(MULTI, "rb").read())
    return own, bpe.Bpe(own.ranks), tiktoken.Encoding("t", pat_str=tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={}), bpe.Splitter(tokenizers.PATTERN).compiled()


def test_every_token_encodes_to_itself(multi):
    assert all(multi[0].merge(t) == [i] for t, i in list(multi[0].ranks.items())[::7])


def test_all_matches_that_are_no_tokens_are_joined(multi, monkeypatch):
    import duckdb

    joined = []
    monkeypatch.setattr(bpe.Bpe, "join", lambda self, a, b, join=bpe.Bpe.join: joined.append(1) or join(self, a, b))
    fresh, seen, through = bpe.Bpe(multi[0].ranks), set(), 0
    for (text,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall():
        for word in {w.encode() for w in multi[3](text)} - seen:
            seen.add(word)
            fresh._spans.clear()
            before = len(joined)
            ids = fresh.encode(word)
            through += len(joined) > before
            assert ids == multi[0].merge(word) and (len(ids) == 1 or len(joined) > before)
    assert through > 0.5 * len(seen)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text("ab ", max_size=400), st.text("the on'll1 \n", max_size=300)))
def test_bpe_as_tiktoken(multi, text):
    own, tree, tik, split = multi
    words = split(text)
    assert "".join(words) == text
    assert [i for w in words for i in own.encode(w.encode())] == tik.encode_ordinary(text) == [i for w in words for i in tree.encode(w.encode())]
    if text:
        assert tree.tree(text.encode()) == own.merge(text.encode())


def test_bpe_query_columns(spark, multi):
    found = bpe.encode(docs(spark, ODD, "doc_id long, text string").withColumn("ids", F.lit(1)), MULTI, tokenizers.PATTERN)
    rows = found.select("*", bpe.decoder(spark, MULTI)("ids").alias("back")).collect()
    want = collections.Counter((i, (t or "").encode(), np.array(multi[2].encode_ordinary(t or ""), "<u4").tobytes()) for i, t in ODD)
    assert collections.Counter((r["doc_id"], bytes(r["back"]), bytes(r["ids"])) for r in rows) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
    assert bpe.encode(docs(spark, []), MULTI, tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="vocabulary"):
        multi[0].decode([10**6])


# ---------------------------------------------------------------- quality classifier


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 6)).astype(np.float32)
    score = x @ np.array([2, -1, 0.5, 0, 0, 0])
    model = quality.fit(x, np.digitize(score, [-1.5, 0, 1.5]))
    assert model.grades == (0, 1, 2, 3) and (np.diff(model.thresholds) > 0).all()
    expected, tail = model.judged(x, 2)
    assert np.corrcoef(expected, score)[0, 1] > 0.9
    assert ((tail >= 0.5) == (score > 0)).mean() > 0.95
    assert (model.judged(x, 0)[1] == 1).all() and (model.judged(x, 9)[1] == 0).all()


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None), (6, 0)], "doc_id long, quality int")
    df = docs(spark, [(*r, 9.0) for r in ODD], "doc_id long, text string, quality double")
    model = quality.learn(df.select("doc_id", "text"), labels)
    rows = quality.judge(df, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["quality"]["tail_prob"] <= 1 for r in rows)
    none = quality.learn(df.limit(0), labels.limit(0))
    assert none.grades == (0,) and all(r["quality"]["tail_prob"] == 0 for r in quality.judge(df, none).collect())
    assert quality.judge(df.limit(0), model).count() == 0


@pytest.mark.parametrize(("name", "least"), [("quality", 0.97), ("toxic", 0.97)])
def test_held_out_accuracy(spark, name, least):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    held = d.join(labels, "doc_id").where(labelled.held_out(F.col("doc_id")))
    if name == "quality":
        judged = quality.judge(held.withColumnRenamed("quality", "y"), quality.learn(d, labels)).select("y", (F.col("quality.tail_prob") >= 0.5).cast("int").alias("p"))
    else:
        judged = toxicity.score(held, toxicity.learn(d, labels)).select(F.col("toxic").alias("y"), (F.col("score") >= 0.5).cast("int").alias("p"))
    right, n = judged.agg(F.avg((F.col("y") == F.col("p")).cast("int")), F.count(F.lit(1))).first()
    assert n > 400 and right >= least


def test_samples_leave_the_held_out_fold(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, toxic int")
    rows = labelled.sample(docs(spark, [(i, str(i)) for i in range(200)]), labels, "toxic", 50).collect()
    assert len(rows) == 50 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


# ---------------------------------------------------------------- toxicity


def test_folding_and_exceptions(spark):
    assert toxicity.folded("ＩＤＩОТ! 1d10t m0r0n tr@sh Idiót 2024 a$$$ b") == " idiot idiot moron trash idiot 2024 a b "
    model = toxicity.Model({"trash": 2.0, "idiot": 3.0}, ("trash can",), (-2.0, 1.0, 1.0, 0.5))
    rows = toxicity.score(docs(spark, [(1, "a trash can"), (2, "you trash can idiot"), (3, None), (4, "trash")]), model).collect()
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[1] == score[3] < score[2] and score[4] > score[3]
    assert toxicity.score(docs(spark, []), model).count() == 0
    automaton = model.automaton()
    assert model.matches(automaton, " trash trash ") == [(1, 6, 2.0), (7, 12, 2.0)]


def test_matching_is_linear_in_the_length_of_a_text():
    model = toxicity.Model({"trash": 2.0, "idiot": 3.0}, ("so trash can", "trash can"), (-2.0, 1.0, 1.0, 0.5))
    automaton, text = model.automaton(), toxicity.folded("trash can idiot trash so trash can " * 300_000)
    start = time.time()
    assert len(text) > 10_000_000 and len(model.matches(automaton, text)) == 600_000
    assert time.time() - start < 60


def test_toxicity_learns_exceptions_and_survives_no_labels(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(30)]
        if i % 4 == 0:
            text[5] = text[17] = "vile"
        elif i % 12 == 1:
            text[5:7] = ["vile", "jelly"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    d, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(d, lab)
    assert "vile" in model.lexicon and "vile jelly" in model.exceptions
    empty = toxicity.learn(d, lab.limit(0))
    assert empty.lexicon == {} and toxicity.score(d, empty).select("score").distinct().count() == 1


# ---------------------------------------------------------------- WARC


def pages_want(rows, least):
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= least and i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f is None or f == i else "revisit", None if f is None or f == i else f))
    return sorted(out, key=repr)


PAGES = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://é", "a\r\n\r\nb\r\n\r\n"), (None, "http://n", "<p>é</p>"), (6, "http://6", "x" * 200_000), (6, "http://6", "x" * 200_000)]


@pytest.mark.parametrize(("least", "broadcast"), [(0, 10), (5, 10), (0, 0), (5, 0)])
def test_warc_round_trip(spark, tmp_path, monkeypatch, least, broadcast):
    monkeypatch.setattr(warc, "MAX_REPEATED", broadcast)
    df = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int").repartition(3)
    index = warc.write(df, f"file://{tmp_path}/w", min_revisit_bytes=least)
    rows = warc.read(index).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=repr) == pages_want(PAGES, least)
    assert {r["payload"].decode() for r in rows if r["record_type"] == "response"} == {h or "" for _, _, h in PAGES}
    some = warc.read(index.where("url = 'http://c'")).collect()
    assert [r["page_id"] for r in some] == [3]
    assert {r["url"] for r in rows} >= {"http://a/ X: y", "", "http://é"}


def test_warc_slices_are_dealt_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SLICE", 4000)
    monkeypatch.setattr(warc, "TASK_BYTES", 8000)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, "u", rng.bytes(300).hex()) for i in range(400)], "page_id long, url string, html string").coalesce(1)
    index = warc.write(df, f"file://{tmp_path}/w")
    found = warc.read(index)
    assert found.rdd.getNumPartitions() >= 8 and len(found.collect()) == 400


def test_warc_of_nothing_and_ranges(spark, tmp_path):
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))).count() == 0
    runs = warc.coalesced([("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP + 1, 5), ("b", 0, 3)])
    assert [(a, o, n, len(p)) for a, o, n, p in runs] == [("a", 0, 20, 2), ("a", 21 + warc.GAP, 5, 1), ("b", 0, 3, 1)]
    with pytest.raises(ValueError, match="cut off"):
        warc.parse(warc.record(1, "u", b"abc", "D", None, False, "d")[:-5])


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for _, t in ODD:
        assert int.from_bytes(simhash.fingerprint((t or "").encode()), "big") == plain_fingerprint(t)


def ball(rng, centers, per, flips):
    out = set()
    for _ in range(centers):
        c = rng.getrandbits(64)
        for _ in range(per):
            x = c
            for b in rng.sample(range(64), rng.randrange(flips + 1)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def near_pairs(fps, distance):
    """All pairs of at most ``distance`` differing bits, by looking at all of them (in threads: numpy lets go of the lock)."""
    a = np.array(fps, np.uint64)

    def rows(lo):
        return [(i, int(j) + i + 1) for i in range(lo, min(lo + 256, len(a))) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= distance)]

    with ThreadPoolExecutor(8) as pool:
        return [p for found in pool.map(rows, range(0, len(a), 256)) for p in found]


def signed(fps):
    return [x - (1 << 64) if x >> 63 else x for x in fps]


def linked_by_index(spark, fps, distance, chunk):
    points = spark.createDataFrame([(0, x, x, 0) for x in signed(fps)], "t int, id long, fp long, more long")
    edges = simhash.links(points, simhash.within(distance), chunk)
    return {r["node"]: r["root"] for r in components.components(edges).collect()}


@pytest.mark.parametrize(("centers", "per", "flips", "chunk", "distance"), [(40, 5, 4, 1 << 16, 3), (2, 400, 5, 64, 3), (1, 700, 12, 100, 3), (300, 1, 0, 4096, 3), (30, 20, 9, 50, 7)])
def test_links_as_brute_force(spark, centers, per, flips, chunk, distance):
    fps = ball(random.Random(centers), centers, per, flips)
    own = signed(fps)
    assert linked_by_index(spark, fps, distance, chunk) == brute_components([(own[i], own[j]) for i, j in near_pairs(fps, distance)])


def test_all_links_come_from_the_index_over_many_fingerprints(spark):
    rng = random.Random(11)
    fps = sorted({*ball(rng, 1500, 20, 4), *(rng.getrandbits(64) for _ in range(80_000))})
    own = signed(fps)
    assert len(fps) > 100_000
    assert linked_by_index(spark, fps, 3, 1 << 14) == brute_components([(own[i], own[j]) for i, j in near_pairs(fps, 3)])


def test_upper_levels_prune_pairs_of_chunks(spark):
    rng = random.Random(12)
    fps = sorted({*(rng.getrandbits(64) for _ in range(20_000)), *ball(rng, 40, 10, 4)})
    parts = simhash.in_chunks(spark.createDataFrame([(k, x, x, 0) for k in (0, 1) for x in signed(fps)], "t int, id long, fp long, more long"), 128)
    sizes = collections.Counter((r["t"], r["part"]) for r in parts.collect())
    n = -(-len(fps) // 128)
    assert len(sizes) == 2 * n and n > simhash.TOP and set(sizes.values()) <= {128, len(fps) % 128}
    pairs = {(r["t"], r["a"], r["b"]) for r in simhash.chunk_pairs(parts, simhash.within(3)).collect()}
    assert len(pairs) < 0.85 * n * (n + 1) and {(0, k, k) for k in range(n)} <= pairs
    place = {r["fp"]: r["part"] for r in parts.where("t = 0").collect()}
    own = signed(fps)
    assert all((0, *sorted((place[own[i]], place[own[j]]))) in pairs for i, j in near_pairs(fps, 3))


def test_index_prunes_and_finds():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a = np.unique(np.concatenate([a, a[:200] ^ np.uint64(5), a[200:300] ^ np.uint64(1 << 60)]))
    want = brute_components(near_pairs(a, 3))
    groups = lambda root: {frozenset(np.flatnonzero(root == r).tolist()) for r in set(root)}
    brute = np.array([want.get(i, i) for i in range(len(a))])
    assert groups(simhash.linked(a, None, simhash.within(3))) == groups(brute)
    assert len(simhash.Index(a[np.argsort(simhash.gray_rank(a))]).levels) > 2
    order = sorted(range(8), key=lambda x: int(simhash.gray_rank(np.array([x], np.uint64))[0]))
    assert all(bin(x ^ y).count("1") == 1 for x, y in zip(order, order[1:]))


def test_dedup_odd_rows(spark):
    rows = simhash.dedup(docs(spark, ODD).withColumn("fp", F.lit("clash"))).collect()
    assert len(rows) == len(ODD)
    zero = [r for r in rows if r["doc_id"] in (0, 1, 2)]
    assert {r["component_id"] for r in zero} == {0} and [r["kept"] for r in zero].count(True) == 1
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert simhash.dedup(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- quality rules


def plain_statistics(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    count, cover = collections.Counter(windows), set()
    for k, x in enumerate(windows):
        if count[x] > 1:
            cover.update(range(k, k + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_statistics(spark):
    rows = [*ODD, (8, "a b c d e f g h " * 3), (9, "x\nx\n \n \nx y"), (10, " ".join(f"w{i}" for i in range(30)) + " | # <b>"), (11, "a b c d e f g h i a b c d e f g h j k l")]
    found = rules.statistics(docs(spark, [(*r, 1) for r in rows], "doc_id long, text string, n_words int")).collect()
    have = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found)
    assert have == collections.Counter((i, *plain_statistics(t)) for i, t in rows)
    assert rules.statistics(docs(spark, [])).count() == 0
    assert rules.statistics(docs(spark, rows)).where("not base_failed").count() == sum((s := plain_statistics(t))[0] >= 20 and 100 * s[4] <= 30 * s[0] for _, t in rows)
    clash = docs(spark, rows).withColumns({c: F.lit("own") for c in ("__words", "__lines", "__windows", "n")})
    assert {r["__words"] + r["__lines"] + r["__windows"] + r["n"] for r in rules.statistics(clash).collect()} == {"own" * 4}


def test_rules_are_learned(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) + ("%%" if bad and rng.random() < 0.9 else "") for _ in range(60)]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    d, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    learned = rules.learn(d, lab)
    assert learned and all(isinstance(str(c), str) for r in learned for c in r)
    judged = {r["doc_id"]: r["kept"] for r in rules.judge(d, learned).collect()}
    assert sum(judged[i] == bool(q) for i, q in labels) >= 0.97 * len(labels)
    assert rules.learn(d, lab.where("quality = 1")) == [] and rules.learn(d, lab.limit(0)) == []
    assert rules.judge(d, []).where("kept").count() == 600


def test_native_operators_run_no_python(spark):
    sf = "/root/testdata/sf0.001"
    from spillway.llm.queries import QUERIES

    for name in ("op5_rules", "op8_chat"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# ---------------------------------------------------------------- packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=12))
def test_plan_places_every_piece(histogram):
    patterns = packing.plan(histogram, 64)
    assert all(sum(p) <= 64 and list(p) == sorted(p, reverse=True) for p, _ in patterns)
    assert sum((collections.Counter({k: v * n for k, v in collections.Counter(p).items()}) for p, n in patterns), collections.Counter()) == collections.Counter(histogram)
    runs = packing.places(patterns)
    for length, n in histogram.items():
        spans = sorted((first, first + count) for x, first, count, *_ in runs if x == length)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_packing_with_another_tokenizer_file(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(tokenizers.path("byte_bpe_50k.json")))
    assert packing.plain_byte_level(spec)
    spec["normalizer"] = {"type": "Lowercase"}
    assert not packing.plain_byte_level(spec)
    raw = json.dumps(spec)
    assert packing.encoder(raw.encode())("Some TEXT, é") == Tokenizer.from_str(raw).encode("some text, é", add_special_tokens=False).ids
    spec["normalizer"], spec["model"]["merges"] = None, spec["model"]["merges"][::-1]
    assert not packing.plain_byte_level(spec)


@pytest.mark.parametrize(("rows", "broadcast"), [(1 << 16, 500_000), (7, 500_000), (7, 0)])
def test_a_length_that_most_pieces_have_is_ranked_in_many_buckets(spark, monkeypatch, rows, broadcast):
    monkeypatch.setattr(packing, "BUCKET_ROWS", rows)
    monkeypatch.setattr(packing, "MAX_BROADCAST", broadcast)
    given = [(1, 5, "same")] * 150 + [(k, 1 + k % 9, "own") for k in range(100)]
    df = spark.createDataFrame(given, "doc_id long, length int, key string").withColumns({c: F.lit(c) for c in ("row", "bucket", "n", "Rank", "run", "k")})
    found = packing.pack(df, capacity=16).collect()
    assert collections.Counter((r["doc_id"], r["length"], r["key"]) for r in found) == collections.Counter(given) and all(r["Rank"] == "Rank" for r in found)
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 16


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    rows = [*ODD, (8, "a <|endoftext|> b"), *((100 + i, "same text") for i in range(300))]
    pieces = packing.tokenize(docs(spark, [(*r, 1) for r in rows], "doc_id long, text string, length int"), path, capacity=256)
    packed = packing.pack(pieces, capacity=256).collect()
    tok = Tokenizer.from_file(path)
    want = collections.Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    parts, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        assert r["length"] * 4 == len(r["ids"])
        parts[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in want:
        if want[i, ids] == 1:
            own = sorted(parts[i], key=lambda r: r["start"])
            assert tuple(np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist()) == ids and {r["doc_tokens"] for r in own} == {len(ids)}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(n for p in sequences.values() for _, n in p) > 0.9 * 256 * len(sequences)
    assert packing.pack(packing.tokenize(docs(spark, []), path)).count() == 0


# ---------------------------------------------------------------- line dedup


def plain_dedup(rows, least):
    key = lambda line: line.encode().strip(b" \t\n\x0b\x0c\r").lower()
    count = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


LINES = [*ODD, *((10 + i, f"Header \n{i % 4}\n\n  HEADER\nline {i}") for i in range(12)), *((50 + i, "É\té\n menu ") for i in range(5)), (99, "header")]


@pytest.mark.parametrize("most", [1 << 20, -1])
def test_line_dedup(spark, most):
    df = docs(spark, [(*r, 7) for r in LINES], "doc_id long, text string, n_lines int")
    index = line_dedup.LineIndex(spark, 3, max_filter_bytes=most).insert(df)
    found = index.apply(df).collect()
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in found) == plain_dedup(LINES, 3)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


@pytest.mark.parametrize("most", [1 << 20, -1])
def test_line_dedup_with_clashing_columns(spark, most):
    df = docs(spark, LINES).withColumns({c: F.lit(c) for c in ("cleaned", "Line_H", "line_hits", "__h")})
    found = line_dedup.LineIndex(spark, 3, max_filter_bytes=most).insert(df).apply(df)
    assert found.columns == [*df.columns, "n_lines", "n_dropped"]
    rows = found.collect()
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows) == plain_dedup(LINES, 3)
    assert all((r["cleaned"], r["Line_H"], r["line_hits"], r["__h"]) == ("cleaned", "Line_H", "line_hits", "__h") for r in rows)


def test_line_dedup_refuses_to_delete_what_was_not_inserted(spark):
    index = line_dedup.LineIndex(spark, 3)
    with pytest.raises(ValueError, match="inserted"):
        index.delete(docs(spark, LINES[:5]))
    index.insert(docs(spark, LINES[:12]))
    before = {tuple(r) for r in index.counts.collect()}
    with pytest.raises(ValueError, match="inserted"):
        index.delete(docs(spark, [(1, "never seen")]))
    assert {tuple(r) for r in index.counts.collect()} == before


def test_line_dedup_is_reversible(spark):
    some, more = LINES[:16], LINES[16:]
    index = line_dedup.LineIndex(spark, 3).insert(docs(spark, some))
    before = {tuple(r) for r in index.counts.collect()}
    index.insert(docs(spark, more))
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in index.apply(docs(spark, LINES)).collect()) == plain_dedup(LINES, 3)
    index.delete(docs(spark, more))
    assert {tuple(r) for r in index.counts.collect()} == before
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in index.apply(docs(spark, some)).collect()) == plain_dedup(some, 3)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, size=(3000, 2))
    made = line_dedup.Cuckoo.of(keys[:2000, 0], keys[:2000, 1])
    held = line_dedup.Filters(1, [(0, made.bits, made.slots.tobytes())], [])
    assert held.maybe(keys[:2000]).all() and held.maybe(keys[2000:]).sum() == 0
    assert all(made.delete(int(a), int(b)) for a, b in keys[:1000])
    held = line_dedup.Filters(1, [(0, made.bits, made.slots.tobytes())], [])
    assert held.maybe(keys[1000:2000]).all() and not held.maybe(keys[:1000]).any()
    assert not line_dedup.Filters(16, [], []).maybe(keys).any()
    wrong = line_dedup.Filters(1, [(0, made.bits, made.slots.tobytes())], [tuple(map(int, keys[1500]))])
    assert wrong.active(keys[1000:2000]).sum() == 999


# ---------------------------------------------------------------- chat


def test_chat(spark):
    def turns(c, *texts):
        return [(c, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]

    rows = [*turns(1, "hi"), *turns(2, "hi", "yo"), *turns(3, "hi", "yo", "ok"), *turns(4, "hi", "no"), *turns(5, "hi", "yo", "ok"), *turns(6, None, "x"), *turns(7, "", "x"), (None, None, None, "lost"), (8, 1, "user", "dup"), (8, 1, "user", "dup"), *turns(9, *map(str, range(600)))]
    found = chat.render(spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, pos int")).collect()
    by = collections.defaultdict(dict)
    for r in found:
        by[r["conv_id"]][r["part"]] = r
    assert set(by) == {3, 4, 6, 7, 8, 9, None}
    assert by[3][0]["text"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user|>\nok<|end|>\n" and by[3][0]["n_copies"] == 2
    assert by[8][0]["n_turns"] == 2 and by[None][0]["text"] == "<||>\nlost<|end|>\n"
    assert sorted(by[9]) == [0, 1, 2] and "".join(by[9][k]["text"] for k in range(3)).count("<|end|>") == 600
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---------------------------------------------------------------- embeddings


def test_e8():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(300, 8)) * 3
    point = embed_dedup.nearest_e8(y)
    twice = (2 * point).astype(int)
    assert np.isin((twice % 2).sum(1), (0, 8)).all() and (point.sum(1) % 2 == 0).all()
    whole = [s * np.eye(8)[i] + t * np.eye(8)[j] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    half = [np.array([0.5 if b >> k & 1 == 0 else -0.5 for k in range(8)]) for b in range(256) if bin(b).count("1") % 2 == 0]
    roots = np.array(whole + half)
    assert len(roots) == 240
    away = ((y[:, None] - point[:, None] - roots) ** 2).sum(2)
    assert (((y - point) ** 2).sum(1) <= away.min(1) + 1e-9).all()
    beside = embed_dedup.neighbour_e8(y, point)
    assert np.allclose(((y - beside) ** 2).sum(1), away.min(1))


@pytest.mark.parametrize("chunk", [2048, 16])
def test_embeddings(spark, chunk):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 32))
    rows, vid = [], 0
    for k in range(400):
        v = base[k % 30] + rng.normal(size=32) * 0.12 * rng.random()
        rows.append((vid, v.astype(np.float32).tolist(), k % 30 % 3))
        vid += 1
    rows += [(vid + i, rows[5][1], rows[5][2]) for i in range(40)]
    vid += 40
    odd = [(vid, None, 1), (vid + 1, [0.0] * 32, 1), (vid + 2, [float("nan")] + [1.0] * 31, 1), (vid + 3, [None] + [1.0] * 31, 1), (vid + 4, rows[0][1], None), (vid + 5, [], 1), (vid + 6, [1.0, 2.0], 1), (vid + 7, [2.0, 4.0], 1), (vid + 8, [float("inf")] * 32, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash"))
    have = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.dedup(df, chunk=chunk).collect()}
    good = [r for r in rows + odd if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    edges, links = [], collections.Counter()
    for i, a in enumerate(good):
        for b in good[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    edges.append((a[0], b[0]))
                    links[a[0]] += 1
                    links[b[0]] += 1
    roots = brute_components(edges)
    assert len(have) == len(rows + odd)
    assert sum(v[0] for v in have.values()) >= 0.97 * sum(links.values()) and all(have[k][0] <= links[k] for k in have)
    assert sum(have[k][1] == roots.get(k, k) for k in have) >= 0.97 * len(have)
    assert all(have[r[0]] == (0, r[0], True) for r in odd if r[0] not in (vid + 6, vid + 7))
    assert have[vid + 7][:2] == (1, vid + 6)
    assert embed_dedup.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [2, 3])
def test_embeddings_recall_with_more_blocks(spark, blocks):
    """Cells of two and three lattice points, as tables of thousands and millions of vectors have them."""
    rng = np.random.default_rng(blocks)
    base = rng.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    near = 0.981 * base + math.sqrt(1 - 0.981**2) * away  # just above the threshold: the hardest
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, near]))]
    found = embed_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), blocks=blocks).collect()
    linked = sum(r["n_links"] == 1 for r in found)
    assert linked >= 0.98 * 800 and all(r["component_id"] == r["vec_id"] % 400 for r in found if r["n_links"])


def test_embeddings_of_any_label_and_size(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, 1.0, -2.0]
    big, small = [x * 1e300 for x in v], [x * 1e-60 for x in v]
    for kind, a, b in (("double", 1.2, 1.9), ("string", "en", "fr"), ("int", 1, 2), ("boolean", True, False)):
        rows = [(1, v, a), (2, big, a), (3, small, a), (4, v, b), (5, w, a), (6, w, None)]
        found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.dedup(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
        assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6)}, kind
    rows = [(1, v, 1), (1, w, 1), (None, v, 1), (2, w, 1), (None, [9.0, -9.0, 1.0], 1)]
    found = collections.Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert found == collections.Counter([(1, 1, 1, True), (1, 1, 1, True), (None, 1, 1, False), (2, 1, 1, False), (None, 0, None, False)])


def test_no_link_is_counted_twice():
    a = np.array([[[1, 2, 3]], [[1, 2, 3]], [[9, 2, 3]]])
    b = np.array([[[1, 5, 6]], [[2, 1, 6]], [[7, 9, 8]]])
    first, cell = embed_dedup.met(a, b)
    assert first.tolist() == [0, 0, 0] and cell.tolist() == [1, 1, 9]
