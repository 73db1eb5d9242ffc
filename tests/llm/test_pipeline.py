"""The pipeline's stages against plain versions."""

import collections

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from spillway.llm import common, quality, toxicity  # noqa: E402
from test_near_copies import plain_components  # noqa: E402
from test_registered import plain_features, plain_score  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    graded = {r["doc_id"]: r["quality"] for r in labels.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "line_dedup", "near_dedup", "packing"]
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r["doc_id"], r["text"]) for r in held.select("doc_id", "text").collect()]
        out = stage(spark, held, SF).cache()
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        found = out.collect()
        if name == "quality":
            model = quality.learn(held, labels)
            assert {r["doc_id"] for r in found} == {i for i, t in rows if plain_features(t) @ model.weights >= model.thresholds[0]}
            right = [(i in {r["doc_id"] for r in found}) == bool(q) for i, q in graded.items()]
            assert sum(right) >= 0.9 * len(right)
        elif name == "toxicity":
            model = toxicity.learn(held, labels)
            assert {r["doc_id"] for r in found} == {i for i, t in rows if plain_score(model, t) < 0.5}
            right = [(r[0] in {x["doc_id"] for x in found}) == (not toxic[r[0]]) for r in rows if r[0] in toxic]
            assert sum(right) >= 0.9 * len(right)
        elif name == "line_dedup":
            key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
            count = collections.Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")} if k)
            assert {r["doc_id"]: r["text"] for r in found} == {i: "\n".join(x for x in t.split("\n") if count[key(x)] < 10) for i, t in rows}
            assert all(r["n_chars"] == len(r["text"]) for r in found)
        elif name == "near_dedup":
            # Texts whose sets of five-word shingles are similar to 0.8 or more, compared pair by pair.
            assert sorted(r["doc_id"] for r in found) == sorted(min(rows[i][0] for i in x) for x in plain_components(rows))
        else:
            tokens = collections.Counter()
            for r in found:
                tokens[r["doc_id"]] += r["length"]
            assert set(tokens) == {i for i, _ in rows} and all(tokens[r["doc_id"]] == r["doc_tokens"] for r in found)
        held = out


def test_near_dedup_of_odd_rows(spark):
    rows = [(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (3, None, None, None, None), (4, "", "en", "s", 0), (None, "only", "en", "s", 4), (None, "only", "en", "s", 4), (None, "other words", "en", "s", 4)]
    out = corpus_pipeline.distinct(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(1, "a b c d"), (3, None), (None, "only"), (None, "other words")], key=repr)
    assert corpus_pipeline.distinct(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0


ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "one two three four five six"), (3, "one two three four five six"), (None, "no id"), (None, None), (4, "word " * 30_000), (5, "x" * 100_000), (6, "\x1c odd\u0085\n\n")]


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, name):
    """Null, empty and very long texts, null and repeated ids, extra columns, an empty table: defined results and no crash."""
    stage = dict(corpus_pipeline.STAGES)[name]
    given = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2) for i, t in ODD], f"{SCHEMA}, quality int, cleaned int")
    out = stage(spark, given, SF)
    found = [r.asDict() for r in out.collect()]
    empty = stage(spark, given.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns
    if name == "packing":
        assert collections.Counter(r["doc_id"] for r in found if r["start"] == 0) == collections.Counter(i for i, _ in ODD)
        return
    assert out.columns == corpus_pipeline.COLUMNS
    have = collections.Counter((r["doc_id"], r["text"]) for r in found)
    if name == "quality":  # equal texts, equal verdicts
        assert set(have.items()) <= set(collections.Counter(ODD).items()) and len({have[(0, None)], have[(1, "")], have[(None, None)]}) == 1
    elif name == "toxicity":
        assert have == collections.Counter(ODD)
    elif name == "line_dedup":
        assert have == collections.Counter((i, t or "") for i, t in ODD)
    else:
        assert have == collections.Counter([(0, None), (3, ODD[3][1]), (None, "no id"), (4, ODD[7][1]), (5, ODD[8][1]), (6, ODD[9][1])])


def test_run_deletes_what_its_stages_needed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {p.name.split("-", 1)[1] for p in (tmp_path / "spillway").iterdir()} == {"stage-near_dedup", "pieces", "length-counts"}
    with common.scratch(spark) as made:
        kept, gone = common.table(spark.range(3), "kept"), common.table(spark.range(3), "gone")
        made.remove(kept._scratch_path)
    assert kept.count() == 3 and gone._scratch_path.startswith(str(tmp_path)) and not [p for p in (tmp_path / "spillway").iterdir() if p.name.endswith("-gone")]


def test_shared_folder(spark, monkeypatch):
    class Unset:
        def __init__(self, master):
            self.conf, self.sparkContext = self, self
            self.master = master

        def get(self, key, default):
            return default

    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert common.shared_dir(Unset("local[8]")) == common.shared_dir(Unset("local"))
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(Unset(master))
