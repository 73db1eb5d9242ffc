"""A corpus pipeline over ``documents``: quality, toxicity, line dedup, near-dedup, packing.

Each stage takes the documents that the one before it kept, and all but the last return the columns of documents.
Documents that the quality classifier takes for bad, or the lexicon for toxic, go; lines found in many documents go; one
document of each group of near copies stays, that with the smallest id; what is left is packed into sequences of tokens.

Defined results, for every stage: columns besides those of documents are not passed on; rows with null or repeated ids are documents like
any others; an empty table gives an empty one. What null and empty texts come to is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm import line_dedup, near_copies, packing, quality, toxicity
from spillway.llm.common import scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least an even chance of the best grade. Null and empty texts are judged by the thresholds alone, so all of them go or stay."""
    docs = docs.select(*COLUMNS)
    judged = quality.judge(docs, quality.learn(docs, _labels(spark, sf_dir)), at_least=1)
    return judged.where(F.col("quality.tail_prob") >= 0.5).select(*COLUMNS)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half. Null and empty texts match nothing and stay, unless nearly all labels are toxic."""
    docs = docs.select(*COLUMNS)
    scored = toxicity.score(docs, toxicity.learn(docs, _labels(spark, sf_dir)), score_col="toxicity")
    return scored.where(F.col("toxicity") < 0.5).select(*COLUMNS)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them have; ``n_chars`` is that of the new text.

    A text all of whose lines go, and a null one, become empty; empty lines never go.
    """
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS), min_docs=10)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five-word similarity of 0.8 or more): that with the smallest id.

    Rows without an id come last, and of several texts with one id any but always the same one is taken. The ids that go, fewer
    than those that stay, are named, so texts move only where that list is too long for the planner's broadcast limit; text keys are needed only for ids
    of which a part goes, and for rows without one. Null and empty texts and those of white space are copies of each other.
    """
    docs = docs.select(*COLUMNS)
    key, place = ["no_id", "id", "h1", "h2"], {"no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0))}
    found = table(near_copies.dedup(docs).withColumns(place).select("component", *key), "near-copies")
    first = table(found.groupBy("component").agg(F.min(F.struct(*key)).alias("first")), "first-rows")
    rows = found.groupBy("component", *key).agg(F.count(F.lit(1)).alias("rows"))
    rows = table(rows.join(first, "component").select(*key, (F.struct(*key) == F.col("first")).alias("kept"), "rows"), "rows")
    ids = table(rows.groupBy("no_id", "id").agg(F.max("kept").alias("some"), F.min("kept").alias("all")), "ids")
    gone = table(ids.where("not no_id and not some").select(F.col("id").alias("doc_id")), "gone")
    out = docs.join(gone, "doc_id", "left_anti").withColumns(near_copies.text_keys() | place)
    parted = ids.where("not all and (no_id or some)").select("no_id", "id")
    if not parted.isEmpty():
        out = out.join(table(rows.where("not kept").join(parted, ["no_id", "id"], "left_semi").select(*key), "gone-rows"), key, "left_anti")
    repeated = rows.where("kept and rows > 1").select(*key)
    if not repeated.isEmpty():
        again = table(repeated, "repeated")
        out = out.join(again, key, "left_anti").unionByName(out.join(again, key, "left_semi").dropDuplicates(key))
    return out.select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences of 2048. A null or empty text is a piece of the end mark alone."""
    import public_tokenizers

    pieces = packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048)
    return packing.pack(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), capacity=2048)


STAGES = [("quality", good), ("toxicity", civil), ("line_dedup", without_common_lines), ("near_dedup", distinct), ("packing", packed)]

#: Neither classifiers nor fingerprints can be said in SQL: the pipeline is tested against a plain version in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage needed is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            before, docs = docs, table(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(docs._scratch_path)
            made += [before._scratch_path] if hasattr(before, "_scratch_path") else []
    return STAGES[-1][1](spark, docs, sf_dir)
