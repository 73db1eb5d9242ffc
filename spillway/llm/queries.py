"""The registered query of each operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spillway.llm import bpe

    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(read(spark, sf_dir, "documents"), vocab, public_tokenizers.PATTERN)
    decoded = bpe.decoder(spark, vocab)("ids")
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spillway.llm import warc

    records = warc.read(warc.write(read(spark, sf_dir, "pages"), min_revisit_bytes=0))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spillway.llm import simhash

    found = simhash.dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spillway.llm import packing

    pieces = packing.tokenize(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048)
    pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(pieces, capacity=2048)


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spillway.llm import line_dedup

    kept = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE_SQL["op7_line_dedup"] = r"""
WITH lines AS (
    SELECT d.rid, d.doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
         LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS i) u
),
common AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM common)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k NOT IN (SELECT k FROM common)), '')) AS kept_sha256
FROM lines GROUP BY rid, doc_id
"""


@query
def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spillway.llm import embed_dedup

    return embed_dedup.dedup(read(spark, sf_dir, "embeddings"), threshold=0.98)


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spillway.llm import labelled, quality

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, quality.learn(docs, read(spark, sf_dir, "labels")), at_least=1)
    judged = judged.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "quality.expected_grade", "quality.tail_prob")
    return judged.withColumn("selected", F.col("tail_prob") >= 0.5)


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spillway.llm import labelled, toxicity

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spillway.llm import rules

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = rules.judge(docs, rules.learn(docs, read(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spillway.llm import chat

    return chat.render(read(spark, sf_dir, "conversations"))


ORACLE_SQL["op8_chat"] = r"""
WITH t AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations
),
c AS (
    SELECT conv_id, count(*) AS n_turns, list(sha256(coalesce('r' || role, '')) || sha256(coalesce('t' || text, '')) ORDER BY pos) AS turns FROM t GROUP BY conv_id
),
classes AS (SELECT turns, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns, n_turns),
inner_ AS (SELECT DISTINCT sha256(array_to_string(list_slice(turns, 1, k), '')) AS h FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)),
kept AS (SELECT conv_id, n_turns, n_copies FROM classes WHERE sha256(array_to_string(turns, '')) NOT IN (SELECT h FROM inner_))
SELECT t.conv_id, (pos - 1) // 256 AS part, any_value(n_turns) AS n_turns, any_value(n_copies) AS n_copies,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY pos) AS text
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY t.conv_id, part
"""

#: Base 32 of a SHA-1, four letters from each five hexadecimal digits.
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::INTEGER >> {shift}) & 31) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))
ORACLE_SQL["op3_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (html)
"""
