"""Chat formatting after collapsing cumulative snapshots.

Logs often hold a conversation again and again while it grows. Each turn's place, role and text give a hash; the hash of a
prefix is the exclusive or of its turns' (places differ, so order counts). A conversation whose whole hash and length
are those of a proper prefix of a longer one is dropped by an anti-join; of equal conversations that with the smallest
``conv_id`` stays. What stays is rendered, in parts of at most ``part`` turns.

A turn's place and prefix are counted in blocks of turn numbers and summed over the blocks before, so a conversation with a
third of all turns is spread over tasks; prefixes are made distinct, by partial aggregation, before they are joined. All this is done on
hashes: texts move once, when the conversations that stay are rendered block by block. Only turns that share a number are
ordered by their role and text before; where there are such, both are looked at earlier.

Defined results: null roles and texts differ from empty ones in comparing and are rendered as empty; turns are ordered by number (null
first), role and text, so repeated rows are turns of their own; rows with a null ``conv_id`` are one conversation with that id;
an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spillway.llm.common import table

#: Turn numbers of a block; turns of a rendered part.
BLOCK, PART = 256, 256
START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def _own(df: DataFrame) -> DataFrame:
    """``no_id, id`` (of the conversation, without nulls), ``turn, block, role, text``."""
    turns = df.select(df["conv_id"].cast("long").alias("conv_id"), df["turn"].cast("long").alias("turn"), df["role"].cast("string").alias("role"), df["text"].cast("string").alias("text"))
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60)))
    return turns.select(F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0)).alias("id"), "turn", block.alias("block"), "role", "text")


CONV = ["no_id", "id"]


def prefixes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables ``no_id, id, pos, p1, p2``: each turn with its place, from 1, and the hash of the turns up to it; and ``no_id, id, block, before, n``."""
    turns = _own(df)
    fields = [x for c in ("role", "text") for x in (F.col(c).isNull(), F.coalesce(c, F.lit("")))]
    hashes = [F.xxhash64(F.lit(salt), *fields).alias(f"c{salt}") for salt in (1, 2)]
    tied = table(turns.groupBy(*CONV, F.coalesce("turn", F.lit(0)).alias("t"), F.col("turn").isNull().alias("no_turn")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "tied-turns")
    if tied.isEmpty():
        narrow, order = turns.select(*CONV, "block", "turn", *hashes), ["turn"]
    else:
        marked = turns.withColumn("t", F.coalesce("turn", F.lit(0))).withColumn("no_turn", F.col("turn").isNull()).join(tied, [*CONV, "t", "no_turn"], "left")
        narrow, order = marked.select(*CONV, "block", "turn", *hashes, F.when(F.col("rows").isNotNull(), F.struct("role", "text")).alias("tie")), ["turn", "tie"]
    earlier = Window.partitionBy(*CONV).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def summed(rows: DataFrame, made: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
        """What each block's earlier ones come to."""
        blocks = rows.groupBy(*CONV, "block").agg(*(c.alias(k) for k, c in made.items()))
        return blocks.select(*CONV, "block", *made, *(F.coalesce(c.over(earlier), F.lit(0)).alias(k) for k, c in sums.items()))

    narrow = table(narrow, "turns")
    blocks = table(summed(narrow, {"n": F.count(F.lit(1))}, {"before": F.sum("n")}), "blocks")
    within = F.row_number().over(Window.partitionBy(*CONV, "block").orderBy(*order))
    placed = narrow.join(blocks.drop("n"), [*CONV, "block"]).select(*CONV, "block", (F.col("before") + within).alias("pos"), "c1", "c2")
    hashed = table(placed.select(*CONV, "block", "pos", *(F.xxhash64(F.lit(salt), "pos", "c1", "c2").alias(f"h{salt}") for salt in (1, 2))), "turn-hashes")
    sums = summed(hashed, {"b1": F.bit_xor("h1"), "b2": F.bit_xor("h2")}, {"e1": F.bit_xor("b1"), "e2": F.bit_xor("b2")}).drop("b1", "b2")
    running = Window.partitionBy(*CONV, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = [F.bit_xor(f"h{k}").over(running).bitwiseXOR(F.col(f"e{k}")).alias(f"p{k}") for k in (1, 2)]
    return table(hashed.join(sums, [*CONV, "block"]).select(*CONV, "pos", *rolled), "turn-prefixes"), blocks.select(*CONV, "block", "before", "n")


def maximal(turns: DataFrame) -> DataFrame:
    """``no_id, id, n_turns, n_copies`` of the conversations that no other one contains as its start."""
    whole = table(turns.groupBy(*CONV).agg(F.max("pos").alias("n_turns"), F.max_by("p1", "pos").alias("p1"), F.max_by("p2", "pos").alias("p2")), "conversations")
    inner = turns.join(whole.select(*CONV, "n_turns"), CONV).where(F.col("pos") < F.col("n_turns"))
    inner = inner.select(F.col("pos").alias("n_turns"), "p1", "p2").distinct()
    first = F.min(F.struct(*CONV)).alias("first")
    classes = whole.groupBy("n_turns", "p1", "p2").agg(first, F.count(F.lit(1)).alias("n_copies"))
    return classes.join(inner, ["n_turns", "p1", "p2"], "left_anti").select("first.*", "n_turns", "n_copies")


def render(df: DataFrame, part: int = PART, start: str = START, middle: str = MIDDLE, end: str = END) -> DataFrame:
    """``conv_id, part, n_turns, n_copies, text``: the maximal conversations, each ``part`` turns (from part 0) in a row."""
    turns, blocks = prefixes(df)
    kept = table(blocks.join(maximal(turns), CONV), "maximal")
    line = lambda x: F.concat(F.lit(start), F.coalesce(x["role"], F.lit("")), F.lit(middle), F.coalesce(x["text"], F.lit("")), F.lit(end))
    conv = F.when(~F.col("no_id"), F.col("id")).alias("conv_id")
    both = ["n_turns", "n_copies"]
    # A block that is just a part is rendered where its turns come together.
    is_part = (F.col("before") % part == 0) & ((F.col("n") == part) | ((F.col("n") < part) & (F.col("before") + F.col("n") == F.col("n_turns"))))
    rows = _own(df).join(kept.where(is_part), [*CONV, "block"])
    rows = rows.groupBy(*CONV, "block").agg(*(F.first(c).alias(c) for c in ("before", *both)), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    out = rows.select(conv, F.floor(F.col("before") / part).alias("part"), *both, F.array_join(F.transform("x", line), "").alias("text"))
    if kept.where(~is_part).isEmpty():
        return out
    within = F.row_number().over(Window.partitionBy(*CONV, "block").orderBy("turn", "role", "text"))
    rows = _own(df).join(kept.where(~is_part), [*CONV, "block"]).withColumn("pos", F.col("before") + within)
    rows = rows.withColumn("part", F.floor((F.col("pos") - 1) / part)).groupBy(*CONV, "part").agg(*(F.first(c).alias(c) for c in both), F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("x"))
    return out.unionByName(rows.select(conv, "part", *both, F.array_join(F.transform("x", line), "").alias("text")))
