"""Quality rules: statistics of a text as native columns, and a decision list learned from labelled ones by sequential covering.

The statistics are DataFrame functions over whole texts. Learning is, too: labelled rows are binned by quantile thresholds; each
step of growing a rule counts the rows still open by (statistic, bin) in one grouped query, from which the best next threshold
follows; rules are pruned on rows kept aside, and rows that a rule covers leave. What comes out is an ordered ``CASE WHEN``.

Defined results: a null or empty text has no words and fails the base rule; without both labels no rule is learned and the base
rule alone decides; null ids and repeated rows pass; an empty table gives an empty table. A window of eight words is known by a
64-bit hash: two different windows of one text are taken for equal with a chance below its squared length / 2^65.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spillway.llm.common import table
from spillway.llm.labelled import sample

SPACE = r"[\x20\x09-\x0D]"
WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
#: Labelled rows that are learned from at most; thresholds for each statistic, conditions of a rule, and rules at most.
MAX_ROWS, THRESHOLDS, CONDITIONS, RULES = 4_000, 63, 3, 8
#: What a rule must cover of the rows it grew on, and the share of bad rows among those it covers on either side.
MIN_COVER, MIN_PRECISION = 3, 0.7
FEATURES = {
    "symbols": "n_symbols / n_words", "word_length": "word_chars / n_words", "duplicate_lines": "n_dup_lines / n_words",
    "repeats": "n_repeat_words / n_words", "length": "cast(n_words as double)",
}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once: inside, it is a lambda's variable, so no rule of Catalyst can copy its expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _covered(windows: Column) -> Column:
    """The number of words in windows that occur twice or more."""

    def by_place(s: Column) -> Column:
        same = lambda x, k: x["h"].eqNullSafe(F.get(s, k)["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def words(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1), x + WINDOW) - x)), F.lit(0), lambda a, b: a + b)

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(placed, lambda s: _let(by_place(s), words))).otherwise(F.lit(0))


def _statistics(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE.replace("[", "[^")))
    hashed = F.transform(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        # A window's hash is that of its words' hashes, so that a word is hashed once.
        windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(n.alias("n"), _let(windows, _covered).alias("again"))

    def whole(found: Column) -> Column:
        return F.struct(
            found["n"].cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            found["again"].cast("long").alias("n_repeat_words"),
        )

    return _let(_let(hashed, of_words), whole)


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed, in place of columns of these names.

    The numbers of a row come out of a generator as one row: they are made once, whatever is filtered or counted on top.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    out = df.select(*kept, F.inline(F.array(_statistics(text))))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def all_of(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's gain of narrowing (p0, n0) covered rows down to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS) -> list[Rule]:
    """Rules, in order, that find rows with label 0 among those that pass the base rule."""
    rows = table(statistics(sample(docs, labels, label_col, max_rows)), "rules-statistics").where("not base_failed")
    rows = table(rows.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("label") <= 0).alias("bad"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 > 0).alias("grows")), "rules-rows")
    quantiles = [k / (THRESHOLDS + 1) for k in range(1, THRESHOLDS + 1)]
    # Thresholds from both kinds of rows: the rarer kind has its own quantiles.
    by_kind = rows.groupBy("bad").agg(*(F.percentile(F.expr(x), quantiles).alias(name) for name, x in FEATURES.items())).collect()
    if len(by_kind) < 2:
        return []
    cuts = {name: sorted({float(t) for r in by_kind for t in r[name]}) for name in FEATURES}
    binned_by = lambda cuts, x: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t < F.expr(x)))
    bin_of = {name: binned_by(cuts[name], x) for name, x in FEATURES.items()}
    # At most max_rows rows: one partition saves the exchange.
    binned = table(rows.coalesce(1).withColumn("bins", F.array(*(F.struct(F.lit(name).alias("feature"), b.alias("bin")) for name, b in bin_of.items()))), "rules-bins")
    rules: list[Rule] = []
    open_ = binned
    while len(rules) < RULES:
        rule = grown(open_, cuts)
        if rule is None:
            break
        rule = pruned(open_, rule)
        if rule is None:
            break
        rules.append(rule)
        open_ = open_.where(~all_of(rule))
    return rules


def grown(open_: DataFrame, cuts: dict[str, list[float]]) -> Rule | None:
    rule: Rule = ()
    while len(rule) < CONDITIONS:
        counts = open_.where(F.col("grows") & all_of(rule)).select("bad", F.explode("bins").alias("b")).groupBy("b.feature", "b.bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        best: tuple[float, Condition | None, int, int] = (1e-9, None, 0, 0)
        for name, thresholds in cuts.items():
            bins = {r["bin"]: (r["p"], r["n"]) for r in counts if r["feature"] == name}
            p0, n0 = sum(x[0] for x in bins.values()), sum(x[1] for x in bins.values())
            if not p0 or not n0:
                continue
            p = n = 0
            for k, t in enumerate(thresholds):  # rows with bin <= k are those at or below threshold k
                p, n = p + bins.get(k, (0, 0))[0], n + bins.get(k, (0, 0))[1]
                for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    if a >= MIN_COVER and (g := gain(a, b, p0, n0)) > best[0]:
                        best = (g, Condition(name, above, t), a, b)
        if best[1] is None:
            break
        rule = (*rule, best[1])
        if not best[3]:
            break
    return rule or None


def pruned(open_: DataFrame, rule: Rule) -> Rule | None:
    """The start of the rule that does best on the rows kept aside, if it is good enough on both sides."""
    parts = [rule[:k] for k in range(1, len(rule) + 1)]
    counted = []
    for k, part in enumerate(parts):
        for side, kind in (("grow", F.col("grows")), ("aside", ~F.col("grows"))):
            counted += [F.count_if(all_of(part) & kind & F.col("bad")).alias(f"{side}_p{k}"), F.count_if(all_of(part) & kind & ~F.col("bad")).alias(f"{side}_n{k}")]
    r = open_.agg(*counted).first()
    worth = [(r[f"aside_p{k}"] - r[f"aside_n{k}"]) / max(1, r[f"aside_p{k}"] + r[f"aside_n{k}"]) for k in range(len(parts))]
    k = max(range(len(parts)), key=lambda i: (worth[i], -i))
    good = all(r[f"{s}_p{k}"] >= MIN_PRECISION * max(1, r[f"{s}_p{k}"] + r[f"{s}_n{k}"]) for s in ("grow", "aside"))
    return parts[k] if good and r[f"grow_p{k}"] >= MIN_COVER else None


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule covers the row: an ordered conditional over the columns of ``statistics``."""
    out = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        out = out.when(all_of(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with its statistics, ``base_failed`` and ``kept``."""
    return statistics(docs, text_col).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))
