"""Quality rules: an ordered list of threshold conjunctions learned from labelled documents, with column functions only.

Statistics of each document are plain column expressions. The list is learned by sequential covering: a rule grows by the condition with the
best gain on two thirds of the labelled rows, is cut back while that helps on the other third, and is kept if it is precise on both; rows it
covers leave, and the next rule grows. Every look at the rows is one aggregate over (statistic, range) counts, so the driver sees a table whose
size is the number of statistics times the number of ranges. The result is a Spark conditional expression, one branch per rule in order.

Null text: no words. Empty text fails the base rule. Rows whose label is null, or without a label, are not learned from but are judged.
Repeated rows and labels count each time; a document with contradicting labels is learned from as both. No labels: no rules, the base rule decides.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightloom.llm.common import SPACES, documents, kept_table

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RATES = ["symbols_per_word", "dup_line_share", "repeat_word_share", "mean_word_chars", "upper_share", "digit_share", "mark_share", "distinct_share"]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base rule, and the rates that rules test."""
    gone = lambda col, chars: F.char_length(col) - F.char_length(F.translate(col, chars, ""))
    t = F.col("_t")
    words = F.array_remove(F.split(t, f"[{SPACES}]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    cut = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).select("*", words.alias("_w"), lines.alias("_l"))
    # Hashes of the 3-word windows; only a text in which one occurs again is looked at further.
    window = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    hashed = cut.withColumn("_h", F.when(F.size("_w") >= 3, window).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    ordered = F.array_sort(F.arrays_zip("_h", F.sequence(F.lit(0), F.size("_h") - 1).alias("_i")))
    seen = hashed.withColumn("_s", F.when(again, ordered)).drop("_h")
    h = lambda i: F.get("_s", i)["_h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: F.coalesce(h(i) == h(i - 1), F.lit(False)) | F.coalesce(h(i) == h(i + 1), F.lit(False)))
    places = F.transform(twice, lambda i: F.get("_s", i)["_i"])
    covered = F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))
    counted = seen.select(
        "doc_id", F.size("_w").cast("long").alias("n_words"), F.char_length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        gone(t, SYMBOLS).cast("long").alias("n_symbols"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_s").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"), F.size("_l").alias("_lines"),
        F.size(F.array_distinct("_w")).alias("_distinct"), gone(t, UPPER).alias("_upper"), gone(t, "0123456789").alias("_digits"), gone(t, "!?").alias("_marks"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    rates = [per("n_symbols", "n_words"), per("n_dup_lines", "_lines"), per("n_repeat_words", "n_words"), per("word_chars", "n_words"),
             per("_upper", "word_chars"), per("_digits", "word_chars"), per("_marks", "n_words"), per("_distinct", "n_words")]
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[r.alias(n) for r, n in zip(rates, RATES, strict=True)])


Condition = tuple[str, str, float]  # statistic, '>=' or '<', threshold


def expression(rule: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f) >= x if sign == ">=" else F.col(f) < x for f, sign, x in rule])


def decide(rules: list[list[Condition]]) -> Column:
    """The ordered list: the first rule that covers a row rejects it, a row no rule covers is kept."""
    out = None
    for rule in rules:
        out = F.when(expression(rule), False) if out is None else out.when(expression(rule), False)
    return F.lit(True) if out is None else out.otherwise(True)


def _counts(rows: DataFrame, names: list[str], cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """For each statistic, (bad, good) rows of each range between its thresholds."""
    def place(name: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(x) for x in cuts[name]]), lambda x: x <= F.col(name)))

    at = F.array(*[F.struct(F.lit(n).alias("f"), place(n).alias("r")) for n in names])
    got = rows.select("bad", F.explode(at).alias("x")).groupBy("x.f", "x.r").agg(F.sum("bad").alias("b"), F.sum(1 - F.col("bad")).alias("g")).collect()
    out = {n: [(0, 0)] * (len(cuts[n]) + 1) for n in names}
    for r in got:
        out[r["f"]][r["r"]] = (r["b"], r["g"])
    return out


def learn(labelled: DataFrame, names: list[str] = RATES, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.97, least: int = 10, ranges: int = 24) -> list[list[Condition]]:
    """Rules that reject. `labelled`: doc_id, the statistics, bad (1 or 0)."""
    part = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3))
    rows = kept_table(labelled.select("bad", part.alias("part"), *names), "rules")
    # Thresholds: quantiles of the good rows, of the bad rows, and of all.
    quantiles = [i / ranges for i in range(1, ranges)] + [0.0, 0.99, 0.995, 0.999, 1.0]
    wanted = [F.percentile_approx(F.when(cond, F.col(n)), quantiles, 2000).alias(f"{n}{k}") for n in names for k, cond in enumerate((F.col("bad") == 0, F.col("bad") == 1))]
    found = rows.agg(*wanted).first()
    cuts = {n: sorted({float(x) for k in (0, 1) for x in (found[f"{n}{k}"] or []) if x is not None and not math.isnan(x)}) for n in names}
    rules: list[list[Condition]] = []
    left = rows
    for _ in range(max_rules):
        grow, rule = left.filter("part < 2"), []
        before: tuple[int, int] | None = None
        while len(rule) < max_conditions:
            counts = _counts(grow, names, cuts)
            if before is None:
                before = (sum(b for b, _ in counts[names[0]]), sum(g for _, g in counts[names[0]]))
            best = _best(counts, cuts, before, least)
            if best is None:
                break
            rule.append(best[0])
            before, grow = best[1], grow.filter(expression([best[0]]))
            if before[1] == 0 or before[0] / sum(before) >= 0.995:
                break
        if not rule:
            break
        rule = _pruned(left.filter("part = 2"), rule)
        judged = left.filter(expression(rule)).agg(F.sum("bad"), F.count(F.lit(1))).first()
        if (judged[1] or 0) < least or judged[0] / judged[1] < precision:
            break
        rules.append(rule)
        left = left.filter(~expression(rule))
    return rules


def _best(counts: dict[str, list[tuple[int, int]]], cuts: dict[str, list[float]], before: tuple[int, int], least: int) -> tuple[Condition, tuple[int, int]] | None:
    """The condition with the highest information gain, and the (bad, good) rows it leaves."""
    if not before[0] or not before[1]:
        return None
    base, best = math.log2(before[0] / sum(before)), None
    for name, ranges in counts.items():
        for k, x in enumerate(cuts[name]):
            for sign, part in ((">=", ranges[k + 1 :]), ("<", ranges[: k + 1])):
                b, g = sum(p[0] for p in part), sum(p[1] for p in part)
                if b >= least and g < before[1]:
                    gain = b * (math.log2(b / (b + g)) - base)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, (name, sign, x), (b, g))
    return None if best is None else best[1:]


def _pruned(rows: DataFrame, rule: list[Condition]) -> list[Condition]:
    """The rule's start with the best worth on the rows kept for pruning; the longer one on a tie."""
    sums = [c for k in range(1, len(rule) + 1) for c in (F.sum(F.when(expression(rule[:k]), F.col("bad"))).alias(f"b{k}"), F.sum(F.when(expression(rule[:k]), 1)).alias(f"n{k}"))]
    got = rows.agg(*sums).first()
    worth = [(2 * (got[f"b{k}"] or 0) - got[f"n{k}"]) / got[f"n{k}"] if got[f"n{k}"] else -1.0 for k in range(1, len(rule) + 1)]
    return rule[: max(range(len(rule)), key=lambda k: (worth[k], k)) + 1]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, and kept: the verdict of the rules learned from labels (quality 0 is bad)."""
    stats = kept_table(statistics(docs), "op10")
    label = labels.filter("quality is not null and doc_id is not null").select("doc_id", (1 - F.col("quality")).cast("int").alias("bad"))
    rules = learn(stats.filter(~base_failed()).join(label, "doc_id"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & decide(rules)).alias("kept"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
