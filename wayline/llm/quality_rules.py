"""Quality rules whose cutoffs are certified on labelled holdouts.

A rule rejects a text when its statistic is above a cutoff. The rules share one level of strictness: level k sets the
cutoff of every rule to step k of its grid, from the mildest to the strictest. For each stratum, levels are tried
in this order on the labelled good texts. A level is certified when, at a true false-rejection rate above `alpha`, so
few rejected good texts would be seen with a chance of `delta / strata` at most: the exact binomial tail (Clopper and
Pearson's bound), with Bonferroni's correction over strata. Trying levels in a fixed order and stopping at the first
failure needs no further correction. Of the certified levels, the mildest counts that rejects as many of
the labelled bad texts as any. So in every stratum at most a share `alpha` of good texts is falsely rejected,
with probability 1 - delta over all strata. A stratum with too few labels certifies nothing and rejects nothing.

Everything here is DataFrame expressions; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage, words_of

#: Rule: (mildest cutoff, strictest cutoff). LEVELS equal steps lie between.
RULES = {
    "symbols": (0.5, 0.02),
    "dup_lines": (0.7, 0.25),
    "repeats": (0.7, 0.2),
    "long_words": (8.0, 5.7),
    "short_words": (-3.5, -4.5),
}
LEVELS = 100
ALPHA, DELTA = 0.025, 0.05


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (longs); null texts give zeros.

    Three-word windows are compared by 64-bit hashes within a text. No shuffle: one row in, one row out. Columns
    of docs that have these names are replaced.
    """
    x = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("__h", F.transform(words_of(text), lambda w: F.xxhash64(w)))
    d = d.withColumn("__n", F.size("__h"))
    d = d.withColumn(
        "__tri",
        F.when(
            F.col("__n") >= 3,
            F.zip_with(
                F.zip_with(F.slice("__h", F.lit(1), F.col("__n") - 2), F.slice("__h", F.lit(2), F.col("__n") - 2), lambda a, b: F.xxhash64(a, b)),
                F.slice("__h", F.lit(3), F.col("__n") - 2),
                lambda ab, c: F.xxhash64(ab, c),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    d = d.withColumn("__sorted", F.when(F.size(F.array_distinct("__tri")) < F.size("__tri"), F.sort_array(F.transform("__tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("__twice", F.filter("__sorted", lambda s, k: (s["h"] == F.get("__sorted", k - 1)["h"]) | (s["h"] == F.get("__sorted", k + 1)["h"])))
    covered = F.array_distinct(F.flatten(F.transform("__twice", lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))))
    d = d.withColumn("__lines", F.filter(F.split(x, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    made = {
        "n_words": F.col("__n").cast("long"),
        "word_chars": F.length(F.translate(x, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(x) - F.length(F.translate(x, "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("__sorted").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long"),
    }
    # The partition's number keeps later filters on the statistics above this step: below it, they would repeat its work.
    d = d.withColumn("__made", F.struct(*[v.alias(k) for k, v in made.items()], F.spark_partition_id().alias("part")))
    return d.withColumns({k: F.col("__made")[k] for k in made}).drop("__h", "__n", "__tri", "__sorted", "__twice", "__lines", "__made")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_values() -> Column:
    """Each rule's statistic as a map; a text without words has no statistics."""
    words = F.col("n_words").cast("double")
    some = F.when(F.col("n_words") > 0, words)
    mean = F.col("word_chars") / some
    return F.create_map(*[
        x
        for name, v in {
            "symbols": F.col("n_symbols") / some,
            "dup_lines": F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines").cast("double")),
            "repeats": F.col("n_repeat_words") / some,
            "long_words": mean,
            "short_words": -mean,
        }.items()
        for x in (F.lit(name), v)
    ])


def cutoffs_at(level: int) -> dict[str, float]:
    return {r: mild + (strict - mild) * level / LEVELS for r, (mild, strict) in RULES.items()}


def first_level(values: Column) -> Column:
    """The mildest level that rejects a text (from there on all do); LEVELS + 1 if none does."""


    def of(rule: str) -> Column:
        grid = F.lit([cutoffs_at(k)[rule] for k in range(LEVELS + 1)])
        return F.when(values[rule].isNull(), F.lit(LEVELS + 1)).otherwise(F.size(F.filter(grid, lambda c: values[rule] <= c)))

    return F.least(*map(of, RULES))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed term by term in logarithms."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n.cast("double") * F.log(F.lit(1 - p))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1).cast("double") / i.cast("double")) + odds
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["sum"] - top) + F.exp(term - top))).alias("sum"))

    steps = F.when(F.least(k, n) >= 1, F.sequence(F.lit(1), F.least(k, n).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), add, lambda acc: F.least(F.exp(acc["sum"]), F.lit(1.0)))


def certified_levels(stats: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, level, holdout, rejected_good, bad, rejected_bad) of each stratum with a certified level.

    stats: rows of with_statistics(); labels: (doc_id, quality). A text labelled twice is good if all its labels
    are; of several texts with one doc_id, the least by (stratum, level that rejects it) counts; labels without quality are left out, and so are texts that the base rules reject. Null is a stratum of its own.
    """
    good = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    held = stats.where(~base_failed()).select("doc_id", F.col(stratum).alias("stratum"), first_level(rule_values()).alias("step"))
    held = held.groupBy("doc_id").agg(F.min(F.struct("stratum", "step")).alias("h")).select("doc_id", "h.*").join(good, "doc_id")
    counts = held.groupBy("stratum", "good", "step").agg(F.count("*").alias("n"))
    of = lambda kind: F.filter(F.col("by_step"), lambda s: s["good"] if kind else ~s["good"])
    count = lambda steps: F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s["n"])
    per = counts.groupBy("stratum").agg(F.collect_list(F.struct("good", "step", "n")).alias("by_step"))
    per = per.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(1))))  # a row per stratum
    tried = per.select("stratum", "strata", "by_step", count(of(True)).alias("holdout"), count(of(False)).alias("bad"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    for name, kind in (("rejected_good", True), ("rejected_bad", False)):
        tried = tried.withColumn(name, count(F.filter(of(kind), lambda s: s["step"] <= F.col("level"))))
    fine = binomial_tail(F.col("rejected_good"), F.col("holdout"), alpha) <= F.lit(delta) / F.col("strata")
    run = Window.partitionBy("stratum").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    tried = tried.withColumn("fine", F.min(fine.cast("int")).over(run)).where("fine = 1")
    best = tried.groupBy("stratum").agg(F.max(F.struct("rejected_bad", (-F.col("level")).alias("mild"), "holdout", "rejected_good", "bad")).alias("b"))
    return best.select("stratum", (-F.col("b.mild")).alias("level"), "b.holdout", "b.rejected_good", "b.bad", "b.rejected_bad")


def apply_levels(stats: DataFrame, levels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add base_failed and kept. levels has a row per stratum."""
    per = levels.select(F.col("stratum").alias("__stratum"), F.col("level").alias("__level"))
    d = stats.withColumns({"base_failed": base_failed(), "__v": rule_values()})
    d = d.join(per, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    broken = reduce(lambda a, b: a | b, [F.coalesce(F.col("__v")[r] > F.get(F.lit([cutoffs_at(k)[r] for k in range(LEVELS + 1)]), F.col("__level")), F.lit(False)) for r in RULES])
    return d.withColumn("kept", ~F.col("base_failed") & ~broken).drop("__v", "__stratum", "__level")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """docs with the statistics, base_failed and kept. Nulls in any column, empty tables and repeated rows are
    allowed: an empty labels table certifies nothing, so only the base rules reject."""
    labelled = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    levels = stage(certified_levels(with_statistics(labelled), labels, stratum, alpha, delta), "levels")
    return apply_levels(with_statistics(docs), levels, stratum)
