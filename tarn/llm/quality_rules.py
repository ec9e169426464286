"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every document gets measures (share of symbols, of repeated lines, ...). A rule rejects a document whose measure is
above a cutoff. For each stratum (language) and rule, the cutoffs of a fixed grid are tested on the labelled documents
of that stratum: with k of n good documents above a cutoff, the exact binomial tail P(Bin(n, alpha) <= k) is the
p-value of "this cutoff rejects more than a share alpha of good documents". A cutoff is certified where the p-value is
at most delta divided by the number of tests (Bonferroni over strata, rules and grid). Where m rules are in use in a
stratum, each is certified for alpha / m, so that with probability 1 - delta the rules together reject no more than
alpha of the good documents of any stratum; m is the number with which the rules' gains add up to most, the fewest of
equals. Of a rule's certified cutoffs the one that tells bad from good best is used, the most lenient of equals; a rule
without a useful certified cutoff rejects nothing in that stratum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm._shared import stored, words_of

#: Up to so many strata, of six numbers each, the cutoffs are broadcast; beyond, they are joined by shuffling.
BROADCAST_STRATA = 10_000

#: Rules and their cutoffs, ascending; a document is rejected where its measure is above the cutoff.
GRID: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.02, 0.05, 0.1, 0.2, 0.4),
    "bang_share": (0.05, 0.1, 0.2, 0.4, 0.8),
    "upper_share": (0.1, 0.2, 0.4, 0.6, 0.8),
    "bar_share": (0.05, 0.1, 0.2, 0.4),
    "dup_line_share": (0.1, 0.2, 0.3, 0.5),
    "repeat_share": (0.1, 0.2, 0.3, 0.4),
}


@dataclass(frozen=True)
class Risk:
    """alpha: most share of a stratum's good documents that the rules may reject together; delta: chance that any stratum breaks that.

    cost: how many shares of bad documents caught make up for the same share of good ones rejected.
    """

    alpha: float = 0.02
    delta: float = 0.05
    least_gain: float = 0.01
    cost: float = 10.0


def measure(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the measures of GRID (double).

    Null text: no words, all counts 0. One row in, one row out, whatever other columns there are: own columns are kept
    in one struct until the end. Three-word windows are compared by their 64-bit hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    at = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text.alias("_text"), words_of(F.col("text")).alias("_words"))
    at = at.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda line: F.length(F.trim(F.translate(line, "\t\x0b\f\r", "    "))) > 0))
    at = at.withColumn("_n", F.size("_words"))
    grams = F.when(F.col("_n") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice("_words", 1, F.greatest(F.col("_n") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))))
    at = at.withColumn("_grams", grams)
    differs = F.size(F.array_distinct("_grams")) < F.size("_grams")
    at = at.withColumn("_sorted", F.when(differs, F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter("_sorted", lambda x, j: (x["h"] == F.get("_sorted", j - 1)["h"]) | (x["h"] == F.get("_sorted", j + 1)["h"]))
    at = at.withColumn("_places", F.sort_array(F.transform(again, lambda x: x["i"])))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_places", start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    joined = F.array_join("_words", "")
    at = at.withColumn("_joined", joined)
    gone = lambda column, pattern: F.length(column) - F.length(F.regexp_replace(column, pattern, ""))
    at = at.select(
        "_row",
        F.col("_n").cast("long").alias("n_words"),
        F.length("_joined").cast("long").alias("word_chars"),
        gone("_joined", "[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        gone("_joined", "[A-ZÀ-ÖØ-Þ]").alias("_upper"),
        gone("_joined", "!").alias("_bangs"),
        gone("_joined", "\\|").alias("_bars"),
    )
    share = lambda part, whole: F.coalesce(F.col(part).cast("double") / F.nullif(F.col(whole).cast("double"), F.lit(0.0)), F.lit(0.0))
    return at.select(
        "_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"), share("_bangs", "n_words").alias("bang_share"),
        share("_upper", "word_chars").alias("upper_share"), share("_bars", "n_words").alias("bar_share"),
        share("n_dup_lines", "_n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in logarithms term by term."""
    first = n * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p)) - F.log1p(F.lit(-p))
    step = lambda a, i: F.struct((a["t"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double")) + odds).alias("t"), a["s"].alias("s"))
    add = lambda a, i: (lambda b: F.struct(b["t"].alias("t"), (b["s"] + F.exp(b["t"])).alias("s")))(step(a, i))
    many = F.when(k > 0, F.sequence(F.lit(0), F.least(k, n).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(many, F.struct(first.cast("double").alias("t"), F.exp(first).cast("double").alias("s")), add, lambda a: a["s"])
    return F.when(k >= n, F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def cutoffs(labelled: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(stratum, rule, cutoff) of the certified cutoffs in use. labelled: (stratum, quality, measures of GRID).

    Null labels are left out; a null stratum is a stratum of its own. At most one row for each stratum and rule.
    """
    tests = [(rule, c) for rule, grid in GRID.items() for c in grid]
    counts = labelled.where("quality IN (0, 1)").groupBy("stratum").agg(
        F.count_if(F.col("quality") == 1).alias("n_good"),
        F.count_if(F.col("quality") == 0).alias("n_bad"),
        *[F.count_if((F.col("quality") == label) & (F.col(rule) > c)).alias(f"_{label}_{i}") for i, (rule, c) in enumerate(tests) for label in (0, 1)],
    )
    counts = counts.withColumn("n_strata", F.count("*").over(Window.partitionBy(F.lit(1))))  # one row for each stratum
    rows = counts.select("stratum", "n_good", "n_bad", "n_strata", F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"_1_{i}").alias("k"), F.col(f"_0_{i}").alias("caught")) for i, (rule, c) in enumerate(tests)])).alias("x"))
    rows = rows.select("stratum", "n_good", "n_bad", "n_strata", "x.*")
    # Above alpha * n the tail is over a third and can't be certified; the sum is left out there.
    possible = F.col("k") <= F.col("n_good") * risk.alpha
    rows = rows.where(possible & (F.col("n_good") > 0))
    # With m rules in use each is certified for a share alpha / m. All rest on the same bounds of the tests' shares, so m may be chosen.
    most = F.lit(risk.delta) / (len(tests) * F.col("n_strata"))
    certified = F.array_compact(F.array(*[F.when((F.col("k") <= F.col("n_good") * (risk.alpha / m)) & (binomial_tail(F.col("k"), F.col("n_good"), risk.alpha / m) <= most), F.lit(m)) for m in range(1, len(GRID) + 1)]))
    gain = F.col("caught") / F.greatest(F.col("n_bad"), F.lit(1)) - risk.cost * F.col("k") / F.col("n_good")
    rows = rows.withColumn("gain", gain).where(F.col("gain") >= risk.least_gain).withColumn("m", F.explode(certified))
    best = rows.groupBy("stratum", "m", "rule").agg(F.max(F.struct(F.round("gain", 9).alias("gain"), "cutoff")).alias("best"))
    sets = best.groupBy("stratum", "m").agg(F.collect_list(F.struct("best.gain", "rule", "best.cutoff")).alias("all")).withColumn("chosen", F.slice(F.sort_array("all", asc=False), F.lit(1), F.col("m")))
    total = F.round(F.aggregate("chosen", F.lit(0.0), lambda a, x: a + x["gain"]), 9)
    used = sets.groupBy("stratum").agg(F.max(F.struct(total.alias("total"), (-F.col("m")).alias("fewest"), "chosen")).alias("used"))
    return used.select("stratum", F.explode("used.chosen").alias("x")).select("stratum", "x.rule", "x.cutoff")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """doc_id, rid (hash of doc_id and text), stratum, the measures, base_failed, rejected_by_rule and kept, for each row of docs.

    Texts are read once; only measures are stored, joined to labels and judged. Ties and repeated rows each get their
    own verdict; a doc_id with several labels counts once for each, and of labelled copies of a text one. Null text has no words and fails the base rule.
    """
    column = F.col(f"`{stratum}`") if stratum in docs.columns else F.lit(None)
    own = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.xxhash64("text").alias("tid"), column.cast("string").alias("stratum"), "text")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    measured = stored(measure(own).select("_row.doc_id", "_row.rid", "_row.tid", "_row.stratum", *counts, *GRID), "measures")
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    # Copies of one text are one trial, not several.
    trials = measured.join(marks, "doc_id").dropDuplicates(["stratum", "quality", "tid"])
    limits = cutoffs(trials, risk).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    limits = stored(limits, "cutoffs")
    if limits.count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    joined = measured.join(limits.withColumnRenamed("stratum", "_of"), F.col("stratum").eqNullSafe(F.col("_of")), "left")
    over = F.lit(False)
    for rule in GRID:
        over = over | F.coalesce(F.col(rule) > F.col("limits")[rule], F.lit(False))
    joined = joined.withColumn("base_failed", base_failed()).withColumn("rejected_by_rule", over)
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("rejected_by_rule")).drop("limits", "_of", "tid")


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """The rows of docs that the rules keep, with their columns. A null doc_id is matched as a value."""
    gone = judge(docs, labels, stratum, risk).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("rid").alias("_rid")).distinct()
    rid = F.xxhash64(docs["doc_id"], docs["text"])
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (rid == gone["_rid"]), "left_anti")
