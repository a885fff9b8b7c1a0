"""Evaluation: precision and recall of citations, calibration of decisions, classifier counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 10


def half_up(x: Column, places: int) -> Column:
    return F.floor(x * 10**places + 0.5) / 10**places


def citation_scores(answers: DataFrame) -> DataFrame:
    """id, precision and recall. answers: id, expected and cited (arrays). Nothing expected: 1 and 1 if nothing is cited, else 0 and 0."""
    cited, expected = F.array_distinct("cited"), F.col("expected")
    hits = F.size(F.filter(expected, lambda e: F.array_contains(cited, e)))
    none = F.size(expected) == 0
    ok = F.when(F.size(cited) == 0, 1.0).otherwise(0.0)
    precision = F.when(none, ok).when(F.size(cited) > 0, hits / F.size(cited)).otherwise(0.0)
    return answers.select("id", precision.alias("precision"), F.when(none, ok).otherwise(hits / F.size(expected)).alias("recall"), (none & (F.size(cited) == 0)).alias("empty"))


def citation_summary(scores: DataFrame) -> DataFrame:
    hit = F.avg(F.when((F.col("recall") > 0) | F.col("empty"), 1.0).otherwise(0.0))
    return scores.agg(F.count("*").alias("questions"), half_up(F.avg("precision"), 3).alias("precision"), half_up(F.avg("recall"), 3).alias("recall"), half_up(hit, 3).alias("hit_rate"))


def reliability(items: DataFrame) -> DataFrame:
    """bin, count, mean_p and accuracy over ten equal bins of p. items: p, choice, wanted."""
    low = F.greatest(F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")
    return items.groupBy(low.alias("bin")).agg(F.count("*").alias("count"), F.avg("p").alias("mean_p"), F.avg((F.col("choice") == F.col("wanted")).cast("double")).alias("accuracy"))


def calibration(items: DataFrame, threshold: float, skip: str) -> DataFrame:
    """One row: n, accuracy, brier, ece, coverage, gated_accuracy, noise_skip_rate, missed_defects. items: p, choice, wanted, probabilities (map)."""
    right = F.col("choice") == F.col("wanted")
    gate = F.col("p") >= threshold
    others = F.aggregate(F.map_entries("probabilities"), F.lit(0.0), lambda s, e: s + F.pow(e["value"] - F.when(e["key"] == F.col("wanted"), 1.0).otherwise(0.0), 2))
    brier = others + F.when(F.map_contains_key("probabilities", F.col("wanted")), 0.0).otherwise(1.0)
    n = F.count("*")
    main = items.withColumn("__b", brier).agg(
        n.alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.avg("__b").alias("brier"), (F.count_if(gate) / n).alias("coverage"), F.coalesce(F.try_divide(F.count_if(gate & right), F.count_if(gate)), F.lit(0.0)).alias("gated_accuracy"),
        (F.count_if(gate & (F.col("choice") == skip)) / n).alias("noise_skip_rate"), F.count_if(gate & (F.col("choice") == skip) & ~right).alias("missed_defects"),
    )
    bins = reliability(items).agg((F.sum(F.col("count") * F.abs(F.col("accuracy") - F.col("mean_p"))) / F.sum("count")).alias("ece"))
    return main.crossJoin(bins)  # one row each


def document_confidence(grounding: Column, names: Column, support: Column | None = None) -> Column:
    """A document's score from the share of grounded statements and known names, with the support of its sources if that is known."""
    return 0.65 * grounding + 0.35 * names if support is None else 0.4 * grounding + 0.2 * names + 0.4 * support


#: Verdicts of findings in the order in which they are listed.
VERDICTS = ("confirmed", "plausible")


def finding_order() -> list[Column]:
    return [F.col("priority").asc(), F.when(F.col("verdict") == VERDICTS[0], 0).when(F.col("verdict") == VERDICTS[1], 1).otherwise(2), F.col("file").asc(), F.col("line").asc()]
