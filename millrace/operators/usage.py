"""Usage ledger: series, totals, savings, spend in sliding and calendar windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRANULARITIES = ("hour", "day", "week", "month")
DIMENSIONS = ("feature", "provider_id", "model", "repo_id", "user_id")


def bucket(at: Column, granularity: str) -> Column:
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}")
    return F.date_trunc(granularity, at).cast("timestamp_ntz")


def usage_series(events: DataFrame, group_by: str, granularity: str) -> DataFrame:
    """Calls, tokens, cost, cache reads, cached and blocked calls per time bucket and key.

    events: at, the dimension, input_tokens, output_tokens, cost_usd, cache_read_tokens, cached, outcome. A null key is its own group.
    """
    return (
        events.groupBy(bucket(F.col("at"), granularity).alias("bucket"), F.col(group_by).alias("key"))
        .agg(
            F.count("*").alias("calls"),
            F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
            F.sum("cost_usd").alias("cost_usd"),
            F.sum("cache_read_tokens").alias("cache_read_tokens"),
            F.count_if("cached").alias("cached_calls"),
            F.count_if(F.col("outcome") == "blocked").alias("blocked_calls"),
        )
    )


def usage_totals(series: DataFrame) -> DataFrame:
    """One row of sums over the points of a series; zeros where there are none."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return series.agg(*(zero(c) for c in ("calls", "tokens", "cost_usd", "cache_read_tokens", "cached_calls", "blocked_calls")))
