"""Reports over job logs, ledgers and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def job_stats(jobs: DataFrame) -> DataFrame:
    """Jobs and exact continuous percentiles of their seconds by type and status. jobs: type, status, created_at, updated_at."""
    seconds = F.unix_micros(F.col("updated_at").cast("timestamp")) / 1e6 - F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6
    p = lambda q: F.coalesce(F.percentile(seconds, q), F.lit(0.0))
    return jobs.groupBy("type", "status").agg(F.count("*").alias("jobs"), p(0.5).alias("p50_seconds"), p(0.95).alias("p95_seconds"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def abort_rate(jobs: DataFrame, kind: str, aborted: str, finished: tuple[str, ...]) -> DataFrame:
    own = F.col("type") == kind
    done, gone = F.count_if(own & F.col("status").isin(*finished)), F.count_if(own & (F.col("status") == aborted))
    return jobs.agg(done.alias("finished"), gone.alias("aborted"), share(gone, done).alias("abort_rate"))


def latest_by(dimension: DataFrame, log: DataFrame, key: str, at: str, statuses: tuple[str, ...]) -> DataFrame:
    """Every row of dimension with the newest time of its log rows in one of statuses, null if there is none."""
    newest = log.where(F.col("status").isin(*statuses)).groupBy(key).agg(F.max(at).alias("latest"))
    return dimension.join(newest, key, "left")


def recent_by(dimension: DataFrame, log: DataFrame, key: str, at: str, since) -> DataFrame:
    """Every row of dimension with how many of its log rows are newer than since."""
    n = log.where(F.col(at) > since).groupBy(key).agg(F.count("*").alias("recent"))
    return dimension.join(n, key, "left").withColumn("recent", F.coalesce("recent", F.lit(0)))


def answer_totals(messages: DataFrame, *by: Column) -> DataFrame:
    """What the source picker did: answers, picked, trimmed, sums. messages: sift (JSON or null), role."""
    get = lambda k, t="long": F.get_json_object("sift", f"$.{k}").cast(t)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return messages.where(F.col("role") == "assistant").groupBy(*by).agg(
        F.count("*").alias("answers"), F.count("sift").alias("picked"), F.count_if(get("kept") < get("candidates")).alias("trimmed"),
        zero(get("candidates")).alias("candidates"), zero(get("kept")).alias("kept"), zero(get("tokens_saved")).alias("tokens_saved"),
    )


def feed(limit: int, *parts: DataFrame) -> DataFrame:
    """The newest limit rows of several feeds (id, kind, at): each is cut first, then their union."""
    newest = [F.col("at").desc(), F.col("kind"), F.col("id")]
    out = None
    for p in parts:
        p = p.orderBy(*newest).limit(limit)
        out = p if out is None else out.unionByName(p)
    return out.orderBy(*newest).limit(limit)


def mean_of_newest(log: DataFrame, value: str, at: str, tie: str, n: int) -> DataFrame:
    return log.orderBy(F.col(at).desc(), F.col(tie)).limit(n).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def members(groups: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Every group with its number of items, 0 for none."""
    n = items.groupBy(key).agg(F.count("*").alias("items"))
    return groups.join(n, key, "left").withColumn("items", F.coalesce("items", F.lit(0)))


def latest_row(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def problem_counts(docs: DataFrame) -> DataFrame:
    """Documents, cost and repaired drafts by kind of problem. docs: problems array<string>, cost, drafts."""
    each = docs.withColumn("problem", F.explode_outer(F.array_distinct("problems")))
    return each.groupBy("problem").agg(F.count("*").alias("documents"), F.sum("cost").alias("cost"), F.count_if(F.col("drafts") > 1).alias("repaired"))


def rolling_p95(peaks: DataFrame, keys: list[str], hour: str, value: str, hours: int = 167) -> DataFrame:
    """peaks (a row for each key and hour number) with p95: nearest rank among the values of the completed hours before, null without any."""
    before = F.array_sort(F.collect_list(value).over(Window.partitionBy(*keys).orderBy(hour).rangeBetween(-hours, -1)))
    return peaks.withColumn("__before", before).withColumn("p95", F.get("__before", F.ceil(0.95 * F.size("__before")).cast("int") - 1)).drop("__before")
