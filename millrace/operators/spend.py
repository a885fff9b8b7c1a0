"""Spend: prices, sliding and calendar windows, limits with a safety buffer, reservations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.folds import in_order

HOURS = {"day": 24, "month": 720}
BUFFER_PCT = 5.0


def sliding(ledger: DataFrame, key: str) -> DataFrame:
    """Tokens and cost of the day and the 30 days up to each hour, by key. Hours are summed first, so windows run over hours, not calls."""
    hours = ledger.groupBy(key, F.date_trunc("hour", "at" if "at" in ledger.columns else "ts").cast("timestamp_ntz").alias("hour")).agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost_usd").alias("cost"))
    second = F.unix_timestamp(F.col("hour").cast("timestamp"))
    out = hours
    for name, n in HOURS.items():
        w = Window.partitionBy(key).orderBy(second).rangeBetween(-n * 3600, 0)
        out = out.withColumn(f"{name}_tokens", F.sum("tokens").over(w)).withColumn(f"{name}_cost", F.sum("cost").over(w))
    return out.drop("tokens", "cost")


def by_month(ledger: DataFrame, features: list[str]) -> DataFrame:
    """Cost of some features by calendar month."""
    return ledger.where(F.col("feature").isin(*features)).groupBy(F.date_trunc("month", "at").cast("timestamp_ntz").alias("month")).agg(F.sum("cost_usd").alias("cost_usd"))


def savings(avoided: DataFrame) -> DataFrame:
    return avoided.groupBy("kind").agg(F.count("*").alias("events"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("tokens_avoided"), F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("cost_avoided_usd"))


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with cost_usd, null where no price is known.

    calls: model, feature, input_tokens (all of the prompt), output_tokens, cache_read_tokens, cache_write_tokens. prices: per
    million tokens by model; a prompt over long_over takes the long rates for the whole call; a missing cache rate is the
    input rate; embeddings have one rate.
    """
    x = calls.join(F.broadcast(prices), "model", "left")
    long = F.coalesce((F.col("long_over") > 0) & F.col("long_input").isNotNull() & (F.col("input_tokens") > F.col("long_over")), F.lit(False))
    rate_in, rate_out = F.when(long, F.col("long_input")).otherwise(F.col("input")), F.when(long, F.col("long_output")).otherwise(F.col("output"))
    cached = lambda c: F.coalesce(F.when(~long, F.col(c)), rate_in)
    plain = F.greatest(F.col("input_tokens") - F.col("cache_read_tokens") - F.col("cache_write_tokens"), F.lit(0))
    cost = plain * rate_in + F.col("cache_read_tokens") * cached("cache_read") + F.col("cache_write_tokens") * cached("cache_write") + F.col("output_tokens") * rate_out
    cost = F.when(F.col("feature") == "embedding", (F.col("input_tokens") + F.col("output_tokens")) * F.col("embed")).otherwise(cost) / 1e6
    return x.select(*[calls[c] for c in calls.columns], cost.alias("cost_usd"))


def buffer(cap: Column, pct: float = BUFFER_PCT) -> Column:
    """What is kept free under a cost ceiling: pct percent, a cent at least, half of it at most; nothing without a ceiling."""
    return F.when((cap <= 0) | F.lit(pct <= 0), 0.0).otherwise(F.least(F.greatest(cap * pct / 100, F.lit(0.01)), cap / 2))


def checked(calls: DataFrame, limits: DataFrame, spent: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """Each call's verdict: allowed, the first breached limit by id, warnings (cost ceilings without a price) and the highest token utilisation.

    calls: call_id, feature, provider, repo, tokens, cost (null: no price). limits: limit_id, scope, scope_key, max_tokens,
    max_cost. spent, reserved: limit_id, tokens, cost. Limits are a short, operator-kept list: it is broadcast. A call meets the
    limits of its scope by equal keys, once for each scope.
    """
    taken = spent if reserved is None else spent.unionByName(reserved)
    taken = taken.groupBy("limit_id").agg(F.sum("tokens").alias("st"), F.sum("cost").alias("sc"))
    lim = limits.join(taken, "limit_id", "left").fillna({"st": 0, "sc": 0.0})
    keys = F.array(F.struct(F.lit("global").alias("scope"), F.lit("").alias("scope_key")), *(F.struct(F.lit(s).alias("scope"), F.col(s).alias("scope_key")) for s in ("feature", "provider", "repo")))
    met = calls.withColumn("k", F.explode(keys)).select("*", "k.scope", "k.scope_key").drop("k").join(F.broadcast(lim), ["scope", "scope_key"])
    tokens = (F.col("max_tokens") > 0) & ((F.col("tokens") > F.col("max_tokens")) | (F.col("st") + F.col("tokens") > F.col("max_tokens")))
    unknown = (F.col("max_cost") > 0) & F.col("cost").isNull()
    cost = F.coalesce((F.col("max_cost") > 0) & (F.col("sc") + F.col("cost") > F.col("max_cost") - buffer(F.col("max_cost"))), F.lit(False))
    breach = tokens | (~unknown & cost)
    out = met.groupBy("call_id").agg(
        F.min(F.when(breach, F.col("limit_id"))).alias("breached"), F.sort_array(F.collect_list(F.when(~tokens & unknown, F.col("limit_id")))).alias("warnings"),
        F.max(F.when(F.col("max_tokens") > 0, (F.col("st") + F.col("tokens")) / F.col("max_tokens"))).alias("utilisation"),
    )
    out = calls.select("call_id").join(out, "call_id", "left")
    return out.select("call_id", F.col("breached").isNull().alias("allowed"), "breached", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), "utilisation")


def admitted(calls: DataFrame, cap: int) -> DataFrame:
    """key, call_id, used and admitted: calls of each key in order, with what earlier admitted calls have reserved; a call that would pass the cap is refused and reserves nothing.

    calls: key, seq, call_id, tokens. The reservations of one key depend on each other, so a key is one fold over its calls.
    """

    def begin():
        used = 0

        def step(c: dict) -> list[dict]:
            nonlocal used
            before, fits = used, used + c["tokens"] <= cap
            used += c["tokens"] if fits else 0
            return [{"key": c["key"], "call_id": c["call_id"], "used": before, "admitted": fits}]

        return step

    kind = calls.schema["key"].dataType.simpleString()
    return in_order(calls.select("key", "seq", "call_id", "tokens"), "key", ["seq", "call_id"], begin, f"key {kind}, call_id long, used long, admitted boolean")
