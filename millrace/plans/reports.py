"""Job, spend and answer reports. Orders stand in for jobs, customers for repositories, conversations for threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import predicates as P
from millrace.operators import reports as R
from millrace.operators import spend
from millrace.plans.usage import LEDGER_SQL, ledger
from millrace.session import table

FINISHED = ("F", "O")


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("repo"), F.col("o_totalprice").alias("cost"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 3601).cast("decimal(18,6)"))).alias("updated_at"),
    )


JOBS_SQL = "jobs AS (SELECT o_orderkey AS id, o_orderpriority AS type, o_orderstatus AS status, o_custkey AS repo, o_totalprice AS cost, o_orderdate AS created_at, o_orderdate + to_seconds(o_orderkey % 3601) AS updated_at FROM orders)"


def usage_totals(spark, folder):
    from millrace.operators.usage import usage_series, usage_totals

    out = usage_totals(usage_series(ledger(spark, folder), "feature", "day"))
    return out.withColumn("cost_usd", F.col("cost_usd").cast("double"))


def job_stats(spark, folder):
    out = R.job_stats(jobs(spark, folder))
    return out.withColumns({c: F.round(c, 6) for c in ("p50_seconds", "p95_seconds")})


def abort_rate(spark, folder):
    return R.abort_rate(jobs(spark, folder), "1-URGENT", "O", FINISHED)


def repo_freshness(spark, folder):
    repos = table(spark, folder, "customer").select(F.col("c_custkey").alias("repo"), F.col("c_name").alias("name"))
    return R.latest_by(repos, jobs(spark, folder), "repo", "updated_at", FINISHED).select("repo", "name", "latest")


def repo_recent(spark, folder):
    repos = table(spark, folder, "customer").select(F.col("c_custkey").alias("repo"), F.col("c_name").alias("name"))
    return R.recent_by(repos, jobs(spark, folder), "repo", "created_at", F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")).select("repo", "name", "recent")


def answers(spark, folder):
    turns = table(spark, folder, "conversations")
    n = F.length("text")
    sift = F.when(F.col("turn") % 3 != 2, F.to_json(F.struct((n % 40).alias("candidates"), (n % 17).alias("kept"), (n * 3).alias("tokens_saved"))))
    return turns.select("conv_id", "turn", "role", sift.alias("sift"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(conv_id % 30)").alias("created_at"))


ANSWERS_SQL = """answers AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 <> 2 THEN length(text) END AS n, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id % 30 AS INT)) AS created_at FROM conversations WHERE role = 'assistant')"""
_SUMS = "count(*) AS answers, count(n) AS picked, count(*) FILTER (WHERE n % 17 < n % 40) AS trimmed, CAST(coalesce(sum(n % 40), 0) AS BIGINT) AS candidates, CAST(coalesce(sum(n % 17), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n * 3), 0) AS BIGINT) AS tokens_saved"


def answer_totals(spark, folder):
    return R.answer_totals(answers(spark, folder))


def answers_daily(spark, folder):
    return R.answer_totals(answers(spark, folder), F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day"))


def activity_feed(spark, folder):
    one = jobs(spark, folder).where(~F.col("status").isin("P")).select(F.col("id"), F.lit("job").alias("kind"), F.col("updated_at").alias("at"))
    two = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("at")).select(F.col("l_orderkey").alias("id"), F.lit("shipment").alias("kind"), "at")
    three = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.lit("event").alias("kind"), F.col("ts").alias("at"))
    return R.feed(50, one, two, three)


def decode_estimate(spark, folder):
    out = R.mean_of_newest(jobs(spark, folder).where("status = 'F'"), "cost", "created_at", "id", 100)
    return out.withColumn("mean", F.round("mean", 6))


def shelf_counts(spark, folder):
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("shelf"), "n_name")
    items = table(spark, folder, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("shelf"), "c_custkey")
    return R.members(nations, items, "shelf").select("shelf", "n_name", "items")


def queue_depth(spark, folder):
    return jobs(spark, folder).where("status = 'O'").groupBy("type").agg(F.count("*").alias("queued"))


def newest_jobs(spark, folder):
    return R.latest_row(jobs(spark, folder), ["repo"], [F.col("created_at").desc(), F.col("id")], 3).select("repo", "id", "created_at")


def visible_documents(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("repo_id"), F.when(F.col("doc_id") % 8 == 0, "jira").otherwise("code").alias("source"), F.when(F.col("doc_id") % 5 == 0, F.array(F.col("source"), F.lit("src1"))).alias("requires"))
    scope = P.Scope(repos=("src0", "src1", "src2"))
    return P.where(docs, P.visible(scope, requires="requires")).select("doc_id", "repo_id", "source")


def job_page(spark, folder):
    return P.page(jobs(spark, folder).select("id", "type", "created_at"), ["created_at", "id"], 200, [F.lit("1997-06-01 00:00:00").cast("timestamp_ntz"), 5000], descending=True)


def problem_report(spark, folder):
    docs = table(spark, folder, "documents").select(F.array_compact(F.array(F.when(F.col("n_chars") > 4000, "long"), F.when(F.col("lang") != "en", "foreign"), F.when(F.col("doc_id") % 7 == 0, "stale"))).alias("problems"), (F.col("n_chars") % 100).alias("cost"), (F.col("doc_id") % 3).alias("drafts"))
    return R.problem_counts(docs)


def spend_windows(spark, folder):
    return spend.sliding(ledger(spark, folder), "feature").withColumn("day_cost", F.col("day_cost").cast("double")).withColumn("month_cost", F.col("month_cost").cast("double"))


def month_spend(spark, folder):
    out = spend.by_month(ledger(spark, folder), ["purchase", "view", "signup"])
    return out.withColumn("cost_usd", F.col("cost_usd").cast("double"))


def savings_by_kind(spark, folder):
    return spend.savings(ledger(spark, folder).where("cached").select(F.col("feature").alias("kind"), "input_tokens", "cost_usd")).withColumn("cost_avoided_usd", F.col("cost_avoided_usd").cast("double"))


#: Prices per million tokens: input, output, embedding, cache read, cache write, long threshold, long input, long output.
PRICES = [("view", 3.0, 15.0, 0.1, 0.3, None, 60, 6.0, 22.5), ("click", 1.0, 5.0, 0.1, None, None, None, None, None), ("embedding", 1.0, 1.0, 0.02, None, None, None, None, None), ("purchase", 2.0, 8.0, 0.1, 0.2, 2.5, 40, 4.0, 12.0)]
PRICE_SCHEMA = "model string, input double, output double, embed double, cache_read double, cache_write double, long_over long, long_input double, long_output double"


def priced_calls(spark, folder):
    calls = table(spark, folder, "events").select("event_id", F.col("event_type").alias("model"), F.when(F.col("user_id") % 10 == 0, "embedding").otherwise("qa").alias("feature"), F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), (F.col("user_id") % 50).alias("output_tokens"), (F.col("user_id") % 3 * 10).alias("cache_read_tokens"), (F.col("user_id") % 2 * 5).alias("cache_write_tokens"))
    out = spend.priced(calls, spark.createDataFrame(PRICES, PRICE_SCHEMA))
    return out.select("event_id", F.round("cost_usd", 12).alias("cost_usd"))


def limit_checks(spark, folder):
    limits = spark.createDataFrame([("l1", "global", "", 900, 4.0), ("l2", "feature", "view", 120, 1.0), ("l3", "feature", "click", 0, 0.02), ("l4", "provider", "7", 60, 0.0)], "limit_id string, scope string, scope_key string, max_tokens long, max_cost double")
    spent = spark.createDataFrame([("l1", 820, 1.0), ("l2", 10, 0.2), ("l4", 5, 0.0)], "limit_id string, tokens long, cost double")
    calls = table(spark, folder, "events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("feature"), (F.col("user_id") % 10).cast("string").alias("provider"), F.lit(None).cast("string").alias("repo"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.when(F.col("user_id") % 6 != 0, F.col("value") / 10000).alias("cost"))
    out = spend.checked(calls, limits, spent)
    return out.select("call_id", "allowed", "breached", F.array_join("warnings", ",").alias("warnings"), F.round("utilisation", 9).alias("utilisation"))


LIMITS_SQL = """lim(limit_id, scope, scope_key, max_tokens, max_cost, st, sc) AS (VALUES ('l1', 'global', '', 900, 4.0, 820, 1.0), ('l2', 'feature', 'view', 120, 1.0, 10, 0.2), ('l3', 'feature', 'click', 0, 0.02, 0, 0.0), ('l4', 'provider', '7', 60, 0.0, 5, 0.0))"""

QUERIES = {f.__name__: f for f in (usage_totals, job_stats, abort_rate, repo_freshness, repo_recent, answer_totals, answers_daily, activity_feed, decode_estimate, shelf_counts, queue_depth, newest_jobs, visible_documents, job_page, problem_report, spend_windows, month_spend, savings_by_kind, priced_calls, limit_checks)}
ORACLES = {
    "usage_totals": f"WITH {LEDGER_SQL} SELECT count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, count(*) FILTER (WHERE cached) AS cached_calls, count(*) FILTER (WHERE outcome = 'blocked') AS blocked_calls FROM ledger",
    "job_stats": f"WITH {JOBS_SQL} SELECT type, status, count(*) AS jobs, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY epoch(updated_at - created_at)), 6) AS p50_seconds, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY epoch(updated_at - created_at)), 6) AS p95_seconds FROM jobs GROUP BY 1, 2",
    "abort_rate": f"WITH {JOBS_SQL} SELECT count(*) FILTER (WHERE status IN ('F', 'O')) AS finished, count(*) FILTER (WHERE status = 'O') AS aborted, CASE WHEN count(*) FILTER (WHERE status IN ('F', 'O')) > 0 THEN count(*) FILTER (WHERE status = 'O') / count(*) FILTER (WHERE status IN ('F', 'O')) ELSE 0.0 END AS abort_rate FROM jobs WHERE type = '1-URGENT'",
    "repo_freshness": f"WITH {JOBS_SQL} SELECT c_custkey AS repo, c_name AS name, (SELECT max(updated_at) FROM jobs WHERE repo = c_custkey AND status IN ('F', 'O')) AS latest FROM customer",
    "repo_recent": f"WITH {JOBS_SQL} SELECT c_custkey AS repo, c_name AS name, (SELECT count(*) FROM jobs WHERE repo = c_custkey AND created_at > TIMESTAMP '1997-01-01') AS recent FROM customer",
    "answer_totals": f"WITH {ANSWERS_SQL} SELECT {_SUMS} FROM answers",
    "answers_daily": f"WITH {ANSWERS_SQL} SELECT date_trunc('day', created_at) AS day, {_SUMS} FROM answers GROUP BY 1",
    "activity_feed": f"""WITH {JOBS_SQL}, f AS (SELECT id, 'job' AS kind, updated_at AS t FROM jobs WHERE status <> 'P' UNION ALL SELECT l_orderkey, 'shipment', max(l_shipdate) FROM lineitem GROUP BY 1 UNION ALL SELECT event_id, 'event', ts FROM events) SELECT id, kind, t AS "at" FROM f ORDER BY t DESC, kind, id LIMIT 50""",
    "decode_estimate": f"WITH {JOBS_SQL} SELECT round(avg(cost), 6) AS mean, count(*) AS n FROM (SELECT cost FROM jobs WHERE status = 'F' ORDER BY created_at DESC, id LIMIT 100)",
    "shelf_counts": "SELECT n_nationkey AS shelf, n_name, count(c_custkey) AS items FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1, 2",
    "queue_depth": f"WITH {JOBS_SQL} SELECT type, count(*) AS queued FROM jobs WHERE status = 'O' GROUP BY 1",
    "newest_jobs": f"WITH {JOBS_SQL} SELECT repo, id, created_at FROM jobs QUALIFY row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, id) <= 3",
    "visible_documents": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN source END AS repo_id, CASE WHEN doc_id % 8 = 0 THEN 'jira' ELSE 'code' END AS source, CASE WHEN doc_id % 5 = 0 THEN [source, 'src1'] END AS requires FROM documents)
SELECT doc_id, repo_id, source FROM d WHERE (repo_id IN ('src0', 'src1', 'src2') OR (repo_id IS NULL AND source IN ('confluence', 'jira', 'notion', 'upload'))) AND (requires IS NULL OR list_has_all(['src0', 'src1', 'src2'], requires))""",
    "job_page": f"WITH {JOBS_SQL} SELECT id, type, created_at FROM jobs WHERE created_at < TIMESTAMP '1997-06-01' OR (created_at = TIMESTAMP '1997-06-01' AND id < 5000) ORDER BY created_at DESC, id DESC LIMIT 200",
    "problem_report": """WITH d AS (SELECT list_filter([CASE WHEN n_chars > 4000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN doc_id % 7 = 0 THEN 'stale' END], lambda x: x IS NOT NULL) AS p, n_chars % 100 AS cost, doc_id % 3 AS drafts FROM documents),
  e AS (SELECT unnest(CASE WHEN len(p) = 0 THEN [NULL] ELSE p END) AS problem, cost, drafts FROM d) SELECT problem, count(*) AS documents, CAST(sum(cost) AS BIGINT) AS cost, count(*) FILTER (WHERE drafts > 1) AS repaired FROM e GROUP BY 1""",
    "spend_windows": f"""WITH {LEDGER_SQL}, h AS (SELECT feature, date_trunc('hour', ts) AS hour, sum(input_tokens + output_tokens) AS tokens, sum(cost_usd) AS cost FROM ledger GROUP BY 1, 2)
SELECT feature, hour, CAST(sum(tokens) OVER d AS BIGINT) AS day_tokens, CAST(sum(cost) OVER d AS DOUBLE) AS day_cost, CAST(sum(tokens) OVER m AS BIGINT) AS month_tokens, CAST(sum(cost) OVER m AS DOUBLE) AS month_cost FROM h
WINDOW d AS (PARTITION BY feature ORDER BY hour RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW), m AS (PARTITION BY feature ORDER BY hour RANGE BETWEEN INTERVAL 720 HOURS PRECEDING AND CURRENT ROW)""",
    "month_spend": f"WITH {LEDGER_SQL} SELECT date_trunc('month', ts) AS month, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd FROM ledger WHERE feature IN ('purchase', 'view', 'signup') GROUP BY 1",
    "savings_by_kind": f"WITH {LEDGER_SQL} SELECT feature AS kind, count(*) AS events, CAST(sum(input_tokens) AS BIGINT) AS tokens_avoided, CAST(sum(cost_usd) AS DOUBLE) AS cost_avoided_usd FROM ledger WHERE cached GROUP BY 1",
    "priced_calls": """WITH p(model, i, o, e, cr, cw, lo, li, lout) AS (VALUES ('view', 3.0, 15.0, 0.1, 0.3, NULL, 60, 6.0, 22.5), ('click', 1.0, 5.0, 0.1, NULL, NULL, NULL, NULL, NULL), ('embedding', 1.0, 1.0, 0.02, NULL, NULL, NULL, NULL, NULL), ('purchase', 2.0, 8.0, 0.1, 0.2, 2.5, 40, 4.0, 12.0)),
  c AS (SELECT event_id, event_type AS model, user_id % 10 = 0 AS emb, CAST(json_extract_string(props, '$.k') AS BIGINT) AS it, user_id % 50 AS ot, user_id % 3 * 10 AS r, user_id % 2 * 5 AS w FROM events),
  x AS (SELECT *, CASE WHEN lo > 0 AND it > lo THEN CAST(li AS DOUBLE) ELSE CAST(i AS DOUBLE) END AS ri, CASE WHEN lo > 0 AND it > lo THEN CAST(lout AS DOUBLE) ELSE CAST(o AS DOUBLE) END AS ro, lo > 0 AND it > lo AS islong FROM c LEFT JOIN p USING (model))
SELECT event_id, round(CASE WHEN i IS NULL THEN NULL WHEN emb THEN (it + ot) * CAST(e AS DOUBLE) / 1e6 ELSE (greatest(it - r - w, 0) * ri + r * coalesce(CASE WHEN NOT coalesce(islong, false) THEN CAST(cr AS DOUBLE) END, ri) + w * coalesce(CASE WHEN NOT coalesce(islong, false) THEN CAST(cw AS DOUBLE) END, ri) + ot * ro) / 1e6 END, 12) AS cost_usd FROM x""",
    "limit_checks": f"""WITH {LIMITS_SQL}, c AS (SELECT event_id AS call_id, event_type AS feature, CAST(user_id % 10 AS VARCHAR) AS provider, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, CASE WHEN user_id % 6 <> 0 THEN value / 10000 END AS cost FROM events),
  x AS (SELECT call_id, limit_id, CASE WHEN max_tokens > 0 THEN (st + tokens) / max_tokens END AS u, max_tokens > 0 AND (tokens > max_tokens OR st + tokens > max_tokens) AS tb, max_cost > 0 AND cost IS NULL AS un,
    max_cost > 0 AND cost IS NOT NULL AND CAST(sc AS DOUBLE) + cost > max_cost - CASE WHEN max_cost <= 0 THEN 0 ELSE least(greatest(CAST(max_cost AS DOUBLE) * 5 / 100, 0.01), CAST(max_cost AS DOUBLE) / 2) END AS cb FROM c JOIN lim ON scope = 'global' OR (scope = 'feature' AND scope_key = feature) OR (scope = 'provider' AND scope_key = provider))
SELECT call_id, NOT bool_or(tb OR (NOT un AND cb)) AS allowed, min(CASE WHEN tb OR (NOT un AND cb) THEN limit_id END) AS breached, coalesce(string_agg(CASE WHEN NOT tb AND un THEN limit_id END, ',' ORDER BY limit_id), '') AS warnings, round(max(u), 9) AS utilisation FROM x GROUP BY 1""",
}
