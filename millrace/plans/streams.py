"""What finished streams leave behind, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import issues as I
from millrace.plans.issues import ORACLES as ISSUES
from millrace.plans.issues import flat, shaped
from millrace.session import shared_folder, table
from millrace.streaming import signals
from millrace.streaming.delivery import Manifests, delivered


def delivered_issues(spark, folder):
    """The events as a stream, a fifth of them twice, without the repeats, through the sink of whole batches, and then folded."""
    spark.dataSource.register(Manifests)
    out = shared_folder(spark, "delivered")
    arrived = shaped(table(spark, folder, "events"))
    arrived.write.parquet(f"{out}/arrived")  # a stream reads folders, and the table may be one file
    stream = spark.readStream.schema(arrived.schema).parquet(f"{out}/arrived")
    stream = stream.withColumn("connector_id", F.lit("events")).withColumn("external_id", F.col("event_id").cast("string"))
    twice = signals.prepared(stream.unionByName(stream.where("event_id % 5 = 0")))
    rows = signals.deduplicated(twice).drop("connector_id", "external_id")
    query = rows.writeStream.format("manifests").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = delivered(spark, f"{out}/rows", rows.schema)
    return flat(I.fold(found)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


QUERIES = {"delivered_issues": delivered_issues}
ORACLES = {"delivered_issues": ISSUES["issue_fold"]}
