"""Daily budgets of calls, and a cache of replies by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.rules import DAILY_CALLS


def admitted(calls: DataFrame, *by: str, limit: int = DAILY_CALLS) -> DataFrame:
    """(day, *by, call_id, nth, refused): calls of each day in order; those beyond `limit` are refused."""
    w = Window.partitionBy("day", *by).orderBy("ts", "call_id")
    return calls.withColumn("nth", F.row_number().over(w).cast("long")).select("day", *by, "call_id", "nth", (F.col("nth") > limit).alias("refused"))


def ledger(calls: DataFrame, limit: int = DAILY_CALLS, days: int = 30) -> DataFrame:
    """(day, used, remaining) of the last `days` days before the latest."""
    per = calls.groupBy("day").agg(F.count("*").alias("used"))
    latest = per.agg(F.max("day").alias("latest"))
    kept = per.join(F.broadcast(latest), F.col("day") >= F.date_sub("latest", days))
    return kept.select("day", "used", F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.col("used")).alias("remaining"))


def cache_key(model: Column, version: Column, payload: Column) -> Column:
    """SHA-256 of all that can change a reply: model, prompt version and canonical payload."""
    quoted = lambda c: F.to_json(F.array(c))
    return F.sha2(F.concat_ws("\n", quoted(model), quoted(version), payload), 256)


def hits_and_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """`requests` (key, ...) with `response` from `cache` (key, response, stored_at), the latest; null is a miss."""
    latest = cache.groupBy("key").agg(F.max_by("response", "stored_at").alias("response"))
    return requests.join(latest, "key", "left")
