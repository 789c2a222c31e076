"""Shop health from the runs of each shop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FRAME, ACTIVE_FROM, BLOCK_AFTER = 7, 4, 3


def shop_health(runs: DataFrame) -> DataFrame:
    """(shop_id, at, run_id, recent_ok, health, failures, needs_retry, blocked) after each run (shop_id, at, run_id, ok 0 or 1).

    health: successes among the last seven runs; failures: length of the failing streak; blocked latches once a streak
    reaches three. All windows share one partitioning and order, so runs are shuffled once.
    """
    order = Window.partitionBy("shop_id").orderBy("at", "run_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    island = runs.withColumn("recent_ok", F.sum("ok").over(order.rowsBetween(1 - FRAME, 0))).withColumn("island", F.sum("ok").over(so_far)).withColumn("place", F.row_number().over(order))
    started = F.max(F.when(F.col("ok") == 1, F.col("place"))).over(so_far)
    streak = island.withColumn("failures", F.when(F.col("ok") == 1, 0).otherwise(F.col("place") - F.coalesce(started, F.lit(0))))
    health = F.when(F.col("recent_ok") >= ACTIVE_FROM, "active").when(F.col("recent_ok") >= 1, "degraded").otherwise("dormant")
    blocked = F.max(F.col("failures") >= BLOCK_AFTER).over(so_far)
    return streak.select("shop_id", "at", "run_id", "recent_ok", health.alias("health"), F.col("failures").cast("long").alias("failures"), (F.col("ok") == 0).alias("needs_retry"), blocked.alias("blocked"))


def run_succeeded(error, count):
    """Whether a run counts as a success: no error and something found."""
    return (error.isNull() & (F.coalesce(count, F.lit(0)) > 0)).cast("int")


def last_runs(runs: DataFrame, n: int = FRAME) -> DataFrame:
    """The newest n runs of each shop."""
    newest = Window.partitionBy("shop_id").orderBy(F.desc("at"), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def to_retry(shops: DataFrame) -> DataFrame:
    """Shops that need a retry and are not blocked."""
    return shops.where(F.coalesce("needs_retry", F.lit(False)) & ~F.col("status").eqNullSafe("blocked"))


def host_gaps(fetches: DataFrame, least_ms: int = 600) -> DataFrame:
    """(host, ts, id, gap_ms, too_soon): time since the host's fetch before."""
    order = Window.partitionBy("host").orderBy("ts", "id")
    gap = F.timestamp_diff("MILLISECOND", F.lag("ts").over(order), F.col("ts"))
    return fetches.withColumn("gap_ms", gap).select("host", "ts", "id", "gap_ms", F.coalesce(F.col("gap_ms") < least_ms, F.lit(False)).alias("too_soon"))
