"""Index runs and jobs: which shops a run takes, job states, cadence, the guard against overlap, records, and cached results."""

from __future__ import annotations

import logging
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.operators.prices import at

MODES = ("full", "retry", "single")


def run_shops(shops: DataFrame, mode: str, slug: str | None = None) -> DataFrame:
    """The shops (slug, status, needs_retry, ...) of a run: full takes the active ones, retry those that need one and are not blocked, single the one of that slug."""
    if mode == "full":
        return shops.where("status = 'active'")
    if mode == "retry":
        return shops.where("needs_retry = true AND NOT status <=> 'blocked'")
    if mode == "single":
        return shops.where(F.col("slug") == slug)
    raise ValueError(f"unknown mode {mode}")


def run_record(outcomes: DataFrame, mode: str, started: str, finished: str) -> DataFrame:
    """One row (mode, shops_attempted, shops_succeeded, shops_failed, urls, inserted, merged, seconds) from a run's shops (slug, urls, inserted, merged, error)."""
    number = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    seconds = F.unix_timestamp(at(finished).cast("timestamp")) - F.unix_timestamp(at(started).cast("timestamp"))
    return outcomes.agg(
        F.count("*").alias("shops_attempted"), F.count_if(F.col("error").isNull()).alias("shops_succeeded"), F.count_if(F.col("error").isNotNull()).alias("shops_failed"),
        number("urls"), number("inserted"), number("merged"),
    ).select(F.lit(mode).alias("mode"), "*", seconds.alias("seconds"))


def append_record(rows: DataFrame, path: str) -> bool:
    """Append run, audit or event records as far as possible: a failure is logged, not raised. Whether they were written."""
    try:
        rows.write.mode("append").parquet(path)
        return True
    except Exception as e:  # noqa: BLE001
        logging.getLogger(__name__).warning("records not written to %s: %s", path, e)
        return False


def job_states(steps: DataFrame) -> DataFrame:
    """(job_id, query, status, started_at, completed_at, error) of each job from its steps (job_id, query, step, at, error).

    A job is PENDING when it is asked for, RUNNING after a start, and COMPLETED or FAILED by its first end; what comes after
    an end changes nothing. A job without a query is a full reindex.
    """
    first = lambda step: F.min(F.when(F.col("step") == step, F.col("at")))
    ended = F.col("step").isin("finish", "fail")
    end = F.min(F.when(ended, F.struct("at", "step", "error")))
    jobs = steps.groupBy("job_id").agg(F.max("query").alias("query"), first("ask").alias("asked"), first("start").alias("ran"), end.alias("end"))
    status = F.when(F.col("end.step") == "fail", "FAILED").when(F.col("end").isNotNull(), "COMPLETED").when(F.col("ran").isNotNull(), "RUNNING").otherwise("PENDING")
    return jobs.select("job_id", F.coalesce("query", F.lit("(full reindex)")).alias("query"), status.alias("status"), F.col("asked").alias("started_at"), F.col("end.at").alias("completed_at"), F.when(F.col("end.step") == "fail", F.col("end.error")).alias("error"))


# Tasks that run by the clock: hour of each day, or minutes between two runs.
DAILY = {"index": 3, "retry": 4, "snapshot": 4, "hot_drops": 5}
EVERY_MINUTES = {"canary": 15}


def due(last: DataFrame, as_of: str) -> DataFrame:
    """(task, last_at, next_at, due) from (task, last_at): the first time after the last run; a task that never ran is due."""
    now = at(as_of)
    hour = F.create_map(*[x for k, v in DAILY.items() for x in (F.lit(k), F.lit(v))])[F.col("task")]
    minutes = F.create_map(*[x for k, v in EVERY_MINUTES.items() for x in (F.lit(k), F.lit(v))])[F.col("task")]
    day = F.date_trunc("day", "last_at").cast("timestamp_ntz") + F.make_dt_interval(hours=hour)
    daily = F.when(day > F.col("last_at"), day).otherwise(day + F.expr("interval 1 day"))
    step = minutes * 60
    tick = F.timestamp_seconds((F.floor(F.unix_timestamp(F.col("last_at").cast("timestamp")) / step) + 1) * step).cast("timestamp_ntz")
    found = last.withColumn("next_at", F.when(minutes.isNotNull(), tick).otherwise(daily))
    return found.select("task", "last_at", "next_at", F.coalesce(F.col("next_at") <= now, F.lit(True)).alias("due"))


class RunGuard:
    """One full run at a time: a file in the shared folder that only one driver can create. Runs of parts are not guarded."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def enter(self) -> bool:
        """Whether this run may start."""
        return bool(self.fs.createNewFile(self.path))

    def leave(self) -> None:
        self.fs.delete(self.path, False)


class ResultCache:
    """Small results by key for a while: least recently used ones go beyond most entries, old ones after seconds."""

    def __init__(self, seconds: float = 60.0, most: int = 500, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self.rows: OrderedDict[str, tuple[float, list]] = OrderedDict()
        self.hits = self.misses = self.evictions = self.failures = 0

    def get(self, key: str, make: Callable[[], DataFrame]) -> list:
        """The rows of make() for a key, from the cache while they are fresh. A failure is counted and raised, not kept."""
        now = self.clock()
        if key in self.rows and now - self.rows[key][0] < self.seconds:
            self.hits += 1
            self.rows.move_to_end(key)
            return self.rows[key][1]
        self.misses += 1
        try:
            found = make().collect()  # a page of results
        except Exception:
            self.failures += 1
            raise
        self.rows[key] = now, found
        self.rows.move_to_end(key)
        while len(self.rows) > self.most:
            self.rows.popitem(last=False)
            self.evictions += 1
        return found

    def flush(self) -> None:
        self.rows.clear()

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        rate = int(self.hits / asked * 1000 + 0.5) / 1000 if asked else 0.0
        return {"size": len(self.rows), "hits": self.hits, "misses": self.misses, "hit_rate": rate, "requests": asked, "evictions": self.evictions, "failures": self.failures}
