"""Token bucket per key, as a fold over each key's events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TokenBucket:
    """Starts full, refills continuously; an event costs 1 and is denied below that, though time moves on."""

    def __init__(self, capacity: int, per_second: float):
        if capacity <= 0 or per_second <= 0:
            raise ValueError("capacity and refill rate must be over 0")
        self.capacity, self.per_second = capacity, per_second

    def step(self, tokens: float, last: float | None, now: float) -> tuple[bool, float]:
        """(allowed, tokens left) for an event at now, in seconds."""
        if last is not None:
            tokens = min(float(self.capacity), tokens + max(0.0, now - last) * self.per_second)
        return (True, tokens - 1) if tokens >= 1 else (False, tokens)


def rate_limit(events: DataFrame, capacity: int, per_second: float, key: str = "actor") -> DataFrame:
    """(key, id, ts, allowed) for each event; events without a key are left out.

    Rows are dealt by key and sorted, and each task folds over its sorted rows batch by batch: a key of any size needs the
    memory of one batch.
    """
    bucket = TokenBucket(capacity, per_second)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, last = None, 0.0, None
        for pdf in batches:
            allowed = []
            for k, t in zip(pdf["key"], pdf["seconds"]):
                if k != current:
                    current, tokens, last = k, float(capacity), None
                ok, tokens = bucket.step(tokens, last, t)
                last = t
                allowed.append(ok)
            yield pdf.drop(columns="seconds").assign(allowed=allowed)

    rows = events.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.repartition("key").sortWithinPartitions("key", "ts", "id")
    return rows.mapInPandas(fold, f"key {kind}, id long, ts {rows.schema['ts'].dataType.simpleString()}, allowed boolean")


def idle_keys(events: DataFrame, as_of: str, minutes: int, key: str = "actor") -> DataFrame:
    """Keys whose last event is older than that: their buckets may go."""
    from cataloom.operators.prices import at

    return events.groupBy(F.col(key).alias("key")).agg(F.max("ts").alias("last")).where(F.col("last") < at(as_of) - F.expr(f"interval {int(minutes)} minutes"))
