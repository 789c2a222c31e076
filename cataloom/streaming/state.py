"""Stateful operators per key: token bucket and shop health."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cataloom.operators.health import ACTIVE_FROM, BLOCK_AFTER, FRAME
from cataloom.operators.ratelimit import TokenBucket


def rate_limited(events: DataFrame, capacity: int, per_second: float, idle: str = "10 minutes") -> DataFrame:
    """(key, id, seconds, allowed) of a stream (key string, id long, ts); a bucket idle past the time-out is forgotten."""
    bucket = TokenBucket(capacity, per_second)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(batches)).sort_values(["seconds", "id"])
        allowed = []
        for t in rows["seconds"]:
            ok, tokens = bucket.step(tokens, last, t)
            last = t
            allowed.append(ok)
        state.update((tokens, last))
        state.setTimeoutDuration(idle_ms)
        yield rows.assign(allowed=allowed)[["key", "id", "seconds", "allowed"]]

    rows = events.select("key", "id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, id long, seconds double, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


class Health:
    """A shop's state: last runs, failing streak, status; an operator's reset makes it active again."""

    def __init__(self, recent: list[int] | None = None, failures: int = 0, status: str = "active"):
        self.recent, self.failures, self.status = recent or [], failures, status

    def run(self, ok: int) -> tuple[str, int, str]:
        self.recent = [*self.recent, ok][-FRAME:]
        self.failures = 0 if ok else self.failures + 1
        if self.failures >= BLOCK_AFTER and self.status == "active":
            self.status = "blocked"
        good = sum(self.recent)
        return "active" if good >= ACTIVE_FROM else "degraded" if good else "dormant", self.failures, self.status

    def reset(self) -> None:
        self.failures, self.status = 0, "active"


def health_stream(runs: DataFrame) -> DataFrame:
    """(shop_id, run_id, health, failures, status) of a stream (shop_id long, run_id long, ok int); ok -1 is an operator's reset."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, failures, status = state.get if state.exists else ("", 0, "active")
        shop = Health([int(c) for c in recent], failures, status)
        out = []
        for run_id, ok in sorted(x for b in batches for x in zip(b["run_id"], b["ok"])):
            if ok < 0:
                shop.reset()
            else:
                out.append((key[0], run_id, *shop.run(int(ok))))
        state.update(("".join(map(str, shop.recent)), shop.failures, shop.status))
        yield pd.DataFrame(out, columns=["shop_id", "run_id", "health", "failures", "status"])

    return runs.groupBy("shop_id").applyInPandasWithState(step, "shop_id long, run_id long, health string, failures int, status string", "recent string, failures int, status string", "append", GroupStateTimeout.NoTimeout)
