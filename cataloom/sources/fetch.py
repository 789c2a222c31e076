"""Page fetching as a Python data source, with retries and a gap for each host."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGENTS = ["Mozilla/5.0 (X11; Linux x86_64)", "Mozilla/5.0 (Windows NT 10.0; Win64; x64)"]


def fetch(url: str, get: Callable[[str, str], str], attempts: int = 3, delay: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The page, or null when all attempts fail; the wait doubles and is jittered by 200 ms."""
    for n in range(attempts):
        try:
            return get(url, AGENTS[n % len(AGENTS)])
        except OSError:
            if n + 1 < attempts:
                sleep(delay * 2**n + random.uniform(0, 0.2))
    return None


def _urllib(url: str, agent: str) -> str:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": agent}), timeout=15) as r:
        return r.read().decode("utf-8", "replace")


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], gap: float):
        self.urls, self.gap = urls, gap

    def partitions(self) -> list[_Host]:
        """One for each host: the gap between requests holds where they are made."""
        from urllib.parse import urlsplit

        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(urlsplit(u).netloc, []).append(u)
        return [_Host(us) for us in hosts.values()] or [_Host([])]

    def read(self, partition: _Host) -> Iterator[tuple]:
        last = 0.0
        for u in partition.urls:
            time.sleep(max(0.0, last + self.gap - time.monotonic()))
            last = time.monotonic()
            yield u, fetch(u, _urllib)


class PageSource(DataSource):
    """spark.read.format("page").option("urls", "<one a line>").load(): (url, html)."""

    @classmethod
    def name(cls) -> str:
        return "page"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema) -> _Reader:
        return _Reader([u for u in self.options.get("urls", "").split("\n") if u], float(self.options.get("gap", "0.6")))
