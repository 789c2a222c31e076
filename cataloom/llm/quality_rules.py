"""Host-level quality rules.

Each document is measured once and tested by a few rules. Failures of each rule are counted by host, each host's rate
is shrunk towards all hosts' by a beta prior fitted to the hosts themselves, and the verdict on the host is joined back
to its documents. A host is rejected if even the low end of its posterior rate is well over the rate of the whole corpus, so
one of three pages of which two fail is judged mildly, one of a million pages by its own rate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import batches_of, materialize, small_side, words

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


@dataclass(frozen=True)
class HostRules:
    """Thresholds. A document fails base rules by too few words or too many repeated ones; hosts are judged by all rules."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_percent: int = 10
    max_dup_lines_percent: int = 30
    #: A host goes when its rate of any rule's failures, tail standard deviations of the posterior below its mean, is over the
    #: corpus' rate by more than this.
    max_excess: float = 0.25
    tail: float = 2.0
    #: Rejected hosts up to this many are broadcast (some 10 MB); more are joined by a shuffle.
    broadcast_hosts: int = 200_000

    def failures(self) -> dict[str, object]:
        """A boolean column for each rule."""
        n = F.col("n_words")
        return {
            "few_words": n < self.min_words,
            "repeats": 100 * F.col("n_repeat_words") > self.max_repeat_percent * n,
            "symbols": 100 * F.col("n_symbols") > self.max_symbols_percent * n,
            "dup_lines": 100 * F.col("n_dup_lines") > self.max_dup_lines_percent * F.col("n_lines"),
        }


def repeated_words(found: list[bytes]) -> int:
    """How many words stand in a 3-word window that the text holds twice or more."""
    n = len(found)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter([ids.setdefault(w, len(ids)) for w in found], np.int64, n)
    v = len(ids)
    if v == n:
        return 0
    pair = at[:-1] * v + at[1:]
    if v > 2_000_000:  # v ** 3 would not fit
        pair, v = np.unique(pair, return_inverse=True)[1], max(v, n)
        window = pair[:-1] * v + at[2:]
    else:
        window = pair[:-1] * v + at[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    held = np.zeros(n, bool)
    held[:-2] |= twice
    held[1:-1] |= twice
    held[2:] |= twice
    return int(held.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (those with a word) of a text; null counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    found = words(text)
    blank = sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return len(found), len(text) - blank, sum(map(text.count, "#*$%&|<>")), again, repeated_words(found), again + len(seen)


def _appended(text: str, kept: list[str]):
    """A function that measures a column of texts and puts the measures behind the columns kept."""

    def run(batches):
        for batch in batches:
            columns = list(zip(*[measure(t) for t in batch.column(text).to_pylist()])) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(c, pa.int64()) for c in columns], kept + [x.split()[0] for x in STATS.split(", ")])

    return run


def document_stats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) for each row, whole texts.

    Null and empty texts count nothing. Repeated rows stay. Other columns of docs, whatever their names, are not read.
    """
    batches_of(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("__text")).mapInArrow(
        _appended("__text", ["doc_id", "host"]), f"doc_id {kind}, host string, {STATS}"
    )


def host_verdicts(stats: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """(host, n_docs, <rule>_rate ..., host_rejected): one row for each host, null among them; rates are posterior means.

    The prior of each rule is a beta distribution fitted by moments: its mean is the rate over all documents, its
    weight follows from the spread of hosts' rates beyond what their sizes explain. One host, or hosts that do not
    differ, give the strongest prior. No documents give no rows.
    """
    failed = rules.failures()
    hosts = materialize(stats.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(test.cast("long")).alias(name) for name, test in failed.items()]), "hosts")
    n = F.col("n_docs").cast("double")
    total = hosts.agg(F.sum("n_docs").cast("double").alias("docs"), F.count("*").cast("double").alias("hosts"), F.sum(n * n).alias("squares"), *[F.sum(k).cast("double").alias(k) for k in failed]).first()
    if not total["docs"]:
        return hosts.select("host", "n_docs", *[F.lit(0.0).alias(f"{k}_rate") for k in failed], F.lit(False).alias("host_rejected"))
    mean = {k: total[k] / total["docs"] for k in failed}
    spread = hosts.agg(*[F.sum(n * (F.col(k) / n - mean[k]) ** 2).alias(k) for k in failed]).first()
    rates, over = [], []
    for k in failed:
        m, free = mean[k], total["hosts"] - 1
        left = m * (1 - m) * (total["docs"] - total["squares"] / total["docs"] - free)
        rho = (spread[k] - m * (1 - m) * free) / left if left > 0 else 0.0
        weight = 1 / min(max(rho, 1e-6), 0.999) - 1
        rate = (F.col(k) + m * weight) / (n + weight)
        low = rate - rules.tail * F.sqrt(rate * (1 - rate) / (n + weight + 1))
        rates.append(rate.alias(f"{k}_rate"))
        over.append(low - m)
    return hosts.select("host", "n_docs", *rates, (F.greatest(*over) > rules.max_excess).alias("host_rejected"))


def host_quality(docs: DataFrame, rules: HostRules = HostRules(), **columns: str) -> DataFrame:
    """Each document's measures with its host's posterior rates, base_failed, host_rejected and kept.

    kept is false for documents that fail a base rule and for all documents of rejected hosts. Null hosts are one host
    of their own. Empty tables give no rows. The statistics are written to the shared folder once, so texts are read
    once; hosts' verdicts are broadcast if they are few enough, else joined by a shuffle whose hot hosts are split.
    """
    stats = materialize(document_stats(docs, **columns), "stats")
    verdicts = materialize(host_verdicts(stats, rules).drop("n_docs").withColumnRenamed("host", "__host"), "verdicts")
    failed = rules.failures()
    return (
        stats.join(small_side(verdicts, rules.broadcast_hosts), F.col("host").eqNullSafe(F.col("__host")))
        .withColumn("base_failed", failed["few_words"] | failed["repeats"])
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
        .drop("__host")
    )


def keep_good(docs: DataFrame, rules: HostRules = HostRules(), *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that host_quality() keeps, with docs' own columns, whatever their names.

    Rows are judged one by one, so repeated ids do no harm. Null and empty texts fail. Each text is measured once: rows and
    measures are written to the shared folder together, and the hosts' verdicts come from there.
    """
    names = docs.columns
    batches_of(docs.sparkSession)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, host = f"c{names.index(text_col)}", f"c{names.index(host_col)}"
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields)
    measured = materialize(inner.mapInArrow(_appended(text, inner.columns), f"{types}, {STATS}"), "measured")
    verdicts = host_verdicts(measured.withColumn("host", F.col(host).cast("string")), rules)
    rejected = small_side(materialize(verdicts.where("host_rejected").select(F.col("host").alias("__host")), "rejected"), rules.broadcast_hosts)
    failed = rules.failures()
    return (
        measured.where(~(failed["few_words"] | failed["repeats"]))
        .join(rejected, F.col(host).cast("string").eqNullSafe(F.col("__host")), "left_anti")
        .select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])
    )
