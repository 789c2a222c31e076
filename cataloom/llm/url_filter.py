"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path.

Training and scoring are SQL expressions over arrays: no Python runs on executors. The labelled table is small and its
size is bounded by a parameter; the fitted weights are a constant of the scoring expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm.common import lower_ascii, materialize

#: Rules of the query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

@dataclass(frozen=True)
class Ngrams:
    """Hashed features and how they are fitted."""

    size: int = 3
    slots: int = 2048
    epochs: int = 120
    rate: float = 30.0
    shrink: float = 2e-4
    #: Labelled rows beyond this many are not trained on, those of the smallest hash are kept: training runs in one task.
    most_rows: int = 2048


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty if there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def slots(host_col: Column, path_col: Column, grams: Ngrams) -> Column:
    """The slot of each n-gram of host and path, as an array; both are set in bounds so that their ends tell."""
    both = F.concat(F.lit("^"), host_col, F.lit("|"), lower_ascii(path_col), F.lit("$"))
    found = F.regexp_extract_all(both, F.lit(f"(?s)(?=(.{{{grams.size}}}))"), F.lit(1))
    return F.transform(found, lambda g: F.pmod(F.xxhash64(g), F.lit(grams.slots)).cast("int"))


def _margin(found: Column, weights: Column, bias: Column) -> Column:
    """Bias plus the weights of the slots that a URL has, over the root of their number."""
    total = F.aggregate(found, F.lit(0.0), lambda a, s: a + F.get(weights, s))
    return bias + total / F.sqrt(F.greatest(F.size(found), F.lit(1)))


def train(labelled: DataFrame, grams: Ngrams = Ngrams()) -> tuple[list[float], float]:
    """Weights of the slots and a bias, from (url, label 0 or 1); null labels are left out, null URLs are empty.

    Gradient descent over all rows at once, in one row of arrays: each row's slots and, for each slot, the rows that have it, so a
    step costs as much as there are n-grams. Sums run in the order of the rows' hashes, so reruns agree. Without rows all
    weights are zero.
    """
    rows = labelled.where("label is not null").select(F.xxhash64("url", "label").alias("h"), slots(host(F.col("url")), path(F.col("url")), grams).alias("s"), F.col("label").cast("double").alias("y"))
    kept = materialize(rows.orderBy("h").limit(grams.most_rows), "labelled")
    one = F.lit(1).alias("one")
    row = F.struct("h", "s", "y", (1 / F.sqrt(F.greatest(F.size("s"), F.lit(1)))).alias("c"))
    listed = materialize(kept.agg(F.array_sort(F.collect_list(row)).alias("xs")).select(one, "xs"), "rows")
    held = listed.select(F.posexplode("xs").alias("i", "x")).select("i", F.explode("x.s").alias("slot")).groupBy("slot").agg(F.array_sort(F.collect_list("i")).alias("at"))
    by_slot = held.agg(F.map_from_entries(F.collect_list(F.struct("slot", "at"))).alias("m")).select(one, "m")
    every = F.transform(F.sequence(F.lit(0), F.lit(grams.slots - 1)), lambda j: F.coalesce(F.col("m")[j], F.array().cast("array<int>")))
    frame = materialize(listed.join(by_slot, "one").select("xs", every.alias("cols")), "examples")
    n = F.greatest(F.size("xs"), F.lit(1))

    def step(w: Column, _: Column) -> Column:
        bias = F.get(w, F.lit(grams.slots))
        errors = F.transform("xs", lambda x: x["y"] - 1 / (1 + F.exp(-_margin(x["s"], w, bias))))

        def move(e: Column) -> Column:
            pull = lambda at: F.aggregate(at, F.lit(0.0), lambda a, i: a + F.get(e, i) * F.get(F.col("xs"), i)["c"])
            moved = F.zip_with(F.slice(w, 1, grams.slots), F.col("cols"), lambda v, at: v * (1 - grams.shrink) + grams.rate * pull(at) / n)
            return F.concat(moved, F.array(bias + _BIAS * grams.rate * F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / n))

        return _let(errors, move)

    fitted = frame.select(F.aggregate(F.sequence(F.lit(1), F.lit(grams.epochs)), F.array_repeat(F.lit(0.0), grams.slots + 1), step).alias("w")).first()["w"]
    return list(fitted[:-1]), fitted[-1]


#: How fast the bias learns beside the weights.
_BIAS = 0.1


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def seed_table(spark: SparkSession) -> DataFrame:
    """The labelled table (url, label) of seed_urls.txt."""
    lines = (Path(__file__).parent / "seed_urls.txt").read_text(encoding="utf-8").splitlines()
    return spark.createDataFrame([(line[2:], int(line[0])) for line in lines if line and not line.startswith("#")], "url string, label int")


def judge(urls: DataFrame, model: tuple[list[float], float], rules: list[tuple[str, str, str]] = RULES, grams: Ngrams = Ngrams(), *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, score, verdict) of each row; score is the chance that the model would block it.

    A rule fits its host and all its subdomains if the path starts with the rule's; the longest host and path win, then the
    first in order. rule is null where none fits, and there the model decides, at a half. Null URLs and those without ://
    have an empty host and path. Repeated rows stay; empty tables give no rows; other columns are not read.
    """
    weights, bias = model
    constant = F.array(*map(F.lit, weights))  # literals alone, so it is folded to one constant
    rows = urls.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, start in reversed(ordered):
        fits = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, at + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    score = 1 / (1 + F.exp(-_margin(slots(F.col("host"), F.col("path"), grams), constant, F.lit(bias))))
    return rows.withColumn("rule", rule).withColumn("score", score).withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
