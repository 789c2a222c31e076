"""Click events as a stream: ingest rules and rolling statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.functions.text import blank_to_null, capped, ip_hash


def accepted(raw: DataFrame) -> DataFrame:
    """Events that count, from rows (type, query, result_count, product_id, seller_slug, anon_id, user_id, latency_ms, ip, ts).

    Searches: trimmed, not empty, 120 characters, lower case. Views: with a product. Clicks: with a product or a seller. Ids
    are cut to 64 characters, addresses hashed. Works on streams and tables alike.
    """
    ids = {c: capped(F.col(c), 64) for c in ("product_id", "seller_slug", "anon_id", "user_id")}
    rows = raw.withColumns({c: blank_to_null(v) for c, v in ids.items()}).withColumn("query", F.lower(capped(F.col("query"), 120))).withColumn("ip_hash", ip_hash(F.col("ip"))).drop("ip")
    search = (F.col("type") == "search") & (F.length("query") > 0)
    view = (F.col("type") == "view") & F.col("product_id").isNotNull()
    click = (F.col("type") == "click") & (F.col("product_id").isNotNull() | F.col("seller_slug").isNotNull())
    return rows.where(search | view | click)


def rolling_counts(events: DataFrame, window: str = "60 seconds", slide: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """(start, end, type, n, actors) of sliding windows; events later than the watermark are dropped.

    Actors are estimated: an exact distinct count would keep every actor of every open window.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", window, slide).alias("w"), "type").agg(F.count("*").alias("n"), F.approx_count_distinct("actor").alias("actors"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "type", "n", "actors")


def upsert_batches(path: str, key: list[str], instant: str = "ts"):
    """A foreachBatch sink that keeps the newest row of each key, by an instant, in versions of a table, safe to repeat.

    Of rows of one instant the one that sorts last by all columns stays. Skipped epochs do no harm: the last whole version
    before this one is taken up.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        row = F.struct(*[F.col(c) for c in batch.columns])
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and int(n[1:]) < epoch and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
        rows = spark.read.parquet(f"{path}/v{max(done)}").unionByName(batch) if done else batch
        newest = rows.groupBy(*key).agg(F.max_by(row, F.struct(F.col(instant), F.to_json(row).alias("tie"))).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return write
