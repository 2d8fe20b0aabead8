"""Incremental refresh of station readings: landed files to monthly means, safe to replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def landed(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def refresh(readings: DataFrame, path: str, checkpoint: str):
    """Runs over everything landed so far and stops. Each micro-batch overwrites its own folder ``batch=<id>`` of ``path``.

    A batch that runs again after a failure replaces what it had written, so rows are stored exactly once a landing; a
    reading that lands twice, however late, is dropped when the table is read (``readings_of``).
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return readings.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def readings_of(spark: SparkSession, path: str, station: str, reading_id: str) -> DataFrame:
    """All readings stored by ``refresh``, each once: of several landings the first batch's row counts."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (station, reading_id)]
    first = rows.groupBy(station, reading_id).agg(F.min(F.struct("batch", *[c for c in rest if c != "batch"])).alias("_r"))
    return first.select(station, reading_id, *[F.col(f"_r.{c}").alias(c) for c in rest if c != "batch"])


def monthly_batch(readings: DataFrame, station: str, reading_id: str, ts: str, value: str) -> DataFrame:
    """Monthly means of all readings, replays dropped."""
    unique = readings.dropDuplicates([station, reading_id])
    return unique.groupBy(station, F.trunc(F.col(ts).cast("date"), "month").alias("month")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


# --- keyed increments ------------------------------------------------------------------------

def refresh_means(readings: DataFrame, path: str, checkpoint: str, station: str, reading_id: str, ts: str, value: str):
    """Adds what has landed to the monthly sums under ``path`` and stops; a run reads its batch and the keys of its months only.

    Each micro-batch writes, in its own folder, the keys that are new (``keys``) and their sums by station and month
    (``sums``). A reading is known by station, id and the month of its date; one that was stored before, in whatever batch, is
    looked up among the keys of its month and adds nothing. A batch that runs again after a failure compares itself with
    earlier batches and replaces its own folders, so it gives what it would have given. A null id is a key like any other;
    readings without a date are dropped.
    """
    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        month = F.trunc(F.col(ts).cast("date"), "month")
        new = batch.select(F.col(station).alias("station"), F.col(reading_id).alias("reading_id"), month.alias("month"), F.col(value).cast("double").alias("value"))
        new = new.where(F.col("month").isNotNull()).groupBy("station", "reading_id", "month").agg(F.min("value").alias("value"))
        keys = T.StructType([f for f in new.schema.fields if f.name != "value"])
        if number:
            months = [r["month"] for r in new.select("month").distinct().collect()]  # calendar months, few
            stored = spark.read.schema(keys.add("batch", "long")).parquet(f"{path}/keys").where(F.col("month").isin(months) & (F.col("batch") < number))
            same = [new[c].eqNullSafe(stored[c]) for c in ("station", "reading_id")] + [new["month"] == stored["month"]]
            new = new.join(stored, same, "left_anti")
        new = new.persist()
        new.drop("value").write.mode("overwrite").partitionBy("month").parquet(f"{path}/keys/batch={number}")
        sums = new.groupBy("station", "month").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
        sums.write.mode("overwrite").parquet(f"{path}/sums/batch={number}")
        new.unpersist()

    return readings.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly_means(spark: SparkSession, path: str) -> DataFrame:
    """(station, month, mean, n) from the sums of all batches; the readings themselves are not read again."""
    merged = spark.read.parquet(f"{path}/sums").groupBy("station", "month").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return merged.select("station", "month", F.try_divide("total", "n").alias("mean"), "n")
