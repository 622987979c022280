"""Streaming ingest, daily aggregates, follow-up closure and triggers (suppression: ``suppress``).

Every sink is idempotent per micro-batch: a batch writes to its own ``batch=<id>`` folder with overwrite, so a batch that
is repeated after a failure replaces its earlier output. Checkpoints live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, glob: str | None = None, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that is available now and stop."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def batch_writer(path: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder."""

    def write(rows: DataFrame, batch: int) -> None:
        keep(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def split_sink(valid_path: str, quarantine_path: str) -> Callable[[DataFrame, int], None]:
    """Rows without flags to the valid table, all others to quarantine, from one evaluation of the batch."""

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        rows.filter(F.size("flags") == 0).write.mode("overwrite").parquet(f"{valid_path}/batch={batch}")
        rows.filter(F.size("flags") > 0).write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch}")
        rows.unpersist()

    return write


def time_policy(rows: DataFrame, now, high_water, delay_seconds: int) -> DataFrame:
    """Route per row: future rows are rejected, rows older than the watermark go to the backfill, the rest is live."""
    late = F.col("ts") < high_water - F.expr(f"INTERVAL {delay_seconds} SECONDS")
    return rows.withColumn(
        "route", F.when(F.col("ts") > now + F.expr("INTERVAL 5 MINUTES"), "rejected").when(F.coalesce(late, F.lit(False)), "backfill").otherwise("live")
    )


def daily_stream(stream: DataFrame, keys: list[str], output: str, checkpoint: str) -> DataFrame:
    """Sums and counts per UTC day: every batch writes its own part, late rows included, and the parts add up to the state."""
    days = [*keys, "day"]

    def part(rows: DataFrame) -> DataFrame:
        return rows.withColumn("day", F.to_date("ts")).groupBy(*days).agg(F.sum("value").alias("total"), F.count("value").alias("n"))

    run_batches(stream, batch_writer(output, part), checkpoint)
    return stream.sparkSession.read.parquet(output).groupBy(*days).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def newest_groups(log: DataFrame, keys: list[str]) -> DataFrame:
    """All rows that the last batch to touch a key wrote for it. A NULL key is a key."""
    last = log.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("batch").alias("_batch"))
    return log.join(last, _same(keys) & (F.col("batch") == F.col("_batch"))).drop("batch", "_batch", *[f"_{k}" for k in keys])


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])


def recompute_touched(history: str, output: str, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Append the batch to the history, then recompute only the groups it touched from their whole history.

    Used where an aggregate cannot be updated in place (medians, curve analysis). A NULL key is a key. The touched keys of a batch are few
    against the history; the semi join lets Spark broadcast them when their measured size allows it.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{history}/batch={batch}")
        spark = rows.sparkSession
        whole = spark.read.parquet(history).filter(F.col("batch") <= batch).drop("batch")
        touched = spark.read.parquet(f"{history}/batch={batch}").select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        compute(whole.join(touched, _same(keys), "left_semi")).write.mode("overwrite").parquet(f"{output}/batch={batch}")

    return write


def joined_followups(due: DataFrame, results: DataFrame, keys: list[str], days: int, delay: str = "1 day") -> DataFrame:
    """Follow-ups with each result of their key after the due instant and up to the end of day ``days`` after it.

    A stream-stream left outer join with watermarks on both sides: a match comes out at once; a follow-up without any comes out with a
    null ``closed_ts`` when the watermark passes its last day, and its state goes. NULL keys have no results.
    """
    left = due.withWatermark("due_ts", delay).alias("d")
    right = results.withWatermark("ts", delay).alias("r")
    on = (F.col("r.ts") > F.col("d.due_ts")) & (F.col("r.ts") <= F.col("d.due_ts") + F.expr(f"INTERVAL {days + 1} DAYS"))  # bounds the state
    on = on & (F.to_date("r.ts") <= F.date_add(F.to_date("d.due_ts"), days))
    for k in keys:
        on = on & (F.col(f"d.{k}") == F.col(f"r.{k}"))
    return left.join(right, on, "leftOuter").select("d.followup_id", *[F.col(f"d.{k}") for k in keys], "d.due_ts", F.col("r.ts").alias("closed_ts"))


def followup_stream(due: DataFrame, results: DataFrame, keys: list[str], days: int, output: str, checkpoint: str, delay: str = "1 day") -> DataFrame:
    """Status of every follow-up after what is available: ``followup_id, keys, due_ts, status, closed_day``.

    The log of transitions has ``scheduled`` for each follow-up as it arrives, ``completed`` with the first result that a batch brings,
    and ``unanswered`` when its time has passed without one. A follow-up is completed by its earliest result, also where that arrives late;
    without one it stays ``scheduled``. A repeated followup_id is another schedule of its own key and due instant.
    """
    spark, own = due.sparkSession, ["followup_id", *keys, "due_ts"]
    arrived = due.select(*own, F.lit("scheduled").alias("status"), F.lit(None).cast("date").alias("closed_day"))
    run_batches(arrived, batch_writer(f"{output}/arrived"), f"{checkpoint}/arrived")

    def first_results(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(*own).agg(F.min(F.to_date("closed_ts")).alias("closed_day"))
        return found.select(*own, F.when(F.col("closed_day").isNull(), "unanswered").otherwise("completed").alias("status"), "closed_day")

    run_batches(joined_followups(due, results, keys, days, delay), batch_writer(f"{output}/closed", first_results), f"{checkpoint}/closed")
    log = spark.read.parquet(f"{output}/arrived").unionByName(spark.read.parquet(f"{output}/closed")).drop("batch")
    state = log.groupBy(*own).agg(F.min("closed_day").alias("closed_day"))
    return state.withColumn("status", F.when(F.col("closed_day").isNull(), "scheduled").otherwise("completed"))
