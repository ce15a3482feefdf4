"""The upload loop as streams: new files come in, tables follow, saved forecasts are scored.

Every flow writes one folder per micro-batch (`epoch=N`) with overwrite. A batch replayed
after a failure rewrites its own folder, so results stay exactly-once; checkpoints and
stores live in shared storage, and a store belongs to one checkpoint.

Batches write what they add, never what there is in all: a batch reads its own rows, the one
row its predecessor left, and the sums of what it changes. Nothing is lost to a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from shelfcast.operators import marts, monitor, staging
from shelfcast.params import Rules


def _into(store: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/epoch={epoch}")
    return write


def _newest(batch: DataFrame, column: str, store: str, epoch: int) -> tuple[Column, Column]:
    """The greatest value of `column` before this batch, and with it: one row an epoch, made from the one before."""
    spark, own = batch.sparkSession, batch.agg(F.max(column).alias("newest"))
    before = spark.read.schema(own.schema).parquet(f"{store}/newest/epoch={epoch - 1}") if epoch else own.filter(F.lit(False))
    own.unionByName(before).agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{store}/newest/epoch={epoch}")
    return before.agg(F.max("newest")).scalar(), spark.read.schema(own.schema).parquet(f"{store}/newest/epoch={epoch}").scalar()


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_to_end(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything that has arrived, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# --- lines -------------------------------------------------------------------------------------

def ingest_lines(lines: DataFrame, store: str) -> DataStreamWriter:
    """Append raw lines. A file is read by one batch, so a file hash has one newest epoch."""
    return lines.writeStream.foreachBatch(_into(store))


def current_lines(spark: SparkSession, store: str) -> DataFrame:
    """Lines of the newest load of each file, then the latest copy of each line. A plain
    streaming drop would keep the first copy; the rule here is that the last one wins."""
    loaded = spark.read.parquet(store)
    newest = loaded.groupBy("source_hash").agg(F.max("epoch").alias("epoch"))
    return staging.dedup_latest(loaded.join(newest, ["source_hash", "epoch"], "left_semi").drop("epoch"))


def first_copies(lines: DataFrame, delay: str) -> DataFrame:
    """The first-wins variant inside the stream, for consumers that cannot wait."""
    return lines.withWatermark("sold_at", delay).dropDuplicatesWithinWatermark(staging.LINE_KEY)


# --- traffic -------------------------------------------------------------------------------------

def follow_traffic(staged: DataFrame, store: str, delay: str) -> DataStreamWriter:
    """Revenue, quantity and lines that each batch adds to a day and invoice, under `days`.

    Distinct invoices cannot be summed over batches, so the invoice is a key here and is counted by the
    reader. A day closes `delay` after its end, by the time of sale of earlier batches. Lines of closed
    days are late: they count like any other, but stand apart (`late`), and go to `late_lines` whole, as
    corrections for those who published the day. Lines without a time of sale belong to no day.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        before, _ = _newest(batch, "sold_at", store, epoch)
        date = F.to_date("sold_at")
        closed = F.date_add(date, 1).cast("timestamp") <= before - F.expr(f"INTERVAL {delay}")
        sold = batch.filter(staging.retail_sale() & F.col("sold_at").isNotNull()).select(
            date.alias("date"), "invoice_id", "sold_at", "line_revenue", "quantity", F.coalesce(closed, F.lit(False)).alias("late"))
        days = sold.groupBy("late", "date", "invoice_id").agg(
            F.sum("line_revenue").alias("revenue"), F.sum("quantity").alias("quantity"), marts.rows().alias("n_lines"))
        days.write.mode("overwrite").partitionBy("late").parquet(f"{store}/days/epoch={epoch}")
        sold.filter("late").drop("late").write.mode("overwrite").parquet(f"{store}/late_lines/epoch={epoch}")
        batch.unpersist()

    return staged.writeStream.foreachBatch(step)


DAYS = "date date, invoice_id string, revenue double, quantity double, n_lines long, epoch long, late boolean"


def _days(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(DAYS).parquet(f"{store}/days")


def current_traffic(spark: SparkSession, store: str) -> DataFrame:
    """Daily traffic of all lines so far, late ones included."""
    invoices = _days(spark, store).groupBy("date", "invoice_id").agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"))
    return invoices.groupBy("date").agg(
        marts.rows().alias("n_invoices"), F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"))


def late_traffic(spark: SparkSession, store: str) -> DataFrame:
    """Lines and revenue of each day, those that came in time and those that came after it was closed."""
    late = F.col("late")
    part = lambda value, which: F.coalesce(F.sum(F.when(which, F.col(value))), F.lit(0))
    return _days(spark, store).groupBy("date").agg(
        part("n_lines", ~late).alias("kept_lines"), part("n_lines", late).alias("late_lines"),
        part("revenue", ~late).alias("kept_revenue"), part("revenue", late).alias("late_revenue"))


# --- saved forecasts -------------------------------------------------------------------------------

SUMS = "run_id string, unique_id string, actual double, epoch long, week_start date"
RUNS = "run_id string, kind string, week_start timestamp, model string, wmape double, bias double, " \
       "actual_total double, forecast_total double, n_series long"


def follow_forecasts(actuals: DataFrame, snapshots: DataFrame, store: str, verdicts: str, reference_wmape: Column,
                     rules: Rules) -> DataStreamWriter:
    """With each batch of new days: score the saved weeks that it completes or changes, run the
    drift rule, and keep the verdicts of that moment.

    A batch adds its own sales to the saved weeks they fall in (`sums`, a folder per week) and then
    reads the folders of the weeks it touched, or that its last day ends. Weeks scored before are
    not read again, unless a day of theirs comes late. Scores are one row per saved run.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        before, last_day = _newest(batch, "ds", store, epoch)
        start = F.to_date("week_start")
        span = batch.agg(F.min("ds").alias("first"), F.max("ds").alias("last")).first()
        near = snapshots.filter((start <= F.lit(span["last"])) & (F.date_add(start, 6) >= F.lit(span["first"])))
        weeks = near.select("run_id", "unique_id", start.alias("week_start")).distinct()
        added = monitor.sold_in_weeks(near, batch).join(weeks, ["run_id", "unique_id"])
        added.write.mode("overwrite").partitionBy("week_start").parquet(f"{store}/sums/epoch={epoch}")
        batch.unpersist()

        sums = spark.read.schema(SUMS).parquet(f"{store}/sums").filter(F.col("epoch") <= epoch)
        # Names of folders: as many weeks as the days of the batch fall in.
        touched = [r[0] for r in sums.filter(F.col("epoch") == epoch).select("week_start").distinct().collect()]
        ended = F.coalesce(F.date_add("week_start", 6) > before, F.lit(True))
        due = sums.filter((F.date_add("week_start", 6) <= last_day) & (F.col("week_start").isin(touched) | ended))
        actual = due.groupBy("run_id", "unique_id").agg(F.sum("actual").alias("actual"))
        scored = monitor.score_runs(snapshots, actual)
        if epoch:
            earlier = spark.read.schema(RUNS).parquet(f"{store}/runs/epoch={epoch - 1}")
            # One row per saved run; those scored anew replace their earlier scores.
            scored = earlier.join(scored.select("run_id"), "run_id", "left_anti").unionByName(scored)
        scored.write.mode("overwrite").parquet(f"{store}/runs/epoch={epoch}")
        runs = spark.read.schema(RUNS).parquet(f"{store}/runs/epoch={epoch}")
        monitor.drift(runs, reference_wmape, rules).write.mode("overwrite").parquet(f"{verdicts}/epoch={epoch}")

    return actuals.writeStream.foreachBatch(step)


def current_verdicts(spark: SparkSession, verdicts: str) -> DataFrame:
    """Flags as of the newest batch that could score anything."""
    flags = spark.read.parquet(verdicts)
    newest = flags.agg(F.max("epoch")).scalar()
    return flags.filter(F.col("epoch") == newest).drop("epoch")
