"""The streaming flows over the driver lines, delivered as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from shelfcast.functions.tables import shared_folder
from shelfcast.operators import evaluate, monitor
from shelfcast.params import SCOPE_ALL
from shelfcast.plans.catalog import contest, query
from shelfcast.plans.layers import Layers
from shelfcast.streaming import flows


def _folder(t: Layers, name: str) -> str:
    return f"{shared_folder(t.spark)}/shelfcast/{t.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"


@query("invoice_id:s sold_at:T sku:s loaded_at:T quantity:d unit_price:d unit_cost:d")
def stream_ingest_dedup(t: Layers) -> DataFrame:
    """Each writing task delivers one file, which carries its own hash."""
    root = _folder(t, "stream-lines")
    files = t.raw.withColumn("source_hash", F.concat_ws("-", "source_hash", F.spark_partition_id()))
    files.write.parquet(f"{root}/in")
    lines = flows.file_stream(t.spark, f"{root}/in", files.schema, files_per_batch=3)
    flows.run_to_end(flows.ingest_lines(lines, f"{root}/store"), f"{root}/checkpoint")
    return flows.current_lines(t.spark, f"{root}/store")


TRAFFIC = ("invoice_id", "sold_at", "txn_channel", "is_return", "line_revenue", "quantity")


def _delivered(lines: DataFrame, folder: str) -> int:
    """Lines as files by time of sale, in one job; as many files as a shuffle has partitions."""
    files = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.select(*TRAFFIC).repartitionByRange(files, "sold_at").write.mode("append").parquet(folder)
    return files


@query("date:t n_invoices:i revenue:d quantity:d")
def stream_daily_traffic(t: Layers) -> DataFrame:
    """All lines, in about four batches, in whatever order the files are listed."""
    root = _folder(t, "stream-traffic")
    files = _delivered(t.staged, f"{root}/in")
    staged = flows.file_stream(t.spark, f"{root}/in", t.staged.select(*TRAFFIC).schema, files_per_batch=max(1, files // 4))
    flows.run_to_end(flows.follow_traffic(staged, f"{root}/store", "92 days"), f"{root}/checkpoint")
    return flows.current_traffic(t.spark, f"{root}/store")


@query("date:t kept_lines:i late_lines:i kept_revenue:d late_revenue:d")
def stream_late_lines(t: Layers) -> DataFrame:
    """Invoices that end in 7 come in after all others: on days closed by then they are late, and still counted."""
    root = _folder(t, "stream-late")
    straggling = F.coalesce(F.col("invoice_id").endswith("7"), F.lit(False))
    for lines in (t.staged.filter(~straggling), t.staged.filter(straggling)):
        files = _delivered(lines, f"{root}/in")
        staged = flows.file_stream(t.spark, f"{root}/in", t.staged.select(*TRAFFIC).schema, files_per_batch=files)
        flows.run_to_end(flows.follow_traffic(staged, f"{root}/store", "92 days"), f"{root}/checkpoint")
    return flows.late_traffic(t.spark, f"{root}/store")


@contest("run_id:s week_start:t wmape:r tracking_signal:r over_limit:b biased:b flagged:b is_latest:b")
def stream_reconcile(t: Layers) -> DataFrame:
    """The hold-out days arrive in files; the last verdicts must equal the batch ones."""
    root = _folder(t, "stream-reconcile")
    days = (
        t.series.filter(F.col("ds") > F.lit(t.holdout_start)).select("unique_id", "ds", "y_raw", "is_closed"))
    days.repartitionByRange("ds").write.parquet(f"{root}/in")
    reference = evaluate.metrics(t.weeks).filter(
        (F.col("scope") == SCOPE_ALL) & (F.col("model") == t.champion)).agg(F.max("WMAPE")).first()[0]
    actuals = flows.file_stream(t.spark, f"{root}/in", days.schema, files_per_batch=1)
    snapshots = monitor.backfill(t.weeks, t.champion)
    flows.run_to_end(
        flows.follow_forecasts(actuals, snapshots, f"{root}/store", f"{root}/verdicts", F.lit(reference), t.rules),
        f"{root}/checkpoint")
    return flows.current_verdicts(t.spark, f"{root}/verdicts")
