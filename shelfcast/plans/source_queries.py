"""Queries for entry and export: the driver lines dressed as exports of other programs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from shelfcast.functions.tables import shared_folder, written
from shelfcast.operators import marts
from shelfcast.plans.catalog import query
from shelfcast.plans.layers import Layers
from shelfcast.sources import ingest, sinks

SYNONYM_HEADERS = {
    "invoice_id": "Mã hóa đơn", "sold_at": "Ngày bán", "sku": "Mã SP", "product_name": "Tên sản phẩm",
    "category_path": "Danh mục", "quantity": "Số lượng", "unit_price": "Đơn giá", "unit_cost": "Giá vốn",
}
LINE = "invoice_id:s sold_at:T sku:s product_name:s category_path:s quantity:d unit_price:d unit_cost:d"


@query(LINE + " brand:s month_revenue:d")
def src_header_map(t: Layers) -> DataFrame:
    """Eight columns under the headers of another program, plus one nobody knows."""
    export = t.raw.select(
        *[F.col(name).cast("string").alias(header) for name, header in SYNONYM_HEADERS.items()],
        F.col("source_file").alias("Cột lạ"))
    return ingest.cast_strict(ingest.to_canonical(export))


@query(LINE + " period_month:s seller:s note:s brand:s")
def src_read_canonical(t: Layers) -> DataFrame:
    """All columns as text under the export's headers, written with odd case and spacing."""
    messy = [header.upper().replace(" ", "  ") + " " for header in ingest.EXPORT_HEADERS]
    export = t.raw.select(*[
        F.col(name).cast("string").alias(header) for name, header in zip(ingest.CANONICAL_FIELDS, messy)])
    return ingest.cast_strict(ingest.to_canonical(export))


def _scratch(t: Layers, name: str) -> str:
    return f"{shared_folder(t.spark)}/shelfcast/{t.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"


@query(LINE + " branch:s seller:s")
def src_read_mixed_headers(t: Layers) -> DataFrame:
    """All lines as CSV files of four programs, read back together: two columns swapped, the whole
    order reversed, and one with other headers and fewer columns."""
    names = {field: header for header, field in ingest.EXPORT_HEADERS.items()}
    swapped = {"quantity": "unit_price", "unit_price": "quantity"}
    orders = [
        [(f, names[f]) for f in names], [(swapped.get(f, f), names[swapped.get(f, f)]) for f in names],
        [(f, names[f].upper()) for f in reversed(names)], list(SYNONYM_HEADERS.items())]
    folder = _scratch(t, "exports")
    for i, columns in enumerate(orders):
        part = t.raw.filter(F.pmod(F.crc32("invoice_id"), F.lit(len(orders))) == i)
        part.select(*[F.col(f).cast("string").alias(h) for f, h in columns]).write.option("header", True).csv(f"{folder}/{i}")
    return ingest.read_export(t.spark, [f"{folder}/{i}" for i in range(len(orders))])


@query("source_hash:s sold_month:s n_lines:i quantity:d rewritten:b")
def src_store_reload(t: Layers) -> DataFrame:
    """All lines in the partitioned store, then one file again: only its folders are written anew."""
    folder = _scratch(t, "store")
    ingest.store(t.raw.drop("loaded_at"), folder)
    files = F.col("_metadata.file_path")
    # Written, so that it tells the files of before from those of after.
    before = written(t.spark.read.parquet(folder).select(files.alias("path")).distinct(), "stored-files")
    again = ingest.store(t.raw.filter(F.col("source_hash") == "b2").drop("loaded_at"), folder)
    kept = again.withColumn("path", files).join(before.withColumn("kept", F.lit(True)), "path", "left")
    return kept.groupBy("source_hash", "sold_month").agg(
        marts.rows().alias("n_lines"), F.sum("quantity").alias("quantity"), F.bool_or(F.col("kept").isNull()).alias("rewritten"))


@query("status:s n_lines:i quantity:d")
def src_coerce_types(t: Layers) -> DataFrame:
    """Text lines, some with a broken quantity: the good ones are cast, the others set aside."""
    broken = F.col("invoice_id").endswith("77")
    text = t.raw.select(*[F.col(c).cast("string").alias(c) for c in ingest.CANONICAL_FIELDS]).withColumn(
        "quantity", F.when(broken, "n/a").otherwise(F.col("quantity")))
    good, quarantined = ingest.cast_lenient(text)
    summary = lambda df, status, qty: df.agg(
        F.lit(status).alias("status"), marts.rows().alias("n_lines"), qty.alias("quantity"))
    return summary(good, "good", F.sum("quantity")).unionByName(
        summary(quarantined, "quarantined", F.sum(F.col("quantity").try_cast("double"))))


@query("source_hash:s loaded_at:T n_lines:i quantity:d")
def src_idempotent_load(t: Layers) -> DataFrame:
    """Load the second file again a day later: its lines are replaced, not doubled."""
    again = t.raw.filter(F.col("source_hash") == "b2").withColumn("loaded_at", F.expr("loaded_at + INTERVAL 1 DAY"))
    loaded = ingest.append_idempotent(t.raw, again)
    return loaded.groupBy("source_hash", "loaded_at").agg(
        marts.rows().alias("n_lines"), F.sum("quantity").alias("quantity"))


@query("year_month:s channel:s revenue:d n_invoices:i")
def sink_pii_guard(t: Layers) -> DataFrame:
    """Publish the monthly table through the guard and read the file back."""
    folder = _scratch(t, "published")
    sinks.export_tables({"mart_monthly": marts.monthly(t.staged, t.calendar)}, folder)
    return t.spark.read.parquet(f"{folder}/mart_monthly")
