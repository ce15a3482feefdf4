"""Entry of sales exports: header mapping, typing, fingerprints, idempotent append."""

from __future__ import annotations

import csv
import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shelfcast.functions.tables import placed, written

# --- fixed values: canonical columns of a sales line and their types -------------------
CANONICAL_FIELDS = {
    "period_month": "string", "month_gross_amount": "double", "month_discount": "double",
    "month_revenue": "double", "month_cogs": "double", "month_gross_profit": "double",
    "invoice_id": "string", "branch": "string", "seller": "string", "note": "string",
    "sold_at": "timestamp", "invoice_gross_amount": "double", "invoice_discount": "double",
    "invoice_revenue": "double", "invoice_cogs": "double", "invoice_gross_profit": "double",
    "sku": "string", "barcode": "string", "product_name": "string", "brand": "string",
    "category_path": "string", "quantity": "double", "unit_price": "double",
    "unit_cost": "double", "unit_profit": "double", "line_profit": "double",
}

# --- fixed values: headers of the export and the field each stands for ------------------
EXPORT_HEADERS = {
    "thời gian": "period_month",
    "tổng tiền hàng (theo thời gian)": "month_gross_amount",
    "giảm giá (theo thời gian)": "month_discount",
    "doanh thu (theo thời gian)": "month_revenue",
    "tổng giá vốn (theo thời gian)": "month_cogs",
    "lợi nhuận gộp (theo thời gian)": "month_gross_profit",
    "mã giao dịch": "invoice_id",
    "chi nhánh": "branch",
    "người bán": "seller",
    "ghi chú": "note",
    "thời gian (theo giao dịch)": "sold_at",
    "tổng tiền hàng (theo giao dịch)": "invoice_gross_amount",
    "giảm giá (theo giao dịch)": "invoice_discount",
    "doanh thu (theo giao dịch)": "invoice_revenue",
    "tổng giá vốn (theo giao dịch)": "invoice_cogs",
    "lợi nhuận gộp (theo giao dịch)": "invoice_gross_profit",
    "mã hàng": "sku",
    "mã vạch": "barcode",
    "tên hàng": "product_name",
    "thương hiệu": "brand",
    "nhóm hàng(3 cấp)": "category_path",
    "sl": "quantity",
    "giá bán/sp": "unit_price",
    "giá vốn/sp": "unit_cost",
    "lợi nhuận/sp": "unit_profit",
    "tổng lợi nhuận hàng hóa": "line_profit",
}

# --- fixed values: other headers seen in files of other point-of-sale programs ---------
SYNONYMS = {
    "mã hóa đơn": "invoice_id",
    "mã hoá đơn": "invoice_id",
    "số hóa đơn": "invoice_id",
    "mã hđ": "invoice_id",
    "ngày bán": "sold_at",
    "thời gian bán": "sold_at",
    "ngày giờ": "sold_at",
    "mã sản phẩm": "sku",
    "mã sp": "sku",
    "sku": "sku",
    "tên sản phẩm": "product_name",
    "tên sp": "product_name",
    "nhóm hàng": "category_path",
    "danh mục": "category_path",
    "ngành hàng": "category_path",
    "số lượng": "quantity",
    "sl bán": "quantity",
    "qty": "quantity",
    "đơn giá": "unit_price",
    "giá bán": "unit_price",
    "giá vốn": "unit_cost",
    "nhân viên": "seller",
    "nhân viên bán": "seller",
    "thu ngân": "seller",
    "cửa hàng": "branch",
    "barcode": "barcode",
}

# --- fixed values: line fields without which nothing can be computed --------------------
REQUIRED_FIELDS = (
    "invoice_id", "sold_at", "sku", "product_name", "category_path", "quantity",
    "unit_price", "unit_cost",
)

# A header ends within so many bytes; files are opened so many at a time to read theirs.
HEADER_BYTES, OPENED_AT_ONCE = 65536, 32


def normalized_header(header: str) -> str:
    return " ".join(re.split(r"\s+", str(header).strip())).lower()


def map_headers(headers: list[str]) -> dict[str, str | None]:
    known = {**SYNONYMS, **EXPORT_HEADERS}
    return {h: known.get(normalized_header(h)) for h in headers}


def missing_fields(mapping: dict[str, str | None]) -> list[str]:
    found = set(mapping.values())
    return [name for name in REQUIRED_FIELDS if name not in found]


def to_canonical(export: DataFrame, mapping: dict[str, str | None] | None = None,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Select the canonical columns of an export; the first column wins on a double target.

    Optional columns that the export lacks become null. `keep` names extra columns to carry.
    """
    mapping = mapping or map_headers([c for c in export.columns if c not in keep])
    missing = missing_fields(mapping)
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    source: dict[str, str] = {}
    for header in export.columns:
        target = mapping.get(header)
        if target and target not in source:
            source[target] = header
    canonical = [
        (F.col(f"`{source[name]}`") if name in source else F.lit(None).cast("string")).alias(name)
        for name in CANONICAL_FIELDS
    ]
    return export.select(*canonical, *keep)


def cast_strict(lines: DataFrame) -> DataFrame:
    """Cast every canonical column; ANSI casts raise on a bad value."""
    return lines.select(*[
        F.col(name).cast(CANONICAL_FIELDS[name]) if name in CANONICAL_FIELDS else F.col(name)
        for name in lines.columns
    ])


def cast_lenient(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split lines into (castable and cast, quarantined as text).

    A row is quarantined when a non-empty value of a typed column does not parse.
    """
    typed = [c for c in lines.columns if CANONICAL_FIELDS.get(c, "string") != "string"]
    bad = F.lit(False)
    for name in typed:
        text = F.col(name).cast("string")
        bad = bad | (text.isNotNull() & text.try_cast(CANONICAL_FIELDS[name]).isNull())
    return cast_strict(lines.filter(~bad)), lines.filter(bad)


def first_lines(spark: SparkSession, paths: str | list[str]) -> dict[str, str]:
    """The first line of every file, by path, compressed files included.

    One open and one read of `HEADER_BYTES` a file, some at a time, through Spark's file systems: a
    task would have to scan whole blocks for it. The driver holds a line per file beside the list of
    files that any scan keeps there.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first(uri: str) -> tuple[str, str]:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
        opened = path.getFileSystem(conf).open(path)
        try:
            codec = codecs.getCodec(path)
            head = (codec.createInputStream(opened) if codec else opened).readNBytes(HEADER_BYTES)
        finally:
            opened.close()
        text = bytes(head).decode("utf-8", errors="ignore").removeprefix("\ufeff")
        return path.toString(), re.split(r"\r\n|\n|\r", text, maxsplit=1)[0]

    with ThreadPoolExecutor(OPENED_AT_ONCE) as pool:
        return dict(pool.map(first, spark.read.text(paths).inputFiles()))


def header_groups(spark: SparkSession, paths: str | list[str],
                  mapping: dict[str, str | None] | None = None) -> dict[tuple[str | None, ...], list[str]]:
    """Files by the field that each of their columns stands for, in order; see `read_export`."""
    groups: dict[tuple[str | None, ...], list[str]] = {}
    for path, line in sorted(first_lines(spark, paths).items()):
        headers = next(csv.reader([line]), [])
        known = map_headers(headers) if mapping is None else mapping
        fields = tuple(known.get(h) for h in headers)
        missing = missing_fields(dict(enumerate(fields)))
        if missing:
            raise ValueError(f"{path}: required columns are missing: {missing}")
        groups.setdefault(fields, []).append(path)
    return groups


def _read_group(spark: SparkSession, fields: tuple[str | None, ...], paths: list[str]) -> DataFrame:
    """The canonical columns, as text, of files whose columns stand for `fields`; the first of two wins."""
    schema = ", ".join(f"_c{i} string" for i in range(len(fields)))
    text = spark.read.schema(schema).option("header", True).csv(paths)
    at = {field: i for i, field in reversed(list(enumerate(fields))) if field}
    return text.select(
        *[(F.col(f"_c{at[name]}") if name in at else F.lit(None).cast("string")).alias(name) for name in CANONICAL_FIELDS],
        F.col("_metadata.file_path").alias("source_path"))


def read_export(spark: SparkSession, paths: str | list[str],
                mapping: dict[str, str | None] | None = None) -> DataFrame:
    """Read CSV exports as text (ids keep leading zeros), map, cast, and tag each line with
    its file name and the SHA-256 of the file's bytes.

    Every file has its own header: files whose columns stand for the same fields in the same order
    are one scan, and the scans are united by name. A file that lacks a required column, or has no
    header at all, raises an error that names it before any line is read. `mapping` (header to
    field) replaces the known headers for all files.
    """
    groups = header_groups(spark, paths, mapping)
    if not groups:
        raise ValueError(f"no files in {paths}")
    text = reduce(DataFrame.unionByName, [_read_group(spark, fields, files) for fields, files in groups.items()])
    lines = cast_strict(text)
    # One row per file. Written first, so that the join sees its size and leaves the lines in place.
    fingerprints = written(file_fingerprints(spark, paths), "fingerprints")
    return (
        lines.join(fingerprints, "source_path")
        .withColumn("loaded_at", F.current_timestamp())
        .drop("source_path")
    )


def file_fingerprints(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: path, name, SHA-256 of the content. Files are hashed in tasks."""
    return (
        spark.read.format("binaryFile").load(paths)
        .select(
            F.col("_metadata.file_path").alias("source_path"),
            F.element_at(F.split("path", "/"), -1).alias("source_file"),
            F.sha2("content", 256).alias("source_hash"))
    )


def append_idempotent(raw: DataFrame, batch: DataFrame) -> DataFrame:
    """Replace every earlier load of the batch's files by the batch itself.

    The list of files is written first: raw lines are only filtered, not shuffled by file.
    """
    reloaded = written(batch.select("source_hash").distinct(), "reloaded")
    return raw.join(reloaded, "source_hash", "left_anti").select(*raw.columns).unionByName(batch)


def store(batch: DataFrame, folder: str) -> DataFrame:
    """Load a batch of lines into the raw store at `folder` and return a reader of the whole store.

    The store has a folder per file and month of sale (`source_hash`, `sold_month`); lines without a
    time of sale have a folder, too. Writing replaces the folders of the batch and touches no other,
    so loading a file again does not read, move or double anything, and a reader that filters by
    month or file opens its folders only. Lines of a month are spread over the tasks that hold them.
    """
    spark = batch.sparkSession
    placed(spark, folder)
    monthly = batch.withColumn("sold_month", F.date_format("sold_at", "yyyy-MM"))
    # Equal bytes are equal lines: a file that was loaded before has the same folders again.
    monthly.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_hash", "sold_month").parquet(folder)
    return stored(spark, folder, monthly.schema)


def stored(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """A reader of the store: the columns of its batches and `sold_month`."""
    reader = spark.read.schema(schema) if schema else spark.read
    found = reader.parquet(folder)
    return found.withColumn("sold_month", F.col("sold_month").cast("string")).withColumn("source_hash", F.col("source_hash").cast("string"))
