import gzip

import pytest
from pyspark.sql import functions as F

from shelfcast.functions.tables import placed
from shelfcast.sources import ingest, sinks

HEADERS = [h.title() for h in ingest.EXPORT_HEADERS]
VALUES = dict(
    period_month="11-2023", invoice_id="Q-17", branch="east", seller="Ada", note=None, sold_at="2023-11-09 08:05:30", sku="000413",
    barcode="5012", product_name="Oats", brand=None, category_path="Pantry>>Oats>>Rolled", quantity="6", unit_price="4.5", unit_cost="2.25")
ROW = [VALUES.get(field, "0") for field in ingest.CANONICAL_FIELDS]


def _text(spark, rows, headers):
    return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in headers))


def test_header_ignores_case_and_spaces():
    assert ingest.normalized_header("  Giá  bán/SP ") == "giá bán/sp"


def test_every_export_header_is_known():
    assert list(ingest.map_headers(HEADERS).values()) == list(ingest.CANONICAL_FIELDS)


def test_ids_keep_leading_zeros(spark):
    lines = ingest.cast_strict(ingest.to_canonical(_text(spark, [ROW], HEADERS)))
    row = lines.first()
    assert row["sku"] == "000413" and row["quantity"] == 6.0
    assert lines.columns == list(ingest.CANONICAL_FIELDS)


@pytest.mark.parametrize("field", sorted(ingest.REQUIRED_FIELDS))
def test_each_missing_column_is_named(spark, field):
    keep = [i for i, name in enumerate(ingest.CANONICAL_FIELDS) if name != field]
    with pytest.raises(ValueError, match=field):
        ingest.to_canonical(_text(spark, [[ROW[i] for i in keep]], [HEADERS[i] for i in keep]))


def test_every_synonym_leads_to_its_field(spark):
    for header, field in ingest.SYNONYMS.items():
        assert ingest.map_headers([header.upper()]) == {header.upper(): field}


def test_optional_columns_may_be_absent(spark):
    keep = [i for i, name in enumerate(ingest.CANONICAL_FIELDS) if name in ingest.REQUIRED_FIELDS]
    row = ingest.cast_strict(ingest.to_canonical(_text(spark, [[ROW[i] for i in keep]], [HEADERS[i] for i in keep]))).first()
    assert (row["sku"], row["quantity"], row["month_revenue"], row["brand"]) == ("000413", 6.0, None, None)


def test_unknown_headers_and_missing_fields():
    mapping = ingest.map_headers(["no such column", "SL"])
    assert mapping["no such column"] is None and mapping["SL"] == "quantity"
    assert "unit_price" in ingest.missing_fields(mapping)


def test_first_column_wins(spark):
    export = _text(spark, [ROW + ["99"]], HEADERS + ["Số lượng"])
    assert ingest.cast_strict(ingest.to_canonical(export)).first()["quantity"] == 6.0


def test_bad_values_raise_or_are_set_aside(spark):
    bad = list(ROW)
    bad[list(ingest.CANONICAL_FIELDS).index("quantity")] = "six"
    lines = ingest.to_canonical(_text(spark, [ROW, bad], HEADERS))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ingest.cast_strict(lines).collect()
    good, aside = ingest.cast_lenient(lines)
    assert good.count() == 1 and aside.first()["quantity"] == "six"


def test_files_are_hashed_and_reloaded_once(spark, tmp_path):
    import hashlib

    path = tmp_path / "autumn.csv"
    path.write_text(",".join(f'"{h}"' for h in HEADERS) + "\n" + ",".join(f'"{v or ""}"' for v in ROW) + "\n")
    batch = ingest.read_export(spark, str(path))
    row = batch.first()
    assert row["source_hash"] == hashlib.sha256(path.read_bytes()).hexdigest()
    assert row["source_file"] == "autumn.csv" and row["sku"] == "000413"
    assert ingest.append_idempotent(batch, ingest.read_export(spark, str(path))).count() == 1


def test_guard_refuses_names(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "seller string, n int")
    with pytest.raises(sinks.SensitiveColumns, match="seller"):
        sinks.export_tables({"fine": df.drop("seller"), "bad": df}, str(tmp_path))
    assert not list(tmp_path.iterdir())
    sinks.export_tables({"fine": df.drop("seller")}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "fine")).count() == 1


def _csv(folder, name, columns, rows, opened=open):
    path = folder / name
    with opened(path, "wt", encoding="utf-8") as out:
        out.write(",".join(columns) + "\n" + "".join(",".join(r) + "\n" for r in rows))
    return str(path)


def _headers(*fields):
    known = {field: header for header, field in ingest.EXPORT_HEADERS.items()}
    return [known[f] for f in fields]


def test_files_of_different_headers_are_read_by_their_own(spark, tmp_path):
    required = list(ingest.REQUIRED_FIELDS)
    values = {**VALUES, "quantity": "2", "unit_price": "10"}
    row = [[values[f] for f in required]]
    swapped = [{"quantity": "unit_price", "unit_price": "quantity"}.get(f, f) for f in required]
    paths = [
        _csv(tmp_path, "a.csv", _headers(*required), row),
        _csv(tmp_path, "b b.csv", _headers(*swapped), [[values[f] for f in swapped]]),
        _csv(tmp_path, "c.csv.gz", ["\ufeff" + h.upper() for h in _headers(*required[:1])] + _headers(*required[1:]) + ["Lạ", "SL bán"],
             [row[0] + ["x", "99"]], gzip.open),
        _csv(tmp_path, "d.csv", ["Mã hóa đơn", "Ngày bán", "Mã SP", "Tên sản phẩm", "Danh mục", "Số lượng", "Đơn giá", "Giá vốn"], row)]
    lines = ingest.read_export(spark, paths).orderBy("source_file").collect()
    assert [r["source_file"] for r in lines] == ["a.csv", "b b.csv", "c.csv.gz", "d.csv"]
    assert {(r["sku"], r["quantity"], r["unit_price"], r["invoice_id"]) for r in lines} == {("000413", 2.0, 10.0, "Q-17")}
    assert len(ingest.header_groups(spark, paths)) == 3  # the last has the fields of the first
    assert len(ingest.header_groups(spark, [paths[0], _csv(tmp_path, "e.csv", [h.upper() for h in _headers(*required)], row)])) == 1


def test_the_file_without_a_column_or_header_is_named(spark, tmp_path):
    good = _csv(tmp_path, "good.csv", _headers(*ingest.REQUIRED_FIELDS), [])
    bad = _csv(tmp_path, "bad.csv", _headers(*ingest.REQUIRED_FIELDS[:-1]), [])
    (tmp_path / "empty.csv").touch()
    with pytest.raises(ValueError, match=r"bad\.csv.*unit_cost"):
        ingest.read_export(spark, [good, bad])
    with pytest.raises(ValueError, match=r"empty\.csv"):
        ingest.read_export(spark, [good, str(tmp_path / "empty.csv")])
    assert ingest.read_export(spark, good).count() == 0


def test_the_store_replaces_only_the_folders_of_a_file(spark, tmp_path):
    rows = [("x", "2024-01-05 10:00:00", 1.0), ("x", "2024-02-05 10:00:00", 2.0), ("x", None, 3.0), ("y", "2024-01-09 10:00:00", 4.0)]
    batch = spark.createDataFrame(rows, "source_hash string, sold_at string, quantity double").withColumn("sold_at", F.to_timestamp("sold_at"))
    folder = str(tmp_path / "store")
    ingest.store(batch, folder)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    before = files()
    again = ingest.store(batch.filter("source_hash = 'x'"), folder)
    assert again.count() == 4 and again.agg(F.sum("quantity")).first()[0] == 10.0
    kept = [p for p, at in files().items() if before.get(p) == at]
    assert [p.parent.parent.name for p in kept] == ["source_hash=y"]
    january = ingest.stored(spark, folder).filter("sold_month = '2024-01'")
    assert january.count() == 2 and "PartitionFilters: [isnotnull(sold_month" in january._jdf.queryExecution().toString()


def test_a_machines_own_folder_is_refused_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace
    cluster = SimpleNamespace(_jsc=spark._jsc, conf=spark.conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    for folder in ("/tmp/store", "file:/tmp/store"):
        with pytest.raises(RuntimeError, match="one machine"):
            placed(cluster, folder)
    assert placed(cluster, "s3a://bucket/store/") == "s3a://bucket/store"
    assert placed(spark, "/tmp/store") == "/tmp/store"


def test_the_folder_the_cluster_shares_is_accepted(spark, tmp_path):
    from types import SimpleNamespace
    conf = {"spark.checkpoint.dir": "file:///mnt/shared"}
    cluster = SimpleNamespace(_jsc=spark._jsc, conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    for folder in ("file:///mnt/shared/app/store", "file:/mnt/shared/app/store/", "/mnt/shared", "/mnt/shared//app"):
        assert placed(cluster, folder) == folder.rstrip("/")
    for folder in ("file:///mnt/shared-not", "/mnt", "/mnt/shared/../store", "file:/tmp/store"):
        with pytest.raises(RuntimeError, match="one machine"):
            placed(cluster, folder)
