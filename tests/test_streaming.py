from datetime import date, datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from shelfcast.operators import monitor
from shelfcast.params import Rules
from shelfcast.streaming import flows

LINES = "invoice_id string, sold_at timestamp, sku string, loaded_at timestamp, source_hash string, " \
        "unit_price double, quantity double, unit_cost double"
DAY = datetime(2026, 1, 1, 9)


def _line(n, load, qty, file):
    return (f"i{n}", DAY, "s", DAY + timedelta(days=load), file, 1.0, float(qty), 1.0)


def test_latest_load_wins_whatever_the_arrival_order(spark, tmp_path):
    inbox, store = str(tmp_path / "in"), str(tmp_path / "store")
    deliver = lambda rows: spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(inbox)

    def drain():
        lines = flows.file_stream(spark, inbox, LINES, files_per_batch=1)
        flows.run_to_end(flows.ingest_lines(lines, store), str(tmp_path / "cp"))
        return {r["invoice_id"]: r["quantity"] for r in flows.current_lines(spark, store).collect()}

    deliver([_line(1, 5, 50, "new"), _line(2, 5, 60, "new")])
    deliver([_line(1, 1, 10, "old"), _line(3, 1, 30, "old")])
    assert drain() == {"i1": 50.0, "i2": 60.0, "i3": 30.0}
    # The same file again, with one line fewer: its earlier load is replaced.
    deliver([_line(3, 1, 31, "old")])
    assert drain() == {"i1": 50.0, "i2": 60.0, "i3": 31.0}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    write = flows._into(str(tmp_path / "store"))
    batch = spark.createDataFrame([_line(1, 1, 10, "a")], LINES)
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1


def test_first_copies_drop_later_ones(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([_line(1, 1, 10, "a"), _line(1, 1, 10, "a"), _line(2, 1, 5, "a")], LINES).coalesce(1).write.parquet(inbox)
    kept = flows.first_copies(flows.file_stream(spark, inbox, LINES), "30 days")
    flows.run_to_end(kept.writeStream.format("parquet").option("path", out), str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == 2


SOLD = "invoice_id string, sold_at timestamp, txn_channel string, is_return boolean, line_revenue double, quantity double"


def _sold(n, day, revenue=1.0, channel="retail"):
    return (f"i{n}", DAY + timedelta(days=day) if day is not None else None, channel, False, revenue, 1.0)


def test_late_lines_are_counted_and_stand_apart(spark, tmp_path):
    inbox, store = str(tmp_path / "in"), str(tmp_path / "store")

    def arrive(rows):
        spark.createDataFrame(rows, SOLD).coalesce(1).write.mode("append").parquet(inbox)
        lines = flows.file_stream(spark, inbox, SOLD)
        flows.run_to_end(flows.follow_traffic(lines, store, "10 days"), str(tmp_path / "cp"))
        return {r["date"].day: (r["kept_lines"], r["late_lines"], r["late_revenue"]) for r in flows.late_traffic(spark, store).collect()}

    # Nothing was seen before the first batch, so nothing in it is late, whatever its order.
    assert arrive([_sold(1, 0), _sold(2, 20), _sold(3, None), _sold(4, 0, channel="wholesale")]) == {1: (1, 0, 0.0), 21: (1, 0, 0.0)}
    # Day 10 ended 10 days before the newest line, 9:00 on the 21st; day 11 did not.
    got = arrive([_sold(1, 0, 4.0), _sold(5, 0, 8.0), _sold(6, 9), _sold(7, 10)])
    assert got == {1: (1, 2, 12.0), 10: (0, 1, 1.0), 11: (1, 0, 0.0), 21: (1, 0, 0.0)}
    traffic = {r["date"].day: (r["n_invoices"], r["revenue"]) for r in flows.current_traffic(spark, store).collect()}
    assert traffic == {1: (2, 13.0), 10: (1, 1.0), 11: (1, 1.0), 21: (1, 1.0)}
    assert sorted(r["invoice_id"] for r in spark.read.parquet(store + "/late_lines").collect()) == ["i1", "i5", "i6"]


SNAPSHOTS = ", ".join(f"{c} {kind}" for c, kind in monitor.SNAPSHOT_COLUMNS.items())
DAYS = "unique_id string, ds date, y_raw double, is_closed boolean"


def test_saved_weeks_are_scored_batch_by_batch_as_all_at_once(spark, tmp_path):
    inbox, store, verdicts = (str(tmp_path / n) for n in ("in", "store", "verdicts"))
    first = date(2026, 1, 5)
    weeks = [first + timedelta(days=7 * k) for k in range(4)]
    snapshots = spark.createDataFrame(
        [(f"r{k}", "replay", None, None, datetime.combine(w, datetime.min.time()), "m", s, 10.0 + k, None)
         for k, w in enumerate(weeks) for s in ("a", "b")], SNAPSHOTS)
    days = [(s, first + timedelta(days=n), float(n % 5 + (s == "a")), n % 9 == 0) for n in range(25) for s in ("a", "b")]
    late = [d for d in days if d[1] == first + timedelta(days=3)]
    rules, reference = Rules(), F.lit(0.2)
    parts = [[d for d in days if d not in late and (d[1] - first).days // 5 == k] for k in (0, 1, 2, 4, 3)] + [late]
    known = []
    for part in parts:
        known += part
        spark.createDataFrame(part, DAYS).coalesce(1).write.mode("append").parquet(inbox)
        actuals = flows.file_stream(spark, inbox, DAYS)
        # A new query each time: it goes on from the checkpoint and the store.
        flows.run_to_end(flows.follow_forecasts(actuals, snapshots, store, verdicts, reference, rules), str(tmp_path / "cp"))
        at_once = spark.createDataFrame(known, DAYS)
        want = monitor.drift(
            monitor.evaluate_snapshots(snapshots, at_once, at_once.agg(F.max("ds")).scalar()), reference, rules)
        got = spark.read.parquet(f"{verdicts}/epoch={len(list(Path(verdicts).glob('epoch=*'))) - 1}")
        order = lambda df: sorted(tuple(r) for r in df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in want.dtypes]).collect())
        assert order(got) == order(want)
    # Days of the second week alone touch no folder of the first.
    touched = sorted(p.name for p in Path(store, "sums", "epoch=1").glob("week_start=*"))
    assert touched == ["week_start=2026-01-05", "week_start=2026-01-12"]
    assert sorted(p.name for p in Path(store, "sums", "epoch=2").glob("week_start=*")) == ["week_start=2026-01-12", "week_start=2026-01-19"]
