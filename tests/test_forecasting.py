import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.functions.holidays import holiday_offset
from shelfcast.functions.pvalues import _student_tail
from shelfcast.operators import evaluate, explain, forecast, kpi, monitor, policy, scenario, series as ts, smoothing
from shelfcast.params import DEFAULT

START = date(2025, 10, 1)
DAILY = "unique_id string, ds date, y_raw double, is_closed boolean, in_holiday_window boolean, cat_l1 string, cat_l2 string"
WEEKLY = "unique_id string, cutoff int, model string, phase string, y double, yhat double, demand_class string, " \
         "cat_l1 string, cat_l2 string"


def daily(spark, values, closed=(), name="A"):
    return spark.createDataFrame([
        (name, START + timedelta(days=i), None if i in closed else float(v), i in closed, False, "X", "Y")
        for i, v in enumerate(values)], DAILY)


def ready(df):
    return df.withColumn("y", F.coalesce("y_raw", F.lit(0.0)))


def measured(spark, y, f, measure):
    return spark.createDataFrame(list(zip(map(float, y), map(float, f))), "y double, yhat double").agg(
        measure.alias("m")).first()["m"]


def test_error_measures_equal_their_definitions(spark):
    rng = random.Random(21)
    y = [rng.choice([0, 0, 3, 8, 14]) for _ in range(30)]
    f = [rng.uniform(0, 15) for _ in y]
    total, gaps = sum(y), [b - a for a, b in zip(y, f)]
    assert measured(spark, y, f, evaluate.wmape()) == pytest.approx(sum(map(abs, gaps)) / total)
    assert measured(spark, y, f, evaluate.bias()) == pytest.approx(sum(gaps) / total)
    assert measured(spark, y, f, evaluate.mae()) == pytest.approx(sum(map(abs, gaps)) / 30)
    assert measured(spark, y, f, evaluate.tracking_signal()) == pytest.approx(sum(gaps) / (sum(map(abs, gaps)) / 30))
    scores = evaluate.metrics(weeks(spark, [("A", i, "m", "holdout", float(a), float(b), "c", "X", "Y") for i, (a, b) in enumerate(zip(y, f))]))
    want = float(np.median([abs(g) / a for a, g in zip(y, gaps) if a]))
    assert {r["scope"]: r["MdAPE"] for r in scores.collect()} == pytest.approx({"Tổng thể": want, "c": want})
    assert measured(spark, [0] * 4, [3] * 4, evaluate.wmape()) is None
    assert measured(spark, [5] * 4, [5] * 4, evaluate.tracking_signal()) == 0


def test_holiday_offset_is_the_distance_to_the_nearest_holiday(spark):
    days = [date(2025, 12, 1) + timedelta(days=13 * i) for i in range(45)]
    got = spark.createDataFrame([(d,) for d in days], "d date").select("d", holiday_offset("d", DEFAULT).alias("o")).collect()
    for row in got:
        assert abs(row["o"]) == min(abs((row["d"] - h).days) for h in DEFAULT.holidays)
        assert any(h + timedelta(days=row["o"]) == row["d"] for h in DEFAULT.holidays)


def test_closed_days_see_no_later_value(spark):
    rng = random.Random(22)
    values = [rng.randrange(1, 40) for _ in range(50)]
    closed = {30, 37}
    first = ts.imputed(daily(spark, values, closed=closed), DEFAULT).orderBy("ds").collect()
    other = ts.imputed(daily(spark, values[:38] + [v + 500 for v in values[38:]], closed=closed), DEFAULT).orderBy("ds").collect()
    assert first[30]["is_imputed"] and first[37]["is_imputed"] and not first[29]["is_imputed"]
    assert [r["y"] for r in other[:38]] == [r["y"] for r in first[:38]]


def test_first_days_fall_back_to_later_weeks(spark):
    rows = ts.imputed(daily(spark, [0, 0] + [9.0] * 26, closed={0, 1}), DEFAULT).orderBy("ds").collect()
    assert [r["y"] for r in rows[:2]] == [9.0, 9.0]


@pytest.mark.parametrize("gap, sizes, want", [
    (1, [11, 12, 13], "smooth"), (1, [2, 90], "erratic"), (4, [6, 6], "intermittent"), (4, [1, 1, 70], "lumpy"), (40, [5, 5], "insufficient")])
def test_demand_class_follows_gaps_and_spread(spark, gap, sizes, want):
    values = [sizes[i // gap % len(sizes)] if i % gap == 0 else 0 for i in range(160)]
    row = ts.demand_classes(daily(spark, values), DEFAULT).first()
    sold = [v for v in values if v]
    cv2 = (np.std(sold, ddof=1) / np.mean(sold)) ** 2
    assert row["demand_class"] == want
    assert row["adi"] == pytest.approx(len(values) / len(sold)) and row["cv2"] == pytest.approx(cv2)


def _ses(x, a):
    level, sse = x[0], 0.0
    for v in x[1:]:
        sse += (v - level) ** 2
        level = a * v + (1 - a) * level
    return sse, level


def _best(x):
    return min(_ses(x, 0.1 + 0.02 * k) for k in range(11))[1] if x else 0.0


def test_intermittent_methods_equal_brute_force(spark):
    rng = random.Random(4)
    y = [rng.choice([0, 0, 0, 1, 2, 7]) for _ in range(90)]
    df, cut = ready(daily(spark, y)), START + timedelta(days=80)
    known = [float(v) for v in y[:81]]
    demand = [v for v in known if v > 0]
    places = [i + 1 for i, v in enumerate(known) if v > 0]
    gaps = [float(p - q) for p, q in zip(places, [0] + places)]
    longest = round(sum(gaps) / len(gaps))

    def block(k):
        cut_y = known[len(known) % k:]
        return _best([sum(cut_y[i:i + k]) for i in range(0, len(cut_y), k)]) / k

    want = {
        "Croston": _best(demand) / _best(gaps),
        "TSB": _ses(demand, 0.2)[1] * _ses([float(v != 0) for v in known], 0.2)[1],
        "ADIDA": block(longest), "IMAPA": sum(block(k) for k in range(1, longest + 1)) / longest,
        "HistoricAverage": sum(known) / len(known), "MovingAvg28": sum(known[-28:]) / 28,
    }
    got = (
        forecast.intermittent(df, [cut], 7).unionByName(forecast.probability_smoothed(df, [cut], 7))
        .unionByName(forecast.aggregated(df, [cut], 7)).unionByName(forecast.averages(df, [cut], 7)))
    rows = got.collect()
    for model, value in want.items():
        path = [r["yhat"] for r in rows if r["model"] == model]
        assert len(path) == 7 and all(v == pytest.approx(value) for v in path), model
    naive = [r["yhat"] for r in sorted((r for r in rows if r["model"] == "SeasonalNaive"), key=lambda r: r["ds"])]
    assert naive == known[-7:]


def test_a_series_without_sales_forecasts_zero(spark):
    df, cut = ready(daily(spark, [0.0] * 60)), START + timedelta(days=59)
    for fc in (forecast.intermittent, forecast.aggregated, forecast.probability_smoothed, forecast.averages):
        assert {r["yhat"] for r in fc(df, [cut], 7).collect()} == {0.0}


def test_smoothing_finds_a_weekly_pattern(spark):
    week = [12.0, 3.0, 3.0, 7.0, 5.0, 18.0, 26.0]
    df, cut = ready(daily(spark, week * 22)), START + timedelta(days=153)
    rows = smoothing.seasonal_smoothing(df, [cut], 7).orderBy("ds").collect()
    assert [r["yhat"] for r in rows] == pytest.approx(week, abs=0.5)


def test_smoothing_equals_a_plain_loop(spark):
    rng = random.Random(23)
    y = [rng.randrange(0, 20) + 8 * (i % 7 == 2) for i in range(75)]
    ends = [9, 40, 74]
    got = smoothing.seasonal_smoothing(ready(daily(spark, y)), [START + timedelta(days=e) for e in ends], 10).collect()
    for end in ends:
        runs = []
        for a, b, g in smoothing.VARIANTS:
            first = y[:14]
            level, slope, sse = sum(first) / 14, 0.0, 0.0
            season = [((first[i] + first[i + 7]) / 2 - level) if g else 0.0 for i in range(7)]
            for t in range(end + 1):
                e = y[t] - (level + slope + season[t % 7])
                sse, level, slope = sse + e * e, level + slope + a * e, slope + b * a * e
                season[t % 7] += g * e
            n, k = end + 1, 2 + 2 * (b > 0) + 7 * (g > 0)
            score = n * math.log(max(sse, 1e-9) / n) + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)
            runs.append((round(score, 6), len(runs), [max(level + slope * s + season[(end + s) % 7], 0) for s in range(1, 11)]))
        path = [r["yhat"] for r in sorted(got, key=lambda r: r["ds"]) if r["cutoff"] == START + timedelta(days=end)]
        assert path == pytest.approx(min(runs)[2])


def test_ensembles_need_every_member(spark):
    cols = "unique_id string, cutoff date, ds date, model string, yhat double"
    day = (START, START + timedelta(days=1))
    df = spark.createDataFrame([("A", *day, "GlobalTweedie", 2.0), ("A", *day, "IMAPA", 4.0)], cols)
    assert [(r["model"], r["yhat"]) for r in forecast.ensembles(df).collect()] == [("Ens_Tweedie_IMAPA", 3.0)]


def weeks(spark, rows):
    return spark.createDataFrame(rows, WEEKLY)


def test_champion_has_the_least_error_within_the_allowed_bias(spark):
    rng = random.Random(24)
    y = [rng.randrange(5, 50) for _ in range(16)]
    paths = {"under": [v * (1 - 2 * DEFAULT.max_abs_bias) for v in y], "even": [v + (9 if i % 2 else -9) for i, v in enumerate(y)],
             "wild": [v + (25 if i % 2 else -25) for i, v in enumerate(y)]}
    df = weeks(spark, [("A", i, m, "selection", float(v), float(p), "c", "X", "Y") for m, path in paths.items() for i, (v, p) in enumerate(zip(y, path))])
    names = tuple(paths)
    assert evaluate.champion(df, DEFAULT, names).first()["model"] == "even"
    assert evaluate.champion(df, DEFAULT.scaled(max_abs_bias=0.9), names).first()["model"] == "under"


@pytest.mark.parametrize("wmape, demand, label", [
    (0.29, "smooth", "Cao"), (0.30, "lumpy", "Cao"), (0.31, "smooth", "Trung bình"), (0.51, "erratic", "Thấp"), (None, "smooth", "Chưa đủ dữ liệu"),
    (0.1, "insufficient", "Chưa đủ dữ liệu")])
def test_confidence_label(spark, wmape, demand, label):
    df = spark.createDataFrame([(wmape, demand)], "wmape double, demand_class string")
    assert df.select(evaluate.confidence()).first()[0] == label


def _dm(spark, diffs):
    rows = []
    for i, d in enumerate(diffs):
        day = START + timedelta(days=i)
        # |ours - 0| - |other - 0| = d
        rows += [("A", START, day, "ours", 100.0 + float(d), 0.0), ("A", START, day, "other", 100.0, 0.0)]
    df = spark.createDataFrame(rows, "unique_id string, cutoff date, ds date, model string, yhat double, y_raw double")
    r = evaluate.diebold_mariano(df, "ours", ["other"], 7).first()
    return r["dm_stat"], _student_tail(r["dm_stat"], r["n_days"] - 1)


def test_diebold_mariano(spark):
    rng = np.random.default_rng(31)
    for n, shift in ((49, -2.0), (63, 0.0), (35, 0.4)):
        d = shift + rng.uniform(-1.5, 1.5, n)
        stat, p = _dm(spark, d)
        c = d - d.mean()
        gamma = [float(c[k:] @ c[:n - k]) / n for k in range(7)]
        var = (gamma[0] + 2 * sum(gamma[1:])) / n
        var = var if var > 0 else gamma[0] / n
        assert stat == pytest.approx(d.mean() / math.sqrt(var) * math.sqrt((n + 1 - 14 + 42 / n) / n))
        assert p < 0.01 or shift != -2.0


def test_student_tail_known_values():
    assert _student_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-6)
    assert _student_tail(0.0, 5) == pytest.approx(1.0, abs=1e-6)


# --- orders ------------------------------------------------------------------------------------

def policy_rows(spark, rows, life):
    cols = "policy string, unique_id string, cutoff int, y double, wanted double, cost double, price double, life int"
    return spark.createDataFrame([("p", u, c, float(y), float(w), 100.0, 150.0, life) for u, c, y, w in rows], cols)


def test_single_period_equals_its_definition(spark):
    rng = random.Random(33)
    rows = [("A", c, rng.choice([0, 7, 13, 22]), rng.randrange(0, 25)) for c in range(20)]
    r = policy.single_period(policy_rows(spark, rows, None)).first()
    short, over = sum(max(y - w, 0) for _, _, y, w in rows), sum(max(w - y, 0) for _, _, y, w in rows)
    asked = [(y, w) for _, _, y, w in rows if y > 0]
    assert (r["units_short"], r["units_excess"], r["excess_value"]) == (short, over, 100 * over)
    assert r["fill_rate"] == pytest.approx(1 - short / sum(y for _, _, y, _ in rows))
    assert r["service_level"] == pytest.approx(sum(y - w <= 0.5 for y, w in asked) / len(asked))


def _simulate(rows, life):
    lots, out = [], dict(ordered=0.0, short=0.0, waste=0.0, held=0.0)
    for _, _, y, wanted in rows:
        on_hand = sum(q for q, _ in lots)
        bought = max(0.0, wanted - on_hand)
        if bought:
            lots.append((bought, 0))
        need = min(y, on_hand + bought)
        out["ordered"] += bought
        out["short"] += y - need
        kept = []
        for q, age in lots:
            take = min(q, need)
            need -= take
            if q - take > 1e-9:
                kept.append((q - take, age + 1))
        out["waste"] += sum(q for q, age in kept if life and age >= life)
        lots = [(q, age) for q, age in kept if not life or age < life]
        out["held"] += sum(q for q, _ in lots)
    return out


@pytest.mark.parametrize("life", [None, 1, 2, 3])
def test_carry_over_equals_brute_force(spark, life):
    rng = random.Random(life or 0)
    rows = [("A", c, rng.randrange(0, 30), rng.randrange(0, 25)) for c in range(25)]
    r = policy.carry_over(policy_rows(spark, rows, life), DEFAULT.scaled(holding_rate_week=0.5)).first()
    want = _simulate(rows, life)
    assert r["units_ordered"] == pytest.approx(want["ordered"]) and r["units_short"] == pytest.approx(want["short"])
    assert r["units_excess"] == pytest.approx(want["waste"])
    assert r["holding_cost"] == pytest.approx(want["held"] * 100 * 0.5)
    assert r["lost_profit"] == pytest.approx(want["short"] * 50)


@pytest.mark.parametrize("units", [0, 1, 11, 64])
def test_allocation_gives_every_unit_once(spark, units):
    sold = {"u": 41.0, "v": 23.0, "w": 19.0, "x": 6.0}
    shares = spark.createDataFrame([("N", s, s.upper(), q, q / sum(sold.values())) for s, q in sold.items()],
                                   "cat_l3 string, sku string, product_name string, qty double, share double")
    plan = spark.createDataFrame([("N", float(units), 5.0)], "unique_id string, order_qty double, forecast_week double")
    parts = {r["sku"]: r["sku_order_qty"] for r in policy.allocate(shares, plan, "cat_l3").collect()}
    assert sum(parts.values()) == units
    assert all(abs(parts[s] - units * q / sum(sold.values())) < 1 for s, q in sold.items())


def test_service_class_is_perishable_before_star_before_durable(spark):
    lives = {"milk": DEFAULT.perishable_max_weeks, "rice": DEFAULT.perishable_max_weeks + 1}
    rules = DEFAULT.scaled(shelf_life=lives)
    profile = spark.createDataFrame([(u, q) for u in ("milk", "rice", "salt") for q in ("top", "rest")], "unique_id string, cat_l2 string")
    margin = spark.createDataFrame([("top", "Ngôi sao"), ("rest", "Cần xem xét")], "cat_l2 string, quadrant string")
    got = {(r["unique_id"], r["cat_l2"]): (r["service_class"], r["tau"]) for r in policy.service_classes(profile, margin, rules).collect()}
    fresh, star, keeps = ("Dễ hư hỏng", 0.55), ("Ngôi sao", 0.80), ("Bảo quản lâu", 0.70)
    assert got == {("milk", "top"): fresh, ("milk", "rest"): fresh, ("rice", "top"): star, ("rice", "rest"): keeps,
                   ("salt", "top"): star, ("salt", "rest"): keeps}


# --- monitoring --------------------------------------------------------------------------------

def runs(spark, wmapes, actual, forecasts):
    rows = [(f"r{i}", "k", START + timedelta(days=7 * i), w, float(a), float(f))
            for i, (w, a, f) in enumerate(zip(wmapes, actual, forecasts))]
    return spark.createDataFrame(
        rows, "run_id string, kind string, week_start date, wmape double, actual_total double, forecast_total double")


def status(spark, *args):
    flags = monitor.drift(runs(spark, *args), F.lit(0.55), DEFAULT)
    return monitor.drift_status(flags).first()


LIMIT = 0.55 * DEFAULT.drift_factor


def test_one_bad_week_calls_for_training_and_good_ones_do_not(spark):
    calm = [LIMIT - 0.05] * 5
    assert not status(spark, calm, [80] * 5, [83, 77, 82, 79, 80])["retrain"]
    assert status(spark, calm[:4] + [LIMIT + 0.05], [80] * 5, [83, 77, 82, 79, 80])["retrain"]


def test_forecasts_that_stay_low_are_biased(spark):
    weeks_ = int(DEFAULT.ts_limit) + 3
    got = status(spark, [0.2] * weeks_, [90] * weeks_, [63] * weeks_)
    assert got["retrain"] and got["state"] == "bias" and got["tracking_signal"] == pytest.approx(-weeks_)


def test_earlier_alarms_are_listed(spark):
    got = status(spark, [0.4, 0.4, LIMIT + 0.2, 0.4], [60] * 4, [60] * 4)
    assert not got["retrain"] and got["flagged_weeks"] == str(START + timedelta(days=14))


def test_retrain_after_a_whole_week_of_new_days(spark):
    calendar = spark.createDataFrame([(START,)], "date date")
    none = monitor.drift_status(monitor.drift(runs(spark, [], [], []), F.lit(0.5), DEFAULT))
    decided = {age: monitor.retrain_decision(calendar, age if age is None else START - timedelta(days=age), none, "k").first()["retrain"]
               for age in (None, 1, 6, 7, 30)}
    assert decided == {None: True, 1: False, 6: False, 7: True, 30: True}


def test_weekly_blocks(spark):
    df = spark.createDataFrame([(START + timedelta(days=i), 1.0) for i in range(-9, 12)], "d date, v double")
    past = kpi.weekly_blocks(df.filter(F.col("d") <= F.lit(START)), "d", "v", F.lit(START)).orderBy("block").collect()
    assert [r["value"] for r in past] == [7.0, 3.0]
    ahead = kpi.weekly_blocks(df.filter(F.col("d") > F.lit(START)), "d", "v", F.lit(START), future=True).collect()
    assert [(r["value"], r["block_start"]) for r in ahead] == [(7.0, START + timedelta(days=1))]


@pytest.mark.parametrize("reliable, slope", [(True, 0.031), (False, 0.012)])
def test_discount_scenario_uses_the_reliable_slope(spark, reliable, slope):
    plan = spark.createDataFrame([("X", 70.0, 90.0)], "cat_l1 string, forecast_week double, order_qty double")
    response = spark.createDataFrame([("X", reliable, 0.031, 0.012)],
                                     "cat_l1 string, reliable boolean, uplift_per_pct double, store_uplift_per_pct double")
    r = scenario.discount(plan, response, 20, 25).first()
    net = slope * 20 * (1 - 0.25)
    assert r["net_factor"] == pytest.approx(1 + net) and r["extra_order"] == pytest.approx(90 * net)


def test_waterfall_ends_at_the_forecast(spark):
    local = spark.createDataFrame(
        [("A", START, "Mức bán dài hạn", 1.0, 0.5, 0.0), ("A", START, "Ngày trong tuần", 1.0, -0.2, 0.0),
         ("A", START, "Bán hôm trước", 1.0, 0.3, 0.0)],
        "unique_id string, ds date, `group` string, base_value double, contribution double, effect_pct double")
    steps = explain.waterfall(local).orderBy("step").collect()
    assert steps[0]["start"] == pytest.approx(math.exp(1.5)) and steps[0]["group"] == "Bán hôm trước"
    assert steps[-1]["to_level"] == pytest.approx(math.exp(1.6))


def test_learner_converges_and_beats_last_week_repeated(spark):
    """Sparse series with a weekly pattern: the fitted model must track their level."""
    from shelfcast.operators import learner

    rng = random.Random(9)
    rows = [(f"s{k}", START + timedelta(days=i), float(rng.random() < 0.5) * rng.randrange(1, 6) * (k + 1)
             * (2 if i % 7 == 3 else 1), f"c{k % 2}") for k in range(6) for i in range(200)]
    df = spark.createDataFrame(rows, "unique_id string, ds date, y double, cat_l1 string").withColumn(
        "is_closed", F.lit(False)).withColumn("y_raw", F.col("y"))
    cut = START + timedelta(days=171)
    fc = learner.learned_forecasts(df, ts.features(df), [cut], 28)
    naive = forecast.averages(df, [cut], 28).filter("model = 'SeasonalNaive'")
    scores = {r["model"]: r for r in evaluate.daily_errors(fc.drop("x").unionByName(naive), df)
              .withColumn("y", F.col("y_raw")).groupBy("model")
              .agg(evaluate.wmape().alias("wmape"), evaluate.bias().alias("bias")).collect()}
    assert abs(scores["GlobalTweedie"]["bias"]) < 0.25
    assert scores["GlobalTweedie"]["wmape"] < scores["SeasonalNaive"]["wmape"]


def test_batch_features_equal_recursive_ones(spark):
    """The first forecast step must see the columns the training rows have for that day."""
    from shelfcast.operators import learner

    rng = random.Random(11)
    df = ready(daily(spark, [rng.randrange(0, 9) for _ in range(80)])).select("unique_id", "ds", "y", "cat_l1")
    day = START + timedelta(days=60)
    feats = ts.features(df)
    row = learner.design(feats, ["X"]).filter(F.col("ds") == F.lit(day)).first()
    n = len(learner.design_names(["X"]))
    first = learner.learned_forecasts(df, feats, [day - timedelta(days=1)], 1).first()
    assert list(first["x"]) == pytest.approx([row[f"x{i}"] for i in range(n)])


def test_short_series_get_a_learned_forecast(spark):
    """Every eligible series competes on the same rows, however short its history."""
    from shelfcast.operators import learner

    rng = random.Random(12)
    rows = [(f"s{k}", START + timedelta(days=i), float(rng.randrange(0, 6)), "c") for k, days in enumerate((120, 90, 22)) for i in range(120 - days, 120)]
    df = spark.createDataFrame(rows, "unique_id string, ds date, y double, cat_l1 string")
    fc = learner.learned_forecasts(df, ts.features(df), [START + timedelta(days=119)], 7).collect()
    assert {k: sum(r["unique_id"] == k for r in fc) for k in ("s0", "s1", "s2")} == {"s0": 7, "s1": 7, "s2": 7}
    assert all(math.isfinite(r["yhat"]) for r in fc)


def test_small_rank_sums_have_their_exact_chance(spark):
    """Against all ways to give n ranks a sign."""
    from itertools import product

    cases, want = [], {}
    for n in range(1, 13):
        sums = [sum(r for r, up in zip(range(1, n + 1), ups) if up) for ups in product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            cases.append((n, float(w)))
            want[n, float(w)] = min(1.0, 2 * sum(s <= w for s in sums) / 2 ** n)
    made = spark.createDataFrame(cases, "n long, w double").withColumn("p", evaluate.signed_rank_p("n", F.col("w")))
    assert {(r["n"], r["w"]): r["p"] for r in made.collect()} == want
    large = spark.createDataFrame([(50, 637.0)], "n long, w double").withColumn("p", evaluate.signed_rank_p("n", F.col("w"))).first()["p"]
    assert abs(large - 1.0) < 0.01


def test_the_score_tells_a_settled_fit_from_a_moved_one(spark):
    import random

    import numpy as np

    from shelfcast.operators import learner

    rng = random.Random(7)
    rows = [(START + timedelta(days=d), rng.choice([0.0, 0.0, 1.0, 3.0, 8.0]), rng.random(), float(d % 7 == 0), 0.0) for d in range(400)]
    df = spark.createDataFrame(rows, "ds date, y double, x0 double, x1 double, x2 double")
    weights = learner.fit(df, 3)
    gaps = {r["place"]: r["gap"] for r in learner.score(df, weights).collect()}
    assert sorted(gaps) == [0, 1, 2, 3] and max(map(abs, gaps.values())) < 1e-3
    # By hand, for weights that no fit gives.
    moved = weights + np.array([0.1, 0.0, 0.2, 0.3])
    x = np.array([[1.0, *r[2:]] for r in rows])
    y, mean = np.array([r[1] for r in rows]), np.exp(x @ moved)
    penalty = np.array([0.0, 1.0, 1.0, 1.0]) * learner.RIDGE * (mean ** 0.8).sum()
    want = (((y - mean) * mean ** -0.2) @ x - penalty * moved) / ((mean ** 0.8) @ (x * x) + penalty)
    got = {r["place"]: r["gap"] for r in learner.score(df, moved).collect()}
    assert np.allclose([got[i] for i in range(4)], want) and np.abs(want).max() > 0.05
