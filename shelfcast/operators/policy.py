"""From forecasts to orders, and what past orders would have cost."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.functions.holidays import holiday_offset, holiday_window
from shelfcast.functions.medians import banded_median, banded_quantiles
from shelfcast.operators.forecast import ENSEMBLES
from shelfcast.operators.marts import rows
from shelfcast.params import (
    MODE_CARRY, MODE_SINGLE, QUADRANT_STAR, Rules, SERVICE_DURABLE, SERVICE_PERISHABLE,
    SERVICE_STAR, SERVICE_TAU, TAUS, WHOLE_STORE,
)


def quantile_name(tau: float) -> str:
    return f"q{int(tau * 100)}"


# --- calibration ----------------------------------------------------------------------------

def ratio_quantiles(weeks: DataFrame, rules: Rules, keys: tuple[str, ...] = ("demand_class",)) -> DataFrame:
    """Quantiles of actual over forecast per demand class, from weeks with a real forecast."""
    ratios = weeks.filter(F.col("yhat") > rules.min_forecast_for_ratio).withColumn("_ratio", F.col("y") / F.col("yhat"))
    found = ratios.groupBy(*keys).agg(rows().alias("n_weeks")).join(
        banded_quantiles(ratios, list(keys), "_ratio", list(TAUS), "_q"), list(keys))
    return found.select(*keys, *[F.col("_q")[i].alias(quantile_name(t)) for i, t in enumerate(TAUS)], "n_weeks")


def horizon_quantiles(daily: DataFrame, profile: DataFrame, chosen: str, rules: Rules) -> DataFrame:
    """The same per week ahead, from backtest forecasts of several weeks."""
    week_ahead = F.floor((F.datediff("ds", "cutoff") - 1) / 7) + 1
    weeks = (
        daily.filter(F.col("model") == chosen)
        .groupBy("unique_id", "cutoff", week_ahead.alias("horizon_week"))
        .agg(F.sum("y_raw").alias("y"), F.sum("yhat").alias("yhat"))
        .join(profile.select("unique_id", "demand_class"), "unique_id")
    )
    return ratio_quantiles(weeks, rules, ("demand_class", "horizon_week"))


# --- fixed values: champions whose later weeks are calibrated by a long backtest ------------
LONG_TESTED = (*ENSEMBLES, "GlobalTweedie", "AutoETS", "IMAPA")


def calibrated(first_week: DataFrame, by_horizon: DataFrame | None = None) -> DataFrame:
    """Week 1 from the weekly backtest, later weeks from the long one, if there is one."""
    first = first_week.withColumn("horizon_week", F.lit(1).cast("bigint"))
    return first if by_horizon is None else first.unionByName(by_horizon.filter("horizon_week > 1"))


# --- service classes ---------------------------------------------------------------------------

def shelf_life(rules: Rules, name: str = "unique_id") -> Column:
    """Weeks a category keeps, null when it keeps long."""
    lives = F.create_map(*[F.lit(x) for x in chain.from_iterable(rules.shelf_life.items())])
    return lives[F.col(name)]


def service_classes(profile: DataFrame, margin: DataFrame, rules: Rules) -> DataFrame:
    """Short-lived goods first, then star categories, the rest keeps; each with its order
    quantile. Adds quadrant, service_class and tau."""
    quadrants = margin.groupBy("cat_l2").agg(F.max("quadrant").alias("quadrant"))
    perishable = F.coalesce(shelf_life(rules) <= rules.perishable_max_weeks, F.lit(False))
    taus = F.create_map(*[F.lit(x) for x in chain.from_iterable(SERVICE_TAU.items())])
    return (
        profile.join(quadrants, "cat_l2", "left")
        .withColumn("service_class",
                    F.when(perishable, SERVICE_PERISHABLE)
                    .when(F.col("quadrant") == QUADRANT_STAR, SERVICE_STAR).otherwise(SERVICE_DURABLE))
        .withColumn("tau", taus[F.col("service_class")])
    )


def quantile_at(tau: Column) -> Column:
    """The calibrated quantile column that belongs to tau."""
    return F.coalesce(*[F.when(tau == t, F.col(quantile_name(t))) for t in TAUS])


# --- the plan -------------------------------------------------------------------------------------

def holiday_layer(forecasts: DataFrame, categories: DataFrame, effect: DataFrame, rules: Rules) -> DataFrame:
    """Multiply days inside a holiday window by the top category's quantity factor."""
    factors = effect.filter(F.col("cat_l1") != WHOLE_STORE).select(
        "cat_l1", "holiday_window", F.col("qty_factor").alias("_factor"))
    return (
        forecasts.join(categories.select("unique_id", "cat_l1"), "unique_id", "left")
        .withColumn("holiday_window", holiday_window(holiday_offset("ds", rules), rules, ""))
        .join(factors, ["cat_l1", "holiday_window"], "left")
        .withColumn("holiday_factor", F.coalesce("_factor", F.lit(1.0)))
        .withColumn("forecast", F.col("yhat") * F.col("holiday_factor")).drop("_factor")
    )


def order_plan(daily_forecast: DataFrame, classes: DataFrame, quantiles: DataFrame, unit_cost: DataFrame,
               report: DataFrame) -> DataFrame:
    """Next week's forecast, its 80% interval, the order and its value per series.

    `classes` carries service_class and tau, `report` the hold-out error and confidence.
    """
    first_day = F.min("ds")
    week = daily_forecast.filter(F.datediff("ds", "cutoff") <= 7).groupBy("unique_id").agg(
        F.sum("forecast").alias("forecast_week"), first_day.alias("week_start"))
    q = quantiles.filter("horizon_week = 1").drop("horizon_week", "n_weeks")
    factor = F.coalesce(quantile_at(F.col("tau")), F.lit(1.0))
    return (
        week.join(classes.select("unique_id", "cat_l1", "cat_l2", "demand_class", "service_class", "tau", "quadrant"),
                  "unique_id")
        .join(report.select("unique_id", "wmape", "confidence"), "unique_id", "left")
        .join(q, "demand_class", "left").join(unit_cost.select("unique_id", "unit_cost"), "unique_id", "left")
        .withColumn("lower_80", F.col("forecast_week") * F.col("q10"))
        .withColumn("upper_80", F.col("forecast_week") * F.col("q90"))
        # A product that is whole but for float noise must not round up.
        .withColumn("order_qty", F.ceil(F.round(F.col("forecast_week") * factor, 6)).cast("double"))
        .withColumn("order_value", F.col("order_qty") * F.col("unit_cost"))
        .drop(*[quantile_name(t) for t in TAUS])
    )


def allocate(shares: DataFrame, plan: DataFrame, level: str) -> DataFrame:
    """Split each category's order over its best-selling articles in whole units.

    Shares are rescaled inside the short list; units left after rounding down go to the
    largest remainders, so the parts always add up to the order. At most the top few
    articles per category take part.
    """
    own = Window.partitionBy(level)
    by_remainder = own.orderBy(F.col("_remainder").desc(), "sku")
    wanted = plan.select(F.col("unique_id").alias(level), "order_qty", "forecast_week")
    parts = (
        shares.drop("share").join(wanted, level)
        .withColumn("share", F.col("qty") / F.sum("qty").over(own))
        .withColumn("sku_forecast_week", F.col("forecast_week") * F.col("share"))
        .withColumn("_raw", F.round(F.col("order_qty") * F.col("share"), 9))
        .withColumn("_whole", F.floor("_raw"))
        .withColumn("_remainder", F.round(F.col("_raw") - F.col("_whole"), 9))
        .withColumn("_left", F.round(F.col("order_qty") - F.sum("_whole").over(own)))
    )
    extra = (F.row_number().over(by_remainder) <= F.col("_left")).cast("double")
    return parts.withColumn("sku_order_qty", F.col("_whole") + extra).select(
        level, "sku", "product_name", "qty", "share", "order_qty", "forecast_week", "sku_forecast_week", "sku_order_qty")


# --- policy backtests ---------------------------------------------------------------------------------

def policy_weeks(weeks: DataFrame, policies: dict[str, Column], prices: DataFrame, rules: Rules) -> DataFrame:
    """Long form: one row per policy, series and week with its wanted quantity, cost, price
    and shelf life. Categories without a price take the median one."""
    long = F.array(*[
        F.struct(F.lit(name).alias("policy"), wanted.cast("double").alias("wanted")) for name, wanted in policies.items()])
    middle_of = lambda column: banded_median(prices, [], column, "_m").select("_m").scalar()
    return (
        weeks.join(prices.select("unique_id", "unit_cost", "unit_price"), "unique_id", "left")
        .withColumn("cost", F.coalesce("unit_cost", middle_of("unit_cost")))
        .withColumn("price", F.coalesce("unit_price", middle_of("unit_price")))
        .withColumn("life", shelf_life(rules))
        .select("unique_id", "cutoff", "y", "cost", "price", "life", F.inline(long))
        .withColumn("wanted", F.ceil(F.round("wanted", 6)).cast("double"))
    )


def _scores(mode: str, ordered, short, excess, served, demanded, **more) -> list[Column]:
    return [
        F.lit(mode).alias("mode"), ordered.alias("units_ordered"), short.alias("units_short"),
        excess.alias("units_excess"), F.try_divide(served, demanded).alias("service_level"),
        (1 - F.try_divide(short, F.sum("y"))).alias("fill_rate"),
        *[value.alias(name) for name, value in more.items()]]


def single_period(weeks: DataFrame) -> DataFrame:
    """Each week stands alone: what is left over is lost. Weeks without demand do not count
    for the service level."""
    short = F.greatest(F.col("y") - F.col("wanted"), F.lit(0.0))
    excess = F.greatest(F.col("wanted") - F.col("y"), F.lit(0.0))
    demanded = F.col("y") > 0
    return weeks.groupBy("policy").agg(*_scores(
        MODE_SINGLE, F.sum("wanted"), F.sum(short), F.sum(excess), F.count_if(demanded & (short <= 0.5)),
        F.count_if(demanded), excess_value=F.sum(excess * F.col("cost"))))


# State of one series over its weeks: stock as lots in order of age, and the week's outcome.
# `step` orders up to the wanted quantity, sells the oldest lots first, ages what is left,
# and drops lots that reached their shelf life.
_SIMULATION = """
aggregate(weeks,
  named_struct('lots', CAST(array() AS array<struct<qty: double, age: int>>),
               'ordered', 0D, 'short', 0D, 'waste', 0D, 'waste_value', 0D, 'lost_profit', 0D,
               'holding', 0D, 'demanded', 0, 'served', 0),
  (s, w) -> aggregate(
    array(aggregate(s.lots, 0D, (a, l) -> a + l.qty)), s,
    (t, on_hand) -> aggregate(
      array(greatest(w.wanted - on_hand, 0D)), t,
      (u, bought) -> aggregate(
        array(least(w.y, on_hand + bought)), u,
        (v, sold) -> aggregate(
          array(filter(transform(
            aggregate(
              IF(bought > 0, concat(v.lots, array(named_struct('qty', bought, 'age', 0))), v.lots),
              named_struct('need', sold, 'kept', CAST(array() AS array<struct<qty: double, age: int>>)),
              (k, l) -> named_struct(
                'need', k.need - least(k.need, l.qty),
                'kept', concat(k.kept, array(named_struct('qty', l.qty - least(k.need, l.qty), 'age', l.age))))
            ).kept,
            l -> named_struct('qty', l.qty, 'age', l.age + 1)), l -> l.qty > 1e-9D)), v,
          (x, aged) -> named_struct(
            'lots', filter(aged, l -> w.life IS NULL OR l.age < w.life),
            'ordered', x.ordered + bought,
            'short', x.short + (w.y - sold),
            'waste', x.waste + aggregate(aged, 0D, (a, l) -> a + IF(l.age >= w.life, l.qty, 0D)),
            'waste_value', x.waste_value + w.cost * aggregate(aged, 0D, (a, l) -> a + IF(l.age >= w.life, l.qty, 0D)),
            'lost_profit', x.lost_profit + (w.y - sold) * greatest(w.price - w.cost, 0D),
            'holding', x.holding + w.cost * aggregate(
               aged, 0D, (a, l) -> a + IF(w.life IS NULL OR l.age < w.life, l.qty, 0D)),
            'demanded', x.demanded + IF(w.y > 0, 1, 0),
            'served', x.served + IF(w.y > 0 AND w.y - sold <= 0.5D, 1, 0)))))))
"""


def carry_over(weeks: DataFrame, rules: Rules) -> DataFrame:
    """Stock left over is sold next week, oldest first, until its shelf life ends.

    Each (policy, series) is a short sorted array of weeks folded by one expression, so the
    work spreads over series and policies. Waste, lost profit and capital cost add up to the
    total cost.
    """
    week = F.struct("cutoff", "y", "wanted", "cost", "price", "life")
    folded = (
        weeks.groupBy("policy", "unique_id").agg(F.array_sort(F.collect_list(week)).alias("weeks"), F.sum("y").alias("y"))
        .withColumn("s", F.expr(_SIMULATION)).select("policy", "y", "s.*")
    )
    scored = folded.groupBy("policy").agg(*_scores(
        MODE_CARRY, F.sum("ordered"), F.sum("short"), F.sum("waste"), F.sum("served"), F.sum("demanded"),
        excess_value=F.sum("waste_value"), lost_profit=F.sum("lost_profit"),
        holding_cost=F.sum("holding") * rules.holding_rate_week))
    return scored.withColumn("total_cost", F.col("lost_profit") + F.col("excess_value") + F.col("holding_cost"))


def policy_change(scores: DataFrame, policy: str, against: str) -> DataFrame:
    """Relative change of every cost component when `policy` replaces `against`."""
    names = [c for c in ("units_ordered", "units_short", "units_excess", "excess_value", "lost_profit", "holding_cost",
                         "total_cost") if c in scores.columns]
    long = scores.select("mode", "policy", *names).unpivot(["mode", "policy"], names, "component", "value")
    of = lambda name: F.max(F.when(F.col("policy") == name, F.col("value")))
    return long.groupBy("mode", "component").agg(of(policy).alias("new"), of(against).alias("old")).withColumn(
        "change", F.try_divide("new", "old") - 1)
