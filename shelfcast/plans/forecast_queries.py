"""Queries for series, forecasts, scoring, orders, monitoring and what-ifs."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from shelfcast.functions.holidays import holiday_offset
from shelfcast.functions.sampling import bottom_k
from shelfcast.functions.tables import shared_folder
from shelfcast.operators import (
    evaluate, explain, forecast, kpi, learner, marts, monitor, policy, scenario, series as ts)
from shelfcast.params import SCOPE_ALL, SNAPSHOT_LIVE
from shelfcast.plans.catalog import contest, query
from shelfcast.plans.layers import Layers
from shelfcast.sources import sinks

DAY = "unique_id:s ds:t"
FORECAST = "unique_id:s cutoff:t ds:t model:s yhat:r"
QUANTILES = "q10:r q50:r q55:r q70:r q80:r q90:r n_weeks:i"
SNAPSHOT = ("run_id:s kind:s created_at:T data_until:T week_start:T model:s unique_id:s forecast_week:r order_qty:r")
RUN = "run_id:s kind:s week_start:t model:s wmape:r bias:r actual_total:d forecast_total:d n_series:i"


# --- series ----------------------------------------------------------------------------------

@query(DAY + " y_raw:d is_closed:b in_holiday_window:b cat_l1:s cat_l2:s")
def ts_dense(t: Layers) -> DataFrame:
    return ts.dense_series(t.daily, t.calendar, t.rules)


@query("date:t off:i")
def ts_holiday_offset(t: Layers) -> DataFrame:
    return t.calendar.select("date", holiday_offset("date", t.rules).alias("off"))


@query(DAY + " y:d is_imputed:b")
def ts_impute(t: Layers) -> DataFrame:
    return ts.imputed(ts.dense_series(t.daily, t.calendar, t.rules), t.rules)


@query(DAY + " y:d is_imputed:b")
def ts_sample(t: Layers) -> DataFrame:
    """A sample of 2,000 days of series, as an explanation by sampled rows would take it."""
    return bottom_k(ts.imputed(ts.dense_series(t.daily, t.calendar, t.rules), t.rules), 2000, ["unique_id", "ds"])


@query("unique_id:s cat_l1:s cat_l2:s sale_days:i open_days:i adi:r cv2:r total_qty:d mean_daily_qty:r demand_class:s")
def ts_demand_class(t: Layers) -> DataFrame:
    return ts.demand_classes(t.series, t.rules)


@query(DAY + " y:d lag1:d lag2:d lag3:d lag7:d lag14:d lag21:d lag28:d rolling_mean_7:r rolling_mean_28:r "
             "rolling_std_28:r expanding_mean:r rolling_mean_28_lag7:r dayofweek:i day:i cat_l1:s")
def ts_features(t: Layers) -> DataFrame:
    return ts.features(t.series)


@query(DAY + " cutoff:t window:i phase:s y_raw:d is_closed:b")
def ts_walk_forward(t: Layers) -> DataFrame:
    return ts.walk_forward(t.series, t.cutoffs, t.rules.horizon, t.rules.n_selection)


# --- forecasts ---------------------------------------------------------------------------------

def _averages(t: Layers, model: str) -> DataFrame:
    fc = forecast.averages(t.eligible(t.profile_before), t.cutoffs, t.rules.horizon)
    return fc.filter(F.col("model") == model)


@query(FORECAST)
def fc_historic_average(t: Layers) -> DataFrame:
    return _averages(t, "HistoricAverage")


@query(FORECAST)
def fc_moving_avg28(t: Layers) -> DataFrame:
    return _averages(t, "MovingAvg28")


@query(FORECAST)
def fc_seasonal_naive(t: Layers) -> DataFrame:
    return _averages(t, "SeasonalNaive")


@query(FORECAST)
def fc_croston(t: Layers) -> DataFrame:
    return forecast.intermittent(t.eligible(t.profile_before), t.cutoffs, t.rules.horizon)


@query(FORECAST)
def fc_adida(t: Layers) -> DataFrame:
    fc = forecast.aggregated(t.eligible(t.profile_before), t.cutoffs, t.rules.horizon)
    return fc.filter(F.col("model") == "ADIDA")


@query(FORECAST)
def fc_imapa(t: Layers) -> DataFrame:
    fc = forecast.aggregated(t.eligible(t.profile_before), t.cutoffs, t.rules.horizon)
    return fc.filter(F.col("model") == "IMAPA")


@query(FORECAST)
def fc_tsb(t: Layers) -> DataFrame:
    return forecast.probability_smoothed(t.eligible(t.profile_before), t.cutoffs, t.rules.horizon)


@query(FORECAST)
def fc_ets(t: Layers) -> DataFrame:
    return t.statistical_backtest.filter(F.col("model") == "AutoETS")


@query(FORECAST)
def fc_global_tweedie(t: Layers) -> DataFrame:
    return t.learned_backtest


@query("place:i gap:d")
def fc_learner_score(t: Layers) -> DataFrame:
    """What is left of the fit at each weight, which must be nothing."""
    rows, _ = t.design
    return learner.score(rows, t.weights)


@query(FORECAST)
def fc_ensembles(t: Layers) -> DataFrame:
    return t.backtest_forecasts.filter(F.col("model").isin(*forecast.ENSEMBLES))


@query("unique_id:s cutoff:t ds:t model:s gap:r")
def fc_ensembles_gap(t: Layers) -> DataFrame:
    """Each ensemble against the mean of its members, which must leave nothing."""
    wide = t.backtest_forecasts.groupBy("unique_id", "cutoff", "ds").pivot("model", list(forecast.MODEL_ORDER)).agg(F.max("yhat"))
    gaps = F.array(*[
        F.struct(F.lit(name).alias("model"), (F.col(name) - sum(F.col(m) for m in members) / len(members)).alias("gap"))
        for name, members in forecast.ENSEMBLES.items()])
    return wide.select("unique_id", "cutoff", "ds", F.inline(gaps))


@contest(FORECAST)
def fc_future(t: Layers) -> DataFrame:
    return t.future_forecasts


FALLBACK_MIN_DAYS = 1300


@query(FORECAST)
def fc_fallback56(t: Layers) -> DataFrame:
    """The driver series are all long, so a higher bar makes some of them thin."""
    rules = t.rules.scaled(min_sale_days=FALLBACK_MIN_DAYS)
    profile = ts.demand_classes(t.series, rules)
    return forecast.fallback(t.series, profile, t.last_day, rules.long_horizon, rules)


# --- scoring --------------------------------------------------------------------------------------

@contest("unique_id:s cutoff:t model:s window:i phase:s y:d yhat:r demand_class:s")
def ev_weekly(t: Layers) -> DataFrame:
    return evaluate.weekly(t.backtest, t.profile_before, t.rules)


METRICS = "scope:s model:s MAE:r WMAPE:r Bias:r MdAPE:r"


@contest(METRICS)
def ev_metrics(t: Layers) -> DataFrame:
    return evaluate.metrics(t.weeks)


@contest("unique_id:s model:s tracking_signal:r")
def ev_tracking_signal(t: Layers) -> DataFrame:
    return t.weeks.filter("phase = 'holdout'").groupBy("unique_id", "model").agg(
        evaluate.tracking_signal().alias("tracking_signal"))


def _others(t: Layers) -> list[str]:
    return [m for m in t.models if m != t.champion]


@contest("compared_to:s n_days:i mean_diff:r share_days_better:r dm_stat:r")
def ev_dm_stat(t: Layers) -> DataFrame:
    held = t.backtest.filter(F.col("cutoff") >= F.lit(t.holdout_start))
    return evaluate.diebold_mariano(held, t.champion, _others(t), t.rules.horizon)


@contest("compared_to:s n_series:i mean_abs_err_diff:r share_series_better:r w_stat:d z_stat:r")
def ev_wilcoxon(t: Layers) -> DataFrame:
    return evaluate.wilcoxon(t.weeks, t.champion, _others(t))


@contest("model:s compared_to:s n_series:i mean_abs_err_diff:r share_series_better:r w_stat:d z_stat:r wilcoxon_p:r "
         "n_days:i share_days_better:r dm_stat:r dm_p:r")
def ev_significance(t: Layers) -> DataFrame:
    """Both tests against every other model, with p-values."""
    return evaluate.significance(t.backtest, t.weeks, t.champion, _others(t), t.rules.horizon)


@contest("model:s wmape:r bias:r")
def ev_champion(t: Layers) -> DataFrame:
    return t.champion_row


@contest("level:s model:s WMAPE:r Bias:r")
def ev_levels(t: Layers) -> DataFrame:
    return evaluate.level_errors(t.weeks)


@contest("unique_id:s wmape:r wmape_baseline:r bias:r tracking_signal:r holdout_qty:d improved:b")
def ev_per_series(t: Layers) -> DataFrame:
    return evaluate.per_series(t.weeks, t.champion)


@contest("unique_id:s demand_class:s wmape:r confidence:s")
def ev_confidence(t: Layers) -> DataFrame:
    return evaluate.per_series(t.weeks, t.champion)


@contest("champion:s holdout_wmape:r baseline_wmape:r store_wmape:r share_improved:r n_series:i n_modelled:i n_backtest:i "
         "data_until:t first_cutoff:t holdout_cutoff:t")
def ev_run_summary(t: Layers) -> DataFrame:
    return t.run_info()


@contest("model:s wmape_selection:r wmape_holdout:r rank_selection:r rank_holdout:r")
def kpi_model_compare(t: Layers) -> DataFrame:
    return evaluate.model_comparison(evaluate.metrics(t.weeks))


@query(METRICS)
def kpi_model_compare_all(t: Layers) -> DataFrame:
    """The error table of every model, the learned ones included."""
    return evaluate.metrics(t.weeks)


@contest("model:s smooth:r erratic:r intermittent:r lumpy:r")
def kpi_class_by_model(t: Layers) -> DataFrame:
    return evaluate.class_by_model(evaluate.metrics(t.weeks))


@query("demand_class:s n_series:i qty_share:r")
def kpi_class_mix(t: Layers) -> DataFrame:
    return evaluate.class_mix(t.profile)


@contest("n_biased:i n_high:i n_low:i")
def kpi_biased_series(t: Layers) -> DataFrame:
    return evaluate.biased_series(t.report, t.rules)


# --- orders ------------------------------------------------------------------------------------------

@contest("demand_class:s " + QUANTILES)
def pol_ratio_quantiles(t: Layers) -> DataFrame:
    return policy.ratio_quantiles(t.weeks.filter(F.col("model") == t.champion), t.rules)


@contest("demand_class:s horizon_week:i " + QUANTILES)
def pol_horizon_quantiles(t: Layers) -> DataFrame:
    return t.quantiles


@query("unique_id:s cat_l2:s quadrant:s service_class:s tau:r")
def pol_service_class(t: Layers) -> DataFrame:
    return policy.service_classes(t.profile, marts.category_margin(t.staged), t.rules)


HOLIDAY_CUTOFF = date(2001, 1, 31)


@query("unique_id:s ds:t model:s yhat:r holiday_window:s holiday_factor:r forecast:r")
def pol_holiday_layer(t: Layers) -> DataFrame:
    """Forecasts made shortly before a holiday of the data span."""
    fc = forecast.averages(t.eligible(t.profile), [HOLIDAY_CUTOFF], t.rules.long_horizon)
    return policy.holiday_layer(fc, t.profile, marts.holiday_effect(t.daily, t.rules), t.rules)


PLAN = ("unique_id:s cat_l1:s cat_l2:s week_start:t demand_class:s confidence:s service_class:s tau:r quadrant:s wmape:r "
        "forecast_week:r lower_80:r upper_80:r order_qty:d unit_cost:d order_value:d")


@contest(PLAN)
def pol_order_plan(t: Layers) -> DataFrame:
    return t.plan


@contest("cat_l2:s sku:s product_name:s qty:d share:r order_qty:d sku_forecast_week:r sku_order_qty:d")
def pol_sku_allocation(t: Layers) -> DataFrame:
    level = t.rules.series_level
    return policy.allocate(marts.recent_sku_shares(t.staged, t.rules, level), t.plan, level)


SCORES = "mode:s policy:s units_ordered:d units_short:d units_excess:d service_level:r fill_rate:r excess_value:d"


@contest(SCORES)
def pol_backtest_single(t: Layers) -> DataFrame:
    return policy.single_period(t.policy_weeks)


@contest(SCORES + " lost_profit:d holding_cost:d total_cost:d")
def pol_backtest_carry(t: Layers) -> DataFrame:
    return policy.carry_over(t.policy_weeks, t.rules)


@contest("mode:s component:s new:d old:d change:r")
def kpi_policy_change(t: Layers) -> DataFrame:
    both = policy.single_period(t.policy_weeks).unionByName(
        policy.carry_over(t.policy_weeks, t.rules), allowMissingColumns=True)
    return policy.policy_change(both, "quantile", "moving_average")


@contest("total_value:d n_ordered:i top_rank:i unique_id:s order_qty:d forecast_week:r order_value:d confidence:s")
def kpi_plan_totals(t: Layers) -> DataFrame:
    totals = t.plan.agg(F.struct(
        F.sum("order_value").alias("value"), F.count_if(F.col("order_qty") > 0).alias("n"))).scalar()
    top = t.plan.orderBy(F.col("order_qty").desc(), "unique_id").limit(t.rules.top_skus)
    return top.withColumn("_t", totals).select(
        F.col("_t.value").alias("total_value"), F.col("_t.n").alias("n_ordered"),
        F.row_number().over(Window.orderBy(F.col("order_qty").desc(), "unique_id")).alias("top_rank"),
        "unique_id", "order_qty", "forecast_week", "order_value", "confidence")


@contest("unique_id:s cat_l1:s service_class:s forecast_week:r order_qty:d order_value:d")
def sink_order_plan(t: Layers) -> DataFrame:
    """The plan of two service classes as CSV, read back as text and cast."""
    path = f"{shared_folder(t.spark)}/shelfcast/{t.spark.sparkContext.applicationId}/order-plan-csv-{uuid.uuid4().hex[:8]}"
    sinks.export_plan_csv(sinks.filtered_plan(t.plan, service_class=["Ngôi sao", "Bảo quản lâu"]), path)
    return t.spark.read.option("header", True).schema(
        sinks.filtered_plan(t.plan).schema).csv(path)


@contest("unique_id:s block_start:t kind:s value:r lower:r upper:r")
def kpi_series_view(t: Layers) -> DataFrame:
    """Ten past weeks and the forecast weeks of every series, with the band of each week."""
    end = F.lit(t.last_day)
    recent = t.series.filter(~F.col("is_closed") & (F.datediff(end, "ds") < 70))
    past = kpi.weekly_blocks(recent, "ds", "y_raw", end, keys=("unique_id",)).select(
        "unique_id", "block_start", F.lit("actual").alias("kind"), "value",
        F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    ahead = kpi.weekly_blocks(t.future, "ds", "forecast", end, future=True, keys=("unique_id",))
    fill = Window.partitionBy("unique_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    banded = (
        ahead.join(t.profile.select("unique_id", "demand_class"), "unique_id")
        .withColumn("horizon_week", F.col("block") + 1)
        .join(t.quantiles.select("demand_class", "horizon_week", "q10", "q90"), ["demand_class", "horizon_week"], "left")
        .withColumn("lower", F.col("value") * F.last("q10", True).over(fill))
        .withColumn("upper", F.col("value") * F.last("q90", True).over(fill))
        .select("unique_id", "block_start", F.lit("forecast").alias("kind"), "value", "lower", "upper"))
    return past.unionByName(banded)


# --- monitoring ------------------------------------------------------------------------------------

@contest(SNAPSHOT)
def snap_backfill(t: Layers) -> DataFrame:
    return monitor.backfill(t.weeks, t.champion)


@contest(SNAPSHOT)
def snap_upsert(t: Layers) -> DataFrame:
    """Save the replayed weeks, then a corrected run of the newest one: it replaces the old."""
    saved = monitor.backfill(t.weeks, t.champion)
    newest = saved.filter(F.col("data_until") == F.lit(t.cutoffs[-1]).cast("timestamp"))
    corrected = newest.withColumn("run_id", F.lit("corrected")).withColumn("forecast_week", F.col("forecast_week") + 1)
    return monitor.upsert(saved, corrected)


@contest(RUN)
def mon_snapshot_eval(t: Layers) -> DataFrame:
    return monitor.evaluate_snapshots(monitor.backfill(t.weeks, t.champion), t.series, F.lit(t.last_day))


def _flags(t: Layers) -> DataFrame:
    reference = evaluate.metrics(t.weeks).filter(
        (F.col("scope") == SCOPE_ALL) & (F.col("model") == t.champion)).agg(F.max("WMAPE")).scalar()
    return monitor.drift(mon_snapshot_eval(t), reference, t.rules)


@contest("run_id:s week_start:t wmape:r tracking_signal:r over_limit:b biased:b flagged:b is_latest:b")
def mon_drift(t: Layers) -> DataFrame:
    return _flags(t)


@contest("data_until:t new_days:i drifted:b retrain:b")
def mon_retrain(t: Layers) -> DataFrame:
    status = monitor.drift_status(_flags(t))
    kind = "Mô phỏng lại"
    return monitor.retrain_decision(t.calendar, t.cutoffs[-1], status, kind)


@contest("kind:s n_weeks:i accuracy:r")
def mon_accuracy(t: Layers) -> DataFrame:
    return monitor.total_accuracy(mon_snapshot_eval(t))


@contest("run_id:s kind:s week_start:t created_at:t forecast_total:r")
def mon_snapshot_list(t: Layers) -> DataFrame:
    return monitor.snapshot_list(monitor.backfill(t.weeks, t.champion))


# --- what-ifs ------------------------------------------------------------------------------------------

@contest("cat_l1:s slope:r net_factor:r base_week:r scenario_week:r extra_order:r")
def sc_discount(t: Layers) -> DataFrame:
    return scenario.discount(t.plan, marts.price_response(t.daily), discount_pct=10, cannibal_pct=50)


@contest("cat_l1:s qty_factor:r normal_two_weeks:r before_holiday:r stock_up:r total:r")
def sc_holiday(t: Layers) -> DataFrame:
    return scenario.holiday(t.plan, marts.holiday_effect(t.daily, t.rules), closed_days=10, stock_up_pct=50)


# --- explanations -----------------------------------------------------------------------------------------

@query("group:s mean_abs_contribution:r")
def xp_global(t: Layers) -> DataFrame:
    rows, categories = t.design
    return explain.global_importance(rows, t.weights, categories)


@query("unique_id:s ds:t group:s base_value:r contribution:r effect_pct:r")
def xp_local(t: Layers) -> DataFrame:
    return t.contributions


@query("unique_id:s ds:t gap:r")
def xp_local_gap(t: Layers) -> DataFrame:
    """Base and contributions against the log of the forecast, which must leave nothing."""
    told = t.contributions.groupBy("unique_id", "ds", "base_value").agg(F.sum("contribution").alias("moved"))
    return told.join(t.learned_future, ["unique_id", "ds"]).withColumn(
        "gap", F.col("base_value") + F.col("moved") - F.log("yhat"))


@query("unique_id:s ds:t step:i group:s start:r from_level:r to_level:r effect_pct:r")
def xp_waterfall(t: Layers) -> DataFrame:
    return explain.waterfall(t.contributions)


@query("unique_id:s ds:t gap:r")
def xp_waterfall_gap(t: Layers) -> DataFrame:
    """The last step of each waterfall relative to the forecast, which must leave nothing."""
    ends = explain.waterfall(t.contributions).groupBy("unique_id", "ds").agg(F.max_by("to_level", "step").alias("end"))
    return ends.join(t.learned_future, ["unique_id", "ds"]).withColumn("gap", F.col("end") / F.col("yhat") - 1)
