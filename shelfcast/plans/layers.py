"""The tables other operators read, each built once per application and written.

Order: raw -> base -> staged -> calendar, prices -> daily -> series -> backtest. A layer is
built on first use; its readers then scan only the columns they need.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfcast.functions.tables import written
from shelfcast.operators import (
    evaluate, explain, forecast, learner, marts, policy, series as ts, smoothing, staging)
from shelfcast.params import BINDING, DEFAULT, FALLBACK_MODEL, Rules
from shelfcast.plans.session import prepared, sized_for
from shelfcast.sources.binding import numbered_sales_lines


class Inputs:
    """Everything up to the forecasts of every model, which no choice of a model changes."""

    def __init__(self, raw: DataFrame, rules: Rules = DEFAULT):
        """`raw` may hold the number of each invoice (`staging.INVOICE_NO`), which only the cleaning reads."""
        self.spark = prepared(raw.sparkSession)
        self.numbered, self.raw, self.rules = raw, raw.drop(staging.INVOICE_NO), rules

    @cached_property
    def base(self) -> DataFrame:
        return written(staging.clean_base(self.numbered, self.rules), "base")

    @cached_property
    def staged(self) -> DataFrame:
        return staging.unpacked(written(staging.packed(staging.stage_lines(self.base, self.rules)), "staged"))

    @cached_property
    def calendar(self) -> DataFrame:
        return written(staging.calendar(self.staged), "calendar")

    @cached_property
    def prices(self) -> DataFrame:
        return written(staging.usual_prices(self.staged), "prices")

    @cached_property
    def daily(self) -> DataFrame:
        return written(marts.daily_category(self.staged, self.calendar, None, self.rules), "daily")

    # --- series and backtests ------------------------------------------------------------

    @cached_property
    def last_day(self) -> date:
        return self.calendar.agg(F.max("date")).first()[0]

    @cached_property
    def series(self) -> DataFrame:
        dense = ts.dense_series(self.daily, self.calendar, self.rules)
        return written(ts.imputed(dense, self.rules), "series")

    @property
    def cutoffs(self) -> list[date]:
        r = self.rules
        return ts.cutoffs(self.last_day, r.horizon, r.n_windows, r.horizon)

    @property
    def holdout_start(self) -> date:
        """The last day known before the first hold-out window."""
        return self.cutoffs[self.rules.n_selection]

    @cached_property
    def profile(self) -> DataFrame:
        return written(ts.demand_classes(self.series, self.rules), "profile")

    @cached_property
    def profile_before(self) -> DataFrame:
        """Classes as known at the first cutoff."""
        return written(ts.demand_classes(self.series, self.rules, until=self.cutoffs[0]), "profile_before")

    def eligible(self, profile: DataFrame) -> DataFrame:
        enough = profile.filter(F.col("demand_class") != "insufficient").select("unique_id")
        return self.series.join(enough, "unique_id", "left_semi")

    @cached_property
    def features(self) -> DataFrame:
        return written(ts.features(self.series), "features")

    def statistical(self, known: DataFrame, last_days: list[date], horizon: int) -> DataFrame:
        """Every method that works series by series, long form."""
        return (
            forecast.native_forecasts(known, last_days, horizon)
            .unionByName(forecast.intermittent(known, last_days, horizon))
            .unionByName(forecast.aggregated(known, last_days, horizon))
            .unionByName(smoothing.seasonal_smoothing(known, last_days, horizon)))

    def learned(self, known: DataFrame, last_days: list[date], horizon: int) -> DataFrame:
        rows = self.features.join(known.select("unique_id").distinct(), "unique_id", "left_semi")
        return learner.learned_forecasts(known, rows, last_days, horizon)

    @cached_property
    def statistical_backtest(self) -> DataFrame:
        known = self.eligible(self.profile_before)
        return written(self.statistical(known, self.cutoffs, self.rules.horizon), "statistical_backtest")

    @cached_property
    def learned_backtest(self) -> DataFrame:
        known = self.eligible(self.profile_before)
        return written(self.learned(known, self.cutoffs, self.rules.horizon).drop("x"), "learned_backtest")

    @cached_property
    def statistical_future(self) -> DataFrame:
        known = self.eligible(self.profile)
        return written(self.statistical(known, [self.last_day], self.rules.long_horizon), "statistical_future")

    @cached_property
    def learned_future(self) -> DataFrame:
        """The learner's forecasts ahead, with the model columns that explain them."""
        known = self.eligible(self.profile)
        return written(self.learned(known, [self.last_day], self.rules.long_horizon), "learned_future")

    @cached_property
    def design(self) -> tuple[DataFrame, list[str]]:
        """The learner's training rows up to the last day, and its top-level categories."""
        known = self.eligible(self.profile).select("unique_id").distinct()
        rows = self.features.join(known, "unique_id", "left_semi")
        categories = learner.top_categories(rows)
        return written(learner.design(rows, categories), "design_rows"), categories

    @cached_property
    def weights(self):
        rows, categories = self.design
        return learner.fit(rows, len(learner.design_names(categories)))

    @cached_property
    def contributions(self) -> DataFrame:
        """What makes the learner's forecasts of the next days, per feature group."""
        rows, categories = self.design
        return written(explain.local_contributions(self.learned_future, rows, self.weights, categories), "contributions")


class Layers:
    """All tables of one set of raw lines. Every model in `models` competes for the plan.

    The tables below a contest are shared: `layers.among(models)` holds another contest over
    the same inputs, and any table of `Inputs` can be asked for here. Only `contenders` may win;
    all models may, if none are named.
    """

    def __init__(self, raw: DataFrame, rules: Rules = DEFAULT, models: tuple[str, ...] = forecast.MODEL_ORDER,
                 inputs: Inputs | None = None, contenders: tuple[str, ...] = ()):
        self.inputs, self.models, self.contenders = inputs or Inputs(raw, rules), tuple(models), tuple(contenders or models)
        self._among: dict[tuple, Layers] = {}

    def __getattr__(self, name: str):
        if name == "inputs":
            raise AttributeError(name)
        return getattr(self.inputs, name)

    def among(self, models: tuple[str, ...], contenders: tuple[str, ...] = ()) -> Layers:
        if (models, contenders) not in self._among:
            self._among[models, contenders] = Layers(self.raw, self.rules, models, self.inputs, contenders)
        return self._among[models, contenders]

    def _competing(self, statistical: DataFrame, learned) -> DataFrame:
        """Forecasts of the competing models; the learner is only asked where it is needed."""
        if set(self.models) <= set(forecast.STATISTICAL):
            return statistical.filter(F.col("model").isin(*self.models))
        single = statistical.unionByName(learned())
        return single.unionByName(forecast.ensembles(single)).filter(F.col("model").isin(*self.models))

    @cached_property
    def backtest_forecasts(self) -> DataFrame:
        return self._competing(self.statistical_backtest, lambda: self.learned_backtest)

    @cached_property
    def future_forecasts(self) -> DataFrame:
        return self._competing(self.statistical_future, lambda: self.learned_future.drop("x"))

    @cached_property
    def backtest(self) -> DataFrame:
        """Forecasts of open days next to actual sales."""
        return written(evaluate.daily_errors(self.backtest_forecasts, self.series), "backtest")

    @cached_property
    def weeks(self) -> DataFrame:
        return written(evaluate.weekly(self.backtest, self.profile_before, self.rules), "weeks")

    @cached_property
    def champion(self) -> str:
        return self.champion_row.first()["model"]

    @property
    def champion_row(self) -> DataFrame:
        able = self.weeks.filter(F.col("model").isin(*self.contenders))
        return evaluate.champion(able, self.rules, forecast.MODEL_ORDER)

    # --- the plan of next week, from the champion ---------------------------------------------

    def unit_prices(self, **options) -> DataFrame:
        prices = marts.category_unit_price(self.staged, level=self.rules.series_level, **options)
        return prices.withColumnRenamed(self.rules.series_level, "unique_id")

    def champion_forecasts(self, last_days: list[date], horizon: int) -> DataFrame:
        """Forecasts of the champion at any cutoffs; only its members are computed."""
        known, members = self.eligible(self.profile_before), set(forecast.ENSEMBLES.get(self.champion, (self.champion,)))
        parts = [build(known, last_days, horizon) for names, build in forecast.METHODS if names & members]
        if "AutoETS" in members:
            parts.append(smoothing.seasonal_smoothing(known, last_days, horizon))
        if "GlobalTweedie" in members:
            parts.append(self.learned(known, last_days, horizon).drop("x"))
        single = reduce(DataFrame.unionByName, parts)
        return single.unionByName(forecast.ensembles(single)).filter(F.col("model") == self.champion)

    @cached_property
    def long_daily(self) -> DataFrame:
        """Backtest of the champion with the long horizon, for quantiles per week ahead."""
        r = self.rules
        days = ts.cutoffs(self.last_day, r.long_horizon, r.long_windows, r.horizon)
        return written(evaluate.daily_errors(self.champion_forecasts(days, r.long_horizon), self.series), "long_daily")

    @cached_property
    def quantiles(self) -> DataFrame:
        """Week 1 from the weekly backtest; later weeks only for champions that are backtested
        that far. For the others, readers carry the last week there is."""
        first = policy.ratio_quantiles(self.weeks.filter(F.col("model") == self.champion), self.rules)
        if self.champion not in policy.LONG_TESTED:
            return written(policy.calibrated(first), "quantiles")
        later = policy.horizon_quantiles(self.long_daily, self.profile_before, self.champion, self.rules)
        return written(policy.calibrated(first, later), "quantiles")

    @cached_property
    def future_daily(self) -> DataFrame:
        """28 days ahead, holiday layer applied: every competing model, and the fallback of thin series."""
        r = self.rules
        thin = forecast.fallback(self.series, self.profile, self.last_day, r.long_horizon, r)
        effect = marts.holiday_effect(self.daily, r)
        layered = policy.holiday_layer(self.future_forecasts, self.profile, effect, r)
        plain = (
            thin.join(self.profile.select("unique_id", "cat_l1"), "unique_id")
            .withColumn("holiday_window", F.lit(None).cast("string"))
            .withColumn("holiday_factor", F.lit(None).cast("double")).withColumn("forecast", F.col("yhat")))
        return written(layered.unionByName(plain), "future")

    @cached_property
    def future(self) -> DataFrame:
        """What the plan is made from: the champion, and the fallback."""
        return self.future_daily.filter(F.col("model").isin(self.champion, FALLBACK_MODEL))

    @cached_property
    def report(self) -> DataFrame:
        return written(evaluate.per_series(self.weeks, self.champion), "report")

    def run_info(self) -> DataFrame:
        """One row on this run: the days it rests on, the champion, its errors, what was modelled."""
        found = evaluate.run_summary(
            evaluate.metrics(self.weeks), evaluate.level_errors(self.weeks), self.report, self.profile, self.champion)
        days = {"data_until": self.last_day, "first_cutoff": self.cutoffs[0], "holdout_cutoff": self.holdout_start}
        return found.withColumns({name: F.lit(day) for name, day in days.items()})

    @cached_property
    def plan(self) -> DataFrame:
        classes = policy.service_classes(self.profile, marts.category_margin(self.staged), self.rules)
        scored = self.profile.select("unique_id", "demand_class").join(
            self.report.select("unique_id", "wmape"), "unique_id", "left")
        labelled = scored.withColumn("confidence", evaluate.confidence())
        return written(
            policy.order_plan(self.future, classes, self.quantiles, self.unit_prices(), labelled), "plan")

    def policies(self) -> dict:
        """Ordering rules compared on the hold-out weeks, as columns of the wide weeks."""
        return {
            "baseline": F.col("HistoricAverage"), "moving_average": F.col("MovingAvg28"),
            "point": F.col(self.champion), "quantile": F.col(self.champion) * F.col("factor"),
        }

    @cached_property
    def prices_before(self) -> DataFrame:
        return written(self.unit_prices(until=self.holdout_start, actual_cost_only=True), "prices_before")

    @cached_property
    def policy_weeks(self) -> DataFrame:
        """Every parameter comes from before the hold-out: margins with actual costs, ratios
        of the selection weeks, prices, demand classes."""
        r, cut = self.rules, self.holdout_start
        margin = marts.category_margin(self.staged, until=cut, actual_cost_only=True)
        classes = policy.service_classes(self.profile_before, margin, r).select("unique_id", "tau")
        selection = self.weeks.filter((F.col("phase") == "selection") & (F.col("model") == self.champion))
        ratios = policy.ratio_quantiles(selection, r).drop("n_weeks")
        models = sorted({"HistoricAverage", "MovingAvg28", self.champion})
        wide = (
            self.weeks.filter(F.col("phase") == "holdout").groupBy("unique_id", "cutoff", "demand_class")
            .agg(F.max("y").alias("y"), *[F.max(F.when(F.col("model") == m, F.col("yhat"))).alias(m) for m in models])
            .join(classes, "unique_id").join(ratios, "demand_class", "left")
            .withColumn("factor", F.coalesce(policy.quantile_at(F.col("tau")), F.lit(1.0)))
        )
        return written(policy.policy_weeks(wide, self.policies(), self.prices_before, r), "policy_weeks")


_built: dict[tuple[str, str], Layers] = {}


def layers_for(spark: SparkSession, sf_dir: str) -> Layers:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        sized_for(prepared(spark), [f"{sf_dir}/{name}.parquet" for name in ("lineitem", "orders", "part")])
        _built[key] = Layers(numbered_sales_lines(spark, sf_dir), BINDING)
    return _built[key]
