"""Scoring of backtest forecasts, in long form: one row per series, week and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.functions.medians import banded_median
from shelfcast.functions.pvalues import normal_p, student_p
from shelfcast.functions.scans import ordered_running
from shelfcast.operators.marts import rows
from shelfcast.params import (
    CONF_HIGH, CONF_LOW, CONF_MID, CONF_NONE, LEVEL_L1, LEVEL_L2, LEVEL_L3, Rules, SCOPE_ALL,
    SCOPE_SELECTION, WHOLE_STORE,
)

BASELINE = "HistoricAverage"


def daily_errors(forecasts: DataFrame, series: DataFrame) -> DataFrame:
    """Forecasts next to the actual sales of open days."""
    actual = series.filter(~F.col("is_closed")).select("unique_id", "ds", "y_raw")
    return forecasts.select("unique_id", "cutoff", "ds", "model", "yhat").join(actual, ["unique_id", "ds"])


def weekly(daily: DataFrame, profile: DataFrame, rules: Rules) -> DataFrame:
    """Daily forecasts summed per window, open days only, with window number and phase."""
    sums = daily.groupBy("unique_id", "cutoff", "model").agg(
        F.sum("y_raw").alias("y"), F.sum("yhat").alias("yhat"))
    # One row per cutoff: the unpartitioned rank sees a dozen rows.
    numbered = daily.select("cutoff").distinct().withColumn(
        "window", F.dense_rank().over(Window.orderBy("cutoff")))
    phase = F.when(F.col("window") <= rules.n_selection, "selection").otherwise("holdout")
    return (
        sums.join(numbered, "cutoff").withColumn("phase", phase)
        .join(profile.select("unique_id", "demand_class", "cat_l1", "cat_l2"), "unique_id")
    )


# --- error measures as aggregates over columns y and yhat ------------------------------------

def error() -> Column:
    return F.col("yhat") - F.col("y")


def wmape() -> Column:
    return F.try_divide(F.sum(F.abs(error())), F.sum(F.abs("y")))


def bias() -> Column:
    return F.try_divide(F.sum(error()), F.sum(F.abs("y")))


def mae() -> Column:
    return F.avg(F.abs(error()))


def relative_error() -> Column:
    """Only weeks with sales have one; its median is the MdAPE."""
    return F.when(F.col("y") > 0, F.abs(error()) / F.col("y"))


def tracking_signal() -> Column:
    """Accumulated error over mean absolute error; positive means forecasts run high."""
    return F.coalesce(F.try_divide(F.sum(error()), F.avg(F.abs(error()))), F.lit(0.0))


def metrics(weeks: DataFrame) -> DataFrame:
    """Error measures per model: hold-out overall, hold-out per demand class, selection."""
    holdout = F.col("phase") == "holdout"
    scopes = F.when(holdout, F.array(F.lit(SCOPE_ALL), F.col("demand_class"))).otherwise(
        F.array(F.lit(SCOPE_SELECTION)))
    scoped = weeks.withColumn("scope", F.explode(scopes)).withColumn("_relative", relative_error())
    means = scoped.groupBy("scope", "model").agg(mae().alias("MAE"), wmape().alias("WMAPE"), bias().alias("Bias"))
    return means.join(banded_median(scoped, ["scope", "model"], "_relative", "MdAPE"), ["scope", "model"], "left")


def champion(weeks: DataFrame, rules: Rules, order: tuple[str, ...]) -> DataFrame:
    """One row: the model with the lowest selection WMAPE among those with little bias; if
    none has, the lowest WMAPE. The order of the model list settles ties."""
    places = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    scored = weeks.filter(F.col("phase") == "selection").groupBy("model").agg(
        wmape().alias("wmape"), bias().alias("bias"))
    too_biased = F.abs("bias") > rules.max_abs_bias
    best = F.min(F.struct(too_biased.alias("rejected"), F.col("wmape"), places.alias("place"), F.col("model"), "bias"))
    return scored.agg(best.alias("b")).select(
        F.col("b.model").alias("model"), F.col("b.wmape").alias("wmape"), F.col("b.bias").alias("bias"))


def level_errors(weeks: DataFrame) -> DataFrame:
    """Hold-out errors after adding series up: level 3, level 2, level 1, whole store.

    The series itself is the lowest level, whatever level it was built on.
    """
    levels = F.array(*[
        F.struct(F.lit(name).alias("level"), key.alias("member"))
        for name, key in ((LEVEL_L3, F.col("unique_id")), (LEVEL_L2, F.col("cat_l2")),
                          (LEVEL_L1, F.col("cat_l1")), (WHOLE_STORE, F.lit("")))])
    summed = (
        weeks.filter(F.col("phase") == "holdout").select("cutoff", "model", "y", "yhat", F.inline(levels))
        .groupBy("level", "member", "cutoff", "model").agg(F.sum("y").alias("y"), F.sum("yhat").alias("yhat"))
    )
    return summed.groupBy("level", "model").agg(
        wmape().alias("WMAPE"), F.try_divide(F.sum(error()), F.sum("y")).alias("Bias"))


def per_series(weeks: DataFrame, chosen: str) -> DataFrame:
    """Hold-out report of each series for the chosen model against the baseline."""
    holdout = weeks.filter(F.col("phase") == "holdout")
    ours = holdout.filter(F.col("model") == chosen).groupBy("unique_id", "demand_class", "cat_l1", "cat_l2").agg(
        wmape().alias("wmape"), (F.sum(error()) / F.greatest(F.sum("y"), F.lit(1e-9))).alias("bias"),
        tracking_signal().alias("tracking_signal"), F.sum("y").alias("holdout_qty"))
    base = holdout.filter(F.col("model") == BASELINE).groupBy("unique_id").agg(wmape().alias("wmape_baseline"))
    return (
        ours.join(base, "unique_id")
        # Rounded, so that equal forecasts do not differ by the order of their sums.
        .withColumn("improved", F.coalesce(F.round("wmape", 9) < F.round("wmape_baseline", 9), F.lit(False)))
        .withColumn("confidence", confidence())
    )


def confidence() -> Column:
    """Label shown next to a forecast, from the series' own hold-out error."""
    unknown = (F.col("demand_class") == "insufficient") | F.col("wmape").isNull()
    return (
        F.when(unknown, CONF_NONE).when(F.col("wmape") <= 0.30, CONF_HIGH)
        .when(F.col("wmape") <= 0.50, CONF_MID).otherwise(CONF_LOW)
    )


# --- significance ------------------------------------------------------------------------------

def _against(errors: DataFrame, keys: list[str], chosen: str, others: list[str]) -> DataFrame:
    """Mean absolute-error difference (chosen minus other) per key and compared model."""
    ours = errors.filter(F.col("model") == chosen).select(*keys, F.abs(error()).alias("_ours"))
    theirs = errors.filter(F.col("model").isin(others)).select(
        *keys, F.col("model").alias("compared_to"), F.abs(error()).alias("_theirs"))
    return theirs.join(ours, keys).withColumn("diff", F.col("_ours") - F.col("_theirs"))


def diebold_mariano(daily: DataFrame, chosen: str, others: list[str], horizon: int) -> DataFrame:
    """Test on the daily mean loss difference: Newey-West variance with horizon - 1 lags and
    the small-sample factor. Windows see one row per hold-out day."""
    errors = daily.withColumnRenamed("y_raw", "y")
    per_day = _against(errors, ["unique_id", "cutoff", "ds"], chosen, others).groupBy("compared_to", "ds").agg(
        F.avg("diff").alias("d"))
    own = Window.partitionBy("compared_to")
    in_order = own.orderBy("ds")
    centred = per_day.withColumn("c", F.col("d") - F.avg("d").over(own))
    for k in range(horizon):
        centred = centred.withColumn(f"p{k}", F.col("c") * F.lag("c", k).over(in_order))
    t = F.col("n_days")
    gamma = [F.col(f"g{k}") / t for k in range(horizon)]
    long_run = gamma[0] + 2 * sum(gamma[1:], F.lit(0.0))
    factor = (t + 1 - 2 * horizon + horizon * (horizon - 1) / t) / t
    variance = F.when(long_run > 0, long_run).otherwise(gamma[0]) / t
    return (
        centred.groupBy("compared_to").agg(
            rows().alias("n_days"), F.avg("d").alias("mean_diff"),
            F.avg((F.col("d") < 0).cast("double")).alias("share_days_better"),
            *[F.sum(f"p{k}").alias(f"g{k}") for k in range(horizon)])
        .select("compared_to", "n_days", "mean_diff", "share_days_better",
                (F.try_divide(F.col("mean_diff"), F.sqrt(variance)) * F.sqrt(factor)).alias("dm_stat"))
    )


def wilcoxon(weeks: DataFrame, chosen: str, others: list[str]) -> DataFrame:
    """Signed-rank test on the series' mean differences; zeros dropped, ties share ranks.

    Ranks come from a running count over distinct absolute values, so no task has to hold
    all series.
    """
    holdout = weeks.filter(F.col("phase") == "holdout")
    diffs = (
        _against(holdout, ["unique_id", "cutoff"], chosen, others).groupBy("compared_to", "unique_id")
        .agg(F.avg("diff").alias("d")).filter(F.col("d") != 0)
        .withColumn("size", F.round(F.abs("d"), 9))
    )
    sizes = diffs.groupBy("compared_to", "size").agg(
        rows().alias("n"), F.sum((F.col("d") > 0).cast("bigint")).alias("n_up"), F.sum("d").alias("d"))
    ranked = ordered_running(sizes, [F.col("compared_to").asc(), F.col("size").asc()], {"_to": "n"})
    first = ranked.groupBy("compared_to").agg(F.min(F.col("_to") - F.col("n")).alias("_start"))
    rank = F.col("_to") - F.col("_start") - (F.col("n") - 1) / 2
    n, up = F.col("n_series"), F.col("rank_sum_up")
    total = n * (n + 1) / 2
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    statistic = F.least(up, total - up)
    return (
        ranked.join(first, "compared_to").withColumn("_rank", rank).groupBy("compared_to").agg(
            F.sum("n").alias("n_series"), F.sum(F.col("_rank") * F.col("n_up")).alias("rank_sum_up"),
            F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("_ties"),
            (F.sum("d") / F.sum("n")).alias("mean_abs_err_diff"),
            (1 - F.sum("n_up") / F.sum("n")).alias("share_series_better"))
        .select("compared_to", "n_series", "mean_abs_err_diff", "share_series_better",
                statistic.alias("w_stat"), F.try_divide(statistic - total / 2, spread).alias("z_stat"),
                F.when((F.col("_ties") == 0) & (n <= EXACT_SERIES), signed_rank_p("n_series", statistic)).alias("exact_p"))
    )


# Up to so many series without ties the rank sum's distribution is counted; the counts are exact in a double.
EXACT_SERIES = 50


def signed_rank_p(n: str, w: Column) -> Column:
    """Two-sided p-value of the smaller rank sum `w` of n ranks, each up or down with even chance.

    The ways to reach each sum are counted rank by rank: with rank i, a sum is reached without it as
    before, or with it from the sum less i.
    """
    ways = F.expr(
        f"aggregate(sequence(1L, {n}), array(1D), (c, i) -> zip_with(concat(c, array_repeat(0D, cast(i AS INT))), "
        "concat(array_repeat(0D, cast(i AS INT)), c), (a, b) -> a + b))")
    reached = F.aggregate(F.slice(ways, F.lit(1), w.cast("int") + 1), F.lit(0.0), lambda a, c: a + c)
    return F.least(F.lit(1.0), 2 * reached / F.pow(F.lit(2.0), F.col(n)))


def significance(daily: DataFrame, weeks: DataFrame, chosen: str, others: list[str], horizon: int) -> DataFrame:
    """Both tests with p-values, one row per compared model."""
    holdout = daily.join(weeks.filter(F.col("phase") == "holdout").select("cutoff").distinct(), "cutoff", "left_semi")
    by_day = diebold_mariano(holdout, chosen, others, horizon).withColumn(
        "dm_p", student_p(F.col("dm_stat"), (F.col("n_days") - 1).cast("double")))
    by_series = wilcoxon(weeks, chosen, others).withColumn("wilcoxon_p", F.coalesce("exact_p", normal_p(F.col("z_stat"))))
    return by_series.drop("exact_p").join(by_day.drop("mean_diff"), "compared_to").withColumn("model", F.lit(chosen))


# --- summaries -----------------------------------------------------------------------------------

def run_summary(scores: DataFrame, levels: DataFrame, report: DataFrame, profile: DataFrame, chosen: str) -> DataFrame:
    """One row: the chosen model, its errors, and how many series were modelled."""
    overall = F.col("scope") == SCOPE_ALL
    wmape_of = lambda model: F.max(F.when(overall & (F.col("model") == model), F.col("WMAPE")))
    store = levels.filter((F.col("level") == WHOLE_STORE) & (F.col("model") == chosen)).agg(F.max("WMAPE")).scalar()
    counts = profile.agg(F.struct(
        rows().alias("n"), F.count_if(F.col("demand_class") != "insufficient").alias("modelled"))).scalar()
    improved = report.agg(F.struct(F.avg(F.col("improved").cast("double")).alias("share"), rows().alias("n"))).scalar()
    return (
        scores.agg(wmape_of(chosen).alias("holdout_wmape"), wmape_of(BASELINE).alias("baseline_wmape"))
        .withColumn("champion", F.lit(chosen)).withColumn("store_wmape", store)
        .withColumn("_c", counts).withColumn("_i", improved)
        .select("champion", "holdout_wmape", "baseline_wmape", "store_wmape",
                F.col("_i.share").alias("share_improved"), F.col("_c.n").alias("n_series"),
                F.col("_c.modelled").alias("n_modelled"), F.col("_i.n").alias("n_backtest"))
    )


def model_comparison(scores: DataFrame) -> DataFrame:
    """Selection error next to hold-out error per model, each with its averaged rank."""
    paired = scores.groupBy("model").agg(
        F.max(F.when(F.col("scope") == SCOPE_SELECTION, F.col("WMAPE"))).alias("wmape_selection"),
        F.max(F.when(F.col("scope") == SCOPE_ALL, F.col("WMAPE"))).alias("wmape_holdout"))
    # A dozen models: the unpartitioned windows see a dozen rows.
    def averaged_rank(column: str) -> Column:
        ties = rows().over(Window.partitionBy(column))
        return F.rank().over(Window.orderBy(column)) + (ties - 1) / 2
    return paired.withColumn("rank_selection", averaged_rank("wmape_selection")).withColumn(
        "rank_holdout", averaged_rank("wmape_holdout"))


def class_by_model(scores: DataFrame, classes: tuple[str, ...] = ("smooth", "erratic", "intermittent", "lumpy")) -> DataFrame:
    return (
        scores.filter(F.col("scope").isin(*classes)).groupBy("model").pivot("scope", list(classes))
        .agg(F.max("WMAPE"))
    )


def class_mix(profile: DataFrame) -> DataFrame:
    mix = profile.groupBy("demand_class").agg(rows().alias("n_series"), F.sum("total_qty").alias("qty"))
    whole = F.sum("qty").over(Window.partitionBy())
    return mix.select("demand_class", "n_series", F.try_divide(F.col("qty"), whole).alias("qty_share"))


def biased_series(report: DataFrame, rules: Rules) -> DataFrame:
    signal = F.col("tracking_signal")
    return report.agg(
        F.count_if(F.abs(signal) > rules.ts_limit).alias("n_biased"),
        F.count_if(signal > rules.ts_limit).alias("n_high"),
        F.count_if(signal < -rules.ts_limit).alias("n_low"))
