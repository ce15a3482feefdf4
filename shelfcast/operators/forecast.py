"""Forecasts of many series at many cutoffs, as plain DataFrame expressions.

Long form: (unique_id, cutoff, ds, model, yhat), never below zero. Averages are running
windows read off at the cutoffs, so twelve cutoffs cost one pass. The methods for
intermittent demand run as array expressions over a series' own history, whose length is
bounded by the calendar; series and cutoffs spread over the cluster.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.operators.marts import rows
from shelfcast.params import FALLBACK_MODEL, Rules

SEASON = 7
TSB_SMOOTHING = 0.2

# --- fixed values: the ensembles and their members ------------------------------------------
ENSEMBLES = {
    "Ens_Tweedie_IMAPA": ("GlobalTweedie", "IMAPA"),
    "Ens_Tweedie_ETS_IMAPA": ("GlobalTweedie", "AutoETS", "IMAPA"),
    "Ens_Tweedie_IMAPA_MA": ("GlobalTweedie", "IMAPA", "MovingAvg28"),
}
MODEL_ORDER = (
    "HistoricAverage", "MovingAvg28", "SeasonalNaive", "AutoETS", "Croston", "ADIDA", "IMAPA", "TSB",
    "GlobalTweedie", *ENSEMBLES,
)
# Those computed series by series, without a model learned over all of them.
STATISTICAL = MODEL_ORDER[:8]


def spread(state: DataFrame, horizon: int, models: dict[str, Column]) -> DataFrame:
    """One row per day ahead and model. Expressions may use `step`, the days ahead."""
    rows_per_day = F.array(*[
        F.struct(F.lit(name).alias("model"), F.greatest(value.cast("double"), F.lit(0.0)).alias("yhat"))
        for name, value in models.items()])
    return (
        state.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .withColumn("ds", F.date_add("cutoff", F.col("step")))
        .select("unique_id", "cutoff", "ds", F.inline(rows_per_day))
    )


def averages(series: DataFrame, last_days: list[date], horizon: int) -> DataFrame:
    """Mean of the whole history, mean of the last 28 days, and last week repeated."""
    own = Window.partitionBy("unique_id").orderBy("ds")
    state = (
        series.select(
            "unique_id", F.col("ds").alias("cutoff"),
            F.avg("y").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("_mean"),
            F.avg("y").over(own.rowsBetween(-27, 0)).alias("_mean28"),
            F.collect_list("y").over(own.rowsBetween(1 - SEASON, 0)).alias("_week"))
        .filter(F.col("cutoff").isin(last_days))
    )
    return spread(state, horizon, {
        "HistoricAverage": F.col("_mean"),
        "MovingAvg28": F.col("_mean28"),
        "SeasonalNaive": F.get("_week", (F.col("step") - 1) % SEASON),
    })


def histories(series: DataFrame, last_days: list[date]) -> DataFrame:
    """One array of daily values per series and cutoff."""
    whole = series.groupBy("unique_id").agg(
        F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("_days"))
    # The arrays are small but the work on them is not: a fixed partition count keeps adaptive
    # execution from folding them into a few tasks.
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        whole.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in last_days])))
        .repartition(tasks, "unique_id", "cutoff")
        .withColumn("y", F.transform(F.filter("_days", lambda d: d["ds"] <= F.col("cutoff")), lambda d: d["y"]))
        .drop("_days")
    )


def _smoothed(values: str, alpha: float) -> Column:
    """Last level of simple exponential smoothing that starts at the first value."""
    return F.expr(f"""
        CASE WHEN size({values}) = 0 THEN 0D ELSE
        aggregate(slice({values}, 2, greatest(size({values}) - 1, 0)), get({values}, 0),
                  (level, v) -> {alpha}D * v + (1D - {alpha}D) * level) END""")


def _best_smoothed(values: str) -> Column:
    """The same with the smoothing weight of 0.10, 0.12 ... 0.30 that predicted best."""
    return F.expr(f"""
        CASE WHEN size({values}) = 0 THEN 0D ELSE
        array_min(transform(sequence(0, 10), k -> aggregate(
            slice({values}, 2, greatest(size({values}) - 1, 0)),
            named_struct('sse', 0D, 'level', get({values}, 0), 'a', 0.1D + 0.02D * k),
            (s, v) -> named_struct('sse', s.sse + (v - s.level) * (v - s.level),
                                   'level', s.a * v + (1D - s.a) * s.level, 'a', s.a)))).level END""")


def _with_demand(history: DataFrame) -> DataFrame:
    """Sizes of the selling days, the gaps between them, and the mean gap."""
    return (
        history.withColumn("demand", F.filter("y", lambda v: v > 0))
        .withColumn("_places", F.expr("filter(transform(y, (v, i) -> IF(v > 0, i + 1, NULL)), p -> p IS NOT NULL)"))
        .withColumn("gaps", F.expr("transform(_places, (p, i) -> CAST(p - IF(i = 0, 0, get(_places, i - 1)) AS DOUBLE))"))
        .withColumn("mean_gap", F.when(F.size("gaps") > 0, F.rint(F.element_at("_places", -1) / F.size("gaps")).cast("int")))
        .drop("_places")
    )


def intermittent(series: DataFrame, last_days: list[date], horizon: int) -> DataFrame:
    """Croston with fitted weights: smoothed demand size over smoothed gap."""
    state = _with_demand(histories(series, last_days)).select(
        "unique_id", "cutoff",
        _best_smoothed("demand").alias("_size"), _best_smoothed("gaps").alias("_gap"))
    return spread(state, horizon, {"Croston": F.coalesce(F.try_divide("_size", "_gap"), F.lit(0.0))})


def probability_smoothed(series: DataFrame, last_days: list[date], horizon: int) -> DataFrame:
    """TSB: smoothed chance of a sale times smoothed size of a sale."""
    state = (
        histories(series, last_days)
        .withColumn("demand", F.filter("y", lambda v: v > 0))
        .withColumn("sold", F.transform("y", lambda v: F.when(v != 0, 1.0).otherwise(0.0)))
        .select("unique_id", "cutoff", (
            _smoothed("sold", TSB_SMOOTHING) * _smoothed("demand", TSB_SMOOTHING)).alias("_rate"))
    )
    return spread(state, horizon, {"TSB": F.col("_rate")})


def aggregated(series: DataFrame, last_days: list[date], horizon: int) -> DataFrame:
    """ADIDA smooths sums over blocks as long as the mean gap; IMAPA averages that over all
    block lengths up to it. Blocks end on the cutoff; the incomplete first one is dropped."""
    levels = (
        _with_demand(histories(series, last_days))
        .select("unique_id", "cutoff", "y", F.coalesce("mean_gap", F.lit(1)).alias("longest"))
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("longest"))))
        .withColumn("sums", F.expr("""
            IF(size(y) < k, array(), transform(sequence(0, CAST(size(y) DIV k AS INT) - 1), b ->
               aggregate(slice(y, size(y) % k + b * k + 1, k), 0D, (s, v) -> s + v)))"""))
        .select("unique_id", "cutoff", "k", "longest", (_best_smoothed("sums") / F.col("k")).alias("_rate"))
    )
    state = levels.groupBy("unique_id", "cutoff").agg(
        F.max(F.when(F.col("k") == F.col("longest"), F.col("_rate"))).alias("_adida"),
        F.avg("_rate").alias("_imapa"))
    return spread(state, horizon, {"ADIDA": F.col("_adida"), "IMAPA": F.col("_imapa")})


def ensembles(forecasts: DataFrame) -> DataFrame:
    """Mean of the members, only where every member has a forecast."""
    memberships = [(name, member) for name, members in ENSEMBLES.items() for member in members]
    joins = F.array(*[
        F.struct(F.lit(name).alias("ensemble"), F.lit(len(ENSEMBLES[name])).alias("size"), F.lit(member).alias("member"))
        for name, member in memberships])
    members = forecasts.select("*", F.inline(F.filter(joins, lambda j: j["member"] == F.col("model"))))
    return (
        members.groupBy("unique_id", "cutoff", "ds", F.col("ensemble").alias("model"), "size")
        .agg(F.avg("yhat").alias("yhat"), rows().alias("_n")).filter(F.col("_n") == F.col("size"))
        .select("unique_id", "cutoff", "ds", "model", "yhat")
    )


def native_forecasts(series: DataFrame, last_days: list[date], horizon: int) -> DataFrame:
    """The methods without a search: three averages and TSB."""
    return averages(series, last_days, horizon).unionByName(probability_smoothed(series, last_days, horizon))


# Which names each of the methods above gives.
METHODS = (
    ({"HistoricAverage", "MovingAvg28", "SeasonalNaive"}, averages), ({"Croston"}, intermittent),
    ({"ADIDA", "IMAPA"}, aggregated), ({"TSB"}, probability_smoothed),
)


def fallback(series: DataFrame, profile: DataFrame, last_day: date, horizon: int, rules: Rules) -> DataFrame:
    """Series too thin to model: the mean of the open days of the last eight weeks."""
    thin = profile.filter(F.col("demand_class") == "insufficient").select("unique_id")
    recent = series.filter((F.datediff(F.lit(last_day), "ds") < rules.share_days) & ~F.col("is_closed"))
    means = recent.join(thin, "unique_id", "left_semi").groupBy("unique_id").agg(F.avg("y_raw").alias("_mean"))
    state = thin.join(means, "unique_id", "left").withColumn("cutoff", F.lit(last_day))
    return spread(state, horizon, {FALLBACK_MODEL: F.coalesce("_mean", F.lit(0.0))})
