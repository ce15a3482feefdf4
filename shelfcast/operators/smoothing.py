"""Seasonal exponential smoothing chosen by an information criterion.

Approximate by design: the smoothing weights come from a small grid instead of a continuous
search. One pass over a series' days (their number is bounded by the calendar) serves every
cutoff, because errors and states only look back; variants and series spread over the cluster.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.operators.forecast import spread

SEASON = 7
LEVEL = (0.02, 0.05, 0.1, 0.2, 0.4)
TREND = (0.0, 0.02)
SEASONAL = (0.0, 0.02, 0.1)
# (level, trend, seasonal) weights; a zero weight leaves that component out.
VARIANTS = tuple((a, b, g) for a in LEVEL for b in TREND for g in SEASONAL)


def _started(series: DataFrame) -> DataFrame:
    """Per series and variant: days in order, level and weekday pattern of the first two weeks."""
    variants = F.array(*[
        F.struct(F.lit(i).alias("variant"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(g).alias("gamma"))
        for i, (a, b, g) in enumerate(VARIANTS)])
    whole = series.groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("days"))
    first = whole.withColumn("first", F.expr(f"transform(slice(days, 1, {2 * SEASON}), d -> d.y)"))
    levelled = first.withColumn("start", F.expr("aggregate(first, 0D, (s, v) -> s + v) / size(first)"))
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        levelled.select("unique_id", "days", "first", "start", F.inline(variants))
        .withColumn("season", F.expr(f"""
            transform(sequence(0, {SEASON - 1}), i -> CASE WHEN gamma = 0D OR i >= size(first) THEN 0D
                WHEN i + {SEASON} >= size(first) THEN get(first, i) - start
                ELSE (get(first, i) + get(first, i + {SEASON})) / 2D - start END)"""))
        .repartition(tasks, "unique_id", "variant"))


def _states(last_days: list[date]) -> Column:
    """States after the days of `last_days`: (cutoff, n, sse, level, slope, season)."""
    wanted = ", ".join(f"DATE '{d}'" for d in last_days)
    kept = "array<struct<cutoff:date,n:int,sse:double,level:double,slope:double,season:array<double>>>"
    return F.expr(f"""
        aggregate(days, named_struct('n', 0, 'sse', 0D, 'level', start, 'slope', 0D, 'season', season,
                                     'kept', cast(array() AS {kept})),
          (s, d) -> transform(transform(array(d.y - (s.level + s.slope + get(s.season, s.n % {SEASON}))), e -> named_struct(
            'n', s.n + 1, 'sse', s.sse + e * e, 'level', s.level + s.slope + alpha * e, 'slope', s.slope + beta * alpha * e,
            'season', transform(s.season, (v, i) -> IF(i = s.n % {SEASON}, v + gamma * e, v)), 'kept', s.kept)),
            x -> IF(array_contains(array({wanted}), d.ds), named_struct('n', x.n, 'sse', x.sse, 'level', x.level,
              'slope', x.slope, 'season', x.season, 'kept', concat(x.kept, array(named_struct('cutoff', d.ds, 'n', x.n,
              'sse', x.sse, 'level', x.level, 'slope', x.slope, 'season', x.season)))), x))[0],
          s -> s.kept)""")


def criterion() -> Column:
    """Akaike's, corrected for short series."""
    weights = 2 + 2 * (F.col("beta") > 0).cast("int") + SEASON * (F.col("gamma") > 0).cast("int")
    n = F.col("n")
    return (n * F.log(F.greatest("sse", F.lit(1e-9)) / n) + 2 * weights
            + 2 * weights * (weights + 1) / F.greatest(n - weights - 1, F.lit(1)))


def seasonal_smoothing(series: DataFrame, last_days: list[date], horizon: int) -> DataFrame:
    states = _started(series).select("unique_id", "variant", "beta", "gamma", F.inline(_states(last_days)))
    # Variants too close to tell apart go to the first of them.
    best = Window.partitionBy("unique_id", "cutoff").orderBy(F.round(criterion(), 6), "variant")
    chosen = states.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1")
    path = F.col("level") + F.col("slope") * F.col("step") + F.get("season", (F.col("n") - 1 + F.col("step")) % SEASON)
    return spread(chosen, horizon, {"AutoETS": path})
