"""Rolling-origin folds, baseline forecasts and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.operators.features import back
from panelmill.settings import DEFAULT, Settings
from panelmill.sources.panel import Panel

# Fixed value: a saturated hour weighs 1 + 3 times an idle one.
SATURATION_WEIGHT = 3.0
BASELINES = ("last_observation", "seasonal_daily", "seasonal_weekly")


def make_folds(settings: Settings = DEFAULT) -> list[tuple[int, int, int]]:
    """(fold, test_start, test_end) in hours; the last test ends with the window and training is all before the test."""
    first = settings.hours - settings.n_folds * settings.test_hours
    if first < settings.min_train:
        raise ValueError(f"{first} hours before the first test, at least {settings.min_train} are needed")
    return [(k, first + k * settings.test_hours, first + (k + 1) * settings.test_hours) for k in range(settings.n_folds)]


def fold_table(spark: SparkSession, settings: Settings = DEFAULT) -> DataFrame:
    return spark.createDataFrame(make_folds(settings), "fold int, test_start int, test_end int")


def denominators(panel: Panel, target: str) -> DataFrame:
    """Per fold and zone: mean |y - y 24 h before| of the training hours; 0 is null."""
    step = panel.observations.withColumn("step", F.abs(F.col(target) - back(target, 24)))
    folds = fold_table(step.sparkSession, panel.settings)
    return (step.join(F.broadcast(folds), F.col("hour_idx") < F.col("test_start")).groupBy("fold", "zone_id")
            .agg(F.nullif(F.avg("step"), F.lit(0.0)).alias("denominator")))


def baselines(panel: Panel, target: str, horizon: int) -> DataFrame:
    """(zone_id, hour_idx of the target, fold, family, predicted, actual, utilisation) of the three baselines. None reads past its origin."""
    settings = panel.settings
    if not 0 < horizon <= 24:
        raise ValueError("a seasonal baseline needs a horizon of 1 to 24 hours")
    families = dict(zip(BASELINES, (horizon, 24, 168)))
    known = panel.observations.withColumns({name: back(target, k) for name, k in families.items()})
    folds = fold_table(known.sparkSession, settings)
    inside = (F.col("hour_idx") >= F.col("test_start")) & (F.col("hour_idx") < F.col("test_end"))
    return (known.join(F.broadcast(folds), inside)
            .where(F.col("hour_idx") - horizon >= settings.warmup - 1)
            .select("zone_id", "hour_idx", "fold", "hour_of_day", "day_of_week", "utilisation", "capacity_points", F.col(target).alias("actual"), *families)
            .unpivot(["zone_id", "hour_idx", "fold", "hour_of_day", "day_of_week", "utilisation", "capacity_points", "actual"], list(families), "family", "predicted"))


def clip(predicted: F.Column, ceiling: F.Column | None) -> F.Column:
    """Not below 0; not above the ceiling, for the measures that have one."""
    low = F.when(predicted < 0, F.lit(0.0)).otherwise(predicted)
    return low if ceiling is None else F.when(low > ceiling, ceiling).otherwise(low)


def score_columns() -> list[F.Column]:
    """mae, rmse, bias, mape and mase with their coverage, and the mae weighted by saturation."""
    e = F.col("predicted") - F.col("actual")
    weight = 1 + SATURATION_WEIGHT * F.greatest(F.lit(0.0), F.least(F.col("utilisation"), F.lit(1.0)))
    return [F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
            (F.avg(F.abs(e) / F.nullif(F.abs("actual"), F.lit(0.0))) * 100).alias("mape"), (F.count_if(F.col("actual") != 0) / F.count("*")).alias("mape_coverage"),
            F.avg(F.abs(e) / F.col("denominator")).alias("mase"), (F.count("denominator") / F.count("*")).alias("mase_coverage"),
            (F.sum(weight * F.abs(e)) / F.sum(weight)).alias("weighted_mae")]


def score_grid(forecasts: DataFrame, denominator: DataFrame) -> DataFrame:
    """Pooled, per zone, per hour and per weekday scores of each family from one pass with grouping sets."""
    known = forecasts.join(F.broadcast(denominator), ["fold", "zone_id"], "left")
    by = [F.col(c) for c in ("family", "zone_id", "hour_of_day", "day_of_week")]
    sets = [[by[0]], [by[0], by[1]], [by[0], by[2]], [by[0], by[3]]]
    return known.groupingSets(sets, *by).agg(*score_columns())


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties. For tables of one row per zone: the ranks need a total order."""
    def rank(c: str) -> F.Column:
        return F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(rank(x).alias("rx"), rank(y).alias("ry")).agg(F.corr("rx", "ry").alias("spearman"))
