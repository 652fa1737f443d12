"""Leakage-safe features: every value at an origin hour reads that hour or earlier ones; the target is read ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelmill.operators import graph
from panelmill.settings import LAGS, NEIGHBOUR_LAGS, WINDOWS
from panelmill.sources.panel import Panel, hour_table, with_calendar

#: Names of the features by block: at the origin, shared by all zones, of the target's hour, of the zone.
ORIGIN = [*[f"lag_{k}" for k in LAGS], "roll_mean_24", "roll_std_24", "roll_mean_168", "roll_std_168", "roll_max_24", "roll_min_24", "diff_1", "diff_24",
          *[f"neighbour_mean_{k}" for k in NEIGHBOUR_LAGS], "e_price_0", "e_price_roll_24", "s_price_0", "s_price_roll_24"]
SHARED = ["air_temp_c", "humidity_pct", "rain_category", "dewpoint_c", "air_temp_roll_24"]
CALENDAR = ["at_hour_sin", "at_hour_cos", "at_dow_sin", "at_dow_cos", "at_hour_of_day", "at_is_weekend", "at_is_holiday", "at_trend"]
STATIC = ["capacity_points", "n_stations", "log_area", "points_density", "station_density", "shape_index", "centroid_lon", "centroid_lat", "n_neighbours"]


def feature_names(static: bool = True) -> list[str]:
    """The features of a design matrix; models of one zone leave the static ones out."""
    return ORIGIN + SHARED + CALENDAR + (STATIC if static else [])


def usable_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """(feature, usable): columns that vary and are nowhere null or not finite, from one pass; all of them if none is."""
    bad = lambda c: F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")))
    fine = lambda c: (bad(c) == 0) & (F.stddev_pop(F.col(c).cast("double")) > 1e-12)
    row = rows.agg(*[F.coalesce(fine(c), F.lit(False)).alias(c) for c in names])
    none = ~F.greatest(*[F.col(c) for c in names]) if len(names) > 1 else ~F.col(names[0])
    return row.select(*[(F.col(c) | none).alias(c) for c in names]).unpivot([], names, "feature", "usable")


def by_zone() -> WindowSpec:
    return Window.partitionBy("zone_id").orderBy("hour_idx")


def back(column: str, k: int, window: WindowSpec | None = None) -> Column:
    """The value k hours earlier; a negative k would read the future and is refused."""
    if k < 0:
        raise ValueError(f"a shift of {k} hours reads the future")
    return F.lag(column, k).over(window or by_zone()) if k else F.col(column)


def trailing(column: str, width: int, how: str, window: WindowSpec | None = None) -> Column:
    """mean, std (sample), max or min of the last `width` hours; null until the window is full."""
    frame = (window or by_zone()).rowsBetween(-(width - 1), 0)
    agg = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}[how]
    return F.when(F.count(column).over(frame) == width, agg(column).over(frame))


def lag_columns(target: str) -> dict[str, Column]:
    return {f"lag_{k}": back(target, k) for k in LAGS}


def rolling_columns(target: str) -> dict[str, Column]:
    day, week = WINDOWS
    return {"roll_mean_24": trailing(target, day, "mean"), "roll_std_24": trailing(target, day, "std"), "roll_mean_168": trailing(target, week, "mean"),
            "roll_std_168": trailing(target, week, "std"), "roll_max_24": trailing(target, day, "max"), "roll_min_24": trailing(target, day, "min")}


def calendar_columns(n_hours: int) -> dict[str, Column]:
    """Cyclic encodings and the trend, of the row's own hour."""
    turn = 2 * F.pi()
    return {"hour_sin": F.sin(turn * F.col("hour_of_day") / 24), "hour_cos": F.cos(turn * F.col("hour_of_day") / 24),
            "dow_sin": F.sin(turn * F.col("day_of_week") / 7), "dow_cos": F.cos(turn * F.col("day_of_week") / 7), "trend": F.col("hour_idx") / n_hours}


def build_features(panel: Panel, target: str) -> DataFrame:
    """Origin, shared and static features of every zone and hour. All zone windows share one sort."""
    obs = panel.observations
    weights = graph.decay_weights(panel.edges, panel.settings.spill_decay_m)
    base = obs.join(graph.neighbour_mean(obs, weights, target), ["zone_id", "ts"])
    made = base.withColumns(lag_columns(target) | rolling_columns(target) | {f"neighbour_mean_{k}": back("neighbour_mean", k) for k in NEIGHBOUR_LAGS} | {
        "diff_1": F.col(target) - back(target, 1), "diff_24": F.col(target) - back(target, 24), "e_price_0": F.col("e_price"), "s_price_0": F.col("s_price"),
        "e_price_roll_24": trailing("e_price", 24, "mean"), "s_price_roll_24": trailing("s_price", 24, "mean")})
    alone = Window.orderBy("hour_idx")  # one row per hour of the window, a bounded dimension
    sky = panel.weather.where("station = 'central'").select("hour_idx", *SHARED[:4]).withColumn("air_temp_roll_24", trailing("air_temp_c", 24, "mean", alone))
    static = panel.zones.withColumn("log_area", F.log1p("area_m2")).select("zone_id", *[c for c in STATIC if c != "capacity_points"])
    return made.join(sky, "hour_idx", "left").join(static, "zone_id", "left")


def design(features: DataFrame, panel: Panel, target: str, horizon: int) -> DataFrame:
    """One row per origin: its features, the calendar of origin + horizon and the target there. Rows without a full history or a target go."""
    hours = hour_table(panel.observations.sparkSession, panel.settings)
    ahead = (with_calendar(hours, panel.settings).withColumns(calendar_columns(panel.settings.hours))
             .select((F.col("hour_idx") - horizon).alias("hour_idx"), *[F.col(c).alias(f"at_{c}") for c in
                     ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "hour_of_day", "is_weekend", "is_holiday", "trend")]))
    return (features.withColumn("y", F.lead(target, horizon).over(by_zone())).join(F.broadcast(ahead), "hour_idx")
            .where(F.col("y").isNotNull() & (F.col("hour_idx") >= panel.settings.warmup - 1)))


def autoregressive_lags(observations: DataFrame, target: str, order: int = 24) -> DataFrame:
    """lags: the array of the last `order` values, newest first."""
    return observations.withColumn("lags", F.array(*[back(target, k) for k in range(order)]))
