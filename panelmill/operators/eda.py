"""Descriptive tables of the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.settings import CEILING
from panelmill.sources.panel import Panel


def aggregate_hourly(panel: Panel) -> DataFrame:
    """City-wide totals of each hour and the utilisation weighted by capacity."""
    return panel.observations.groupBy("ts").agg(
        F.sum("occupancy").alias("occupancy"), F.sum("volume").alias("volume"), F.sum("duration").alias("duration"),
        (F.sum("occupancy") / F.nullif(F.sum("capacity_points"), F.lit(0))).alias("utilisation"))


def aggregate_daily(panel: Panel) -> DataFrame:
    hourly = aggregate_hourly(panel)
    return hourly.groupBy(F.to_date("ts").alias("obs_date")).agg(
        F.avg("utilisation").alias("utilisation"), F.avg("occupancy").alias("occupancy"), F.sum("volume").alias("volume"), F.sum("duration").alias("duration"))


def volume_deciles(panel: Panel) -> DataFrame:
    """ceil(rank * 10 / zones) by total volume, ties by zone id; the windows run over one row per zone."""
    total = panel.observations.groupBy("zone_id").agg(F.sum("volume").alias("total_volume"))
    rank = F.row_number().over(Window.orderBy(F.round("total_volume", 6), "zone_id"))
    return total.withColumn("decile", F.ceil(rank * 10.0 / F.count("*").over(Window.partitionBy())).cast("int"))


def hour_of_day_profile(panel: Panel) -> DataFrame:
    return panel.observations.groupBy("hour_of_day").agg(
        F.avg("utilisation").alias("mean_utilisation"), F.avg("volume").alias("mean_volume"), F.avg("duration").alias("mean_duration"))


def saturation_profile(panel: Panel) -> DataFrame:
    """Exact percentiles, by zone."""
    return panel.observations.groupBy("zone_id").agg(
        F.avg("utilisation").alias("mean"), F.percentile("utilisation", 0.95).alias("p95"), F.max("utilisation").alias("max"),
        (F.count_if(F.col("utilisation") >= CEILING) / F.count("*")).alias("share_at_ceiling"),
        (F.count_if(F.col("utilisation") >= 0.9) / F.count("*")).alias("share_above_90"), (F.count_if(F.col("utilisation") == 0) / F.count("*")).alias("share_idle"))


def price_variation(panel: Panel) -> DataFrame:
    """Mean, sample deviation and number of changes; the first hour counts as one."""
    by_hour = Window.partitionBy("zone_id").orderBy("hour_idx")
    before = panel.observations.withColumn("was", F.lag("e_price").over(by_hour))
    return before.groupBy("zone_id").agg(
        F.avg("e_price").alias("mean_price"), F.stddev_samp("e_price").alias("std_price"),
        F.count_if(F.col("was").isNull() | (F.col("was") != F.col("e_price"))).alias("n_changes"))


def estimate_comparison(panel: Panel) -> DataFrame:
    """Two volume estimates per zone, the power each implies and their ratio."""
    hours = F.nullif(F.sum("duration"), F.lit(0.0))
    return panel.observations.groupBy("zone_id").agg(
        F.sum("volume").alias("rated"), F.sum("volume_11kw").alias("capped"), (F.sum("volume") / hours).alias("implied_kw"),
        (F.sum("volume_11kw") / hours).alias("implied_kw_capped"), (F.sum("volume") / F.nullif(F.sum("volume_11kw"), F.lit(0.0))).alias("ratio"))


def measured_summary(panel: Panel, measures: tuple[str, ...] = ("occupancy", "volume", "volume_11kw", "duration", "utilisation")) -> DataFrame:
    """min, median, mean, max and share of zeros of each measure, from one scan."""
    stats = {"min": F.min, "median": F.median, "mean": F.avg, "max": F.max, "zero_share": lambda c: F.count_if(F.col(c) == 0) / F.count("*")}
    row = panel.observations.agg(*[F.struct(*[f(m).cast("double").alias(s) for s, f in stats.items()]).alias(m) for m in measures])
    return row.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), *[F.col(f"{m}.{s}").alias(s) for s in stats]) for m in measures])))


def summary_rows(panel: Panel) -> DataFrame:
    """Headline numbers as (metric, value)."""
    facts = panel.observations.agg(
        F.count("*").alias("fact_rows"), F.count_distinct("zone_id").alias("zones"), F.count_distinct("ts").alias("hours"), F.sum("volume").alias("total_volume"),
        F.sum("volume_11kw").alias("total_volume_11kw"), F.sum("duration").alias("point_hours"), F.avg("utilisation").alias("mean_utilisation"),
        F.count_if(F.col("utilisation") >= CEILING).alias("saturated_hours"),
        F.count_distinct(F.when(F.col("utilisation") >= CEILING, F.col("zone_id"))).alias("saturated_zones"), (F.sum("volume") / F.nullif(F.sum("volume_11kw"), F.lit(0.0))).alias("estimate_ratio"))
    zones = panel.zones.agg(F.sum("n_stations").alias("stations"), F.sum("capacity_points").alias("points"))
    row = facts.crossJoin(zones)  # one row each
    return row.select(*[F.col(c).cast("double").alias(c) for c in row.columns]).unpivot([], row.columns, "metric", "value")


#: What the measures are (fixed texts).
MEANING = {"occupancy": "points in use", "volume": "energy by rated power, kWh", "volume_11kw": "energy by 11 kW, kWh", "duration": "point hours", "utilisation": "points in use by points"}


def dictionary(panel: Panel) -> DataFrame:
    """(measure, meaning, observed): the data dictionary, with what was measured as text."""
    meaning = F.element_at(F.create_map(*[F.lit(x) for pair in MEANING.items() for x in pair]), F.col("measure"))
    shown = F.format_string("%.6f to %.6f, mean %.6f", *[F.round(c, 6) for c in ("min", "max", "mean")])
    return measured_summary(panel, tuple(MEANING)).select("measure", meaning.alias("meaning"), shown.alias("observed"))
