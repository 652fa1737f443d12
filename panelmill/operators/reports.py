"""The five reports over the panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators import graph
from panelmill.settings import CEILING
from panelmill.sources.panel import Panel

at_ceiling = lambda: F.count_if(F.col("utilisation") >= CEILING)


def daily_profile(panel: Panel) -> DataFrame:
    return panel.observations.groupBy("zone_id", "obs_date", "day_of_week", "is_weekend", "is_holiday").agg(
        F.count("*").alias("n_hours"), F.sum("volume").alias("volume_kwh"), F.sum("volume_11kw").alias("volume_11kw_kwh"),
        F.sum("duration").alias("point_hours"), F.avg("occupancy").alias("mean_occupancy"), F.max("occupancy").alias("peak_occupancy"),
        F.avg("utilisation").alias("mean_utilisation"), F.max("utilisation").alias("peak_utilisation"), at_ceiling().alias("hours_at_ceiling"),
        F.avg(F.col("e_price") + F.col("s_price")).alias("mean_total_price"))


def hourly_profile(panel: Panel) -> DataFrame:
    return panel.observations.groupBy("zone_id", "hour_of_day", "is_weekend").agg(
        F.count("*").alias("n_obs"), F.avg("occupancy").alias("mean_occupancy"), F.avg("utilisation").alias("mean_utilisation"),
        F.avg("volume").alias("mean_volume_kwh"), F.avg("duration").alias("mean_point_hours"), F.max("utilisation").alias("max_utilisation"))


def zone_ranking(panel: Panel) -> DataFrame:
    """Aggregated before the zones join, so the join carries one row per zone."""
    per_zone = panel.observations.groupBy("zone_id").agg(
        F.count("*").alias("n_hours"), F.sum("volume").alias("total_volume_kwh"), F.sum("volume_11kw").alias("total_volume_11kw_kwh"),
        F.sum("duration").alias("total_point_hours"), F.avg("utilisation").alias("mean_utilisation"), F.max("utilisation").alias("peak_utilisation"),
        at_ceiling().alias("hours_at_ceiling"), (at_ceiling() / F.count("*")).alias("share_at_ceiling"),
        F.count_if(F.col("utilisation") >= 0.90).alias("hours_above_90pct"),
        F.avg("e_price").alias("mean_e_price"), F.avg("s_price").alias("mean_s_price"), F.avg(F.col("e_price") + F.col("s_price")).alias("mean_total_price"))
    zones = panel.zones.select("zone_id", "capacity_points", "n_stations", "n_neighbours")
    return per_zone.join(F.broadcast(zones), "zone_id").withColumn(
        "kwh_per_point", F.col("total_volume_kwh") / F.nullif("capacity_points", F.lit(0)))


def peak_windows(panel: Panel, width: int = 4) -> DataFrame:
    """The best run of consecutive weekday hours of each zone, over midnight too; ties at 12 digits are all kept."""
    shape = panel.observations.where("is_weekend = 0").groupBy("zone_id", "hour_of_day").agg(F.avg("utilisation").alias("u"))
    starts = shape.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    windows = (starts.groupBy("zone_id", ((F.col("hour_of_day") - F.col("back") + 24) % 24).alias("window_start"))
               .agg(F.avg("u").alias("window_utilisation"), F.count("*").alias("n")).where(F.col("n") == width))
    best = Window.partitionBy("zone_id").orderBy(F.desc(F.round("window_utilisation", 12)))
    return (windows.withColumn("rank", F.rank().over(best)).where("rank = 1")
            .select("zone_id", "window_start", ((F.col("window_start") + width - 1) % 24).alias("window_end"), "window_utilisation"))


def _negative() -> F.Column:
    return reduce(lambda a, b: a | b, [F.col(c) < 0 for c in ("occupancy", "volume", "volume_11kw", "duration", "e_price", "s_price")])


def checks(panel: Panel) -> DataFrame:
    """Assertion rows (check_id, n_failing, n_total, status): one scan of the facts gives ten of them."""
    settings, spark = panel.settings, panel.observations.sparkSession
    rows = settings.zones * settings.hours
    per_key = panel.observations.groupBy("zone_id", "ts").agg(
        F.count("*").alias("n"), F.count_if(_negative()).alias("negative"), F.count_if(F.col("utilisation") > 1 + 1e-6).alias("over"),
        F.count_if(F.col("duration") > F.col("capacity_points") + 1e-6).alias("long"),
        F.count_if((F.col("occupancy") > 0) & (F.col("volume") == 0)).alias("idle"), F.count_if((F.col("volume") > 0) & (F.col("occupancy") == 0)).alias("ghost"),
        at_ceiling().alias("full"))
    per_zone = per_key.groupBy("zone_id").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("dup"), *[F.sum(c).alias(c) for c in ("negative", "over", "long", "idle", "ghost", "full")])
    facts = per_zone.agg(
        F.sum("n").alias("n"), F.count("*").alias("zones"), F.count_if(F.col("n") != settings.hours).alias("ragged"),
        *[F.sum(c).alias(c) for c in ("dup", "negative", "over", "long", "idle", "ghost", "full")]).fillna(0)
    hours = panel.observations.agg(F.count_distinct("ts").alias("hours"))
    bare = panel.observations.select("zone_id").distinct().join(panel.zones, "zone_id", "left_anti").agg(F.count("*").alias("bare"))
    reverse = graph.one_way(panel.edges).agg(F.count("*").alias("one_way")).crossJoin(panel.edges.agg(F.count("*").alias("edges")))
    weather = panel.weather.agg(F.count_distinct("ts").alias("wx"))
    row = facts.crossJoin(hours).crossJoin(bare).crossJoin(reverse).crossJoin(weather)  # one row each
    wanted = [
        ("row_count", f"abs(n - {rows})", f"{rows}", "fail"), ("distinct_hours", f"abs(hours - {settings.hours})", f"{settings.hours}", "fail"),
        ("distinct_zones", f"abs(zones - {settings.zones})", f"{settings.zones}", "fail"), ("duplicate_keys", "dup", "n", "fail"),
        ("ragged_zone_coverage", "ragged", f"{settings.zones}", "fail"), ("negative_values", "negative", "n", "fail"),
        ("utilisation_above_one", "over", "n", "fail"), ("duration_above_capacity", "long", "n", "fail"),
        ("occupancy_without_volume", "idle", "n", "info"), ("volume_without_occupancy", "ghost", "n", "info"), ("saturated_zone_hours", "full", "n", "info"),
        ("zones_missing_attributes", "bare", f"{settings.zones}", "fail"), ("edges_are_reciprocal", "one_way", "edges", "fail"),
        ("weather_hours", f"abs(wx - {settings.hours})", f"{settings.hours}", "fail")]
    structs = ", ".join(f"named_struct('check_id', '{i}', 'n_failing', cast({a} as bigint), 'n_total', cast({t} as bigint), 'bad', '{b}')" for i, a, t, b in wanted)
    return (row.select(F.expr(f"inline(array({structs}))"))
            .withColumn("status", F.when(F.col("bad") == "info", "info").when(F.col("n_failing") == 0, "pass").otherwise("fail")).drop("bad"))
