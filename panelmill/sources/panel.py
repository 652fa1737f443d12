"""The panel: a dense zone-by-hour fact table with its dimensions, as lazy DataFrames.

`from_events` builds it from the driver tables; `panelmill.sources.files` reads the wide CSV form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators import graph
from panelmill.settings import DEFAULT, Settings
from panelmill.sources.files import zone_attributes


@dataclass(frozen=True)
class Panel:
    """observations: one row per zone and hour; zones, weather, edges: its dimensions; hours: (hour_idx, ts)."""

    observations: DataFrame
    zones: DataFrame
    weather: DataFrame
    adjacency: DataFrame
    edges: DataFrame
    hours: DataFrame
    settings: Settings


def hour_table(spark: SparkSession, settings: Settings = DEFAULT) -> DataFrame:
    """Every hour of the window: hour_idx from 0, and ts."""
    return spark.range(settings.hours).select(
        F.col("id").cast("int").alias("hour_idx"),
        F.expr(f"timestamp_ntz'{settings.start}' + make_dt_interval(0, cast(id as int))").alias("ts"))


def with_calendar(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds obs_date, hour_of_day, day_of_week (Monday 0), is_weekend and is_holiday of ts."""
    day = F.to_date("ts")
    return df.withColumns({
        "obs_date": day, "hour_of_day": F.hour("ts"), "day_of_week": F.weekday("ts"),
        "is_weekend": (F.weekday("ts") >= 5).cast("int"),
        "is_holiday": F.date_format(day, "yyyy-MM-dd").isin(*settings.holidays).cast("int")})


def cells(events: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Measures of the cells that hold events: one partial-aggregated shuffle on (zone, hour)."""
    inside = f"user_id is not null and ts >= timestamp_ntz'{settings.start}' and ts < timestamp_ntz'{settings.start}' + interval '{settings.hours}' hour"
    capped = F.when(F.col("value") > 50.0, F.lit(50.0)).otherwise(F.col("value"))
    return (events.where(inside)
            .groupBy((F.col("user_id") % settings.zones).cast("int").alias("zone_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
            .agg(F.count("*").cast("double").alias("occupancy"), F.sum("value").alias("volume"),
                 F.sum(capped).alias("volume_11kw"), F.count_distinct("user_id").cast("double").alias("duration")))


def densify(sparse: DataFrame, zone_ids: DataFrame, hours: DataFrame) -> DataFrame:
    """A row for every zone and hour, measures 0 where the sparse table has none.

    The grid is the product of two dimensions, both bounded by the panel's own definition; the facts join it by key.
    """
    grid = zone_ids.select("zone_id").crossJoin(F.broadcast(hours))
    filled = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("occupancy", "volume", "volume_11kw", "duration")]
    return grid.join(sparse, ["zone_id", "ts"], "left").select("zone_id", "ts", "hour_idx", *filled)


def from_events(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT) -> Panel:
    """The panel over the driver tables: zones are nations, stations customers, weather two event types."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    events = read("events").select("ts", "user_id", "value", "event_type")
    nation = read("nation").select(F.col("n_nationkey").cast("int").alias("zone_id"), F.col("n_regionkey").cast("int").alias("region_id"))
    hours = hour_table(spark, settings)
    sparse = cells(events, settings)
    dense = densify(sparse, nation, hours)
    capacity = sparse.groupBy("zone_id").agg(F.max("occupancy").cast("int").alias("capacity_points"))
    key, place = F.col("c_custkey"), F.col("c_nationkey").cast("int")
    stations = read("customer").select(
        key.alias("station_id"), (110 + key % 100 / 100.0).alias("longitude"), (20 + key % 50 / 100.0).alias("latitude"), (1 + key % 2).alias("charge_count"),
        place.alias("TAZID"), (1e6 * (place + 1)).alias("area"), (4000.0 * (place + 1)).alias("perimeter"))
    attributes = zone_attributes(stations, nation).withColumnRenamed("capacity_points", "charge_count")
    pairs = nation.alias("a").join(F.broadcast(nation.alias("b")), "region_id").select(
        F.col("a.zone_id").alias("zone_id"), F.col("b.zone_id").alias("neighbour_id"))
    adjacency = pairs.where("zone_id = neighbour_id or zone_id < neighbour_id or (zone_id + neighbour_id) % 3 <> 0")
    edges = graph.symmetrise(adjacency).withColumn("distance_m", 500.0 * F.abs(F.col("zone_id") - F.col("neighbour_id")))
    zones = (nation.select("zone_id").join(capacity, "zone_id", "left").join(attributes, "zone_id", "left")
             .join(graph.degree(nation, edges), "zone_id")
             .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("capacity_points", "n_stations", "charge_count")}))
    tariff = {"e_price": 0.6 + 0.1 * F.floor(F.hour("ts") / 6), "s_price": F.lit(0.4)}
    used = F.coalesce(F.col("occupancy") / F.nullif("capacity_points", F.lit(0)), F.lit(0.0))
    observations = with_calendar(
        dense.join(F.broadcast(zones.select("zone_id", "capacity_points")), "zone_id").withColumns(tariff).withColumn("utilisation", used), settings)
    kinds = {"click": "central", "view": "airport"}
    named = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("event_type"))
    hourly = (events.where(F.col("event_type").isin(*kinds)).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), named.alias("station"))
              .agg(F.avg("value").alias("air_temp_c"), F.max("value").alias("humidity_pct"), F.count("*").alias("rain_category"), F.min("value").alias("dewpoint_c")))
    grid = hours.withColumn("station", F.explode(F.array(*[F.lit(n) for n in kinds.values()])))
    weather = grid.join(hourly, ["ts", "station"], "left").select("ts", "hour_idx", "station", "air_temp_c", "humidity_pct", "rain_category", "dewpoint_c")
    return Panel(observations, zones, weather, adjacency, edges, hours, settings)


def register(panel: Panel, prefix: str = "") -> None:
    """The four tables as temporary views, for SQL over them."""
    for name in ("observations", "zones", "weather", "edges"):
        getattr(panel, name).createOrReplaceTempView(f"{prefix}{'zone_edges' if name == 'edges' else name}")


TABLES = ("observations", "zones", "weather", "edges")


def write_tables(panel: Panel, path: str) -> dict[str, DataFrame]:
    """The four reporting tables below path, read back; facts are partitioned by day."""
    out = {}
    for name in TABLES:
        df = getattr(panel, name)
        writer = df.write.mode("overwrite")
        (writer.partitionBy("obs_date") if name == "observations" else writer).parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{path}/{name}")
    return out
