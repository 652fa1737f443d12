"""Readers and writers of the panel's files: wide CSV tables, matrices, stations, manifests, result tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions.bookkeeping import LoadError

# The two timestamp patterns of the input files.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
WEATHER_TIME_FORMAT = "yyyy/M/d H:mm"
STATION_SCHEMA = "station_id int, longitude double, latitude double, charge_count int, TAZID int, area double, perimeter double"


def read_wide(spark: SparkSession, path: str, measure: str, fmt: str = TIME_FORMAT) -> DataFrame:
    """A wide table (time, one column per zone) as (ts, zone_id, measure). A first column other than time, or a bad timestamp, raises."""
    names = spark.read.option("header", True).csv(path).columns
    if not names or names[0] != "time":
        raise LoadError(f"{path}: the first column must be time, not {names[:1]}")
    schema = T.StructType([T.StructField("time", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in names[1:]])
    wide = spark.read.option("header", True).schema(schema).csv(path)
    return (wide.withColumn("ts", F.expr(f"to_timestamp_ntz(time, '{fmt}')")).drop("time")
            .unpivot(["ts"], names[1:], "zone", measure).select("ts", F.col("zone").cast("int").alias("zone_id"), measure))


def build_long(tables: dict[str, DataFrame]) -> DataFrame:
    """Aligns long tables of one measure each: tagged, united and pivoted, so one shuffle serves them all."""
    tagged = [df.select("zone_id", "ts", F.lit(name).alias("measure"), F.col(name).alias("v")) for name, df in tables.items()]
    united = reduce(DataFrame.unionByName, tagged)
    return united.groupBy("zone_id", "ts").agg(*[F.max(F.when(F.col("measure") == n, F.col("v"))).alias(n) for n in tables])


def hourly_faults(df: DataFrame, hours: DataFrame) -> DataFrame:
    """One row: duplicated hours, hours of the window that are missing, hours outside it."""
    seen = df.groupBy("ts").agg(F.count("*").alias("n"))
    return (hours.select("ts", F.lit(1).alias("wanted")).join(seen, "ts", "full")
            .agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("duplicated"),
                 F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("unexpected")))


def assert_hourly(df: DataFrame, hours: DataFrame, label: str) -> None:
    """Raises unless every hour is there exactly once."""
    faults = hourly_faults(df, hours).first().asDict()
    if any(faults.values()):
        raise ValueError(f"{label}: {faults}")


#: Columns of a weather file and their names here.
WEATHER_NAMES = {"T": "air_temp_c", "P0": "pressure_station", "P": "pressure_sea", "U": "humidity_pct", "nRAIN": "rain_category", "Td": "dewpoint_c"}


def read_weather(spark: SparkSession, path: str, station: str) -> DataFrame:
    """One station's weather with its names, station added; a missing column or a bad timestamp raises."""
    names = spark.read.option("header", True).csv(path).columns
    if missing := sorted({"time", *WEATHER_NAMES} - set(names)):
        raise LoadError(f"{path}: no column {', '.join(missing)}")
    schema = T.StructType([T.StructField(n, T.StringType() if n == "time" else T.DoubleType()) for n in names])
    raw = spark.read.option("header", True).schema(schema).csv(path)
    return raw.select(F.expr(f"to_timestamp_ntz(time, '{WEATHER_TIME_FORMAT}')").alias("ts"), F.lit(station).alias("station"),
                      *[F.col(a).alias(b) for a, b in WEATHER_NAMES.items()])


def load_weather(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The stations' weather side by side, one row per hour, columns with the station's name behind."""
    tables = [read_weather(spark, path, station).select("ts", *[F.col(c).alias(f"{c}_{station}") for c in WEATHER_NAMES.values()]) for station, path in paths.items()]
    return reduce(lambda a, b: a.join(b, "ts", "full"), tables)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("enforceSchema", False).schema(STATION_SCHEMA).csv(path)


def zone_attributes(stations: DataFrame, zone_ids: DataFrame) -> DataFrame:
    """Zones from their stations: counts, points, centroid, densities, shape. A zone without stations has nulls."""
    area = F.min("area")
    grouped = stations.groupBy(F.col("TAZID").alias("zone_id")).agg(
        F.sum("charge_count").alias("capacity_points"), F.count("*").alias("n_stations"), area.alias("area_m2"), F.min("perimeter").alias("perimeter_m"),
        F.avg("longitude").alias("centroid_lon"), F.avg("latitude").alias("centroid_lat"),
        F.avg("charge_count").alias("mean_points_per_station"), F.max("charge_count").alias("max_points_per_station"))
    km2 = F.nullif(F.col("area_m2"), F.lit(0.0)) / 1e6
    return zone_ids.select("zone_id").join(grouped, "zone_id", "left").withColumns({
        "station_density": F.col("n_stations") / km2, "points_density": F.col("capacity_points") / km2,
        "shape_index": F.col("perimeter_m") / F.nullif(2 * F.sqrt(F.pi() * F.col("area_m2")), F.lit(0.0))})


def read_matrix(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A square matrix with a header of zone ids as (zone_id, neighbour_id, value); one that isn't square raises when it's read.

    A row is named by its place, so the file is one text, cut into lines and cells by Spark; its size is zones squared, bounded by
    the panel's definition.
    """
    text = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "^\\s+|\\s+$|\\r", ""), "\n").alias("lines"))
    heads = text.select(F.split(F.element_at("lines", 1), ",").alias("ids"), F.slice("lines", 2, F.greatest(F.lit(0), F.size("lines") - 1)).alias("rows"))
    rows = heads.select("ids", F.size("rows").alias("n"), F.posexplode("rows").alias("i", "row")).withColumn("cells", F.split("row", ","))
    square = (F.size("cells") == F.size("ids")) & (F.col("n") == F.size("ids"))
    cells = F.when(square, F.col("cells")).otherwise(F.raise_error(F.lit(f"{path}: the matrix must be square")))
    zone = lambda k: F.element_at("ids", k + 1).cast("double").cast("int")
    return rows.select("ids", "i", F.posexplode(cells).alias("j", "x")).select(
        zone(F.col("i")).alias("zone_id"), zone(F.col("j")).alias("neighbour_id"), F.col("x").cast("double").alias(value))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of each file below a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or a temporary one where it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise LoadError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="panelmill-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cached(df: DataFrame, path: str, rebuild: bool = False) -> DataFrame:
    """df as written below path; written first where there's nothing yet, or again on rebuild."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if rebuild or not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def append_rows(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """Append to a result table; other columns than those in fields are left out, and fields that df hasn't are null."""
    names = fields or df.columns
    df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names]).write.mode("append").parquet(path)


def existing_keys(spark: SparkSession, path: str, key: str = "cell_key") -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path).select(key).distinct()


def consolidate(spark: SparkSession, paths: list[str], keys: list[str], order: list[str], out: str) -> DataFrame:
    """The rows of several shards, the last of each key, written as one table."""
    merged = keep_last(spark.read.option("mergeSchema", True).parquet(*paths), keys, order)
    merged.write.mode("overwrite").parquet(out)
    return spark.read.schema(merged.schema).parquet(out)


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key by the given order."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return df.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")


def write_report(df: DataFrame, path: str) -> None:
    """A result table as CSV; doubles with six significant digits."""
    shown = [F.format_string("%.6g", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)
