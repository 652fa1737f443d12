"""Operators on the zone graph, held as an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("neighbour_id").alias("zone_id"), F.col("zone_id").alias("neighbour_id"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once, without self loops."""
    return edges.select("zone_id", "neighbour_id").union(flip(edges)).where("zone_id <> neighbour_id").distinct()


def one_way(edges: DataFrame) -> DataFrame:
    """Edges whose opposite is missing."""
    return edges.select("zone_id", "neighbour_id").join(flip(edges), ["zone_id", "neighbour_id"], "left_anti")


def degree(zones: DataFrame, edges: DataFrame) -> DataFrame:
    """n_neighbours of every zone, 0 for an isolated one."""
    counted = edges.groupBy("zone_id").agg(F.count("*").alias("n_neighbours"))
    return zones.select("zone_id").join(counted, "zone_id", "left").fillna(0, ["n_neighbours"])


def neighbour_lists(edges: DataFrame) -> DataFrame:
    return edges.groupBy("zone_id").agg(F.sort_array(F.collect_list("neighbour_id")).alias("neighbours"))


def decay_weights(edges: DataFrame, decay_m: float = 2000.0) -> DataFrame:
    """Weights exp(-distance / decay), scaled to sum 1 per zone."""
    raw = F.exp(-F.col("distance_m") / decay_m)
    return edges.withColumn("raw", raw).withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy("zone_id"))).drop("raw")


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest other zones; ties go to the smaller id."""
    order = Window.partitionBy("zone_id").orderBy("distance_m", "neighbour_id")
    return edges.where("zone_id <> neighbour_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbour_mean(observations: DataFrame, weights: DataFrame, column: str) -> DataFrame:
    """(zone_id, ts, neighbour_mean): the weighted mean over neighbours; the weights are zones times degree, so broadcast."""
    other = observations.select(F.col("zone_id").alias("neighbour_id"), "ts", F.col(column).alias("y"))
    summed = (other.join(F.broadcast(weights.select("zone_id", "neighbour_id", "weight")), "neighbour_id")
              .groupBy("zone_id", "ts").agg(F.sum(F.col("weight") * F.col("y")).alias("neighbour_mean")))
    return observations.select("zone_id", "ts").join(summed, ["zone_id", "ts"], "left").fillna(0.0, ["neighbour_mean"])
