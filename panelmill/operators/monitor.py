"""Drift monitors at matched false alarm rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.sources.panel import Panel

# Floor of a bin's share, CUSUM slack, EWMA weight.
SHARE_FLOOR = 1e-6
SLACK = 0.5
EWMA_WEIGHT = 0.1


#: Inputs that are watched: calendar and zone attributes can't drift. Bins of the two statistics.
MONITORED = ("lag_0", "lag_24", "roll_mean_24", "roll_mean_168", "roll_std_24", "diff_24", "neighbour_mean_0", "e_price_0", "s_price_0")
PSI_BINS, KS_BINS = 10, 50


def mask(inside: tuple[int, int], without: tuple[int, int] | None = None) -> F.Column:
    """Hours of a window, both ends included, less those of another."""
    own = F.col("hour_idx").between(*inside)
    return own & ~F.col("hour_idx").between(*without) if without else own


def bin_edges(reference: DataFrame, bins: int) -> DataFrame:
    """(feature, edges): interior quantile edges of a long reference (feature, value), without repeats and inside the range; bins - 1 numbers at most."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    q = reference.where(F.col("value").isNotNull()).groupBy("feature").agg(
        F.percentile("value", shares).alias("q"), F.min("value").alias("low"), F.max("value").alias("high"))
    inside = F.filter(F.array_distinct(F.transform("q", lambda e: F.round(e, 9))), lambda e: (e > F.col("low")) & (e < F.col("high")))
    return q.select("feature", F.array_sort(inside).alias("edges"))


def place(value: str, edges: str) -> F.Column:
    """Number of the left-closed bin: how many edges aren't above the value."""
    return F.size(F.filter(edges, lambda e: e <= F.col(value)))


def drift(long: DataFrame, reference_hours: int, width: int, bins: int) -> DataFrame:
    """(feature, hour_idx, psi, ks) of a trailing window against the first hours, of a long table (feature, hour_idx, value).

    Values are counted per feature, hour and bin on a dense table of hours and bins, and summed over the window. Values and edges meet at
    nine digits, so that an edge that interpolation puts beside a value doesn't part them.
    """
    long = long.withColumn("value", F.round("value", 9))
    reference = long.where(F.col("hour_idx") < reference_hours)
    edges = bin_edges(reference, bins)
    counted = long.where(F.col("value").isNotNull()).join(edges, "feature").groupBy("feature", "hour_idx", place("value", "edges").alias("bin")).agg(F.count("*").alias("n"))
    grid = long.select("hour_idx").distinct().crossJoin(F.broadcast(edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))))  # hours times bins
    dense = grid.join(counted, ["feature", "hour_idx", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    expected = dense.where(F.col("hour_idx") < reference_hours).groupBy("feature", "bin").agg(F.sum("n").alias("n")).select(
        "feature", "bin", (F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("feature")), F.lit(1))).alias("expected"))
    frame = Window.partitionBy("feature", "bin").orderBy("hour_idx").rowsBetween(-(width - 1), 0)
    summed = dense.select("feature", "hour_idx", "bin", F.sum("n").over(frame).alias("n"), F.count("*").over(frame).alias("full")).where(F.col("full") == width)
    share = F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("feature", "hour_idx")), F.lit(1))
    joined = summed.withColumn("share", share).join(expected, ["feature", "bin"])
    a, e = F.greatest("share", F.lit(SHARE_FLOOR)), F.greatest("expected", F.lit(SHARE_FLOOR))
    running = Window.partitionBy("feature", "hour_idx").orderBy("bin")
    gaps = joined.withColumns({"term": (a - e) * F.ln(a / e), "gap": F.abs(F.sum("share").over(running) - F.sum("expected").over(running))})
    return gaps.groupBy("feature", "hour_idx").agg(F.sum("term").alias("psi"), F.max("gap").alias("ks"))


def input_monitor(panel: Panel, column: str, bins: int, reference_hours: int, width: int) -> DataFrame:
    """(hour_idx, psi, ks) of one measure."""
    long = panel.observations.select(F.lit(column).alias("feature"), "hour_idx", F.col(column).alias("value"))
    return drift(long, reference_hours, width, bins).select("hour_idx", "psi", "ks")


def input_monitors(panel: Panel, target: str, reference_hours: int, width: int, features: tuple[str, ...] = MONITORED) -> DataFrame:
    """(hour_idx, input_psi, input_ks): the mean PSI of the watched features and their largest KS, each over its own bins."""
    from panelmill.operators.features import build_features

    long = build_features(panel, target).select("hour_idx", *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["hour_idx"], list(features), "feature", "value")
    psi = drift(long, reference_hours, width, PSI_BINS).groupBy("hour_idx").agg(F.avg("psi").alias("input_psi"))
    return psi.join(drift(long, reference_hours, width, KS_BINS).groupBy("hour_idx").agg(F.max("ks").alias("input_ks")), "hour_idx")


def residuals(panel: Panel, target: str) -> DataFrame:
    """City mean residual of the daily baseline: (hour_idx, mean_residual, mean_absolute)."""
    order = Window.partitionBy("zone_id").orderBy("hour_idx")
    e = F.col(target) - F.lag(target, 24).over(order)
    return (panel.observations.select("hour_idx", "zone_id", e.alias("e")).where("e is not null")
            .groupBy("hour_idx").agg(F.avg("e").alias("mean_residual"), F.avg(F.abs("e")).alias("mean_absolute")))


def _centred(series: DataFrame, column: str, reference: int) -> DataFrame:
    """z of a column against its first `reference` rows; a deviation of 0 counts as 1."""
    order = Window.orderBy("hour_idx")  # one row per hour of the window
    ranked = series.withColumn("_row", F.row_number().over(order))
    stats = ranked.where(F.col("_row") <= reference).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return ranked.crossJoin(F.broadcast(stats)).withColumn("z", (F.col(column) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0))


def cusum(series: DataFrame, reference: int, width: int) -> DataFrame:
    """Two-sided CUSUM restarted in each trailing window: its largest excursion, null until the window is full."""
    frame = Window.orderBy("hour_idx").rowsBetween(-(width - 1), 0)
    windowed = _centred(series, "mean_residual", reference).withColumn("zs", F.collect_list("z").over(frame))
    walk = f"""aggregate(zs, named_struct('up', 0D, 'down', 0D, 'top', 0D),
        (s, x) -> named_struct('up', greatest(0D, s.up + x - {SLACK}D), 'down', greatest(0D, s.down - x - {SLACK}D),
                               'top', greatest(s.top, s.up + x - {SLACK}D, s.down - x - {SLACK}D))).top"""
    return windowed.select("hour_idx", F.when(F.size("zs") == width, F.expr(walk)).alias("cusum"))


def ewma(series: DataFrame, reference: int, width: int = 1) -> DataFrame:
    """|state| of the weighted mean of z, from 0, null before `width` hours. The fold over one city series, one value an hour, is sequential."""
    rows = _centred(series, "mean_absolute", reference).agg(F.sort_array(F.collect_list(F.struct("hour_idx", "z"))).alias("rows"))
    states = f"""aggregate(rows, named_struct('s', 0D, 'out', cast(array() as array<struct<hour_idx:int,ewma:double>>)),
        (a, r) -> named_struct('s', (1 - {EWMA_WEIGHT}D) * a.s + {EWMA_WEIGHT}D * r.z,
          'out', concat(a.out, array(named_struct('hour_idx', r.hour_idx, 'ewma', abs((1 - {EWMA_WEIGHT}D) * a.s + {EWMA_WEIGHT}D * r.z)))))).out"""
    out = rows.select(F.inline(F.expr(states)))
    return out.withColumn("ewma", F.when(F.row_number().over(Window.orderBy("hour_idx")) >= width, F.col("ewma")))  # one row per hour


def monitors(inputs: DataFrame, residual: DataFrame, reference: int, width: int) -> DataFrame:
    """(monitor, kind, hour_idx, value) of the two input and the two residual statistics."""
    long = inputs.unpivot(["hour_idx"], [c for c in inputs.columns if c != "hour_idx"], "monitor", "value").withColumn("kind", F.lit("input"))
    two = {"residual_mean_cusum": cusum(residual, reference, width).withColumnRenamed("cusum", "value"), "residual_abs_ewma": ewma(residual, reference, width).withColumnRenamed("ewma", "value")}
    for name, df in two.items():
        long = long.unionByName(df.select("hour_idx", F.lit(name).alias("monitor"), "value", F.lit("residual").alias("kind")))
    return long.select("monitor", "kind", "hour_idx", "value")


def calibrate(statistics: DataFrame, rates: tuple[float, ...], stable: F.Column) -> DataFrame:
    """(monitor, kind, far, threshold, achieved, n_stable, n_false): for each rate of false alarms per 1000 hours the exact quantile of the
    stable hours; alarms are strictly above."""
    calm = statistics.where(stable & F.col("value").isNotNull())
    far = F.array(*[F.lit(float(r)) for r in rates])
    q = calm.groupBy("monitor", "kind").agg(F.percentile("value", [1 - r / 1000 for r in rates]).alias("q"), F.count("*").alias("n_stable"))
    thresholds = q.select("monitor", "kind", "n_stable", F.posexplode("q").alias("k", "threshold")).withColumn("far", F.element_at(far, F.col("k") + 1))
    above = calm.select("monitor", "value").join(F.broadcast(thresholds.select("monitor", "far", "threshold")), "monitor").groupBy("monitor", "far").agg(
        F.count_if(F.col("value") > F.col("threshold")).alias("n_false"))
    return thresholds.join(above, ["monitor", "far"]).select("monitor", "kind", "far", "threshold", (F.col("n_false") * 1000.0 / F.col("n_stable")).alias("achieved"), "n_stable", "n_false")


def first_alert(statistics: DataFrame, thresholds: DataFrame, event_hour: int) -> DataFrame:
    """(monitor, far, alarm): the first hour at or after the event strictly above the threshold; null if none is."""
    joined = statistics.where((F.col("hour_idx") >= event_hour) & F.col("value").isNotNull()).select("monitor", "hour_idx", "value").join(
        F.broadcast(thresholds.select("monitor", "far", "threshold")), "monitor")
    return joined.groupBy("monitor", "far").agg(F.min(F.when(F.col("value") > F.col("threshold"), F.col("hour_idx"))).alias("alarm"))


def detections(statistics: DataFrame, rates: tuple[float, ...], stable: F.Column, event_hour: int) -> DataFrame:
    """The calibration of every monitor at every rate, with detected and delay (hours from the event to the first alarm, -1 where there's none)."""
    known = calibrate(statistics, rates, stable)
    found = known.join(first_alert(statistics, known, event_hour), ["monitor", "far"], "left")
    return found.withColumns({"detected": F.col("alarm").isNotNull(), "delay": F.coalesce(F.col("alarm") - event_hour, F.lit(-1))}).drop("alarm")


def best_monitors(detection: DataFrame) -> DataFrame:
    """For each rate the first monitor of each side to alert; a side that never does has an infinite delay and the monitor "none"."""
    side = lambda kind: F.min(F.when(F.col("detected") & (F.col("kind") == kind), F.struct("delay", "monitor")))
    best = detection.groupBy("far").agg(side("input").alias("i"), side("residual").alias("r"))
    delay = lambda c: F.coalesce(F.col(f"{c}.delay").cast("double"), F.lit(float("inf")))
    return best.select("far", F.coalesce("i.monitor", F.lit("none")).alias("input_monitor"), delay("i").alias("input_delay"),
                       F.coalesce("r.monitor", F.lit("none")).alias("residual_monitor"), delay("r").alias("residual_delay"), (delay("i") > delay("r")).alias("input_later"))


def trigger_schedule(alarms: DataFrame, cooldown: int) -> DataFrame:
    """Alarm hours that start a refit: none within `cooldown` hours of the last. One row per alarm of one city series."""
    hours = alarms.agg(F.sort_array(F.collect_set("hour_idx")).alias("hs"))
    kept = f"aggregate(hs, cast(array() as array<int>), (a, h) -> if(size(a) = 0 or h - element_at(a, -1) >= {cooldown}, concat(a, array(h)), a))"
    return hours.select(F.explode(F.expr(kept)).alias("hour_idx"))


def model_in_force(hours: DataFrame, refits: DataFrame) -> DataFrame:
    """The latest refit not later than each hour (as-of), null before the first."""
    marked = hours.join(refits.select("hour_idx", F.col("hour_idx").alias("refit")).distinct(), "hour_idx", "left")
    order = Window.orderBy("hour_idx").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select("hour_idx", F.last("refit", ignorenulls=True).over(order).alias("refit_hour"))
