"""Runs, repeats, robust scores and the quality suite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators import graph
from panelmill.settings import FLAT_RUN, MEASURES
from panelmill.sources.panel import Panel

# The scale that makes a median deviation a standard deviation, and the flag's threshold.
MAD_SCALE = 1.4826
ROBUST_THRESHOLD = 6.0


def run_lengths(observations: DataFrame, column: str) -> DataFrame:
    """Gaps and islands: run_length of the constant run each row is in."""
    order = Window.partitionBy("zone_id").orderBy("hour_idx")
    change = F.when(F.lag(column).over(order).eqNullSafe(F.col(column)) & (F.row_number().over(order) > 1), 0).otherwise(1)
    numbered = observations.withColumn("_change", change).withColumn("run", F.sum("_change").over(order)).drop("_change")
    return numbered.withColumn("run_length", F.count("*").over(Window.partitionBy("zone_id", "run")))


def flat_runs(observations: DataFrame, column: str, at_least: int = FLAT_RUN) -> DataFrame:
    """Hours of each zone that are part of a constant run of `at_least` hours."""
    return run_lengths(observations, column).groupBy("zone_id").agg(
        F.count_if(F.col("run_length") >= at_least).alias("n_flat"), F.max("run_length").alias("longest"), F.count("*").alias("n_hours"))


def weather_repeats(weather: DataFrame) -> DataFrame:
    """Hours that repeat the previous value, per station; the first hour doesn't count."""
    before = F.lag("air_temp_c").over(Window.partitionBy("station").orderBy("hour_idx"))
    return weather.withColumn("was", before).groupBy("station").agg(F.count_if(F.col("was") == F.col("air_temp_c")).alias("n_repeats"), F.count("*").alias("n_hours"))


def robust_scores(observations: DataFrame, column: str, threshold: float = ROBUST_THRESHOLD) -> DataFrame:
    """|x - median| / (1.4826 MAD) within zone and hour of week; a MAD of 0 scores 0."""
    group = Window.partitionBy("zone_id", "hour_of_week")
    scored = (observations.withColumn("hour_of_week", F.col("day_of_week") * 24 + F.col("hour_of_day"))
              .withColumn("deviation", F.abs(F.col(column) - F.median(column).over(group))).withColumn("mad", F.median("deviation").over(group)))
    score = F.coalesce(F.col("deviation") / F.nullif(MAD_SCALE * F.col("mad"), F.lit(0.0)), F.lit(0.0))
    return scored.withColumn("robust_score", score).withColumn("robust_flag", F.col("robust_score") >= threshold)


def status(fraction: F.Column, warn: float, fail: float) -> F.Column:
    return F.when(fraction >= fail, "fail").when(fraction >= warn, "warn").otherwise("pass")


#: Physical bounds of the measures (fixed values); a measure without an upper one has None.
BOUNDS = {"occupancy": (0, None), "volume": (0, None), "volume_11kw": (0, None), "duration": (0, None), "e_price": (0, 5), "s_price": (0, 5)}


def quality_suite(panel: Panel) -> DataFrame:
    """(check_id, n_failing, n_total, fraction, status), 31 checks: one pass for the rows, one for the runs of all measures, small ones for
    index, weather and graph."""
    obs, settings, eps = panel.observations, panel.settings, 1e-6
    bounds = {f"bounds_{c}": f"{c} < {low}" + (f" or {c} > {high}" if high is not None else "") for c, (low, high) in BOUNDS.items()}
    over = {f"capacity_bound_{c}": f"{c} > capacity_points + {eps}" for c in ("occupancy", "duration")}
    cross = {"cross_occupancy_without_volume": "occupancy > 0 and volume <= 0", "cross_volume_without_occupancy": "occupancy <= 0 and volume > 0",
             "cross_duration_without_occupancy": "occupancy <= 0 and duration > 0"}
    more = {"saturated_zone_hours": f"occupancy >= capacity_points - {eps}", "volume_estimates_identical": f"abs(volume - volume_11kw) < {eps}"}
    conditions = bounds | over | cross | more
    cells = sum(F.count_if(F.col(c).isNull()) for c in MEASURES)
    # the change flags of all measures come from one window pass, the runs' lengths from one more for each
    order = Window.partitionBy("zone_id").orderBy("hour_idx")
    flat = ("occupancy", "volume", "duration", "e_price", "s_price")
    new = {f"_{c}": F.when(F.lag(c).over(order).eqNullSafe(F.col(c)) & (F.row_number().over(order) > 1), 0).otherwise(1) for c in flat}
    marked = obs.withColumns(new).withColumns({f"_{c}": F.sum(f"_{c}").over(order) for c in flat})
    runs = marked.select("zone_id", F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"_{c}").alias("run")) for c in flat]))).groupBy("measure", "zone_id", "run").agg(F.count("*").alias("n"))
    runs = runs.groupBy("measure").agg(F.coalesce(F.sum(F.when(F.col("n") >= FLAT_RUN, F.col("n"))), F.lit(0)).alias("n_failing"), F.sum("n").alias("n_total"))
    rows = obs.agg(F.count("*").alias("_n"), cells.alias("_nulls"), *[F.count_if(F.expr(c)).alias(n) for n, c in conditions.items()])
    wide = rows.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_id"), F.col(n).alias("n_failing"), F.col("_n").alias("n_total")) for n in conditions],
                                        F.struct(F.lit("no_nulls").alias("check_id"), F.col("_nulls").alias("n_failing"), (F.col("_n") * len(MEASURES)).alias("n_total")))))
    one = lambda name, df, failing, total: df.agg(failing.alias("n_failing"), total.alias("n_total")).select(F.lit(name).alias("check_id"), "n_failing", "n_total")
    whole = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    per_key = obs.groupBy("zone_id", "ts").agg(F.count("*").alias("n"))
    per_zone = per_key.groupBy("zone_id").agg(F.sum("n").alias("n"))
    hours = obs.select("ts").distinct().agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.count("*").alias("n")).withColumn("span", F.expr("timestampdiff(HOUR, low, high) + 1"))
    weather = panel.weather.select("station", "hour_idx", "air_temp_c", "humidity_pct")
    by_station = Window.partitionBy("station").orderBy("hour_idx")
    repeats = {f"{c}_{s}": (F.col("station") == s) & (F.lag(c).over(by_station) == F.col(c)) for c, s in (("air_temp_c", "central"), ("humidity_pct", "central"), ("air_temp_c", "airport"))}
    still = weather.withColumns(repeats).agg(F.count_distinct("hour_idx").alias("_n"), *[F.count_if(F.col(c)).alias(c) for c in repeats])
    parts = [wide, one("index_completeness", hours, whole(F.sum(F.col("span") - F.col("n"))), whole(F.sum("span"))),
             one("index_length", hours, whole(F.sum(F.abs(F.col("n") - settings.hours))), F.lit(settings.hours).cast("bigint")),
             one("duplicate_keys", per_key, whole(F.sum(F.col("n") - 1)), whole(F.sum("n"))),
             one("zone_count", per_zone, F.abs(F.count("*") - settings.zones), F.lit(settings.zones).cast("bigint")),
             one("zone_coverage", per_zone, F.count_if(F.col("n") != settings.hours), F.count("*")),
             runs.select(F.concat(F.lit("flat_run_"), "measure").alias("check_id"), "n_failing", "n_total"),
             still.select(F.inline(F.array(*[F.struct(F.lit(f"weather_repeat_{c}").alias("check_id"), F.col(c).alias("n_failing"), (F.col("_n") - 1).alias("n_total")) for c in repeats]))),
             one("adjacency_symmetric", graph.one_way(panel.adjacency), 2 * F.count("*"), F.lit(settings.zones**2).cast("bigint")),
             one("adjacency_self_loops", panel.adjacency, F.count_if(F.expr("zone_id = neighbour_id")), F.lit(settings.zones).cast("bigint")),
             one("adjacency_isolated_zones", panel.zones, F.count_if(F.expr("n_neighbours = 0")), F.count("*")),
             one("distance_zero_diagonal", panel.adjacency.where("zone_id = neighbour_id"), F.count_if(500.0 * F.abs(F.expr("zone_id - neighbour_id")) > eps), F.lit(settings.zones).cast("bigint"))]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    fraction = F.coalesce(F.col("n_failing") / F.nullif("n_total", F.lit(0)), F.lit(0.0))
    info = F.col("check_id").rlike("^(saturated|flat_run|weather_repeat|volume_estimates|adjacency_isolated)")
    plain = F.when(F.col("n_failing") == 0, "pass").otherwise("fail")
    verdict = F.when(info, "info").when(F.col("check_id").isin(*cross), status(fraction, 0.01, 0.10)).otherwise(plain)
    return united.withColumns({"fraction": F.round(fraction, 6), "status": verdict})


def cross_check(suite: DataFrame, report: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Counts of checks that two implementations share, side by side: pairs maps the report's names to the suite's."""
    names = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    own = report.where(F.col("check_id").isin(*pairs)).select("check_id", F.element_at(names, F.col("check_id")).alias("suite_id"), F.col("n_failing").alias("sql_count"))
    other = suite.select(F.col("check_id").alias("suite_id"), F.col("n_failing").alias("suite_count"))
    return own.join(other, "suite_id").withColumn("agree", F.col("sql_count") == F.col("suite_count"))
