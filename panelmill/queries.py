"""Registered queries of the panel engine and their SQL.

Doubles are rounded to six digits on both sides, since sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators import anomaly, breaks, capacity, eda, features, forecasts, graph, models, monitor, quality, reports, segments
from panelmill.settings import DEFAULT
from panelmill.sources import files
from panelmill.sources.panel import Panel, from_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FACT = "occupancy"
#: Of the capacity study: worlds of each scenario, hours of its busiest stretch, points to place.
SEEDS, STRETCH, BUDGETS = 20, 336, (50, 100, 200, 400, 800)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, columns: str = "", body: str = "") -> Callable:
    """Registers a function of a panel; columns and body are the SQL: `columns` selected, doubles as r(...), from `body`."""
    def add(make: Callable[[Panel], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(make(from_events(spark, sf_dir)))
        if body:
            ORACLE[name] = f"{CTE} SELECT {columns} {body}"
        return make
    return add


def r(*names: str) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]}, 6) + 0.0 AS {n.split(' AS ')[-1]}" for n in names)


CTE = f"""
WITH cells AS (SELECT (user_id % {DEFAULT.zones})::INT AS zone_id, date_trunc('hour', ts)::TIMESTAMP AS ts, count(*)::DOUBLE AS occupancy, sum(value) AS volume,
    sum(CASE WHEN value > 50 THEN 50.0::DOUBLE ELSE value END) AS volume_11kw, count(DISTINCT user_id)::DOUBLE AS duration
  FROM events WHERE ts >= TIMESTAMP '{DEFAULT.start}' AND ts < TIMESTAMP '{DEFAULT.start}' + to_hours({DEFAULT.hours}) AND user_id IS NOT NULL GROUP BY 1, 2),
hours AS (SELECT i::INT AS hour_idx, TIMESTAMP '{DEFAULT.start}' + to_hours(i::INT) AS ts FROM range({DEFAULT.hours}) t(i)),
nations AS (SELECT n_nationkey::INT AS zone_id, n_regionkey::INT AS region_id FROM nation),
adjacency AS (SELECT a.zone_id, b.zone_id AS neighbour_id FROM nations a JOIN nations b USING (region_id)
  WHERE a.zone_id <= b.zone_id OR (a.zone_id + b.zone_id) % 3 <> 0),
edges AS (SELECT DISTINCT zone_id, neighbour_id, 500.0::DOUBLE * abs(zone_id - neighbour_id) AS distance_m
  FROM (SELECT zone_id, neighbour_id FROM adjacency UNION ALL SELECT neighbour_id, zone_id FROM adjacency) WHERE zone_id <> neighbour_id),
zones AS (SELECT n.zone_id, coalesce(c.capacity_points, 0)::INT AS capacity_points, coalesce(s.n_stations, 0)::BIGINT AS n_stations,
    coalesce(s.charge_count, 0)::BIGINT AS charge_count, coalesce(d.n_neighbours, 0)::BIGINT AS n_neighbours, s.* EXCLUDE (zone_id, n_stations, charge_count) FROM nations n
  LEFT JOIN (SELECT zone_id, max(occupancy)::INT AS capacity_points FROM cells GROUP BY 1) c USING (zone_id)
  LEFT JOIN (SELECT c_nationkey::INT AS zone_id, count(*) AS n_stations, sum(1 + c_custkey % 2) AS charge_count, 1e6::DOUBLE * (c_nationkey + 1) AS area_m2,
      4000.0::DOUBLE * (c_nationkey + 1) AS perimeter_m, avg(110 + c_custkey % 100 / 100.0::DOUBLE) AS centroid_lon, avg(20 + c_custkey % 50 / 100.0::DOUBLE) AS centroid_lat,
      avg(1 + c_custkey % 2) AS mean_points_per_station, max(1 + c_custkey % 2)::BIGINT AS max_points_per_station, count(*) / (1.0::DOUBLE * (c_nationkey + 1)) AS station_density,
      sum(1 + c_custkey % 2) / (1.0::DOUBLE * (c_nationkey + 1)) AS points_density, 4000.0::DOUBLE * (c_nationkey + 1) / (2 * sqrt(pi() * 1e6::DOUBLE * (c_nationkey + 1))) AS shape_index
    FROM customer GROUP BY c_nationkey) s USING (zone_id)
  LEFT JOIN (SELECT zone_id, count(*) AS n_neighbours FROM edges GROUP BY 1) d USING (zone_id)),
obs AS (SELECT z.zone_id, h.ts, h.hour_idx, coalesce(c.occupancy, 0) AS occupancy, coalesce(c.volume, 0) AS volume, coalesce(c.volume_11kw, 0) AS volume_11kw,
    coalesce(c.duration, 0) AS duration, 0.6::DOUBLE + 0.1::DOUBLE * (hour(h.ts) // 6) AS e_price, 0.4::DOUBLE AS s_price, z.capacity_points,
    coalesce(c.occupancy / nullif(z.capacity_points, 0), 0)::DOUBLE AS utilisation, h.ts::DATE AS obs_date, hour(h.ts)::INT AS hour_of_day,
    (isodow(h.ts) - 1)::INT AS day_of_week, (isodow(h.ts) >= 6)::INT AS is_weekend, (h.ts::DATE = DATE '2024-01-01')::INT AS is_holiday
  FROM zones z CROSS JOIN hours h LEFT JOIN cells c ON c.zone_id = z.zone_id AND c.ts = h.ts),
weather AS (SELECT s.station, h.ts, h.hour_idx, w.air_temp_c, w.humidity_pct, w.rain_category, w.dewpoint_c FROM (VALUES ('click', 'central'), ('view', 'airport')) s(kind, station) CROSS JOIN hours h
  LEFT JOIN (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS air_temp_c, max(value) AS humidity_pct, count(*) AS rain_category,
    min(value) AS dewpoint_c FROM events GROUP BY 1, 2) w ON w.ts = h.ts AND w.event_type = s.kind),
city AS (SELECT ts, hour_idx, sum(occupancy) AS occupancy, sum(volume) AS volume, sum(duration) AS duration, sum(occupancy) / nullif(sum(capacity_points), 0) AS utilisation FROM obs GROUP BY 1, 2),
folds AS (SELECT k::INT AS fold, (432 + 72 * k)::INT AS test_start, (504 + 72 * k)::INT AS test_end FROM range(4) t(k)),
denominators AS (SELECT fold, zone_id, nullif(avg(step), 0) AS denominator FROM (SELECT zone_id, hour_idx,
    abs({FACT} - lag({FACT}, 24) OVER (PARTITION BY zone_id ORDER BY hour_idx)) AS step FROM obs) JOIN folds ON hour_idx < test_start GROUP BY 1, 2),
baselines AS (SELECT zone_id, hour_idx, fold, hour_of_day, day_of_week, utilisation, actual, family, predicted FROM (
    SELECT zone_id, hour_idx, hour_of_day, day_of_week, utilisation, {FACT} AS actual, lag({FACT}, 6) OVER w AS last_observation, lag({FACT}, 24) OVER w AS seasonal_daily,
      lag({FACT}, 168) OVER w AS seasonal_weekly FROM obs WINDOW w AS (PARTITION BY zone_id ORDER BY hour_idx))
  UNPIVOT (predicted FOR family IN (last_observation, seasonal_daily, seasonal_weekly)) JOIN folds ON hour_idx >= test_start AND hour_idx < test_end),
shares AS (SELECT zone_id, neighbour_id, distance_m, exp(-distance_m / 2000) / sum(exp(-distance_m / 2000)) OVER (PARTITION BY zone_id) AS weight FROM edges),
daily AS (SELECT obs_date, avg(utilisation) AS utilisation, avg(occupancy) AS occupancy, sum(volume) AS volume, sum(duration) AS duration FROM (SELECT *, ts::DATE AS obs_date FROM city) GROUP BY 1),
series AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY obs_date)::INT - 1 AS position, obs_date, value,
    value - avg(value) OVER (PARTITION BY series, isodow(obs_date)) + avg(value) OVER (PARTITION BY series) AS adjusted
  FROM (SELECT obs_date, utilisation, volume, duration FROM daily) UNPIVOT (value FOR series IN (utilisation, volume, duration)))
"""
CEILING_COUNT = "count(*) FILTER (utilisation >= 0.999) AS hours_at_ceiling"

query("q1_daily_profile", "zone_id, obs_date, day_of_week, is_weekend, is_holiday, count(*) AS n_hours, " + r(
    "sum(volume) AS volume_kwh", "sum(volume_11kw) AS volume_11kw_kwh", "sum(duration) AS point_hours", "avg(occupancy) AS mean_occupancy", "max(occupancy) AS peak_occupancy",
    "avg(utilisation) AS mean_utilisation", "max(utilisation) AS peak_utilisation", "avg(e_price + s_price) AS mean_total_price") + ", " + CEILING_COUNT,
    "FROM obs GROUP BY 1, 2, 3, 4, 5")(reports.daily_profile)
query("q2_hourly_profile", "zone_id, hour_of_day, is_weekend, count(*) AS n_obs, " + r(
    "avg(occupancy) AS mean_occupancy", "avg(utilisation) AS mean_utilisation", "avg(volume) AS mean_volume_kwh", "avg(duration) AS mean_point_hours", "max(utilisation) AS max_utilisation"),
    "FROM obs GROUP BY 1, 2, 3")(reports.hourly_profile)
query("q3_zone_ranking", "zone_id, z.capacity_points, n_stations, n_neighbours, count(*) AS n_hours, count(*) FILTER (utilisation >= 0.9) AS hours_above_90pct, " + r(
    "sum(volume) AS total_volume_kwh", "sum(volume_11kw) AS total_volume_11kw_kwh", "sum(duration) AS total_point_hours", "avg(utilisation) AS mean_utilisation",
    "max(utilisation) AS peak_utilisation", "avg(e_price) AS mean_e_price", "avg(s_price) AS mean_s_price", "avg(e_price + s_price) AS mean_total_price",
    "count(*) FILTER (utilisation >= 0.999) / count(*) AS share_at_ceiling", "sum(volume) / nullif(z.capacity_points, 0) AS kwh_per_point") + ", " + CEILING_COUNT,
    "FROM obs JOIN zones z USING (zone_id) GROUP BY 1, 2, 3, 4")(reports.zone_ranking)
query("q4_peak_windows", "zone_id, window_start, ((window_start + 3) % 24)::INT AS window_end, " + r("window_utilisation"), """
    FROM (SELECT *, rank() OVER (PARTITION BY zone_id ORDER BY round(window_utilisation, 12) DESC) AS rk FROM (
      SELECT s.zone_id, s.hour_of_day AS window_start, avg(t.u) AS window_utilisation, count(*) AS n
      FROM (SELECT zone_id, hour_of_day, avg(utilisation) AS u FROM obs WHERE is_weekend = 0 GROUP BY 1, 2) s
      JOIN (SELECT zone_id, hour_of_day, avg(utilisation) AS u FROM obs WHERE is_weekend = 0 GROUP BY 1, 2) t
        ON s.zone_id = t.zone_id AND (t.hour_of_day - s.hour_of_day + 24) % 24 < 4 GROUP BY 1, 2) WHERE n = 4) WHERE rk = 1""")(reports.peak_windows)


def _check(name: str, failing: str, total: str, kind: str = "fail", source: str = "obs") -> str:
    status = "'info'" if kind == "info" else "CASE WHEN f = 0 THEN 'pass' ELSE 'fail' END"
    return f"SELECT '{name}' AS check_id, f::BIGINT AS n_failing, t::BIGINT AS n_total, {status} AS status FROM (SELECT {failing} AS f, {total} AS t FROM {source})"


N_ROWS = DEFAULT.zones * DEFAULT.hours
query("q5_checks", "*", "FROM (" + " UNION ALL ".join([
    _check("row_count", f"abs(count(*) - {N_ROWS})", str(N_ROWS)), _check("distinct_hours", "abs(count(DISTINCT ts) - 720)", "720"),
    _check("distinct_zones", "abs(count(DISTINCT zone_id) - 25)", "25"), _check("duplicate_keys", "count(*) - count(DISTINCT (zone_id, ts))", "count(*)"),
    _check("ragged_zone_coverage", "count(*) FILTER (n <> 720)", "25", source="(SELECT count(*) AS n FROM obs GROUP BY zone_id)"),
    _check("negative_values", "count(*) FILTER (occupancy < 0 OR volume < 0 OR volume_11kw < 0 OR duration < 0 OR e_price < 0 OR s_price < 0)", "count(*)"),
    _check("utilisation_above_one", "count(*) FILTER (utilisation > 1.000001)", "count(*)"),
    _check("duration_above_capacity", "count(*) FILTER (duration > capacity_points + 0.000001)", "count(*)"),
    _check("occupancy_without_volume", "count(*) FILTER (occupancy > 0 AND volume = 0)", "count(*)", "info"),
    _check("volume_without_occupancy", "count(*) FILTER (volume > 0 AND occupancy = 0)", "count(*)", "info"),
    _check("saturated_zone_hours", "count(*) FILTER (utilisation >= 0.999)", "count(*)", "info"),
    _check("zones_missing_attributes", "count(*)", "25", source="(SELECT DISTINCT o.zone_id FROM obs o LEFT JOIN zones z USING (zone_id) WHERE z.zone_id IS NULL)"),
    _check("edges_are_reciprocal", "count(*) FILTER (NOT EXISTS (SELECT 1 FROM edges b WHERE b.zone_id = a.neighbour_id AND b.neighbour_id = a.zone_id))", "count(*)", source="edges a"),
    _check("weather_hours", "abs(count(DISTINCT ts) - 720)", "720", source="weather")]) + ")")(reports.checks)

query("observations", "* REPLACE (" + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("volume", "volume_11kw", "e_price", "utilisation")) + ")",
      "FROM obs")(lambda p: p.observations)
query("hourly_completeness", "0::BIGINT AS duplicated, count(*) FILTER (c.ts IS NULL) AS missing, 0::BIGINT AS unexpected", "FROM hours h LEFT JOIN (SELECT DISTINCT ts FROM cells) c USING (ts)")(
    lambda p: files.hourly_faults(p.observations.where("occupancy > 0").select("ts").distinct(), p.hours))
query("unpivot_long", "zone_id, ts, measure, " + r("value"), """FROM (SELECT zone_id, ts, occupancy, volume, duration FROM obs)
    UNPIVOT (value FOR measure IN (occupancy, volume, duration))""")(
    lambda p: p.observations.unpivot(["zone_id", "ts"], ["occupancy", "volume", "duration"], "measure", "value"))
query("align_long", "zone_id, ts, " + r("occupancy", "volume", "duration"), "FROM obs")(
    lambda p: files.build_long({m: p.observations.select("zone_id", "ts", m) for m in ("occupancy", "volume", "duration")}))
query("zone_attributes", "zone_id, capacity_points, n_stations, charge_count, n_neighbours, max_points_per_station, " + r(
    "area_m2", "perimeter_m", "centroid_lon", "centroid_lat", "mean_points_per_station", "station_density", "points_density", "shape_index"), "FROM zones")(lambda p: p.zones)
query("weather_long", "station, ts, hour_idx, rain_category, " + r("air_temp_c", "humidity_pct", "dewpoint_c"), "FROM weather")(lambda p: p.weather)
query("edges_symmetrised", "zone_id, neighbour_id, " + r("distance_m"), "FROM edges")(lambda p: p.edges)
query("edges_one_way", "zone_id, neighbour_id", "FROM adjacency a WHERE NOT EXISTS (SELECT 1 FROM adjacency b WHERE b.zone_id = a.neighbour_id AND b.neighbour_id = a.zone_id)")(
    lambda p: graph.one_way(p.adjacency))
query("neighbour_weights", "zone_id, neighbour_id, " + r("distance_m", "weight"), "FROM shares")(lambda p: graph.decay_weights(p.edges))
query("zone_degree", "zone_id, n_neighbours", "FROM zones")(lambda p: graph.degree(p.zones, p.edges))
query("neighbour_lists", "zone_id, array_to_string(list(neighbour_id ORDER BY neighbour_id), ',') AS neighbours", "FROM edges GROUP BY zone_id")(
    lambda p: graph.neighbour_lists(p.edges).select("zone_id", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours")))
query("nearest_zones", "zone_id, neighbour_id, distance_m, rank", "FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY distance_m, neighbour_id)::INT AS rank FROM edges) WHERE rank <= 3")(
    lambda p: graph.nearest(p.edges, 3))
query("aggregate_hourly", "ts, " + r("occupancy", "volume", "duration", "utilisation"), "FROM city")(eda.aggregate_hourly)
query("aggregate_daily", "obs_date, " + r("occupancy", "volume", "duration", "utilisation"), "FROM daily")(eda.aggregate_daily)
query("volume_deciles", "zone_id, " + r("total_volume") + ", ceil(row_number() OVER (ORDER BY round(total_volume, 6), zone_id) * 10.0 / count(*) OVER ())::INT AS decile",
      "FROM (SELECT zone_id, sum(volume) AS total_volume FROM obs GROUP BY 1)")(eda.volume_deciles)
query("hour_of_day_profile", "hour_of_day, " + r("avg(utilisation) AS mean_utilisation", "avg(volume) AS mean_volume", "avg(duration) AS mean_duration"), "FROM obs GROUP BY 1")(eda.hour_of_day_profile)
query("saturation_profile", "zone_id, " + r("avg(utilisation) AS mean", "quantile_cont(utilisation, 0.95) AS p95", "max(utilisation) AS max",
      "count(*) FILTER (utilisation >= 0.999) / count(*) AS share_at_ceiling", "count(*) FILTER (utilisation >= 0.9) / count(*) AS share_above_90",
      "count(*) FILTER (utilisation = 0) / count(*) AS share_idle"), "FROM obs GROUP BY 1")(eda.saturation_profile)
query("price_variation", "zone_id, " + r("avg(e_price) AS mean_price", "stddev_samp(e_price) AS std_price") + ", count(*) FILTER (was IS NULL OR was <> e_price) AS n_changes",
      "FROM (SELECT *, lag(e_price) OVER (PARTITION BY zone_id ORDER BY hour_idx) AS was FROM obs) GROUP BY 1")(eda.price_variation)
query("estimate_comparison", "zone_id, " + r("sum(volume) AS rated", "sum(volume_11kw) AS capped", "sum(volume) / nullif(sum(duration), 0) AS implied_kw",
      "sum(volume_11kw) / nullif(sum(duration), 0) AS implied_kw_capped", "sum(volume) / nullif(sum(volume_11kw), 0) AS ratio"), "FROM obs GROUP BY 1")(eda.estimate_comparison)
query("measured_summary", "*", "FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS measure, " + r(
    f"min({m}) AS min", f"median({m}) AS median", f"avg({m}) AS mean", f"max({m}) AS max", f"count(*) FILTER ({m} = 0) / count(*) AS zero_share") + " FROM obs"
    for m in ("occupancy", "volume", "volume_11kw", "duration", "utilisation")) + ")")(eda.measured_summary)
query("summary_rows", "*", "FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, round(({e})::DOUBLE, 6) + 0.0 AS value FROM {t}" for n, e, t in [
    ("fact_rows", "count(*)", "obs"), ("zones", "count(DISTINCT zone_id)", "obs"), ("hours", "count(DISTINCT ts)", "obs"), ("total_volume", "sum(volume)", "obs"),
    ("total_volume_11kw", "sum(volume_11kw)", "obs"), ("point_hours", "sum(duration)", "obs"), ("mean_utilisation", "avg(utilisation)", "obs"),
    ("saturated_hours", "count(*) FILTER (utilisation >= 0.999)", "obs"), ("estimate_ratio", "sum(volume) / nullif(sum(volume_11kw), 0)", "obs"),
    ("saturated_zones", "count(DISTINCT zone_id) FILTER (utilisation >= 0.999)", "obs"), ("stations", "sum(n_stations)", "zones"), ("points", "sum(capacity_points)", "zones")]) + ")")(eda.summary_rows)

OVER = "OVER (PARTITION BY zone_id ORDER BY hour_idx)"


def _trailing(fn: str, width: int, name: str, column: str = FACT) -> str:
    frame = f"OVER (PARTITION BY zone_id ORDER BY hour_idx ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) {frame} = {width} THEN {fn}({column}) {frame} END AS {name}"


query("lag_features", "zone_id, hour_idx, " + ", ".join(f"lag({FACT}, {k}) {OVER} AS lag_{k}" for k in (0, 1, 2, 23, 24, 47, 167)), "FROM obs")(
    lambda p: p.observations.select("zone_id", "hour_idx", *[c.alias(n) for n, c in features.lag_columns(FACT).items()]))
query("rolling_features", "zone_id, hour_idx, " + r(*[_trailing(f, w, n) for f, w, n in [
    ("avg", 24, "roll_mean_24"), ("stddev_samp", 24, "roll_std_24"), ("avg", 168, "roll_mean_168"), ("stddev_samp", 168, "roll_std_168"), ("max", 24, "roll_max_24"), ("min", 24, "roll_min_24")]]),
    "FROM obs")(lambda p: p.observations.select("zone_id", "hour_idx", *[c.alias(n) for n, c in features.rolling_columns(FACT).items()]))
query("neighbour_mean", "o.zone_id, o.ts, " + r("coalesce(m.v, 0) AS neighbour_mean"), f"""FROM obs o LEFT JOIN (
    SELECT s.zone_id, n.ts, sum(s.weight * n.{FACT}) AS v FROM shares s JOIN obs n ON n.zone_id = s.neighbour_id GROUP BY 1, 2) m ON m.zone_id = o.zone_id AND m.ts = o.ts""")(
    lambda p: graph.neighbour_mean(p.observations, graph.decay_weights(p.edges), FACT))
query("calendar_features", "DISTINCT hour_idx, " + r("sin(2 * pi() * hour_of_day / 24) AS hour_sin", "cos(2 * pi() * hour_of_day / 24) AS hour_cos", "sin(2 * pi() * day_of_week / 7) AS dow_sin",
      "cos(2 * pi() * day_of_week / 7) AS dow_cos", "hour_idx / 720 AS trend"), "FROM obs")(
    lambda p: p.observations.where("zone_id = 0").select("hour_idx", *[c.alias(n) for n, c in features.calendar_columns(720).items()]))
query("design_matrix", f"zone_id, hour_idx, y, is_weekend_then AS at_is_weekend, lag_24, " + r("diff_24"), f"""FROM (SELECT zone_id, hour_idx, lead({FACT}, 6) {OVER} AS y,
    lead(is_weekend, 6) {OVER} AS is_weekend_then, lag({FACT}, 24) {OVER} AS lag_24, {FACT} - lag({FACT}, 24) {OVER} AS diff_24 FROM obs) WHERE y IS NOT NULL AND hour_idx >= 167""")(
    lambda p: features.design(features.build_features(p, FACT), p, FACT, 6).select("zone_id", "hour_idx", "y", "at_is_weekend", "lag_24", "diff_24"))
query("flat_runs", "zone_id, count(*) FILTER (len >= 4) AS n_flat, max(len) AS longest, count(*) AS n_hours", f"""FROM (SELECT zone_id, count(*) OVER (PARTITION BY zone_id, run) AS len FROM (
    SELECT zone_id, hour_idx, sum(change) {OVER} AS run FROM (SELECT zone_id, hour_idx, CASE WHEN lag({FACT}) {OVER} = {FACT} THEN 0 ELSE 1 END AS change FROM obs))) GROUP BY 1""")(
    lambda p: quality.flat_runs(p.observations, FACT))
query("weather_repeats", "station, count(*) FILTER (was = air_temp_c) AS n_repeats, count(*) AS n_hours",
      "FROM (SELECT *, lag(air_temp_c) OVER (PARTITION BY station ORDER BY hour_idx) AS was FROM weather) GROUP BY 1")(lambda p: quality.weather_repeats(p.weather))
query("robust_scores", "zone_id, ts, " + r("score AS robust_score") + ", score >= 6 AS robust_flag", """FROM (SELECT *, coalesce(deviation / nullif(1.4826::DOUBLE *
    median(deviation) OVER (PARTITION BY zone_id, how), 0), 0) AS score FROM (SELECT *, abs(volume - median(volume) OVER (PARTITION BY zone_id, how)) AS deviation
    FROM (SELECT *, day_of_week * 24 + hour_of_day AS how FROM obs)))""")(
    lambda p: quality.robust_scores(p.observations, "volume").select("zone_id", "ts", "robust_score", "robust_flag"))
query("deseasonalised_daily", "series, position, obs_date, " + r("value", "adjusted"), "FROM series")(breaks.deseasonalised)
query("single_split_gain", "series, position, obs_date, round(ls * ls / position + (s - ls) * (s - ls) / (n - position) - s * s / n, 3) + 0.0 AS gain", """FROM (SELECT *, count(*) OVER (PARTITION BY series) AS n,
    sum(adjusted) OVER (PARTITION BY series) AS s, sum(adjusted) OVER (PARTITION BY series ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls FROM series)
    WHERE position >= 3 AND n - position >= 3""")(
    lambda p: breaks.split_gains(breaks.deseasonalised(p), 3).withColumn("gain", F.round("gain", 3)))
query("cv_folds", "*", "FROM folds")(lambda p: forecasts.fold_table(p.observations.sparkSession))
query("seasonal_denominator", "fold, zone_id, " + r("denominator"), "FROM denominators")(lambda p: forecasts.denominators(p, FACT))
query("baseline_forecasts", "zone_id, hour_idx, fold, family, predicted, actual", "FROM baselines")(
    lambda p: forecasts.baselines(p, FACT, 6).select("zone_id", "hour_idx", "fold", "family", "predicted", "actual"))
query("metrics_grid", "family, zone_id, hour_of_day, day_of_week, count(*) AS n, " + r(
    "avg(abs(e)) AS mae", "sqrt(avg(e * e)) AS rmse", "avg(e) AS bias", "avg(abs(e) / nullif(abs(actual), 0)) * 100 AS mape", "count(*) FILTER (actual <> 0) / count(*) AS mape_coverage",
    "avg(abs(e) / denominator) AS mase", "count(denominator) / count(*) AS mase_coverage", "sum(w * abs(e)) / sum(w) AS weighted_mae"),
    """FROM (SELECT *, predicted - actual AS e, 1 + 3 * greatest(0.0::DOUBLE, least(utilisation, 1.0::DOUBLE)) AS w FROM baselines LEFT JOIN denominators USING (fold, zone_id))
    GROUP BY GROUPING SETS ((family), (family, zone_id), (family, hour_of_day), (family, day_of_week))""")(
    lambda p: forecasts.score_grid(forecasts.baselines(p, FACT, 6), forecasts.denominators(p, FACT)))
query("spearman_rank", r("corr(x, y) AS spearman"), """FROM (SELECT rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2 AS x, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS y
    FROM (SELECT round(avg(utilisation), 9) AS u, round(sum(volume), 6) AS v FROM obs GROUP BY zone_id))""")(
    lambda p: forecasts.spearman(p.observations.groupBy("zone_id").agg(F.round(F.avg("utilisation"), 9).alias("u"), F.round(F.sum("volume"), 6).alias("v")), "u", "v"))
query("top_overlap", "zone_id", """FROM (SELECT zone_id, row_number() OVER (ORDER BY u DESC, zone_id) AS a, row_number() OVER (ORDER BY v DESC, zone_id) AS b
    FROM (SELECT zone_id, round(avg(utilisation), 9) AS u, round(sum(volume), 6) AS v FROM obs GROUP BY zone_id)) WHERE a <= 10 AND b <= 10""")(lambda p: _top_overlap(p, 10))
query("load_shapes", "zone_id, slot, " + r("coalesce(u / nullif(m, 0), 0) AS value"), """FROM (SELECT *, avg(u) OVER (PARTITION BY zone_id) AS m FROM (
    SELECT zone_id, CASE WHEN is_weekend = 1 THEN 'weekend_' ELSE 'weekday_' END || lpad(hour_of_day::VARCHAR, 2, '0') AS slot, avg(utilisation) AS u FROM obs GROUP BY 1, 2))""")(
    lambda p: segments.load_shapes(p).unpivot(["zone_id"], segments.SLOTS, "slot", "value"))
query("peak_stretch", "start, busy", """FROM (SELECT hour_idx AS start, sum(occupancy) OVER w AS busy, count(*) OVER w AS n FROM city
    WINDOW w AS (ORDER BY hour_idx ROWS BETWEEN CURRENT ROW AND 167 FOLLOWING)) WHERE n = 168 ORDER BY busy DESC, start LIMIT 1""")(lambda p: capacity.peak_stretch(p, 168))
query("erlang_b", "zone_id, " + r("list_reduce(list_prepend(1.0::DOUBLE, [n::DOUBLE FOR n IN range(1, capacity_points + 1)]), lambda b, n: a * b / (n + a * b)) AS blocking"),
      "FROM (SELECT zone_id, capacity_points, 0.7::DOUBLE * capacity_points AS a FROM zones)")(
    lambda p: p.zones.withColumn("a", 0.7 * F.col("capacity_points")).select("zone_id", capacity.erlang_b("capacity_points", "a").alias("blocking")))
query("largest_remainder", "zone_id, (floor(e) + CASE WHEN row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, zone_id) <= 100 - sum(floor(e)) OVER () THEN 1 ELSE 0 END)::BIGINT AS added",
      "FROM (SELECT zone_id, round(100 * u / sum(u) OVER (), 9) AS e FROM (SELECT zone_id, avg(utilisation) AS u FROM obs GROUP BY 1))")(
    lambda p: capacity.apportion(p.observations.groupBy("zone_id").agg(F.avg("utilisation").alias("u")), "u", 100).withColumn("added", F.col("added").cast("bigint")))
query("keep_last", "zone_id, obs_date, " + r("volume"), "FROM (SELECT *, row_number() OVER (PARTITION BY zone_id, obs_date ORDER BY hour_idx DESC) AS k FROM obs) WHERE k = 1")(
    lambda p: files.keep_last(p.observations, ["zone_id", "obs_date"], ["hour_idx"]).select("zone_id", "obs_date", "volume"))
query("asof_schedule", "hour_idx, (CASE WHEN hour_idx >= 100 THEN 100 + (hour_idx - 100) // 150 * 150 END)::INT AS refit_hour", "FROM hours")(
    lambda p: monitor.model_in_force(p.hours.select("hour_idx"), p.hours.where("hour_idx >= 100 and (hour_idx - 100) % 150 = 0")))
EDGES = """edges10 AS (SELECT list_filter(list_sort(list_distinct(q)), lambda e: e > low AND e < high) AS es FROM (SELECT list_transform(quantile_cont(round(volume, 9), [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]), lambda e: round(e, 9)) AS q,
    min(round(volume, 9)) AS low, max(round(volume, 9)) AS high FROM obs WHERE hour_idx < 168))"""
MONITOR_CTE = f"""{EDGES}, placed AS (SELECT hour_idx, len(list_filter(es, lambda e: round(volume, 9) >= e)) AS bin, count(*) AS n FROM obs, edges10 GROUP BY 1, 2),
    dense AS (SELECT hour_idx, b.bin, coalesce(n, 0) AS n FROM hours CROSS JOIN (SELECT unnest(range(len(es) + 1)) AS bin FROM edges10) b LEFT JOIN placed USING (hour_idx, bin)),
    ref AS (SELECT bin, sum(n) / sum(sum(n)) OVER () AS e FROM dense WHERE hour_idx < 168 GROUP BY 1),
    win AS (SELECT hour_idx, bin, sum(n) OVER w AS n, count(*) OVER w AS hours_in FROM dense WINDOW w AS (PARTITION BY bin ORDER BY hour_idx ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)),
    act AS (SELECT hour_idx, bin, n / sum(n) OVER (PARTITION BY hour_idx) AS a, e FROM win JOIN ref USING (bin) WHERE hours_in = 168),
    gaps AS (SELECT hour_idx, (greatest(a, 1e-6) - greatest(e, 1e-6)) * ln(greatest(a, 1e-6) / greatest(e, 1e-6)) AS term,
      abs(sum(a) OVER (PARTITION BY hour_idx ORDER BY bin) - sum(e) OVER (PARTITION BY hour_idx ORDER BY bin)) AS gap FROM act),
    drifts AS (SELECT hour_idx, sum(term) AS psi, max(gap) AS ks FROM gaps GROUP BY 1),
    res AS (SELECT hour_idx, avg(e) AS m, avg(abs(e)) AS a FROM (SELECT hour_idx, {FACT} - lag({FACT}, 24) {OVER} AS e FROM obs) WHERE e IS NOT NULL GROUP BY 1),
    base AS (SELECT avg(m) AS c, coalesce(nullif(stddev_pop(m), 0), 1) AS s FROM (SELECT * FROM res ORDER BY hour_idx LIMIT 168)),
    zs AS (SELECT hour_idx, list((m - c) / s) OVER (ORDER BY hour_idx ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS z FROM res, base),
    cus AS (SELECT hour_idx, CASE WHEN len(z) = 48 THEN (list_max(list_transform(range(1, 49), lambda i: greatest(0.0,
      list_max(list_transform(range(1, i + 1), lambda j: list_sum(list_transform(z[j:i], lambda x: x - 0.5)))),
      list_max(list_transform(range(1, i + 1), lambda j: list_sum(list_transform(z[j:i], lambda x: -x - 0.5)))))))) END AS cusum FROM zs)"""
query("input_monitor")(lambda p: monitor.input_monitor(p, "volume", 10, 168, 168))
ORACLE["input_monitor"] = f"{CTE}, {MONITOR_CTE} SELECT hour_idx, {r('psi', 'ks')} FROM drifts"
query("cusum_monitor")(lambda p: monitor.cusum(monitor.residuals(p, FACT), 168, 48))
ORACLE["cusum_monitor"] = f"{CTE}, {MONITOR_CTE} SELECT hour_idx, {r('cusum')} FROM cus"


def _top_overlap(panel: Panel, n: int) -> DataFrame:
    """Zones among the first n of two measures."""
    both = panel.observations.groupBy("zone_id").agg(F.round(F.avg("utilisation"), 9).alias("u"), F.round(F.sum("volume"), 6).alias("v"))
    top = lambda c: both.orderBy(F.desc(c), "zone_id").limit(n).select("zone_id")
    return top("u").intersect(top("v"))


def _retraining(panel: Panel) -> DataFrame:
    start = panel.settings.hours - panel.settings.n_folds * panel.settings.test_hours
    statistics = monitor.monitors(monitor.input_monitors(panel, FACT, 168, 168), monitor.residuals(panel, FACT), 168, 48)
    statistics = files.cached(statistics, files.work_dir(panel.observations.sparkSession, "statistics"))  # read for thresholds and by every monitor
    thresholds = monitor.calibrate(statistics, (5.0,), monitor.mask((0, start - 1)))
    above = statistics.join(F.broadcast(thresholds.select("monitor", "threshold")), "monitor").where("value > threshold")
    alarms = {m: above.where(F.col("monitor") == m).select("hour_idx") for m in ("residual_mean_cusum", "input_psi")}
    return models.retraining(panel, FACT, 6, models.schedules(panel, start, alarms, (72, 144), 72), start + 144)


def _segments(panel: Panel) -> DataFrame:
    shapes = files.cached(segments.load_shapes(panel), files.work_dir(panel.observations.sparkSession, "shapes"))  # one row per zone, read by every fit
    return segments.describe(panel, segments.cluster(shapes, segments.choose_k(segments.diagnostics(shapes))))


def _break_match(panel: Panel) -> DataFrame:
    found = breaks.detect(breaks.deseasonalised(panel))
    return breaks.match_nearest(found.where("method = 'binary'"), found.where("method = 'pruned'"))


for _name, _make in {
        "breaks": lambda p: breaks.detect(breaks.deseasonalised(p)), "break_matches": _break_match,
        "stable_period": lambda p: breaks.monitoring_window(breaks.detect(breaks.deseasonalised(p)).where("series = 'utilisation' and method = 'pruned'"), 30),
        "anomaly_agreement": lambda p: anomaly.agreement(anomaly.flagged(p), "robust_flag", "forest_flag"),
        "anomaly_sample": lambda p: anomaly.sample_per_group(anomaly.flagged(p), "label", ["zone_id", "ts"], 5, 7),
        "ar_forecast": lambda p: models.autoregressive(p, FACT, 6), "zone_ridge_forecast": lambda p: models.zone_ridge(p, FACT, 6),
        "zone_gbm_forecast": lambda p: models.zone_trees(p, FACT, 6),
        "global_ridge_forecast": lambda p: models.global_ridge(p, FACT, 6), "global_gbm_forecast": lambda p: models.global_trees(p, FACT, 6),
        "model_grid": lambda p: models.run_grid(p, (FACT,), (6,), ("autoregressive", "zone_ridge", "zone_gbm", "global_ridge")),
        "retraining_backtest": _retraining, "score_latest": lambda p: models.score_latest(p, FACT, 6),
        "capacity_calibration": lambda p: capacity.calibrate(p).select("zone_id", "hour_idx", "kw", "kw_11", "service_hours", "offered"),
        "greedy_allocation": lambda p: capacity.greedy_allocation(capacity.marginal_gains(capacity.calibrate(p), 20), 20),
        "simulated_marginal": lambda p: capacity.simulated_marginal(p, capacity.calibrate(p), SEEDS, capacity.peak_stretch(p, STRETCH).first()["start"], STRETCH, DEFAULT.base_seed),
        "capacity_scenarios": lambda p: capacity.scenarios(p, SEEDS, BUDGETS, STRETCH, DEFAULT.base_seed),
        "capacity_sensitivity": lambda p: capacity.sensitivity(p, SEEDS // 2, STRETCH, DEFAULT.base_seed),
        "segment_diagnostics": lambda p: segments.diagnostics(segments.load_shapes(p)), "kmeans_segments": _segments}.items():
    query(_name)(_make)
