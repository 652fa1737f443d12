"""Further registered queries: operators on stated inputs, beside SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import bookkeeping, seeds
from panelmill.operators import anomaly, breaks, capacity, claims, eda, features, forecasts, graph, models, monitor, quality, segments
from panelmill.queries import CTE, FACT, MONITOR_CTE, ORACLE, OVER, QUERIES, query, r
from panelmill.settings import DEFAULT, MEASURES
from panelmill.sources import files, sql
from panelmill.sources.panel import Panel, write_tables
from panelmill.streaming.ingest import ingest

BASE = DEFAULT.base_seed


def more(name: str, ctes: str, columns: str, body: str = ""):
    """Registers a query whose SQL has CTEs of its own."""
    def add(make):
        query(name)(make)
        ORACLE[name] = f"{CTE}, {ctes} SELECT {columns} {body}"
        return make
    return add


def _session(p: Panel):
    return p.observations.sparkSession


def _csv(df: DataFrame, name: str) -> str:
    path = files.work_dir(df.sparkSession, name)
    df.coalesce(1).write.option("header", True).csv(path)
    return path


# ---------------------------------------------------------------- files


def _wide_csv(p: Panel) -> DataFrame:
    wide = p.observations.withColumn("time", F.date_format("ts", files.TIME_FORMAT)).groupBy("time").pivot("zone_id", list(range(p.settings.zones))).agg(F.first("volume"))
    long = files.read_wide(_session(p), _csv(wide.orderBy("time"), "wide"), "volume")
    files.assert_hourly(long.select("ts").distinct(), p.hours, "volume")
    return long


query("wide_csv", "zone_id, ts, " + r("volume"), "FROM obs")(_wide_csv)


def _weather_csv(p: Panel) -> DataFrame:
    def path(station: str) -> str:
        raw = p.weather.where(F.col("station") == station).select(
            F.date_format("ts", files.WEATHER_TIME_FORMAT).alias("time"), F.col("air_temp_c").alias("T"), F.col("rain_category").alias("P0"), (F.col("rain_category") + 1).alias("P"),
            F.col("humidity_pct").alias("U"), F.col("rain_category").alias("nRAIN"), F.col("dewpoint_c").alias("Td"))
        return _csv(raw, station)

    return files.load_weather(_session(p), {s: path(s) for s in ("central", "airport")})


query("weather_csv", "ts, " + r(*[f"{t}.{of} AS {name}_{s}" for s, t in (("central", "c"), ("airport", "a")) for name, of in (
    ("air_temp_c", "air_temp_c"), ("pressure_station", "rain_category::DOUBLE"), ("pressure_sea", "pressure"), ("humidity_pct", "humidity_pct"), ("rain_category", "rain_category::DOUBLE"),
    ("dewpoint_c", "dewpoint_c"))]).replace("c.pressure,", "c.rain_category + 1.0::DOUBLE,").replace("a.pressure,", "a.rain_category + 1.0::DOUBLE,"),
    "FROM (FROM weather WHERE station = 'central') c JOIN (FROM weather WHERE station = 'airport') a USING (ts)")(_weather_csv)


def _matrix_csv(p: Panel) -> DataFrame:
    ids = list(range(p.settings.zones))
    square = p.zones.select("zone_id").join(p.adjacency.groupBy("zone_id").pivot("neighbour_id", ids).agg(F.count(F.lit(1))), "zone_id", "left").fillna(0)
    return files.read_matrix(_session(p), _csv(square.orderBy("zone_id").drop("zone_id"), "matrix"), "adjacent")


query("matrix_csv", "a.zone_id, b.zone_id AS neighbour_id, count(e.zone_id)::DOUBLE AS adjacent",
      "FROM nations a CROSS JOIN nations b LEFT JOIN adjacency e ON e.zone_id = a.zone_id AND e.neighbour_id = b.zone_id GROUP BY 1, 2")(_matrix_csv)


def _cache(p: Panel) -> DataFrame:
    path, df = files.work_dir(_session(p), "bundle"), p.observations.select("zone_id", "hour_idx", *MEASURES)
    files.cached(df, path)
    return files.cached(df.where("false"), path)  # there already: what is read is what was written


query("bundle_cache", "zone_id, hour_idx, " + r(*MEASURES), "FROM obs")(_cache)


def _tables(p: Panel) -> DataFrame:
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows")) for name, df in write_tables(p, files.work_dir(_session(p), "tables")).items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


query("reporting_tables", "*", "FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {t}" for n, t in (
    ("observations", "obs"), ("zones", "zones"), ("weather", "weather"), ("edges", "edges"))) + ")")(_tables)

for _report, _own in zip(sql.REPORTS, ("q1_daily_profile", "q2_hourly_profile", "q3_zone_ranking", "q4_peak_windows", "q5_checks")):
    query(f"sql_{_report}")(lambda p, name=_report: sql.run_reports(p)[name])
    ORACLE[f"sql_{_report}"] = ORACLE[_own]


def _shards(p: Panel) -> DataFrame:
    """Two workers' result tables with overlapping keys; the later row of a key stays. Columns outside the field list are left out."""
    spark, paths = _session(p), [files.work_dir(_session(p), "shard") for _ in range(2)]
    daily = p.observations.groupBy("zone_id", "obs_date").agg(F.sum("volume").alias("volume"))
    rows = daily.withColumn("cell_key", F.concat_ws("/", "zone_id", "obs_date"))
    fields = ["cell_key", "seq", "volume"]
    files.append_rows(rows.withColumn("seq", F.lit(1)), paths[0], fields)
    files.append_rows(rows.where("zone_id < 10").withColumns({"seq": F.lit(2), "volume": 2 * F.col("volume")}), paths[0], fields)
    files.append_rows(rows.where("zone_id % 2 = 0").withColumns({"seq": F.lit(3), "volume": -F.col("volume")}), paths[1], fields)
    done = files.consolidate(spark, paths, ["cell_key"], ["seq"], files.work_dir(spark, "consolidated"))
    return done.join(files.existing_keys(spark, paths[1]).withColumn("in_second", F.lit(True)), "cell_key", "left").withColumn("in_second", F.coalesce("in_second", F.lit(False)))


query("consolidated_shards", "zone_id || '/' || obs_date AS cell_key, CASE WHEN zone_id % 2 = 0 THEN 3 WHEN zone_id < 10 THEN 2 ELSE 1 END AS seq, " + r(
    "sum(volume) * (CASE WHEN zone_id % 2 = 0 THEN -1 WHEN zone_id < 10 THEN 2 ELSE 1 END) AS volume") + ", zone_id % 2 = 0 AS in_second", "FROM obs GROUP BY zone_id, obs_date")(_shards)


def _manifest(p: Panel) -> DataFrame:
    path = files.work_dir(_session(p), "manifest")
    p.zones.agg(F.to_json(F.collect_list(F.struct(F.col("zone_id").alias("zone"), "n_stations"))).alias("value")).coalesce(1).write.text(path)
    return files.manifest(_session(p), path)


query("manifest", "zone_id::BIGINT AS zone, n_stations", "FROM zones")(_manifest)


def _digests(p: Panel) -> DataFrame:
    path = files.work_dir(_session(p), "digests")
    p.zones.orderBy("zone_id").select(F.concat(F.lit("zone "), F.col("zone_id").cast("string")).alias("value")).coalesce(1).write.text(path)
    return files.file_digests(_session(p), f"{path}/part-*").select("length", "sha256")


query("file_digests", "length(t)::BIGINT AS length, sha256(t) AS sha256", "FROM (SELECT string_agg('zone ' || zone_id, chr(10) ORDER BY zone_id) || chr(10) AS t FROM zones)")(_digests)


def _progress(p: Panel) -> DataFrame:
    path = files.work_dir(_session(p), "progress")
    for phase, status in ((1, "running"), (2, "pending"), (1, "complete")):
        bookkeeping.mark(_session(p), path, phase, status)
    return bookkeeping.progress(_session(p), path).select("phase", "status")


query("progress", "phase, status", "FROM (VALUES (1, 'complete'), (2, 'pending')) t(phase, status)")(_progress)


def _stream(p: Panel) -> DataFrame:
    """Events of the window in two files, the later one second, and a last event far ahead that makes every hour final."""
    spark, path = _session(p), files.work_dir(_session(p), "stream")
    hours = p.observations.where("occupancy > 0").select("zone_id", "ts", "volume", F.explode(F.sequence(F.lit(1), F.col("occupancy").cast("int"))).alias("k"), "occupancy")
    events = hours.select(F.col("ts"), F.col("zone_id").cast("long").alias("user_id"), (F.col("volume") / F.col("occupancy")).alias("value"))
    tail = spark.sql("select timestamp_ntz'2030-01-01 00:00:00' ts, 0L user_id, 0D value")
    events.unionByName(tail).coalesce(1).write.parquet(f"{path}/events")
    return ingest(spark, f"{path}/events", path).where("ts < timestamp_ntz'2030-01-01 00:00:00'")


query("stream_cells", "zone_id, ts, " + r("occupancy", "volume"), "FROM obs WHERE occupancy > 0")(_stream)

# ---------------------------------------------------------------- predicates, projections

query("clipped_forecasts", "zone_id, hour_idx, fold, family, " + r("least(greatest(predicted * 1.5 - 2, 0), z.capacity_points::DOUBLE) AS clipped"), "FROM baselines JOIN zones z USING (zone_id) WHERE predicted IS NOT NULL")(
    lambda p: forecasts.baselines(p, FACT, 6).where("predicted is not null").select(
        "zone_id", "hour_idx", "fold", "family", forecasts.clip(F.col("predicted") * 1.5 - 2, F.col("capacity_points").cast("double")).alias("clipped")))
query("window_masks", "hour_idx", "FROM hours WHERE hour_idx BETWEEN 100 AND 400 AND NOT hour_idx BETWEEN 200 AND 260")(
    lambda p: p.hours.where(monitor.mask((100, 400), (200, 260))).select("hour_idx"))
query("service_hours", "zone_id, " + r("kw", "kw_11", "CASE WHEN kw >= 22 THEN 1.0 WHEN kw >= 11 THEN 2.0 ELSE 3.5 END::DOUBLE AS service_hours"), """FROM (SELECT zone_id,
    coalesce(sum(volume) / nullif(sum(duration), 0), 0) AS kw, coalesce(sum(volume_11kw) / nullif(sum(duration), 0), 0) AS kw_11 FROM obs GROUP BY 1)""")(capacity.zone_power)
query("usable_columns", "*", "FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, coalesce(count(*) = count(x) AND stddev_pop(x) > 1e-12, false) AS usable FROM (SELECT {e} AS x FROM obs)" for n, e in (
    ("occupancy", "occupancy"), ("e_price", "e_price"), ("s_price", "s_price"), ("lag_24", f"lag({FACT}, 24) {OVER}"))) + ")")(
    lambda p: features.usable_columns(p.observations.withColumn("lag_24", features.back(FACT, 24)), ["occupancy", "e_price", "s_price", "lag_24"]))
query("feature_blocks", "*", "FROM (VALUES ('origin', 21), ('shared', 5), ('calendar', 8), ('static', 9)) t(block, n)")(
    lambda p: _session(p).createDataFrame([(b, len(n)) for b, n in (("origin", features.ORIGIN), ("shared", features.SHARED), ("calendar", features.CALENDAR), ("static", features.STATIC))], "block string, n int"))


def _frame(width: int) -> str:
    return f"OVER (PARTITION BY zone_id ORDER BY hour_idx ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"


def _full(fn: str, column: str, width: int) -> str:
    return f"CASE WHEN count({column}) {_frame(width)} = {width} THEN {fn}({column}) {_frame(width)} END"


FEATURES = f"""near AS (SELECT o.zone_id, o.hour_idx, coalesce(m.v, 0) AS nm FROM obs o LEFT JOIN (SELECT s.zone_id, n.ts, sum(s.weight * n.{FACT}) AS v
      FROM shares s JOIN obs n ON n.zone_id = s.neighbour_id GROUP BY 1, 2) m ON m.zone_id = o.zone_id AND m.ts = o.ts),
    sky AS (SELECT hour_idx, air_temp_c, humidity_pct, rain_category, dewpoint_c, CASE WHEN count(air_temp_c) OVER w = 24 THEN avg(air_temp_c) OVER w END AS air_temp_roll_24
      FROM weather WHERE station = 'central' WINDOW w AS (ORDER BY hour_idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
    feats AS (SELECT o.zone_id, o.hour_idx, {", ".join(f"lag(o.{FACT}, {k}) {OVER} AS lag_{k}" for k in (0, 1, 2, 23, 24, 47, 167))},
      {_full("avg", f"o.{FACT}", 24)} AS roll_mean_24, {_full("stddev_samp", f"o.{FACT}", 24)} AS roll_std_24, {_full("avg", f"o.{FACT}", 168)} AS roll_mean_168,
      {_full("stddev_samp", f"o.{FACT}", 168)} AS roll_std_168, {_full("max", f"o.{FACT}", 24)} AS roll_max_24, {_full("min", f"o.{FACT}", 24)} AS roll_min_24,
      o.{FACT} - lag(o.{FACT}, 1) {OVER} AS diff_1, o.{FACT} - lag(o.{FACT}, 24) {OVER} AS diff_24, nm AS neighbour_mean_0, lag(nm, 23) {OVER} AS neighbour_mean_23,
      o.e_price AS e_price_0, {_full("avg", "o.e_price", 24)} AS e_price_roll_24, o.s_price AS s_price_0, {_full("avg", "o.s_price", 24)} AS s_price_roll_24,
      lead(o.{FACT}, 6) {OVER} AS y, lead(o.hour_of_day, 6) {OVER} AS at_hour_of_day, lead(o.is_weekend, 6) {OVER} AS at_is_weekend, lead(o.is_holiday, 6) {OVER} AS at_is_holiday,
      lead(o.day_of_week, 6) {OVER} AS dow FROM (SELECT obs.*, near.nm FROM obs JOIN near USING (zone_id, hour_idx)) o)"""
FEATURES = FEATURES.replace("PARTITION BY zone_id", "PARTITION BY o.zone_id").replace("ORDER BY hour_idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),", "ORDER BY hour_idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),")
_PLAIN = ("at_hour_of_day", "at_is_weekend", "at_is_holiday", "capacity_points", "n_stations", "n_neighbours", "rain_category")
more("feature_matrix", FEATURES, "zone_id, hour_idx, y, " + ", ".join(_PLAIN) + ", " + r(
    *[c for c in features.ORIGIN + features.SHARED + features.STATIC if c not in (*_PLAIN, "log_area", "air_temp_roll_24")], "round(air_temp_roll_24, 5) AS air_temp_roll_24", "ln(1 + area_m2) AS log_area", "sin(2 * pi() * at_hour_of_day / 24) AS at_hour_sin",
    "cos(2 * pi() * at_hour_of_day / 24) AS at_hour_cos", "sin(2 * pi() * dow / 7) AS at_dow_sin", "cos(2 * pi() * dow / 7) AS at_dow_cos", "(hour_idx + 6) / 720 AS at_trend"),
    "FROM feats JOIN sky USING (hour_idx) JOIN zones USING (zone_id) WHERE y IS NOT NULL AND hour_idx >= 167")(
    lambda p: features.design(features.build_features(p, FACT), p, FACT, 6).select("zone_id", "hour_idx", "y", *features.feature_names()).withColumn(
        "air_temp_roll_24", F.round("air_temp_roll_24", 5)))
query("autoregressive_lags", f"zone_id, hour_idx, lag({FACT}, 0) {OVER} AS first, lag({FACT}, 11) {OVER} AS twelfth, lag({FACT}, 23) {OVER} AS last", "FROM obs")(
    lambda p: features.autoregressive_lags(p.observations, FACT).select("zone_id", "hour_idx", F.col("lags")[0].alias("first"), F.col("lags")[11].alias("twelfth"), F.col("lags")[23].alias("last")))

# ---------------------------------------------------------------- flags


def _robust(column: str) -> str:
    return f"""(SELECT zone_id, hour_idx, coalesce(deviation / nullif(1.4826::DOUBLE * median(deviation) OVER (PARTITION BY zone_id, how), 0), 0) >= 6 AS flag
      FROM (SELECT *, abs({column} - median({column}) OVER (PARTITION BY zone_id, how)) AS deviation FROM (SELECT *, day_of_week * 24 + hour_of_day AS how FROM obs)))"""


FLAGS = f"""flags AS (SELECT a.zone_id, a.hour_idx, a.flag AS by_volume, b.flag AS by_occupancy, CASE WHEN a.flag AND b.flag THEN 'both' WHEN a.flag THEN 'volume_only'
    WHEN b.flag THEN 'occupancy_only' ELSE 'neither' END AS label FROM {_robust("volume")} a JOIN {_robust("occupancy")} b USING (zone_id, hour_idx))"""


def _flags(p: Panel) -> DataFrame:
    by = {c: quality.robust_scores(p.observations, c).select("zone_id", "hour_idx", F.col("robust_flag").alias(f"by_{c}")) for c in ("volume", "occupancy")}
    return anomaly.labelled(by["volume"].join(by["occupancy"], ["zone_id", "hour_idx"]), "by_volume", "by_occupancy", "volume", "occupancy")


more("flag_agreement", FLAGS, """count(*) FILTER (by_volume) AS n_a, count(*) FILTER (by_occupancy) AS n_b, count(*) FILTER (by_volume AND by_occupancy) AS n_both, count(*) AS n_rows,
    round(coalesce(count(*) FILTER (by_volume AND by_occupancy) / nullif(count(*) FILTER (by_volume OR by_occupancy), 0), 0), 6) + 0.0 AS jaccard""", "FROM flags")(
    lambda p: anomaly.agreement(_flags(p), "by_volume", "by_occupancy"))
more("flag_labels", FLAGS, "label, count(*) AS n", "FROM flags GROUP BY 1")(lambda p: _flags(p).groupBy("label").agg(F.count("*").alias("n")))
more("flagged_by_zone", FLAGS, "zone_id, count(*) AS n_flagged", "FROM flags WHERE by_volume GROUP BY 1")(
    lambda p: claims.ranked_by_zone(claims.clean_join(_flags(p).drop("by_occupancy"), p.observations.select("zone_id", "hour_idx", "occupancy"), ["zone_id", "hour_idx"], "by_volume"), "n_flagged"))
more("inspection_sample", FLAGS, "zone_id, hour_idx, label",
     "FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || zone_id || ':' || hour_idx), zone_id, hour_idx) AS k FROM flags) WHERE k <= 5")(
    lambda p: anomaly.sample_per_group(_flags(p), "label", ["zone_id", "hour_idx"], 5, 7).select("zone_id", "hour_idx", "label"))

# ---------------------------------------------------------------- quality

CHECKS = [("duplicate_keys", "count(*) - count(DISTINCT (zone_id, ts))", "count(*)", "obs", ""), ("no_nulls", "count(*) FILTER (occupancy IS NULL) + count(*) FILTER (volume IS NULL)", "count(*) * 6", "obs", ""),
          ("zone_count", "abs(count(DISTINCT zone_id) - 25)", "25", "obs", ""), ("zone_coverage", "count(*) FILTER (n <> 720)", "count(*)", "(SELECT count(*) AS n FROM obs GROUP BY zone_id)", ""),
          ("index_length", "abs(count(DISTINCT ts) - 720)", "720", "obs", ""), ("index_completeness", "date_diff('hour', min(ts), max(ts)) + 1 - count(DISTINCT ts)", "date_diff('hour', min(ts), max(ts)) + 1", "obs", ""),
          *[(f"bounds_{c}", f"count(*) FILTER ({c} < 0 OR {c} > {high})", "count(*)", "obs", "") for c, high in (
              ("occupancy", "1e300"), ("volume", "1e300"), ("volume_11kw", "1e300"), ("duration", "1e300"), ("e_price", "5"), ("s_price", "5"))],
          *[(f"capacity_bound_{c}", f"count(*) FILTER ({c} > capacity_points + 1e-6)", "count(*)", "obs", "") for c in ("occupancy", "duration")],
          ("cross_occupancy_without_volume", "count(*) FILTER (occupancy > 0 AND volume <= 0)", "count(*)", "obs", "cross"),
          ("cross_volume_without_occupancy", "count(*) FILTER (occupancy <= 0 AND volume > 0)", "count(*)", "obs", "cross"),
          ("cross_duration_without_occupancy", "count(*) FILTER (occupancy <= 0 AND duration > 0)", "count(*)", "obs", "cross"),
          ("saturated_zone_hours", "count(*) FILTER (occupancy >= capacity_points - 1e-6)", "count(*)", "obs", "info"),
          ("volume_estimates_identical", "count(*) FILTER (abs(volume - volume_11kw) < 1e-6)", "count(*)", "obs", "info"),
          *[(f"flat_run_{c}", "count(*) FILTER (len >= 4)", "count(*)", f"""(SELECT count(*) OVER (PARTITION BY zone_id, run) AS len FROM (SELECT zone_id, sum(change) {OVER} AS run FROM (
              SELECT zone_id, hour_idx, CASE WHEN lag({c}) {OVER} = {c} THEN 0 ELSE 1 END AS change FROM obs)))""", "info") for c in ("occupancy", "volume", "duration", "e_price", "s_price")],
          *[(f"weather_repeat_{c}_{s}", f"count(*) FILTER (was = {c})", "count(*) - 1", f"(SELECT *, lag({c}) OVER (ORDER BY hour_idx) AS was FROM weather WHERE station = '{s}')", "info") for c, s in (
              ("air_temp_c", "central"), ("humidity_pct", "central"), ("air_temp_c", "airport"))],
          ("adjacency_symmetric", "2 * count(*)", "625", "(FROM adjacency a WHERE NOT EXISTS (SELECT 1 FROM adjacency b WHERE b.zone_id = a.neighbour_id AND b.neighbour_id = a.zone_id))", ""),
          ("adjacency_self_loops", "count(*) FILTER (zone_id = neighbour_id)", "25", "adjacency", ""), ("adjacency_isolated_zones", "count(*) FILTER (n_neighbours = 0)", "count(*)", "zones", "info"),
          ("distance_zero_diagonal", "0", "25", "(SELECT 1)", "")]
SUITE = "suite AS (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS check_id, f::BIGINT AS n_failing, t::BIGINT AS n_total, round(f / t, 6) AS fraction, {"'info'" if kind == "info" else
        "CASE WHEN f / t >= 0.1 THEN 'fail' WHEN f / t >= 0.01 THEN 'warn' ELSE 'pass' END" if kind else "CASE WHEN f = 0 THEN 'pass' ELSE 'fail' END"} AS status
        FROM (SELECT {failing} AS f, {total} AS t FROM {source})""" for n, failing, total, source, kind in CHECKS) + ")"
more("quality_suite", SUITE, "check_id, n_failing, n_total, status, " + r("fraction"), "FROM suite")(quality.quality_suite)
PAIRS = {"occupancy_without_volume": "cross_occupancy_without_volume", "volume_without_occupancy": "cross_volume_without_occupancy", "saturated_zone_hours": "saturated_zone_hours",
         "duplicate_keys": "duplicate_keys"}
more("quality_cross_check", SUITE, "suite_id, check_id, sql_count, suite_count, sql_count = suite_count AS agree", "FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS check_id, '{b}' AS suite_id, ({count})::BIGINT AS sql_count, (SELECT n_failing FROM suite WHERE check_id = '{b}') AS suite_count" for (a, b), count in zip(PAIRS.items(), (
        "SELECT count(*) FROM obs WHERE occupancy > 0 AND volume = 0", "SELECT count(*) FROM obs WHERE volume > 0 AND occupancy = 0", "SELECT count(*) FROM obs WHERE utilisation >= 0.999",
        "SELECT count(*) - count(DISTINCT (zone_id, ts)) FROM obs"))) + ")")(
    lambda p: quality.cross_check(quality.quality_suite(p), sql.run_reports(p)["checks"], PAIRS))


def _contract(p: Panel) -> DataFrame:
    """Planted breaches: a gap and a short history, hours twice, negative, missing and too large values, an unknown zone."""
    z, h = F.col("zone_id"), F.col("hour_idx")
    rows = p.observations.where(~((z == 3) & (h % 50 == 7)) & ~((z == 4) & (h > 100)))
    rows = rows.unionByName(rows.where((z == 5) & (h < 4))).withColumn("volume", F.when((z == 6) & (h == 9), -1.0).when((z == 7) & (h == 9), None).otherwise(F.col("volume")))
    rows = rows.withColumn("occupancy", F.when((z == 8) & (h < 2), F.col("capacity_points") + 1.0).otherwise(F.col("occupancy"))).withColumn("zone_id", F.when(z == 9, 99).otherwise(z))
    return models.contract_violations(rows.drop("capacity_points"), p.zones)


query("contract_breaches", "violation, n", """FROM (SELECT unnest(['unknown_zones', 'duplicates', 'negatives', 'nulls', 'over_capacity', 'short_history', 'gaps', 'ragged']) AS violation,
    unnest([1, 4, 1, 1, 2, 1, 1, (SELECT count(DISTINCT k) - 1 FROM (SELECT CASE WHEN zone_id = 3 THEN 720 - 15 WHEN zone_id = 4 THEN 101 ELSE 720 END AS k FROM nations))])::BIGINT AS n)""")(_contract)

# ---------------------------------------------------------------- breaks

CUTS = """jumps AS (SELECT series, position, obs_date, row_number() OVER (PARTITION BY series ORDER BY round(abs(adjusted - was), 6) DESC, position) AS by_jump,
      row_number() OVER (PARTITION BY series ORDER BY round(abs(adjusted - m), 6) DESC, position) AS by_level
    FROM (SELECT *, lag(adjusted) OVER (PARTITION BY series ORDER BY position) AS was, avg(adjusted) OVER (PARTITION BY series) AS m FROM series) WHERE position > 0),
  cuts AS (SELECT series, position, obs_date FROM jumps WHERE by_jump <= 3), others AS (SELECT series, position, obs_date FROM jumps WHERE by_level <= 3),
  sizes AS (SELECT series, count(*) AS n FROM series GROUP BY 1)"""


def _cuts(p: Panel, by: str) -> DataFrame:
    """Three days of each series as breaks: those after the largest jumps, or those farthest from the mean."""
    whole, order = Window.partitionBy("series"), Window.partitionBy("series").orderBy("position")
    s = breaks.deseasonalised(p)
    far = F.abs(F.col("adjusted") - (F.lag("adjusted").over(order) if by == "jump" else F.avg("adjusted").over(whole)))
    ranked = s.withColumn("far", F.round(far, 6)).where("position > 0").withColumn("k", F.row_number().over(whole.orderBy(F.desc("far"), "position")))
    return ranked.where("k <= 3").select("series", "position", "obs_date")


def _sizes(p: Panel) -> DataFrame:
    return breaks.deseasonalised(p).groupBy("series").agg(F.count("*").alias("n"))


more("break_windows", CUTS, 'series, position, coalesce(lag(position) OVER w, 0)::INT AS start, coalesce(lead(position) OVER w, n)::BIGINT AS "end"',
     "FROM cuts JOIN sizes USING (series) WINDOW w AS (PARTITION BY series ORDER BY position)")(
    lambda p: breaks.windows_around(_cuts(p, "jump"), _sizes(p)).withColumn("end", F.col("end").cast("bigint")))
more("break_segments", CUTS, 'series, min(position) AS start, max(position) + 1 AS "end", round(avg(adjusted), 6) + 0.0 AS mean',
     "FROM (SELECT s.*, (SELECT count(*) FROM cuts c WHERE c.series = s.series AND c.position <= s.position) AS k FROM series s) GROUP BY series, k")(
    lambda p: breaks.segment_means(breaks.deseasonalised(p), _cuts(p, "jump")))
more("stable_window", CUTS, 'start, "end", length, next_break', """FROM (SELECT position AS start, lead(position) OVER (ORDER BY position) AS "end", "end" - start AS length, CASE WHEN "end" < 30 THEN "end" END AS next_break
    FROM (SELECT DISTINCT position FROM cuts WHERE series = 'utilisation' UNION SELECT unnest([0, 30]))) WHERE "end" IS NOT NULL ORDER BY length DESC, start LIMIT 1""")(
    lambda p: breaks.monitoring_window(_cuts(p, "jump").where("series = 'utilisation'"), 30))
more("nearest_breaks", CUTS, "c.series, c.obs_date, m.obs_date AS matched, abs(date_diff('day', c.obs_date, m.obs_date))::INT AS gap", """FROM cuts c LEFT JOIN (
    SELECT a.series, a.obs_date AS of, b.obs_date, row_number() OVER (PARTITION BY a.series, a.obs_date ORDER BY abs(date_diff('day', a.obs_date, b.obs_date)), b.obs_date) AS k
    FROM cuts a JOIN others b ON a.series = b.series AND abs(date_diff('day', a.obs_date, b.obs_date)) <= 7) m ON m.series = c.series AND m.of = c.obs_date AND m.k = 1""")(
    lambda p: breaks.match_nearest(_cuts(p, "jump"), _cuts(p, "level")))

# ---------------------------------------------------------------- segments


def _groups(p: Panel) -> DataFrame:
    return p.zones.select("zone_id", (F.col("zone_id") % 3).alias("segment"))


SHAPE = """seg AS (SELECT zone_id % 3 AS segment, * FROM obs), shape AS (SELECT segment, hour_of_day, round(avg(utilisation), 9) AS u FROM seg WHERE is_weekend = 0 GROUP BY 1, 2),
  per AS (SELECT segment, (list(hour_of_day ORDER BY u DESC, hour_of_day))[1] AS peak_hour, (list(hour_of_day ORDER BY u, hour_of_day))[1] AS trough_hour, coalesce(max(u) / nullif(avg(u), 0), 0) AS peak_to_mean,
    coalesce(sum(u) FILTER (hour_of_day < 6) / nullif(sum(u), 0), 0) AS overnight_share FROM shape GROUP BY 1),
  kinds AS (SELECT segment, count(DISTINCT zone_id) AS n_zones, coalesce(avg(utilisation) FILTER (is_weekend = 1) / nullif(avg(utilisation) FILTER (is_weekend = 0), 0), 0) AS weekend_ratio FROM seg GROUP BY 1)"""
more("segment_profiles", SHAPE, "segment, peak_hour, trough_hour, n_zones, " + r("peak_to_mean", "overnight_share", "weekend_ratio") + """, CASE WHEN overnight_share > 0.30 THEN 'overnight' WHEN peak_to_mean < 1.25 THEN 'flat'
    WHEN weekend_ratio > 1.10 THEN 'weekend' WHEN peak_hour BETWEEN 6 AND 11 THEN 'morning' WHEN peak_hour BETWEEN 12 AND 16 THEN 'midday' WHEN peak_hour BETWEEN 17 AND 22 THEN 'evening' ELSE 'late' END AS archetype""",
     "FROM per JOIN kinds USING (segment)")(lambda p: segments.describe(p, _groups(p)))
INERTIA = """means AS (SELECT zone_id, round(avg(utilisation), 6) AS u FROM obs GROUP BY 1), parted AS (SELECT k::INT AS k, u, avg(u) OVER (PARTITION BY k, zone_id % k) AS m FROM means CROSS JOIN range(2, 7) t(k)),
    sums AS (SELECT k, round(sum((u - m) * (u - m)), 9) AS inertia FROM parted GROUP BY 1)"""


def _inertia(p: Panel) -> DataFrame:
    u = p.observations.groupBy("zone_id").agg(F.round(F.avg("utilisation"), 6).alias("u")).withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(6))))
    off = u.withColumn("d", F.col("u") - F.avg("u").over(Window.partitionBy("k", F.col("zone_id") % F.col("k"))))
    return segments.inertia_drop(off.groupBy("k").agg(F.round(F.sum(F.col("d") * F.col("d")), 9).alias("inertia")))


more("inertia_drop", INERTIA, "k, " + r("inertia", "(lag(inertia) OVER (ORDER BY k) - inertia) / nullif(lag(inertia) OVER (ORDER BY k), 0) AS inertia_drop"), "FROM sums")(_inertia)


def _criteria(p: Panel) -> DataFrame:
    z = F.col("zone_id")
    rows = p.observations.groupBy("zone_id").agg(F.round(F.avg("utilisation"), 6).alias("silhouette")).select(
        (z + 2).alias("k"), "silhouette", z.cast("double").alias("calinski_harabasz"), (z % 5 / 4).alias("stability"), (z % 3 / 3).alias("largest_share"))
    return segments.criteria(rows)


more("segment_criteria", "d AS (SELECT zone_id + 2 AS k, round(avg(utilisation), 6) AS silhouette, zone_id::DOUBLE AS calinski_harabasz, zone_id % 5 / 4 AS stability, zone_id % 3 / 3 AS share FROM obs GROUP BY zone_id)",
     """k, silhouette, calinski_harabasz, stability >= 0.75 AS passes_stability, share <= 0.6 AS passes_balance, stability >= 0.75 AND share <= 0.6 AS admitted,
     row_number() OVER (ORDER BY CASE WHEN stability >= 0.75 AND share <= 0.6 THEN 0 WHEN stability >= 0.75 THEN 1 ELSE 2 END, silhouette DESC, k) = 1 AS chosen""", "FROM d")(_criteria)

# ---------------------------------------------------------------- monitors


def _statistics(p: Panel) -> DataFrame:
    inputs = monitor.input_monitor(p, "volume", 10, 168, 168)
    return monitor.monitors(inputs, monitor.residuals(p, FACT), 168, 48).withColumn("value", F.round("value", 9))


STATISTICS = f"""{MONITOR_CTE}, ar AS (SELECT hour_idx, row_number() OVER (ORDER BY hour_idx) AS i, (a - (SELECT avg(a) FROM (FROM res ORDER BY hour_idx LIMIT 168))) /
      coalesce(nullif((SELECT stddev_pop(a) FROM (FROM res ORDER BY hour_idx LIMIT 168)), 0), 1) AS z FROM res),
    ew AS (SELECT t.hour_idx, any_value(t.i) AS i, abs(sum(0.1::DOUBLE * power(0.9::DOUBLE, t.i - s.i) * s.z)) AS v FROM ar t JOIN ar s ON s.i <= t.i GROUP BY 1),
    stats AS (SELECT 'psi' AS monitor, 'input' AS kind, hour_idx, round(psi, 9) AS value FROM drifts UNION ALL SELECT 'ks', 'input', hour_idx, round(ks, 9) FROM drifts
      UNION ALL SELECT 'residual_mean_cusum', 'residual', hour_idx, round(cusum, 9) FROM cus UNION ALL SELECT 'residual_abs_ewma', 'residual', hour_idx, CASE WHEN i >= 48 THEN round(v, 9) END FROM ew)"""
RATES = (0.5, 1.0, 2.0, 5.0)
CALM = (0, 499)
DETECTION = STATISTICS + """, calm AS (SELECT * FROM stats WHERE hour_idx < 500 AND value IS NOT NULL),
    qs AS (SELECT monitor, kind, quantile_cont(value, [0.9995, 0.999, 0.998, 0.995]) AS ts, count(*) AS n_stable FROM calm GROUP BY 1, 2),
    q AS (SELECT monitor, kind, n_stable, unnest([0.5, 1.0, 2.0, 5.0])::DOUBLE AS far, unnest(ts) AS threshold FROM qs),
    falses AS (SELECT q.monitor, far, count(*) FILTER (value > threshold) AS n_false FROM q JOIN calm USING (monitor) GROUP BY ALL),
    alarms AS (SELECT q.monitor, far, min(hour_idx) FILTER (value > threshold) AS alarm FROM q JOIN stats USING (monitor) WHERE hour_idx >= 500 GROUP BY ALL),
    found AS (SELECT monitor, kind, far, threshold, n_false * 1000.0 / n_stable AS achieved, n_stable, n_false, alarm IS NOT NULL AS detected, coalesce(alarm - 500, -1)::INT AS delay
      FROM q JOIN falses USING (monitor, far) JOIN alarms USING (monitor, far))"""


def _detected(p: Panel) -> DataFrame:
    known = files.cached(_statistics(p), files.work_dir(_session(p), "statistics"))  # read for thresholds, false alarms and alarms
    return monitor.detections(known, RATES, monitor.mask(CALM), 500)


more("monitor_statistics", STATISTICS, "monitor, kind, hour_idx, " + r("value"), "FROM stats")(_statistics)
more("detection_table", DETECTION, "monitor, kind, far, n_stable, n_false, detected, delay, " + r("threshold", "achieved"), "FROM found")(_detected)
SIDES = DETECTION + """, sides AS (SELECT far, coalesce(list(monitor ORDER BY delay, monitor) FILTER (detected AND kind = 'input')[1], 'none') AS input_monitor,
      coalesce(min(delay) FILTER (detected AND kind = 'input'), 'inf'::DOUBLE) AS input_delay, coalesce(list(monitor ORDER BY delay, monitor) FILTER (detected AND kind = 'residual')[1], 'none') AS residual_monitor,
      coalesce(min(delay) FILTER (detected AND kind = 'residual'), 'inf'::DOUBLE) AS residual_delay FROM found GROUP BY 1)"""
SIDES = SIDES.replace("list(monitor ORDER BY delay, monitor) FILTER (detected AND kind = 'input')[1]", "(list(monitor ORDER BY delay, monitor) FILTER (detected AND kind = 'input'))[1]").replace(
    "list(monitor ORDER BY delay, monitor) FILTER (detected AND kind = 'residual')[1]", "(list(monitor ORDER BY delay, monitor) FILTER (detected AND kind = 'residual'))[1]")
more("best_monitors", SIDES, "far, input_monitor, input_delay, residual_monitor, residual_delay, input_delay > residual_delay AS input_later", "FROM sides")(lambda p: monitor.best_monitors(_detected(p)))
more("claim_delay", SIDES, """count(*) AS n_rates, count(*) FILTER (input_delay > residual_delay) AS n_later, min(input_delay) AS input_delay, min(residual_delay) AS residual_delay,
    CASE WHEN count(*) FILTER (input_delay > residual_delay) * 2 > count(*) THEN 'supported' ELSE 'refuted' END AS verdict""", "FROM sides")(lambda p: claims.claim_delay(monitor.best_monitors(_detected(p))))
WATCHED = ", ".join(monitor.MONITORED)


def _drift(bins: int, tag: str) -> str:
    shares = ", ".join(str(k / bins) for k in range(1, bins))
    return f""", q{tag} AS (SELECT feature, list_filter(list_sort(list_distinct(list_transform(quantile_cont(value, [{shares}]), lambda e: round(e, 9)))), lambda e: e > low AND e < high) AS es FROM (SELECT *, min(value) OVER (PARTITION BY feature) AS low,
        max(value) OVER (PARTITION BY feature) AS high FROM long WHERE hour_idx < 168 AND value IS NOT NULL) GROUP BY feature, low, high),
      c{tag} AS (SELECT feature, hour_idx, len(list_filter(es, lambda e: value >= e)) AS bin, count(*) AS n FROM long JOIN q{tag} USING (feature) WHERE value IS NOT NULL GROUP BY ALL),
      d{tag} AS (SELECT hour_idx, b.feature, b.bin, coalesce(n, 0) AS n FROM hours CROSS JOIN (SELECT feature, unnest(range(len(es) + 1)) AS bin FROM q{tag}) b LEFT JOIN c{tag} USING (hour_idx, feature, bin)),
      e{tag} AS (SELECT feature, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY feature) AS e FROM d{tag} WHERE hour_idx < 168 GROUP BY 1, 2),
      w{tag} AS (SELECT feature, hour_idx, bin, sum(n) OVER w AS n, count(*) OVER w AS hours_in FROM d{tag} WINDOW w AS (PARTITION BY feature, bin ORDER BY hour_idx ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)),
      a{tag} AS (SELECT feature, hour_idx, bin, n / greatest(sum(n) OVER (PARTITION BY feature, hour_idx), 1) AS a, e FROM w{tag} JOIN e{tag} USING (feature, bin) WHERE hours_in = 168),
      g{tag} AS (SELECT feature, hour_idx, sum((greatest(a, 1e-6) - greatest(e, 1e-6)) * ln(greatest(a, 1e-6) / greatest(e, 1e-6))) AS psi, max(gap) AS ks FROM (SELECT *,
        abs(sum(a) OVER (PARTITION BY feature, hour_idx ORDER BY bin) - sum(e) OVER (PARTITION BY feature, hour_idx ORDER BY bin)) AS gap FROM a{tag}) GROUP BY 1, 2)"""


more("input_monitors", FEATURES + f", long AS (SELECT feature, hour_idx, round(value, 9) AS value FROM (SELECT hour_idx, {', '.join(f'{m}::DOUBLE AS {m}' for m in monitor.MONITORED)} FROM feats) UNPIVOT INCLUDE NULLS (value FOR feature IN ({WATCHED})))"
     + _drift(10, "1") + _drift(50, "2"), "hour_idx, round(p, 6) + 0.0 AS input_psi, round(k, 6) + 0.0 AS input_ks",
     "FROM (SELECT hour_idx, avg(psi) AS p FROM g1 GROUP BY 1) JOIN (SELECT hour_idx, max(ks) AS k FROM g2 GROUP BY 1) USING (hour_idx)")(lambda p: monitor.input_monitors(p, FACT, 168, 168))


def _schedule(p: Panel) -> DataFrame:
    city = p.observations.groupBy("hour_idx").agg(F.sum("occupancy").alias("x"))
    return monitor.trigger_schedule(city.crossJoin(F.broadcast(city.agg(F.avg("x").alias("m")))).where("x > m"), 24)


query("trigger_schedule")(_schedule)
ORACLE["trigger_schedule"] = CTE.replace("WITH cells", "WITH RECURSIVE cells", 1) + """, above AS (SELECT hour_idx AS h FROM city WHERE occupancy > (SELECT avg(occupancy) FROM city)),
    kept AS (SELECT min(h) AS h FROM above UNION ALL SELECT (SELECT min(a.h) FROM above a WHERE a.h >= k.h + 24) FROM kept k WHERE k.h IS NOT NULL) SELECT h AS hour_idx FROM kept WHERE h IS NOT NULL"""

# ---------------------------------------------------------------- grid, headline tables, claims

SCORES = """count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, avg(abs(e) / nullif(abs(actual), 0)) * 100 AS mape, count(*) FILTER (actual <> 0) / count(*) AS mape_coverage,
    avg(abs(e) / denominator) AS mase, count(denominator) / count(*) AS mase_coverage, sum(w * abs(e)) / sum(w) AS weighted_mae"""
SCORED = "scored AS (SELECT *, predicted - actual AS e, 1 + 3 * greatest(0.0::DOUBLE, least(utilisation, 1.0::DOUBLE)) AS w FROM baselines LEFT JOIN denominators USING (fold, zone_id))"
_METRICS = ("mae", "rmse", "bias", "mape", "mape_coverage", "mase", "mase_coverage", "weighted_mae")


def _grid(p: Panel) -> DataFrame:
    """The baselines' cells, as if the first fold's were done already."""
    done = [(seeds.cell_key({"target": FACT, "horizon": 6, "family": f, "fold": 0}),) for f in forecasts.BASELINES]
    return models.run_grid(p, (FACT,), (6,), (), _session(p).createDataFrame(done, "cell_key string"))


more("grid_scores", f"{SCORED}, cells_of AS (SELECT family, fold, {SCORES} FROM scored WHERE fold > 0 GROUP BY 1, 2)",
     f"""substr(sha256('{{"family": "' || family || '", "fold": ' || fold || ', "horizon": 6, "target": "{FACT}"}}'), 1, 16) AS cell_key, family, fold, '{FACT}' AS target, 6 AS horizon, n, """ + r(*_METRICS), "FROM cells_of")(_grid)


def _pooled(p: Panel) -> DataFrame:
    return models.run_grid(p, (FACT,), (6,), ())


more("headline_models", f"{SCORED}, cells_of AS (SELECT family, fold, {SCORES} FROM scored GROUP BY 1, 2)", f"'{FACT}' AS target, 6 AS horizon, family, count(DISTINCT fold) AS n_folds, sum(n)::BIGINT AS n_rows, " + r(
    *[f"avg({m}) AS {m}" for m in ("mae", "rmse", "mape", "mape_coverage", "mase", "weighted_mae", "bias")]), "FROM cells_of GROUP BY family")(lambda p: claims.headline_models(_pooled(p)))
POOLED, OWN = ["last_observation", "seasonal_daily"], ["seasonal_weekly"]
ADVANTAGE = f"""{SCORED}, by_family AS (SELECT zone_id, family, avg(abs(e) / denominator) AS mase FROM scored GROUP BY 1, 2),
    deciles AS (SELECT zone_id, ceil(row_number() OVER (ORDER BY round(v, 6), zone_id) * 10.0 / count(*) OVER ())::INT AS decile FROM (SELECT zone_id, sum(volume) AS v FROM obs GROUP BY 1)),
    advantage AS (SELECT zone_id, decile, round(min(mase) FILTER (family = 'seasonal_weekly') - min(mase) FILTER (family <> 'seasonal_weekly'), 9) AS advantage FROM by_family JOIN deciles USING (zone_id)
      GROUP BY 1, 2 HAVING count(mase) = 3),
    decile_rows AS (SELECT decile, count(DISTINCT zone_id) AS n_zones, avg(advantage) AS mean_advantage, median(advantage) AS median_advantage, avg((advantage > 0)::INT) AS share_pooled FROM advantage GROUP BY 1),
    combos AS (SELECT fold, min(mase) FILTER (family <> 'seasonal_weekly') AS pooled_score, min(mase) FILTER (family = 'seasonal_weekly') AS own_score,
      arg_min(family, (mase, family)) FILTER (family <> 'seasonal_weekly') AS pooled_family FROM (SELECT fold, family, avg(abs(e) / denominator) AS mase FROM scored GROUP BY 1, 2) GROUP BY 1)"""


def _advantage(p: Panel) -> DataFrame:
    known = forecasts.baselines(p, FACT, 6).join(F.broadcast(forecasts.denominators(p, FACT)), ["fold", "zone_id"], "left")
    zone = known.groupBy("zone_id", "family").agg(F.avg(F.abs(F.col("predicted") - F.col("actual")) / F.col("denominator")).alias("mase"))
    return claims.advantage_by_decile(zone, eda.volume_deciles(p), POOLED, OWN).withColumn("advantage", F.round("advantage", 9))


def _comparison(p: Panel) -> DataFrame:
    return claims.best_by_side(_pooled(p), ["fold"], POOLED, OWN)


more("pooled_against_own", ADVANTAGE, "fold, pooled_family, 'seasonal_weekly' AS own_family, pooled_score < own_score AS pooled_wins, " + r("pooled_score", "own_score", "own_score - pooled_score AS advantage"), "FROM combos")(_comparison)
more("advantage_deciles", ADVANTAGE, "decile, n_zones, " + r("mean_advantage", "median_advantage", "share_pooled"), "FROM decile_rows")(lambda p: claims.decile_table(_advantage(p)))
more("claim_pooling", ADVANTAGE + """, ranks AS (SELECT rank() OVER (ORDER BY decile) + (count(*) OVER (PARTITION BY decile) - 1) / 2 AS x, rank() OVER (ORDER BY advantage) + (count(*) OVER (PARTITION BY advantage) - 1) / 2 AS y
      FROM advantage), one AS (SELECT count(*) AS n_combinations, count(*) FILTER (pooled_score < own_score) AS n_pooled_wins FROM combos)""",
     "n_combinations, n_pooled_wins, (SELECT sum(n_zones) FROM decile_rows)::BIGINT AS n_zones, " + r("(SELECT corr(x, y) FROM ranks) AS spearman").replace(" + 0.0 AS", " + 0.0 AS") + ", " + r(
         "(SELECT arg_min(mean_advantage, decile) FROM decile_rows) AS lowest_decile", "(SELECT arg_max(mean_advantage, decile) FROM decile_rows) AS highest_decile")
     + ", CASE WHEN n_pooled_wins * 2 > n_combinations AND (SELECT corr(x, y) FROM ranks) < 0 THEN 'supported' ELSE 'refuted' END AS verdict", "FROM one")(
    lambda p: claims.claim_pooling(_comparison(p), _advantage(p)))
more("error_by_hour", SCORED, "hour_of_day, " + r(*[f"avg(abs(e)) FILTER (family = '{f}') AS {f}" for f in forecasts.BASELINES]), "FROM scored GROUP BY 1")(
    lambda p: forecasts.baselines(p, FACT, 6).groupBy("hour_of_day").pivot("family", list(forecasts.BASELINES)).agg(F.avg(F.abs(F.col("predicted") - F.col("actual")))))
RANKS = "u AS (SELECT zone_id, round(avg(utilisation), 9) AS a, round(sum(volume), 6) AS b FROM obs GROUP BY 1)"
_RANKED = """corr(x, y) AS spearman, (SELECT count(*) FROM (SELECT row_number() OVER (ORDER BY a DESC, zone_id) AS i, row_number() OVER (ORDER BY b DESC, zone_id) AS j FROM u) WHERE i <= 10 AND j <= 10) AS top_overlap
    FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS y FROM u)"""


def _two_measures(p: Panel) -> DataFrame:
    return p.observations.groupBy("zone_id").agg(F.round(F.avg("utilisation"), 9).alias("a"), F.round(F.sum("volume"), 6).alias("b"))


more("rank_agreement", RANKS, r("spearman") + ", top_overlap, spearman <= 0.9 AS disagree", f"FROM (SELECT {_RANKED})")(lambda p: claims.rank_agreement(_two_measures(p), "a", "b", 10))


def _per_seed(p: Panel) -> DataFrame:
    """Days as seeds, four groups of zones as worlds: energy and sessions of a day."""
    return p.observations.groupBy((F.col("zone_id") % 4).cast("string").alias("world"), F.col("obs_date").alias("seed")).agg(F.sum("volume").alias("energy"), F.sum("occupancy").alias("unserved"))


PER_SEED = "seeded AS (SELECT (zone_id % 4)::VARCHAR AS world, obs_date, sum(volume) AS energy, sum(occupancy) AS unserved FROM obs GROUP BY 1, 2)"
SUMMARY = "count(*) AS n_seeds, " + r("avg(energy) AS mean_energy", "stddev_pop(energy) AS std_energy", "quantile_cont(energy, 0.1) AS p10", "quantile_cont(energy, 0.9) AS p90", "avg(unserved) AS mean_unserved",
                                     "quantile_cont(unserved, 0.9) AS p90_unserved")
more("scenario_summary", PER_SEED, "world, " + SUMMARY, "FROM seeded GROUP BY 1")(lambda p: capacity.scenario_summary(_per_seed(p)))


def _rules(p: Panel) -> DataFrame:
    rules = F.element_at(F.array(*[F.lit(x) for x in ("by_utilisation", "by_marginal_energy", "balanced", "no_investment")]), F.col("world").cast("int") + 1)
    return capacity.scenario_summary(_per_seed(p)).withColumns({
        "estimate": F.lit("kw"), "budget": F.lit(20), "rule": rules, "n_zones": F.lit(6), "most_points": F.lit(3)})


RULES = PER_SEED + f", rows_of AS (SELECT 'kw' AS estimate, 20 AS budget, ['by_utilisation', 'by_marginal_energy', 'balanced', 'no_investment'][world::INT + 1] AS rule, {SUMMARY}, 6 AS n_zones, 3 AS most_points FROM seeded GROUP BY world)"
more("headline_capacity", RULES, "*", "FROM rows_of")(lambda p: claims.headline_capacity(_rules(p)))
more("claim_allocation", RULES + f", {RANKS}, w AS (SELECT estimate, max(mean_energy) FILTER (rule = 'by_marginal_energy') - max(mean_energy) FILTER (rule = 'by_utilisation') AS extra FROM rows_of GROUP BY estimate, budget)",
     "estimate, 1::BIGINT AS n_budgets, (extra > 0)::BIGINT AS n_won, round(extra, 4) + 0.0 AS mean_extra, top_overlap, disagree, " + r("spearman") + ", CASE WHEN disagree AND extra > 0 THEN 'supported' ELSE 'refuted' END AS verdict",
     f"FROM w CROSS JOIN (SELECT *, spearman <= 0.9 AS disagree FROM (SELECT {_RANKED}))")(
    lambda p: claims.claim_allocation(_rules(p), claims.rank_agreement(_two_measures(p), "a", "b", 10).withColumn("estimate", F.lit("kw"))).withColumn("mean_extra", F.round("mean_extra", 4)))

# ---------------------------------------------------------------- capacity

ERLANG = "list_reduce(list_prepend(1.0::DOUBLE, [n::DOUBLE FOR n IN range(1, {c} + 1)]), lambda b, n: a * b / (n + a * b))"
query("carried_load", "zone_id, " + r(f"a * (1 - {ERLANG.format(c='capacity_points')}) AS carried"), "FROM (SELECT zone_id, capacity_points, 0.7::DOUBLE * capacity_points AS a FROM zones)")(
    lambda p: p.zones.withColumn("a", 0.7 * F.col("capacity_points")).select("zone_id", capacity.carried("capacity_points", "a").alias("carried")))
query("analytic_marginal", "zone_id, " + r(f"sum(a * ({ERLANG.format(c='capacity_points')} - {ERLANG.format(c='(capacity_points + 1)')})) * any_value(kw) AS marginal"),
      """FROM (SELECT zone_id, capacity_points, 0.9::DOUBLE * occupancy AS a, coalesce(sum(volume) OVER (PARTITION BY zone_id) / nullif(sum(duration) OVER (PARTITION BY zone_id), 0), 0) AS kw FROM obs) GROUP BY 1""")(
    lambda p: capacity.analytic_marginal(p.observations.withColumn("offered", 0.9 * F.col("occupancy")).join(capacity.zone_power(p), "zone_id")))
query("greedy_budget", "zone_id, count(*) AS added, " + r("sum(g) AS gain"), "FROM (SELECT zone_id, v / j AS g FROM (SELECT zone_id, sum(volume) AS v FROM obs GROUP BY 1), range(1, 21) t(j) ORDER BY round(g, 6) DESC, zone_id, j LIMIT 20) GROUP BY 1")(
    lambda p: capacity.greedy_allocation(p.observations.groupBy("zone_id").agg(F.sum("volume").alias("v")).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(20)))).select(
        "zone_id", "j", (F.col("v") / F.col("j")).alias("gain")), 20))
query("spill_product", "s.neighbour_id AS zone_id, o.ts, " + r("sum(0.35::DOUBLE * o.occupancy * s.weight) AS sent"), "FROM obs o JOIN shares s USING (zone_id) GROUP BY 1, 2")(
    lambda p: capacity.spill(p.observations.select("zone_id", "ts", F.col("occupancy").alias("blocked")), p.edges))
query("persistence_hours", "zone_id, " + r("CASE WHEN c IS NULL OR isnan(c) OR spread < 1e-9 THEN 2.0 ELSE least(greatest(-1 / ln(least(greatest(c, 1e-3), 0.999)), 0.5), 8.0) END::DOUBLE AS persistence_hours"),
      """FROM (SELECT zone_id, corr(rest, was) FILTER (was IS NOT NULL) AS c, stddev_pop(rest) AS spread FROM (SELECT *, lag(rest) OVER (PARTITION BY zone_id ORDER BY hour_idx) AS was
      FROM (SELECT *, occupancy - avg(occupancy) OVER (PARTITION BY zone_id, hour_of_day) AS rest FROM obs)) GROUP BY 1)""")(capacity.persistence_hours)
query("seeds", f"zone_id, ('0x' || substr(sha256('{BASE}:kmeans:' || zone_id), 1, 8))::BIGINT AS seed", "FROM zones")(
    lambda p: p.zones.select("zone_id", bookkeeping.seed_column(BASE, F.concat(F.lit("kmeans:"), F.col("zone_id").cast("string"))).alias("seed")))
query("cell_keys", f"""zone_id, substr(sha256('{{"family": "ridge", "fold": ' || zone_id || '}}'), 1, 16) AS cell_key""", "FROM zones")(
    lambda p: p.zones.select("zone_id", F.lit("ridge").alias("family"), F.col("zone_id").alias("fold")).select("zone_id", bookkeeping.key_column("fold", "family").alias("cell_key")))

# ---------------------------------------------------------------- tables behind figures, dictionary

query("saturation_histogram", 'b.bin::INT AS bin, round(b.bin * 0.025, 6) + 0.0 AS from_value, count(o.u) AS n', """FROM range(40) b(bin) LEFT JOIN (SELECT least(39, floor(utilisation / 0.025::DOUBLE)) AS u FROM obs) o ON o.u = b.bin
    GROUP BY 1, 2""")(lambda p: claims.histogram(p.observations, "utilisation"))
query("first_zones", "zone_id, volume, place", "FROM (SELECT zone_id, round(sum(volume), 6) + 0.0 AS volume, row_number() OVER (ORDER BY round(sum(volume), 6) DESC, zone_id)::INT AS place FROM obs GROUP BY 1) WHERE place <= 12")(
    lambda p: claims.first_zones(p.observations.groupBy("zone_id").agg(F.sum("volume").alias("volume")), "volume", 12))
query("data_dictionary", "*", "FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS measure, '{eda.MEANING[m]}' AS meaning, printf('%.6f to %.6f, mean %.6f', round(min({m}), 6), round(max({m}), 6), round(avg({m}), 6)) AS observed FROM obs" for m in eda.MEANING) + ")")(eda.dictionary)
