-- Assertions as rows; :n_hours and :n_zones are what the panel promises.
WITH row_checks AS (
  SELECT count(*) AS n, abs(count(*) - :n_hours * :n_zones) AS rows_off, abs(count(DISTINCT ts) - :n_hours) AS hours_off,
         abs(count(DISTINCT zone_id) - :n_zones) AS zones_off,
         count_if(least(occupancy, volume, volume_11kw, duration, e_price, s_price) < 0) AS negative,
         count_if(utilisation > 1.000001D) AS above_one, count_if(duration > capacity_points + 0.000001D) AS too_long,
         count_if(occupancy > 0 AND volume = 0) AS no_volume, count_if(volume > 0 AND occupancy = 0) AS no_occupancy,
         count_if(utilisation >= 0.999D) AS saturated
  FROM observations),
per_key AS (SELECT zone_id, ts, count(*) AS n FROM observations GROUP BY zone_id, ts),
per_zone AS (SELECT zone_id, sum(n) AS n FROM per_key GROUP BY zone_id),
named AS (
  SELECT stack(9, 'row_count', rows_off, cast(:n_hours * :n_zones AS bigint), 'fail', 'distinct_hours', hours_off, cast(:n_hours AS bigint), 'fail',
         'distinct_zones', zones_off, cast(:n_zones AS bigint), 'fail', 'negative_values', negative, n, 'fail', 'utilisation_above_one', above_one, n, 'fail',
         'duration_above_capacity', too_long, n, 'fail', 'occupancy_without_volume', no_volume, n, 'info', 'volume_without_occupancy', no_occupancy, n, 'info',
         'saturated_zone_hours', saturated, n, 'info') AS (check_id, n_failing, n_total, kind)
  FROM row_checks
  UNION ALL SELECT 'duplicate_keys', coalesce(sum(n - 1), 0), coalesce(sum(n), 0), 'fail' FROM per_key
  UNION ALL SELECT 'ragged_zone_coverage', count_if(n <> :n_hours), cast(:n_zones AS bigint), 'fail' FROM per_zone
  UNION ALL SELECT 'zones_missing_attributes', count(*), cast(:n_zones AS bigint), 'fail' FROM per_zone p LEFT ANTI JOIN zones z ON z.zone_id = p.zone_id
  UNION ALL SELECT 'edges_are_reciprocal', count_if(b.zone_id IS NULL), count(*), 'fail'
            FROM zone_edges a LEFT JOIN zone_edges b ON b.zone_id = a.neighbour_id AND b.neighbour_id = a.zone_id
  UNION ALL SELECT 'weather_hours', abs(count(DISTINCT ts) - :n_hours), cast(:n_hours AS bigint), 'fail' FROM weather)
SELECT check_id, n_failing, n_total, CASE WHEN kind = 'info' THEN 'info' WHEN n_failing = 0 THEN 'pass' ELSE 'fail' END AS status
FROM named
ORDER BY check_id;
