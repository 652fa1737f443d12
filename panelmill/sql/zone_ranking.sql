-- Zones by mean utilisation; facts are aggregated before they meet the dimension.
WITH facts AS (
  SELECT zone_id, count(*) AS n_hours, sum(volume) AS total_volume_kwh, sum(volume_11kw) AS total_volume_11kw_kwh,
         sum(duration) AS total_point_hours, avg(utilisation) AS mean_utilisation, max(utilisation) AS peak_utilisation,
         count_if(utilisation >= 0.999D) AS hours_at_ceiling, count_if(utilisation >= 0.9D) AS hours_above_90pct,
         avg(e_price) AS mean_e_price, avg(s_price) AS mean_s_price, avg(e_price + s_price) AS mean_total_price
  FROM observations GROUP BY zone_id)
SELECT f.*, z.capacity_points, z.n_stations, z.n_neighbours, f.hours_at_ceiling / f.n_hours AS share_at_ceiling,
       f.total_volume_kwh / nullif(z.capacity_points, 0) AS kwh_per_point
FROM facts f JOIN zones z ON z.zone_id = f.zone_id
ORDER BY mean_utilisation DESC, f.zone_id;
