-- One row per zone and day.
SELECT zone_id, obs_date, day_of_week, is_weekend, is_holiday, count(*) AS n_hours,
       sum(volume) AS volume_kwh, sum(volume_11kw) AS volume_11kw_kwh, sum(duration) AS point_hours,
       avg(occupancy) AS mean_occupancy, max(occupancy) AS peak_occupancy,
       avg(utilisation) AS mean_utilisation, max(utilisation) AS peak_utilisation,
       count_if(utilisation >= 0.999D) AS hours_at_ceiling, avg(e_price + s_price) AS mean_total_price
FROM observations
GROUP BY ALL
ORDER BY zone_id, obs_date;
