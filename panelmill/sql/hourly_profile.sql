-- The mean day of each zone, weekdays and weekends apart.
SELECT zone_id, hour_of_day, is_weekend, count(*) AS n_obs, avg(occupancy) AS mean_occupancy,
       avg(utilisation) AS mean_utilisation, avg(volume) AS mean_volume_kwh,
       avg(duration) AS mean_point_hours, max(utilisation) AS max_utilisation
FROM observations
GROUP BY ALL
ORDER BY zone_id, is_weekend, hour_of_day;
