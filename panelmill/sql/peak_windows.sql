-- The four hours in a row of a weekday in which a zone is busiest; all ties stay.
WITH shape AS (
  SELECT zone_id, hour_of_day, avg(utilisation) AS u FROM observations WHERE is_weekend = 0 GROUP BY zone_id, hour_of_day),
stretches AS (
  SELECT a.zone_id, a.hour_of_day AS window_start, avg(b.u) AS window_utilisation
  FROM shape a JOIN shape b ON b.zone_id = a.zone_id AND pmod(b.hour_of_day - a.hour_of_day, 24) < 4
  GROUP BY a.zone_id, a.hour_of_day HAVING count(*) = 4)
SELECT zone_id, window_start, pmod(window_start + 3, 24) AS window_end, window_utilisation
FROM (SELECT *, rank() OVER (PARTITION BY zone_id ORDER BY round(window_utilisation, 12) DESC) AS place FROM stretches)
WHERE place = 1
ORDER BY zone_id, window_start;
