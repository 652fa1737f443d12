"""Erlang loss model, allocation rules and simulation of capacity."""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.seeds import rng
from panelmill.operators.graph import decay_weights
from panelmill.sources.files import cached, work_dir
from panelmill.sources.panel import Panel

# Blocking at the end of the offered grid, its points, shares of blocked arrivals that try a neighbour.
GRID_BLOCKING = 0.5
GRID_POINTS = 1500
SPILL = 0.35


def erlang_b(servers: str, offered: str) -> F.Column:
    """Blocking of `servers` at an offered load, by the recursion over servers; 1 without servers."""
    return F.expr(f"if({servers} < 1, 1D, aggregate(sequence(1, greatest(1, cast({servers} as int))), 1D, (b, n) -> {offered} * b / (n + {offered} * b)))")


def carried(servers: str, offered: str) -> F.Column:
    return F.expr(offered) * (1 - erlang_b(servers, offered))


def service_hours(kw: F.Column) -> F.Column:
    return F.when(kw >= 22, 1.0).when(kw >= 11, 2.0).otherwise(3.5)


def blocking(servers: int, offered: np.ndarray) -> np.ndarray:
    b = np.ones_like(offered, dtype=float)
    for n in range(1, servers + 1):
        b = offered * b / (n + offered * b)
    return b


@lru_cache(maxsize=4096)
def carried_curve(servers: int) -> tuple[np.ndarray, np.ndarray]:
    """(offered, carried) on a grid that ends where half is blocked; made once per number of servers and worker."""
    low, high = 0.0, 2.0 * servers
    while blocking(servers, np.array([high]))[0] < GRID_BLOCKING:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if blocking(servers, np.array([middle]))[0] < GRID_BLOCKING else (low, middle)
    grid = np.linspace(0.0, high, GRID_POINTS)
    return grid, np.maximum.accumulate(grid * (1 - blocking(servers, grid)))


def invert_carried(servers: int, observed: np.ndarray) -> np.ndarray:
    """Offered load that carries what was observed, by interpolation; 0 without servers."""
    if servers < 1:
        return np.zeros_like(observed, dtype=float)
    grid, curve = carried_curve(servers)
    return np.interp(np.clip(observed, 0.0, curve[-1]), curve, grid)


def zone_power(panel: Panel, service_scale: float = 1.0) -> DataFrame:
    """(zone_id, kw, kw_11, service_hours): power by either volume estimate, and the session length that the rated one suggests."""
    hours = F.nullif(F.sum("duration"), F.lit(0.0))
    per_zone = panel.observations.groupBy("zone_id").agg(F.coalesce(F.sum("volume") / hours, F.lit(0.0)).alias("kw"), F.coalesce(F.sum("volume_11kw") / hours, F.lit(0.0)).alias("kw_11"))
    return per_zone.withColumn("service_hours", service_hours(F.col("kw")) * service_scale)


def calibrate(panel: Panel, service_scale: float = 1.0) -> DataFrame:
    """Power and session length of each zone, and the offered load of each hour: the load that would carry the points in use.

    The inversion is a column function over batches of rows; curves depend on the points of a zone alone.
    """
    known = (panel.observations.select("zone_id", "hour_idx", "ts", "obs_date", "capacity_points", "occupancy", "utilisation", "volume", "duration")
             .join(F.broadcast(zone_power(panel, service_scale)), "zone_id"))

    @F.pandas_udf("double")
    def offered(points: pd.Series, observed: pd.Series) -> pd.Series:
        out, x = np.zeros(len(points)), observed.to_numpy(float)
        for c in points.unique():
            at = (points == c).to_numpy()
            out[at] = invert_carried(int(c), x[at])
        return pd.Series(out)

    return known.withColumn("offered", offered("capacity_points", "occupancy"))


def persistence_hours(panel: Panel) -> DataFrame:
    """(zone_id, persistence_hours): -1 / ln of the correlation of a zone's de-seasonalised occupancy with the hour before, within 0.5 and 8;
    2 for a zone that doesn't vary or has under two days. A diagnostic: nothing is computed from it."""
    day = Window.partitionBy("zone_id", "hour_of_day")
    order = Window.partitionBy("zone_id").orderBy("hour_idx")
    rest = panel.observations.withColumn("rest", F.col("occupancy") - F.avg("occupancy").over(day)).withColumn("before", F.lag("rest").over(order))
    both = F.col("before").isNotNull()
    r = F.corr(F.when(both, F.col("rest")), F.when(both, F.col("before")))
    per = rest.groupBy("zone_id").agg(r.alias("r"), F.count("*").alias("n"), F.stddev_pop("rest").alias("spread"))
    length = -1 / F.ln(F.least(F.greatest(F.col("r"), F.lit(1e-3)), F.lit(0.999)))
    dull = (F.col("n") < 48) | (F.col("spread") < 1e-9) | F.col("r").isNull() | F.isnan("r")
    return per.select("zone_id", F.when(dull, 2.0).otherwise(F.least(F.greatest(length, F.lit(0.5)), F.lit(8.0))).alias("persistence_hours"))


def analytic_marginal(rows: DataFrame, offered: str = "offered", kw: str = "kw") -> DataFrame:
    """(zone_id, marginal): energy that one more point of a zone carries over all hours of rows, spill left out."""
    more = F.expr(f"cast(capacity_points as int) + 1")
    with_more = rows.withColumn("_more", more)
    gain = carried("_more", offered) - carried("capacity_points", offered)
    return with_more.groupBy("zone_id").agg((F.sum(gain) * F.first(kw)).alias("marginal"))


def marginal_gains(calibrated: DataFrame, budget: int, kw: str = "kw") -> DataFrame:
    """(zone_id, j, gain): energy that the j-th added point of a zone serves over all hours, never above the one before.

    The recursion over servers keeps only the loads carried by the last `budget` + 1 numbers of servers.
    """
    curve = """aggregate(sequence(1, cast(capacity_points as int) + {b}), named_struct('b', 1D, 'c', cast(array() as array<double>)),
        (s, n) -> named_struct('b', offered * s.b / (n + offered * s.b),
                               'c', if(n < cast(capacity_points as int), s.c, concat(s.c, array(offered * (1 - offered * s.b / (n + offered * s.b))))))).c""".format(b=budget)
    carried_by = F.expr(f"if(cast(capacity_points as int) = 0, concat(array(0D), {curve}), {curve})")
    steps = calibrated.where("offered > 0").withColumn("curve", carried_by).select("zone_id", F.col(kw).alias("kw"), F.expr(
        f"posexplode(transform(sequence(1, {budget}), j -> element_at(curve, j + 1) - element_at(curve, j)))").alias("k", "served"))
    raw = steps.groupBy("zone_id", (F.col("k") + 1).alias("j")).agg(F.sum(F.col("served") * F.col("kw")).alias("raw"))
    return raw.select("zone_id", "j", F.min("raw").over(Window.partitionBy("zone_id").orderBy("j")).alias("gain"))


def greedy_allocation(gains: DataFrame, budget: int) -> DataFrame:
    """Points per zone of the repeated best next point, as one top-k over falling gains; ties go to the smaller zone."""
    best = gains.orderBy(F.desc("gain"), "zone_id", "j").limit(budget)
    return best.groupBy("zone_id").agg(F.count("*").alias("added"), F.sum("gain").alias("gain"))


def apportion(weights: DataFrame, weight: str, budget: int) -> DataFrame:
    """Largest remainder: floors of the exact shares, then one each to the largest remainders, ties to the smaller zone. All weights 0 share evenly."""
    whole = Window.partitionBy()  # one row per zone
    even = F.when(F.sum(weight).over(whole) > 0, F.col(weight)).otherwise(1.0)
    exact = weights.select("zone_id", even.alias("w"))
    exact = exact.withColumn("exact", F.round(budget * F.col("w") / F.sum("w").over(whole), 9)).withColumn("base", F.floor("exact"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), "zone_id"))
    left = budget - F.sum("base").over(whole)
    return exact.select("zone_id", (F.col("base") + F.when(rank <= left, 1).otherwise(0)).alias("added"))


def peak_stretch(panel: Panel, hours: int) -> DataFrame:
    """First start of the busiest run of hours of the city."""
    city = panel.observations.groupBy("hour_idx").agg(F.sum("occupancy").alias("busy"))
    frame = Window.orderBy("hour_idx").rowsBetween(0, hours - 1)  # one row per hour
    sums = city.select(F.col("hour_idx").alias("start"), F.sum("busy").over(frame).alias("busy"), F.count("*").over(frame).alias("n")).where(F.col("n") == hours)
    return sums.orderBy(F.desc("busy"), "start").limit(1).select("start", "busy")


def simulate_worlds(rates: np.ndarray, capacity: np.ndarray, service: np.ndarray, weights: np.ndarray, max_slots: int, source: np.random.Generator) -> tuple:
    """(served, blocked, diverted) sessions of each world and zone; capacity has a row per world, rates one per hour.

    Draws depend on zones, hours and max_slots alone, and all worlds share them: who leaves, who arrives, and what of a spilled fraction counts as one.
    """
    worlds, zones = capacity.shape
    busy, served, lost, diverted = (np.zeros((worlds, zones), int) for _ in range(4))
    column = np.arange(zones)
    for rate in rates:
        leaves = source.random((zones, max_slots)) < 1.0 / service[:, None]
        gone = np.concatenate([np.zeros((zones, 1), int), leaves.cumsum(axis=1)], axis=1)
        busy = busy - gone[column, busy]
        arrivals = source.poisson(rate)
        direct = np.minimum(arrivals, capacity - busy)
        blocked = arrivals - direct
        sent = (SPILL * blocked) @ weights
        received = np.floor(sent).astype(int) + (source.random(zones) < sent % 1)
        taken = np.minimum(received, capacity - busy - direct)
        busy = busy + direct + taken
        served, lost, diverted = served + direct + taken, lost + blocked, diverted + taken
    return served, lost, diverted


def spill(blocked: DataFrame, edges: DataFrame, decay_m: float = 2000.0) -> DataFrame:
    """(zone_id, ts, sent): what neighbours' blocked arrivals (zone_id, ts, blocked) send to each zone."""
    sent = blocked.join(decay_weights(edges, decay_m), "zone_id").groupBy(F.col("neighbour_id").alias("zone_id"), "ts").agg(F.sum(SPILL * F.col("blocked") * F.col("weight")).alias("sent"))
    return sent


def simulate(panel: Panel, calibrated: DataFrame, worlds: DataFrame, seeds: int, first: int, hours: int, base_seed: int, kw: str = "kw", label: str = "world",
             decay_m: float = 2000.0) -> DataFrame:
    """(world, seed, zone_id, energy, unserved, diverted) of worlds (world, zone_id, added) over `hours` from hour `first`.

    One task per seed, in which all worlds share the seed's draws. Rates travel as one row per zone, an array over the hours, added points as an
    array over the worlds: the input of a task is bounded by zones times hours and worlds.
    """
    spark = panel.observations.sparkSession
    per_zone = (calibrated.where((F.col("hour_idx") >= first) & (F.col("hour_idx") < first + hours)).groupBy("zone_id", F.col(kw).alias("kw"), "service_hours", "capacity_points")
                .agg(F.sort_array(F.collect_list(F.struct("hour_idx", (F.col("offered") / F.col("service_hours")).alias("rate")))).alias("rates")))
    near = decay_weights(panel.edges, decay_m).groupBy("zone_id").agg(F.collect_list(F.struct("neighbour_id", "weight")).alias("near"))
    names = sorted(r["world"] for r in worlds.select("world").distinct().collect())  # the worlds' names
    added = worlds.groupBy("zone_id").agg(F.map_from_entries(F.collect_list(F.struct("world", "added"))).alias("added"))
    rows = per_zone.join(near, "zone_id", "left").join(added, "zone_id", "left")
    rows = F.broadcast(spark.range(seeds).select(F.col("id").cast("int").alias("seed"))).crossJoin(rows)  # seeds, given by the caller

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("zone_id").reset_index(drop=True)
        ids = part["zone_id"].tolist()
        index, seed = {z: i for i, z in enumerate(ids)}, int(part["seed"].iloc[0])
        weights = np.zeros((len(ids), len(ids)))
        for i, edges in enumerate(part["near"]):
            for edge in edges if edges is not None else []:
                if edge["neighbour_id"] in index:
                    weights[i, index[edge["neighbour_id"]]] = edge["weight"]
        rates = np.array([[r["rate"] for r in zone] for zone in part["rates"]]).T
        more = [dict(m) if m is not None else {} for m in part["added"]]
        capacity = part["capacity_points"].to_numpy(int) + np.array([[m.get(name) or 0 for m in more] for name in names])
        service, power = part["service_hours"].to_numpy(float), part["kw"].to_numpy(float)
        served, lost, moved = simulate_worlds(rates, capacity, service, weights, int(capacity.max(initial=0)), rng(base_seed, f"{label}:{seed}"))
        unit = service * power
        return pd.DataFrame({"world": np.repeat(names, len(ids)), "seed": seed, "zone_id": ids * len(names), "energy": (served * unit).ravel(),
                             "unserved": (lost - moved).ravel().astype(float), "diverted": moved.ravel().astype(float)})

    return rows.groupBy("seed").applyInPandas(run, "world string, seed int, zone_id int, energy double, unserved double, diverted double")


def spread(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, population deviation, tenth and ninetieth percentile of a value."""
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, 0.1).alias("p10"), F.percentile(value, 0.9).alias("p90"), F.count("*").alias("n"))


def simulated_marginal(panel: Panel, calibrated: DataFrame, seeds: int, first: int, hours: int, base_seed: int, kw: str = "kw") -> DataFrame:
    """(zone_id, mean, std, p10, p90, n): energy that the whole system serves more with one more point at the zone, over the seeds."""
    ids = panel.zones.select("zone_id")
    worlds = ids.select(F.concat(F.lit("zone "), F.col("zone_id").cast("string")).alias("world"), "zone_id", F.lit(1).alias("added")).unionByName(
        ids.select(F.lit("base").alias("world"), "zone_id", F.lit(0).alias("added")))
    total = simulate(panel, calibrated, worlds, seeds, first, hours, base_seed, kw, "marginal").groupBy("world", "seed").agg(F.sum("energy").alias("energy"))
    base = total.where("world = 'base'").select("seed", F.col("energy").alias("base"))
    gain = total.where("world <> 'base'").join(F.broadcast(base), "seed").select(F.expr("cast(substring(world, 6) as int)").alias("zone_id"), (F.col("energy") - F.col("base")).alias("gain"))
    return spread(gain, ["zone_id"], "gain")


def allocations(panel: Panel, calibrated: DataFrame, budget: int, kw: str = "kw") -> DataFrame:
    """(rule, zone_id, added) of the four rules: by utilisation, by marginal energy, half of each, and none."""
    ids = panel.zones.select("zone_id")
    used = panel.observations.groupBy("zone_id").agg(F.avg("utilisation").alias("u"))
    gains = marginal_gains(calibrated, budget, kw)
    half = budget // 2
    shared = lambda n: apportion(used, "u", n).select("zone_id", F.col("added").cast("int").alias("added"))
    best = lambda n: greedy_allocation(gains, n).select("zone_id", F.col("added").cast("int").alias("added"))
    parts = {"by_utilisation": shared(budget), "by_marginal_energy": best(budget),
             "balanced": shared(half).unionByName(best(budget - half)).groupBy("zone_id").agg(F.sum("added").cast("int").alias("added"))}
    out = ids.select(F.lit("no_investment").alias("rule"), "zone_id", F.lit(0).alias("added"))
    for rule, df in parts.items():
        out = out.unionByName(ids.join(df, "zone_id", "left").select(F.lit(rule).alias("rule"), "zone_id", F.coalesce("added", F.lit(0)).alias("added")))
    return out


def scenarios(panel: Panel, seeds: int, budgets: tuple[int, ...], hours: int, base_seed: int, estimates: tuple[str, ...] = ("kw", "kw_11")) -> DataFrame:
    """Served and unserved demand of each estimate, budget and rule over the busiest stretch: one row each, over the seeds."""
    known = cached(calibrate(panel), work_dir(panel.observations.sparkSession, "calibrated"))  # read by every estimate and budget
    first = peak_stretch(panel, hours).first()["start"]
    parts = []
    for estimate in estimates:
        inside = known.where((F.col("hour_idx") >= first) & (F.col("hour_idx") < first + hours))
        plans = [allocations(panel, inside, b, estimate).select(F.concat(F.col("rule"), F.lit(f":{b}")).alias("world"), "zone_id", "added") for b in budgets]
        worlds = cached(reduce(DataFrame.unionByName, plans), work_dir(panel.observations.sparkSession, "worlds"))
        total = simulate(panel, known, worlds, seeds, first, hours, base_seed, estimate, "allocate").groupBy("world", "seed").agg(
            F.sum("energy").alias("energy"), F.sum("unserved").alias("unserved"))
        given = worlds.groupBy("world").agg(F.count_if(F.col("added") > 0).alias("n_zones"), F.max("added").alias("most_points"))
        parts.append(scenario_summary(total).join(F.broadcast(given), "world").select(
            F.lit(estimate).alias("estimate"), F.expr("cast(split_part(world, ':', 2) as int)").alias("budget"), F.expr("split_part(world, ':', 1)").alias("rule"), "n_seeds",
            "mean_energy", "std_energy", "p10", "p90", "mean_unserved", "p90_unserved", "n_zones", "most_points"))
    return reduce(DataFrame.unionByName, parts)


def scenario_summary(per_seed: DataFrame) -> DataFrame:
    return per_seed.groupBy("world").agg(
        F.count("*").alias("n_seeds"), F.avg("energy").alias("mean_energy"), F.stddev_pop("energy").alias("std_energy"), F.percentile("energy", 0.1).alias("p10"),
        F.percentile("energy", 0.9).alias("p90"), F.avg("unserved").alias("mean_unserved"), F.percentile("unserved", 0.9).alias("p90_unserved"))


def sensitivity(panel: Panel, seeds: int, hours: int, base_seed: int, scales: tuple[float, ...] = (0.5, 1.0, 1.5)) -> DataFrame:
    """(scale, spearman, disagree, n_zones, total): how the marginal value of the zones depends on the session length that is assumed."""
    from panelmill.operators.claims import rank_agreement

    first = peak_stretch(panel, hours).first()["start"]
    used = panel.observations.groupBy("zone_id").agg(F.avg("utilisation").alias("u"))
    parts = []
    for scale in scales:
        gain = cached(simulated_marginal(panel, calibrate(panel, scale), seeds, first, hours, base_seed), work_dir(panel.observations.sparkSession, "marginal"))
        ranks = rank_agreement(gain.join(used, "zone_id"), "u", "mean")
        totals = gain.agg(F.count_if(F.col("mean") > 0).alias("n_zones"), F.sum("mean").alias("total"))
        parts.append(ranks.crossJoin(totals).select(F.lit(scale).alias("scale"), "spearman", "disagree", "n_zones", "total"))  # one row each
    return reduce(DataFrame.unionByName, parts)
