"""Structural breaks of daily series: seasonal adjustment, segmentation, bootstrap significance, matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.seeds import rng
from panelmill.operators.eda import aggregate_daily
from panelmill.sources.panel import Panel


def deseasonalised(panel: Panel) -> DataFrame:
    """(series, position, obs_date, value, adjusted): daily city series less the mean of their weekday, plus the series mean."""
    daily = aggregate_daily(panel).unpivot(["obs_date"], ["utilisation", "volume", "duration"], "series", "value")
    whole, weekday = Window.partitionBy("series"), Window.partitionBy("series", F.weekday("obs_date"))
    return daily.select("series", (F.row_number().over(whole.orderBy("obs_date")) - 1).alias("position"), "obs_date", "value",
                        (F.col("value") - F.avg("value").over(weekday) + F.avg("value").over(whole)).alias("adjusted"))


def split_gains(series: DataFrame, min_segment: int) -> DataFrame:
    """The drop in squared error of every legal single split, from running sums."""
    order, whole = Window.partitionBy("series").orderBy("position"), Window.partitionBy("series")
    n, s = F.count("*").over(whole), F.sum("adjusted").over(whole)
    left, left_sum = F.col("position"), F.sum("adjusted").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gains = series.withColumns({"n": n, "total": s, "left_n": left, "left_sum": left_sum}).where(
        (F.col("left_n") >= min_segment) & (F.col("n") - F.col("left_n") >= min_segment))
    rest, rest_sum = F.col("n") - F.col("left_n"), F.col("total") - F.col("left_sum")
    return gains.select("series", "position", "obs_date", (F.col("left_sum") ** 2 / F.col("left_n") + rest_sum ** 2 / rest - F.col("total") ** 2 / F.col("n")).alias("gain"))


class SegmentCost:
    """Squared error of a stretch around its mean, from prefix sums."""

    def __init__(self, values: np.ndarray):
        self.s1, self.s2 = (np.concatenate([[0.0], np.cumsum(v)]) for v in (values, values**2))

    def __call__(self, a, b):
        return np.maximum(self.s2[b] - self.s2[a] - (self.s1[b] - self.s1[a]) ** 2 / (b - a), 0.0)


def default_penalty(values: np.ndarray) -> float:
    variance = np.var(np.diff(values)) / 2 if len(values) > 1 else 0.0
    return 3.0 * np.log(max(len(values), 2)) * (variance or 1.0)


def pruned_partition(values: np.ndarray, penalty: float, min_segment: int) -> list[int]:
    """Starts of the segments after the first, by optimal partitioning with pruning (PELT).

    F(t) is the least cost of the first t values, each segment paying its squared error and the penalty: the least over s of
    F(s) + C(s, t) + penalty. As splitting a stretch never costs more, C(s, t) + C(t, u) <= C(s, u), a start s with
    F(s) + C(s, t) > F(t) can't begin the last segment of any u that t can end before, and is dropped from t + min_segment on.
    """
    n, cost = len(values), SegmentCost(values)
    total, last = {0: 0.0}, {}
    starts, until = [0], {}
    for t in range(min_segment, n + 1):
        starts = [k for k in starts if until.get(k, n) >= t]
        s = np.array(starts)
        whole = np.array([total[k] for k in starts]) + cost(s, t)
        total[t], last[t] = float(whole.min()) + penalty, int(s[whole.argmin()])
        for k, w in zip(starts, whole.tolist()):
            if w > total[t]:
                until.setdefault(k, t + min_segment - 1)
        if t - min_segment + 1 in total:  # long enough to be followed by t + 1's last segment
            starts.append(t - min_segment + 1)
    cuts, t = [], n
    while last.get(t, 0) > 0:
        t = last[t]
        cuts.append(t)
    return cuts[::-1]


def best_split(values: np.ndarray, min_segment: int) -> tuple[int, float]:
    n = len(values)
    if n < 2 * min_segment:
        return 0, 0.0
    at, cost = np.arange(min_segment, n - min_segment + 1), SegmentCost(values)
    gain = cost(0, n) - np.array([cost(0, k) + cost(k, n) for k in at])
    return int(at[gain.argmax()]), float(gain.max())


def greedy_partition(values: np.ndarray, min_segment: int, rounds: int = 6, share: float = 0.01) -> list[int]:
    """Binary segmentation: the best split of any segment, while it saves at least `share` of the whole cost."""
    cuts, whole = [0, len(values)], float(SegmentCost(values)(0, len(values))) if len(values) else 0.0
    for _ in range(rounds):
        found = [(a + k, g) for a, b in zip(cuts, cuts[1:]) for k, g in [best_split(values[a:b], min_segment)] if k]
        if not found or max(g for _, g in found) < share * whole or whole == 0:
            break
        cuts = sorted([*cuts, max(found, key=lambda f: f[1])[0]])
    return cuts[1:-1]


def block_pvalue(values: np.ndarray, min_segment: int, block: int, draws: int, label: str, seed: int) -> float | None:
    """(draws that gain as much + 1) / (draws + 1) under a moving-block bootstrap of the residuals; None for a short window."""
    n = len(values)
    if n < 2 * min_segment + 1:
        return None
    block, source = min(block, n), rng(seed, label)
    residual, gain = values - values.mean(), best_split(values, min_segment)[1]
    starts = source.integers(0, n - block + 1, size=(draws, -(-n // block)))
    samples = residual[(starts[:, :, None] + np.arange(block)).reshape(draws, -1)[:, :n]]
    return (sum(best_split(row, min_segment)[1] >= gain for row in samples) + 1) / (draws + 1)


def detect(series: DataFrame, min_segment: int = 3, block: int = 5, draws: int = 500, seed: int = 20250901) -> DataFrame:
    """(series, method, position, obs_date, mean_before, mean_after, p_value) of the breaks of both methods. A series is one value a day, so one task holds it."""
    def find(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("position")
        name, x, rows = part["series"].iloc[0], part["adjusted"].to_numpy(float), []
        for method, cuts in (("pruned", pruned_partition(x, default_penalty(x), min_segment)), ("binary", greedy_partition(x, min_segment))):
            edges = [0, *cuts, len(x)]
            for a, at, b in zip(edges, cuts, edges[2:]):
                p = block_pvalue(x[a:b], min_segment, block, draws, f"{name}:{method}:{at}", seed)
                rows.append((name, method, at, part["obs_date"].iloc[at], x[a:at].mean(), x[at:b].mean(), p))
        return pd.DataFrame(rows, columns=["series", "method", "position", "obs_date", "mean_before", "mean_after", "p_value"])

    return series.groupBy("series").applyInPandas(find, "series string, method string, position int, obs_date date, mean_before double, mean_after double, p_value double")


def match_nearest(left: DataFrame, right: DataFrame, days: int = 7) -> DataFrame:
    """Each break of left with the nearest of right's of the same series within some days; ties go to the earliest."""
    other = right.select("series", F.col("obs_date").alias("other"))
    gap = F.abs(F.datediff("other", "obs_date"))
    near = left.join(other, "series").where(gap <= days).groupBy("series", "obs_date").agg(F.min(F.struct(gap.alias("gap"), "other")).alias("m"))
    return left.join(near, ["series", "obs_date"], "left").select("series", "obs_date", F.col("m.other").alias("matched"), F.col("m.gap").alias("gap"))


def stable_period(breaks: DataFrame, first: int, last: int) -> DataFrame:
    """The longest stretch without a break, the earliest of equals: (start, end, length)."""
    edges = breaks.select("position").union(breaks.sparkSession.createDataFrame([(first,), (last,)], "position int")).distinct()
    nxt = F.lead("position").over(Window.orderBy("position"))  # one row per break
    return edges.select(F.col("position").alias("start"), nxt.alias("end")).where("end is not null").withColumn("length", F.expr("end - start")).orderBy(F.desc("length"), "start").limit(1)


def windows_around(breaks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(series, position, start, end): the window between the breaks on either side of each break; sizes: (series, n)."""
    order = Window.partitionBy("series").orderBy("position")
    edges = breaks.select("series", "position").distinct().join(sizes, "series")
    return edges.select("series", "position", F.coalesce(F.lag("position").over(order), F.lit(0)).alias("start"), F.coalesce(F.lead("position").over(order), F.col("n")).alias("end"))


def segment_means(series: DataFrame, breaks: DataFrame) -> DataFrame:
    """(series, start, end, mean) of the segments that the breaks cut a series (series, position, adjusted) into."""
    marked = series.join(breaks.select("series", "position", F.lit(1).alias("cut")).distinct(), ["series", "position"], "left")
    number = F.sum(F.coalesce("cut", F.lit(0))).over(Window.partitionBy("series").orderBy("position"))
    return marked.withColumn("segment", number).groupBy("series", "segment").agg(
        F.min("position").alias("start"), (F.max("position") + 1).alias("end"), F.avg("adjusted").alias("mean")).drop("segment")


def monitoring_window(breaks: DataFrame, n: int) -> DataFrame:
    """The longest stretch of one series without a break, and the break that follows it (null if the series ends there)."""
    return stable_period(breaks, 0, n).withColumn("next_break", F.when(F.col("end") < n, F.col("end")))
