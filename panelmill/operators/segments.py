"""Load shapes of zones and their segmentation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.seeds import rng
from panelmill.sources.panel import Panel

CANDIDATES = list(range(2, 11))

SLOTS = [f"{kind}_{h:02d}" for kind in ("weekday", "weekend") for h in range(24)]


def load_shapes(panel: Panel) -> DataFrame:
    """Mean utilisation of each zone by kind of day and hour in 48 columns, scaled to a row mean of 1; a zone of zeros stays 0."""
    slot = F.concat(F.when(F.col("is_weekend") == 1, "weekend_").otherwise("weekday_"), F.lpad(F.col("hour_of_day").cast("string"), 2, "0"))
    wide = panel.observations.withColumn("slot", slot).groupBy("zone_id").pivot("slot", SLOTS).agg(F.avg("utilisation")).fillna(0.0, SLOTS)
    mean = sum(F.col(s) for s in SLOTS) / len(SLOTS)
    scaled = wide.withColumn("mean", mean)
    return scaled.select("zone_id", *[F.coalesce(F.col(s) / F.nullif("mean", F.lit(0.0)), F.lit(0.0)).alias(s) for s in SLOTS])


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    pairs = lambda x: float((x * (x - 1) / 2).sum())
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    both, rows, columns, every = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), len(a) * (len(a) - 1) / 2
    expected = rows * columns / every if every else 0.0
    top = (rows + columns) / 2
    return 1.0 if top == expected else (both - expected) / (top - expected)


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean Euclidean silhouette; one row per zone, so the distances are zones squared."""
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    names, scores = np.unique(labels), []
    if len(names) < 2:
        return 0.0
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            scores.append(0.0)
            continue
        inside, outside = d[i][same].sum() / (same.sum() - 1), min(d[i][labels == k].mean() for k in names if k != own)
        scores.append((outside - inside) / max(inside, outside) if max(inside, outside) > 0 else 0.0)
    return float(np.mean(scores))


def nearest_means(x: np.ndarray, k: int, source: np.random.Generator, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Labels and inertia of Lloyd's iteration from centres drawn by squared distance; a centre that loses its rows moves to the farthest row."""
    centres = x[[int(source.integers(len(x)))]]
    for _ in range(k - 1):
        d = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
        pick = source.choice(len(x), p=d / d.sum()) if d.sum() > 0 else source.integers(len(x))
        centres = np.concatenate([centres, x[[int(pick)]]])
    labels = np.full(len(x), -1)
    for _ in range(rounds):
        d = ((x[:, None] - centres[None]) ** 2).sum(-1)
        now = d.argmin(1)
        if (now == labels).all():
            break
        labels = now
        centres = np.stack([x[labels == c].mean(0) if (labels == c).any() else x[d.min(1).argmax()] for c in range(k)])
    return labels, float(((x - centres[labels]) ** 2).sum())


def fits(shapes: DataFrame, ks: list[int], seeds: int, starts: int, base_seed: int) -> DataFrame:
    """(k, seed, zone_id, label, inertia): for each k and seed the best of some starts. One task per fit; its rows are the zones."""
    jobs = shapes.sparkSession.createDataFrame([(k, s) for k in ks for s in range(seeds)], "k int, seed int")
    rows = F.broadcast(jobs).crossJoin(shapes)  # fits, given by the caller, times zones

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("zone_id")
        x, k, seed = part[SLOTS].to_numpy(float), int(part["k"].iloc[0]), int(part["seed"].iloc[0])
        source = rng(base_seed, f"kmeans:{k}:{seed}")
        labels, inertia = min((nearest_means(x, min(k, len(x)), source) for _ in range(starts)), key=lambda f: f[1])
        first = {c: i for i, c in enumerate(dict.fromkeys(labels.tolist()))}  # numbered by the first zone
        return pd.DataFrame({"k": k, "seed": seed, "zone_id": part["zone_id"], "label": [first[c] for c in labels.tolist()], "inertia": inertia})

    return rows.groupBy("k", "seed").applyInPandas(fit, "k int, seed int, zone_id int, label int, inertia double")


def cluster(shapes: DataFrame, k: int, starts: int = 20, seed: int = 7) -> DataFrame:
    """(zone_id, segment) of the start with the least inertia."""
    return fits(shapes, [k], 1, starts, seed).select("zone_id", F.col("label").alias("segment"))


def diagnostics(shapes: DataFrame, ks: list[int] = CANDIDATES, starts: int = 10, seeds: int = 10, seed: int = 7) -> DataFrame:
    """(k, inertia, silhouette, calinski_harabasz, stability, least_stability, largest_share, smallest, inertia_drop).

    Each k is fitted once for its partition and `seeds` times more for its stability, the mean adjusted Rand index with that partition.
    """
    found = fits(shapes, ks, 1 + seeds, starts, seed).join(shapes, "zone_id")

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        own = part[part.seed == 0].sort_values("zone_id")
        x, labels, k, inertia = own[SLOTS].to_numpy(float), own["label"].to_numpy(), int(own["k"].iloc[0]), float(own["inertia"].iloc[0])
        total = float(((x - x.mean(0)) ** 2).sum())
        ch = ((total - inertia) / (k - 1)) / (inertia / (len(x) - k)) if inertia > 0 and len(x) > k else 0.0
        others = [adjusted_rand(labels, o.sort_values("zone_id")["label"].to_numpy()) for s, o in part.groupby("seed") if s] or [1.0]
        sizes = np.bincount(labels, minlength=k)
        return pd.DataFrame([(k, inertia, silhouette(x, labels), ch, float(np.mean(others)), float(np.min(others)), float(sizes.max() / len(x)), int(sizes.min()))],
                            columns=["k", "inertia", "silhouette", "calinski_harabasz", "stability", "least_stability", "largest_share", "smallest"])

    rows = found.groupBy("k").applyInPandas(judge, "k int, inertia double, silhouette double, calinski_harabasz double, stability double, least_stability double, largest_share double, smallest int")
    return inertia_drop(rows)


def inertia_drop(rows: DataFrame) -> DataFrame:
    """Adds the share of the inertia that a further cluster saves; null for the first k."""
    before = F.lag("inertia").over(Window.orderBy("k"))  # one row per k
    return rows.withColumn("inertia_drop", (before - F.col("inertia")) / F.nullif(before, F.lit(0.0)))


def criteria(rows: DataFrame, stability: float = 0.75, share: float = 0.60) -> DataFrame:
    """Which k each criterion admits, and which is chosen: the best silhouette among stable and balanced k, else among stable ones, else among all."""
    stable, balanced = F.col("stability") >= stability, F.col("largest_share") <= share
    rank = F.when(stable & balanced, 0).when(stable, 1).otherwise(2)
    order = Window.orderBy(rank, F.desc("silhouette"), "k")  # one row per k
    return rows.select("k", "silhouette", "calinski_harabasz", stable.alias("passes_stability"), balanced.alias("passes_balance"), (stable & balanced).alias("admitted"),
                       (F.row_number().over(order) == 1).alias("chosen"))


def choose_k(rows: DataFrame) -> int:
    found = criteria(rows).where("chosen").first()
    if found is None:
        raise ValueError("no candidates")
    return found["k"]


def describe(panel: Panel, segments: DataFrame) -> DataFrame:
    """Peak and trough hour, ratios and archetype of each segment."""
    day = panel.observations.join(F.broadcast(segments), "zone_id")
    shape = day.where("is_weekend = 0").groupBy("segment", "hour_of_day").agg(F.avg("utilisation").alias("u"))
    per = shape.groupBy("segment").agg(
        F.max_by("hour_of_day", F.struct("u", -F.col("hour_of_day"))).alias("peak_hour"), F.min_by("hour_of_day", F.struct("u", "hour_of_day")).alias("trough_hour"),
        F.coalesce(F.max("u") / F.nullif(F.avg("u"), F.lit(0.0)), F.lit(0.0)).alias("peak_to_mean"),
        F.coalesce(F.sum(F.when(F.col("hour_of_day") < 6, F.col("u"))) / F.nullif(F.sum("u"), F.lit(0.0)), F.lit(0.0)).alias("overnight_share"))
    mean = lambda weekend: F.avg(F.when(F.col("is_weekend") == weekend, F.col("utilisation")))
    kinds = day.groupBy("segment").agg(F.count_distinct("zone_id").alias("n_zones"), F.coalesce(mean(1) / F.nullif(mean(0), F.lit(0.0)), F.lit(0.0)).alias("weekend_ratio"))
    label = (F.when(F.col("overnight_share") > 0.30, "overnight").when(F.col("peak_to_mean") < 1.25, "flat").when(F.col("weekend_ratio") > 1.10, "weekend")
             .when(F.col("peak_hour").between(6, 11), "morning").when(F.col("peak_hour").between(12, 16), "midday").when(F.col("peak_hour").between(17, 22), "evening").otherwise("late"))
    return per.join(kinds, "segment").withColumn("archetype", label)
