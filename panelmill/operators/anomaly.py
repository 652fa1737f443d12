"""Isolation forest flags, their agreement with the robust flags, and inspection samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.quality import robust_scores
from panelmill.sources.files import cached, work_dir
from panelmill.sources.panel import Panel

INPUTS = ["utilisation", "kwh_per_hour", "hours_per_point", "hour_of_day", "is_weekend"]


def forest_inputs(panel: Panel) -> DataFrame:
    """Ratios with a denominator of 0 are 0."""
    safe = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    return panel.observations.withColumns({"kwh_per_hour": safe("volume", "duration"), "hours_per_point": safe("duration", "occupancy")})


def _path_constant(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def grow(sample: np.ndarray, source: np.random.Generator, depth: int = 0, limit: int = 8) -> tuple:
    """A tree of nested (feature, cut, left, right); a leaf holds its path length."""
    spread = sample.max(0) - sample.min(0) if len(sample) else np.zeros(0)
    usable = np.flatnonzero(spread > 0)
    if depth >= limit or len(sample) <= 1 or not len(usable):
        return (depth + _path_constant(len(sample)),)
    f = int(source.choice(usable))
    cut = float(source.uniform(sample[:, f].min(), sample[:, f].max()))
    low = sample[:, f] < cut
    return (f, cut, grow(sample[low], source, depth + 1, limit), grow(sample[~low], source, depth + 1, limit))


def path_length(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    out, low = np.empty(len(x)), x[:, tree[0]] < tree[1]
    out[low], out[~low] = path_length(tree[2], x[low]), path_length(tree[3], x[~low])
    return out


def forest_scores(panel: Panel, trees: int = 200, per_tree: int = 256, contamination: float = 0.005, seed: int = 7) -> DataFrame:
    """forest_score (higher: odder) and forest_flag. The trees grow on trees * per_tree sampled rows, the bound of what reaches the driver; all rows are scored."""
    rows = forest_inputs(panel).select("zone_id", "ts", *[F.col(c).cast("double").alias(c) for c in INPUTS])
    sample = rows.orderBy(F.xxhash64("zone_id", "ts", F.lit(seed))).limit(trees * per_tree).select(*INPUTS).toPandas().to_numpy(float)
    source = np.random.default_rng(seed)
    forest = [grow(sample[source.choice(len(sample), min(per_tree, len(sample)), replace=False)], source) for _ in range(trees)] if len(sample) else []
    scale = _path_constant(min(per_tree, max(len(sample), 2))) or 1.0

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        return pd.Series(2.0 ** (-np.mean([path_length(t, x) for t in forest], axis=0) / scale))

    # written once: the threshold and the result read the scores. The quantile is off by one row in a million at most
    scored = cached(rows.withColumn("forest_score", score(*INPUTS)), work_dir(panel.observations.sparkSession, "forest"))
    threshold = scored.agg(F.percentile_approx("forest_score", 1 - contamination, 1_000_000).alias("threshold"))
    return scored.crossJoin(F.broadcast(threshold)).withColumn("forest_flag", F.col("forest_score") > F.col("threshold")).drop("threshold", *INPUTS)


def agreement(flags: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two flags and their Jaccard overlap, 0 where neither is set."""
    both, either = F.count_if(F.col(a) & F.col(b)), F.count_if(F.col(a) | F.col(b))
    return flags.agg(F.count_if(F.col(a)).alias("n_a"), F.count_if(F.col(b)).alias("n_b"), both.alias("n_both"), F.count("*").alias("n_rows"),
                     F.coalesce(both / F.nullif(either, F.lit(0)), F.lit(0.0)).alias("jaccard"))


def labelled(joined: DataFrame, a: str, b: str, name_a: str, name_b: str) -> DataFrame:
    """Which of two flags of a row is set."""
    label = F.when(F.col(a) & F.col(b), "both").when(F.col(a), f"{name_a}_only").when(F.col(b), f"{name_b}_only").otherwise("neither")
    return joined.withColumn("label", label)


def flagged(panel: Panel) -> DataFrame:
    """Both flags of every row and which of them is set."""
    robust = robust_scores(panel.observations, "volume").select("zone_id", "ts", "robust_score", "robust_flag")
    return labelled(robust.join(forest_scores(panel), ["zone_id", "ts"]), "robust_flag", "forest_flag", "robust", "forest")


def sample_per_group(df: DataFrame, group: str, keys: list[str], n: int, seed: int) -> DataFrame:
    """n reproducible rows of each group, in the order of a hash of their keys."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")
