"""Forecast models: autoregression and ridge per zone, pooled ridge from Gram matrices, pooled boosted trees, retraining."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.seeds import cell_key
from panelmill.operators.features import CALENDAR, autoregressive_lags, build_features, by_zone, calendar_columns, design, feature_names, usable_columns
from panelmill.operators.forecasts import BASELINES, baselines, clip, denominators, make_folds, score_columns
from panelmill.operators.monitor import trigger_schedule
from panelmill.sources.files import cached, work_dir
from panelmill.sources.panel import Panel, hour_table, with_calendar

ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)
#: Boosting settings that an inner split chooses from: (iterations, step, depth); of a model per zone: trees, step, depth, rows of a leaf.
GBM_SETTINGS = ((10, 0.1, 5), (20, 0.1, 5), (20, 0.05, 6))
ZONE_GBM = (60, 0.1, 4, 20)
#: Measures that can't be above the zone's points.
CAPPED = ("occupancy", "duration")
OUT = "fold int, zone_id int, hour_idx int, family string, predicted double, actual double"


def solve_ridge(gram: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and weights of standardised ridge from the Gram matrix of [1, x, y]; constant columns get 0."""
    n, k = gram[0, 0], len(gram) - 2
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(centred)[:k] / n, 0))
    usable = np.flatnonzero(spread > 1e-9 * (1 + np.abs(mean[:k])))
    out = np.zeros(k + 1)
    if len(usable):
        s = spread[usable]
        a = centred[np.ix_(usable, usable)] / np.outer(s, s) + alpha * np.eye(len(usable))
        out[1 + usable] = np.linalg.solve(a, centred[usable, k] / s) / s
    out[0] = mean[k] - out[1:] @ mean[:k]
    return out


def gram_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    full = np.column_stack([np.ones(len(y)), x, y])
    return full.T @ full


def choose_alpha(x: np.ndarray, y: np.ndarray, hours: np.ndarray) -> float:
    """The alpha with the least absolute error on the last quarter of hours; 10 where there's too little to split."""
    unique = np.unique(hours)
    if len(unique) <= 4 or len(y) <= 50:
        return 10.0
    late = hours >= unique[-min(336, len(unique) // 4)]
    if min(late.sum(), (~late).sum()) <= 10:
        return 10.0
    gram = gram_of(x[~late], y[~late])
    errors = [np.abs(np.column_stack([np.ones(late.sum()), x[late]]) @ solve_ridge(gram, a) - y[late]).mean() for a in ALPHAS]
    return ALPHAS[int(np.argmin(errors))]


def autoregressive(panel: Panel, target: str, horizon: int, order: int = 24) -> DataFrame:
    """Direct AR per zone by least squares; the training mean where 25 rows or fewer are left. One task holds one zone's hours."""
    rows = (autoregressive_lags(panel.observations, target, order).withColumn("y", F.lead(target, horizon).over(by_zone()))
            .where(F.col("y").isNotNull() & (F.col("hour_idx") >= order - 1)).select("zone_id", (F.col("hour_idx") + horizon).alias("hour_idx"), "lags", "y", ceiling(target)))
    folds = make_folds(panel.settings)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        hours, y, x = part["hour_idx"].to_numpy(), part["y"].to_numpy(), np.column_stack([np.ones(len(part)), np.stack(part["lags"].to_numpy())])
        out = []
        for fold, start, end in folds:
            train, test = hours < start, (hours >= start) & (hours < end)
            if train.sum() <= 25:
                predicted = np.full(test.sum(), y[train].mean() if train.any() else 0.0)
            else:
                predicted = x[test] @ np.linalg.lstsq(x[train], y[train], rcond=None)[0]
            out.append(pd.DataFrame({"fold": fold, "zone_id": part["zone_id"].iloc[0], "hour_idx": hours[test], "family": "autoregressive", "predicted": clipped(predicted, part["ceiling"].to_numpy()[test]), "actual": y[test]}))
        return pd.concat(out)

    return rows.groupBy("zone_id").applyInPandas(fit, OUT)


def ceiling(target: str) -> F.Column:
    """What a forecast of the target can't exceed: the zone's points, or nothing."""
    return (F.col("capacity_points").cast("double") if target in CAPPED else F.lit(float("inf"))).alias("ceiling")


def clipped(predicted: np.ndarray, most: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(predicted, 0.0), most)


def training_rows(panel: Panel, target: str, horizon: int, static: bool) -> tuple[DataFrame, list[str]]:
    """Rows of the design matrix and the names of its usable features, by the hours before the first test."""
    names = feature_names(static)
    rows = design(build_features(panel, target), panel, target, horizon)
    rows = rows.select("zone_id", (F.col("hour_idx") + horizon).alias("hour_idx"), "y", ceiling(target), *[F.col(c).cast("double").alias(c) for c in names])
    first = make_folds(panel.settings)[0][1]
    usable = {r["feature"] for r in usable_columns(rows.where(F.col("hour_idx") < first), names).where("usable").collect()}  # one row per feature
    names = [n for n in names if n in usable]
    return rows.select("zone_id", "hour_idx", "y", "ceiling", *names).dropna(subset=names), names


def settled_rows(panel: Panel, target: str, horizon: int, static: bool) -> tuple[DataFrame, list[str]]:
    """`training_rows` written once, for fits that read them several times."""
    rows, names = training_rows(panel, target, horizon, static)
    return cached(rows, work_dir(rows.sparkSession, "rows")), names


def zone_level(panel: Panel, target: str, folds: list[tuple[int, int, int]]) -> DataFrame:
    """(fold, zone_id, zone_mean, zone_std) of the training hours: how the pooled models know a zone."""
    table = panel.observations.sparkSession.createDataFrame(folds, "fold int, test_start int, test_end int")
    return (panel.observations.select("zone_id", "hour_idx", target).join(F.broadcast(table), F.col("hour_idx") < F.col("test_start"))
            .groupBy("fold", "zone_id").agg(F.avg(target).alias("zone_mean"), F.stddev_pop(target).alias("zone_std")))


def zone_ridge(panel: Panel, target: str, horizon: int) -> DataFrame:
    """Ridge per zone on the features without the static ones; the training mean below 30 rows."""
    rows, names = training_rows(panel, target, horizon, static=False)
    folds = make_folds(panel.settings)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        hours, y, x, out = part["hour_idx"].to_numpy(), part["y"].to_numpy(), part[names].to_numpy(float), []
        for fold, start, end in folds:
            train, test = hours < start, (hours >= start) & (hours < end)
            if train.sum() < 30:
                predicted = np.full(test.sum(), y[train].mean() if train.any() else 0.0)
            else:
                w = solve_ridge(gram_of(x[train], y[train]), choose_alpha(x[train], y[train], hours[train]))
                predicted = w[0] + x[test] @ w[1:]
            out.append(pd.DataFrame({"fold": fold, "zone_id": part["zone_id"].iloc[0], "hour_idx": hours[test], "family": "zone_ridge", "predicted": clipped(predicted, part["ceiling"].to_numpy()[test]), "actual": y[test]}))
        return pd.concat(out)

    return rows.groupBy("zone_id").applyInPandas(fit, OUT)


class SmallTrees:
    """Boosted regression trees over binned columns, grown level by level from histograms; for the rows of one zone."""

    def __init__(self, trees: int, step: float, depth: int, leaf: int, bins: int = 32):
        self.trees, self.step, self.depth, self.leaf, self.bins = trees, step, depth, leaf, bins

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> SmallTrees:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        binned, n_features = self._binned(x), x.shape[1]
        self.mean, self.grown = float(y.mean()), []
        guess, cell = np.full(len(y), self.mean), np.arange(n_features) * self.bins
        for _ in range(self.trees):
            rest, node, tree = y - guess, np.zeros(len(y), int), []
            for _ in range(self.depth):
                wide = int(node.max()) + 1
                at = (node[:, None] * n_features * self.bins + cell + binned).ravel()
                count = np.bincount(at, minlength=wide * n_features * self.bins).reshape(wide, n_features, self.bins).cumsum(2)
                total = np.bincount(at, np.repeat(rest, n_features), wide * n_features * self.bins).reshape(wide, n_features, self.bins).cumsum(2)
                n, s = count[:, :1, -1:], total[:, :1, -1:]
                right, legal = n - count, (count >= self.leaf) & (n - count >= self.leaf)
                gain = np.where(legal, total**2 / np.maximum(count, 1) + (s - total) ** 2 / np.maximum(right, 1), -np.inf).reshape(wide, -1)
                best = gain.argmax(1)
                split = gain[np.arange(wide), best] > (s**2 / np.maximum(n, 1)).ravel() + 1e-12
                feature, cut = np.where(split, best // self.bins, 0), np.where(split, best % self.bins, self.bins)
                tree.append((feature, cut))
                node = 2 * node + (binned[np.arange(len(y)), feature[node]] > cut[node])
            leaves = np.bincount(node, minlength=2**self.depth)
            value = np.bincount(node, rest, 2**self.depth) / np.maximum(leaves, 1)
            self.grown.append((tree, value))
            guess = guess + self.step * value[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned, guess, rows = self._binned(x), np.full(len(x), self.mean), np.arange(len(x))
        for tree, value in self.grown:
            node = np.zeros(len(x), int)
            for feature, cut in tree:
                known = np.minimum(node, len(feature) - 1)
                node = 2 * node + (binned[rows, feature[known]] > cut[known])
            guess = guess + self.step * value[node]
        return guess


def zone_trees(panel: Panel, target: str, horizon: int) -> DataFrame:
    """Boosted trees per zone with one fixed setting; the training mean below 30 rows."""
    rows, names = training_rows(panel, target, horizon, static=False)
    folds = make_folds(panel.settings)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        hours, y, x, out = part["hour_idx"].to_numpy(), part["y"].to_numpy(), part[names].to_numpy(float), []
        for fold, start, end in folds:
            train, test = hours < start, (hours >= start) & (hours < end)
            predicted = np.full(test.sum(), y[train].mean() if train.any() else 0.0)
            if train.sum() >= 30:
                predicted = SmallTrees(*ZONE_GBM).fit(x[train], y[train]).predict(x[test])
            out.append(pd.DataFrame({"fold": fold, "zone_id": part["zone_id"].iloc[0], "hour_idx": hours[test], "family": "zone_gbm",
                                     "predicted": clipped(predicted, part["ceiling"].to_numpy()[test]), "actual": y[test]}))
        return pd.concat(out)

    return rows.groupBy("zone_id").applyInPandas(fit, OUT)


def block_grams(rows: DataFrame, names: list[str], blocks: list[str]) -> dict[tuple, np.ndarray]:
    """Gram matrix of [1, x, y] per block (columns of integers): partial sums per batch in the tasks, one small matrix per block at the driver."""
    size = len(names) + 2
    fields = ", ".join(f"{b} int" for b in blocks)

    def partial(batches):
        sums: dict[tuple, np.ndarray] = {}
        for part in batches:
            for b, group in part.groupby(blocks):
                sums[b] = sums.get(b, 0) + gram_of(group[names].to_numpy(float), group["y"].to_numpy(float))
        if sums:
            yield pd.DataFrame(list(sums), columns=blocks).assign(gram=[g.ravel().tolist() for g in sums.values()])

    partials = rows.select(*blocks, "y", *names).mapInPandas(partial, f"{fields}, gram array<double>")
    summed = partials.select(*blocks, F.posexplode("gram").alias("at", "v")).groupBy(*blocks, "at").agg(F.sum("v").alias("v"))
    out: dict[tuple, np.ndarray] = {}
    for r in summed.collect():  # blocks times features squared
        out.setdefault(tuple(r[b] for b in blocks), np.zeros(size * size))[r["at"]] = r["v"]
    return {b: g.reshape(size, size) for b, g in out.items()}


def linear(names: list[str], w: np.ndarray) -> F.Column:
    return F.lit(float(w[0])) + sum(F.lit(float(v)) * F.col(c) for c, v in zip(names, w[1:]))


def global_ridge(panel: Panel, target: str, horizon: int) -> DataFrame:
    """One ridge over all zones, which it knows by mean and deviation of their training hours; alpha is chosen on the last quarter of the training hours.

    Blocks are what a fold trains on and holds out inside, so one pass of Gram sums fits every fold, and one more scores the alphas.
    """
    rows, names = settled_rows(panel, target, horizon, static=True)
    folds = make_folds(panel.settings)
    known = names + ["zone_mean", "zone_std"]
    first = panel.settings.warmup - 1 + horizon
    late = {f: start - min(336, max(1, (start - first) // 4)) for f, start, _ in folds}
    table = panel.observations.sparkSession.createDataFrame([(f, late[f], start, end) for f, start, end in folds], "fold int, late int, test_start int, test_end int")
    joined = (rows.join(F.broadcast(table), F.col("hour_idx") < F.col("test_end")).join(F.broadcast(zone_level(panel, target, folds)), ["fold", "zone_id"])
              .withColumn("part", F.when(F.col("hour_idx") < F.col("late"), 0).when(F.col("hour_idx") < F.col("test_start"), 1).otherwise(2)))
    grams = block_grams(joined.where("part < 2"), known, ["fold", "part"])
    early = {f: {a: solve_ridge(grams[f, 0], a) for a in ALPHAS} for f, _, _ in folds}
    errors = joined.where("part = 1").groupBy("fold").agg(*[
        F.avg(F.abs(_by_fold({f: linear(known, w[a]) for f, w in early.items()}) - F.col("y"))).alias(f"e{k}") for k, a in enumerate(ALPHAS)])
    chosen = {r["fold"]: ALPHAS[int(np.argmin([r[f"e{k}"] for k in range(len(ALPHAS))]))] for r in errors.collect()}  # one row per fold
    weights = {f: solve_ridge(grams[f, 0] + grams[f, 1], chosen[f]) for f, _, _ in folds}
    scored = joined.where("part = 2").withColumn("predicted", _by_fold({f: linear(known, w) for f, w in weights.items()}))
    return scored.select("fold", "zone_id", "hour_idx", F.lit("global_ridge").alias("family"), clip(F.col("predicted"), F.col("ceiling")).alias("predicted"), F.col("y").alias("actual"))


def _by_fold(values: dict[int, F.Column]) -> F.Column:
    out = F.lit(None).cast("double")
    for fold, value in values.items():
        out = F.when(F.col("fold") == fold, value).otherwise(out)
    return out


def global_trees(panel: Panel, target: str, horizon: int, settings: tuple[tuple[int, float, int], ...] = GBM_SETTINGS[:1]) -> DataFrame:
    """Boosted trees of Spark ML over all zones, fitted again for each fold on the hours before it.

    Of several settings (iterations, step, depth) the last quarter of the first training hours chooses one.
    """
    rows, names = settled_rows(panel, target, horizon, static=True)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)  # each boosting round reads them again, from the written rows
    folds = make_folds(panel.settings)

    def fit(before: int, setting: tuple[int, float, int]):
        iterations, step, depth = setting
        return GBTRegressor(labelCol="y", maxIter=iterations, stepSize=step, maxDepth=depth, maxBins=64, seed=7).fit(vectors.where(F.col("hour_idx") < before))

    best, start = settings[0], folds[0][1]
    if len(settings) > 1:
        late = start - max(1, (start - panel.settings.warmup) // 4)
        inner = vectors.where((F.col("hour_idx") >= late) & (F.col("hour_idx") < start))
        best = min(settings, key=lambda s: fit(late, s).transform(inner).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0])
    scored = []
    for fold, start, end in folds:
        own = fit(start, best).transform(vectors.where((F.col("hour_idx") >= start) & (F.col("hour_idx") < end)))
        scored.append(own.select(F.lit(fold).alias("fold"), "zone_id", "hour_idx", F.lit("global_gbm").alias("family"), clip(F.col("prediction"), F.col("ceiling")).alias("predicted"),
                                 F.col("y").alias("actual")))
    return reduce(DataFrame.unionByName, scored)


#: What fits each family of the grid; baselines come from `forecasts.baselines`.
FAMILIES = {"autoregressive": autoregressive, "zone_ridge": zone_ridge, "zone_gbm": zone_trees, "global_ridge": global_ridge, "global_gbm": global_trees}


def run_grid(panel: Panel, targets: tuple[str, ...], horizons: tuple[int, ...], families: tuple[str, ...] = tuple(FAMILIES), done: DataFrame | None = None) -> DataFrame:
    """Pooled scores of each (target, horizon, family, fold), with the cell's key; cells whose key is in done (cell_key) are left out.

    The loop over targets and horizons is the driver's; folds and zones run in Spark. A group with no pending cell isn't fitted.
    """
    folds = [f for f, _, _ in make_folds(panel.settings)]
    known = {r["cell_key"] for r in done.select("cell_key").collect()} if done is not None else set()  # one row per cell of the grid
    scores = []
    for target in targets:
        truth = panel.observations.select("zone_id", "hour_idx", "utilisation")
        denominator = denominators(panel, target)
        for horizon in horizons:
            cells = {(family, f): cell_key({"target": target, "horizon": horizon, "family": family, "fold": f}) for family in (*BASELINES, *families) for f in folds}
            pending = {c for c, key in cells.items() if key not in known}
            parts = []
            if any(family in BASELINES for family, _ in pending):
                parts.append(baselines(panel, target, horizon).select("fold", "zone_id", "hour_idx", "family", "predicted", "actual"))
            parts += [FAMILIES[family](panel, target, horizon) for family in families if any(own == family for own, _ in pending)]
            if not parts:
                continue
            keys = panel.observations.sparkSession.createDataFrame([(family, f, cells[family, f]) for family, f in sorted(pending)], "family string, fold int, cell_key string")
            rows = reduce(DataFrame.unionByName, parts).join(F.broadcast(keys), ["family", "fold"])
            rows = rows.join(truth, ["zone_id", "hour_idx"]).join(F.broadcast(denominator), ["fold", "zone_id"], "left")
            scores.append(rows.groupBy("cell_key", "family", "fold").agg(*score_columns()).withColumns({"target": F.lit(target), "horizon": F.lit(horizon)}))
    if not scores:
        raise ValueError("every cell is done")
    return reduce(DataFrame.unionByName, scores)


def schedules(panel: Panel, start: int, alarms: dict[str, DataFrame], periods: tuple[int, ...] = (168, 336), cooldown: int = 168) -> dict[str, list[int]]:
    """Refit hours of each policy: never, periodic, and at the alarms of a monitor (hour_idx) with a cooldown."""
    out = {"no_retraining": [start]} | {f"periodic_{p}h": list(range(start, panel.settings.hours, p)) for p in periods}
    for name, hours in alarms.items():
        later = hours.where(F.col("hour_idx") >= start + cooldown)
        out[f"triggered_{name}"] = [start, *sorted(r["hour_idx"] for r in trigger_schedule(later, cooldown).collect())]  # one row per refit
    return out


def retraining(panel: Panel, target: str, horizon: int, policies: dict[str, list[int]], event: int, alpha: float = 10.0) -> DataFrame:
    """(policy, n_refits, mae, mae_before, mae_after, n_hours): a pooled ridge refitted at each policy's hours, each model serving until the next.

    Blocks end at every hour at which some policy refits, so one pass of Gram sums fits the models of all policies.
    """
    rows, names = settled_rows(panel, target, horizon, static=True)
    refits = sorted({h for hours in policies.values() for h in hours})
    start = refits[0]
    block = sum((F.col("hour_idx") >= h).cast("int") for h in refits)
    grams = block_grams(rows.withColumn("block", block), names, ["block"])
    weights = {h: solve_ridge(sum(g for (b,), g in grams.items() if b <= k), alpha) for k, h in enumerate(refits)}
    serving = [(policy, lo, hi, weights[lo].tolist()) for policy, hours in policies.items() for lo, hi in zip(hours, [*hours[1:], panel.settings.hours])]
    models = panel.observations.sparkSession.createDataFrame(serving, "policy string, lo int, hi int, w array<double>")
    held = rows.where(F.col("hour_idx") >= start).select("hour_idx", "y", "ceiling", F.array(F.lit(1.0), *names).alias("x"))
    scored = held.join(F.broadcast(models), (F.col("hour_idx") >= F.col("lo")) & (F.col("hour_idx") < F.col("hi")))
    dot = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = scored.withColumn("e", F.abs(clip(dot, F.col("ceiling")) - F.col("y")))
    out = scored.groupBy("policy").agg(F.avg("e").alias("mae"), F.avg(F.when(F.col("hour_idx") < event, F.col("e"))).alias("mae_before"),
                                       F.avg(F.when(F.col("hour_idx") >= event, F.col("e"))).alias("mae_after"), F.count_distinct("hour_idx").alias("n_hours"))
    counts = panel.observations.sparkSession.createDataFrame([(p, len(h) - 1) for p, h in policies.items()], "policy string, n_refits int")
    return out.join(F.broadcast(counts), "policy")


class ContractError(ValueError):
    """Input that breaks the scoring contract; violations lists every breach."""

    def __init__(self, violations: list[str]):
        super().__init__("; ".join(violations))
        self.violations = violations


def contract_violations(history: DataFrame, zones: DataFrame, min_history: int = 168) -> DataFrame:
    """(violation, n) of a scoring input (zone_id, ts, measures); missing columns raise at once."""
    measures = ["occupancy", "volume", "volume_11kw", "duration", "e_price", "s_price"]
    if missing := [c for c in ["zone_id", "ts", *measures] if c not in history.columns]:
        raise ContractError([f"missing columns: {', '.join(missing)}"])
    if not dict(history.dtypes)["ts"].startswith("timestamp"):
        raise ContractError(["ts is not a timestamp"])
    known = history.select("zone_id", "ts", *measures).join(F.broadcast(zones.select("zone_id", "capacity_points", F.lit(1).alias("_known"))), "zone_id", "left")
    negative, null = (" or ".join(f"{c} {how}" for c in measures) for how in ("< 0", "is null"))
    per = known.groupBy("zone_id").agg(
        F.count("*").alias("n"), F.count_distinct("ts").alias("hours"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("_known").alias("known"),
        F.count_if(F.expr(negative)).alias("negative"), F.count_if(F.expr(null)).alias("nulls"), F.count_if(F.expr("occupancy > capacity_points")).alias("over"))
    span = F.expr("timestampdiff(HOUR, first, last) + 1")
    row = per.agg(F.count_if(F.col("known").isNull()).alias("unknown_zones"), F.coalesce(F.sum(F.col("n") - F.col("hours")), F.lit(0)).alias("duplicates"),
                  F.coalesce(F.sum("negative"), F.lit(0)).alias("negatives"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"),
                  F.coalesce(F.sum("over"), F.lit(0)).alias("over_capacity"), F.count_if(F.col("hours") < min_history).alias("short_history"),
                  F.count_if(span != F.col("hours")).alias("gaps"), F.greatest(F.count_distinct("hours") - 1, F.lit(0)).alias("ragged"),
                  (F.count("*") == 0).cast("bigint").alias("empty"))
    return row.unpivot([], row.columns, "violation", "n").where("n > 0")


def score_latest(panel: Panel, target: str, horizon: int, alpha: float = 10.0) -> DataFrame:
    """One forecast per zone from the last hour of the panel, by the pooled ridge and the features it was trained on."""
    rows, names = training_rows(panel, target, horizon, static=True)
    w = solve_ridge(block_grams(rows.withColumn("block", F.lit(0)), names, ["block"])[0,], alpha)
    hours = hour_table(panel.observations.sparkSession, panel.settings)
    last = panel.settings.hours - 1
    from_last = build_features(panel, target).where(F.col("hour_idx") == last)
    ahead = with_calendar(hours.where(F.col("hour_idx") == last).withColumns({"hour_idx": F.col("hour_idx") + horizon, "ts": F.expr(f"ts + interval '{horizon}' hour")}), panel.settings)
    ahead = ahead.withColumns(calendar_columns(panel.settings.hours)).select("ts", *[F.col(c[3:]).alias(c) for c in CALENDAR])
    rows = from_last.drop("ts").crossJoin(F.broadcast(ahead))  # one row
    return rows.select("zone_id", "ts", clip(linear(names, w), F.col("capacity_points") if target in CAPPED else None).alias("predicted"))
