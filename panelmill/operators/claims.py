"""The three questions that the engine's tables answer, and the headline tables they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.forecasts import spearman

# Fixed value: rankings agree above this correlation.
AGREE = 0.9


def headline_models(scores: DataFrame) -> DataFrame:
    """Mean scores of each target, horizon and family over the folds of a table of pooled scores."""
    means = ("mae", "rmse", "mape", "mape_coverage", "mase", "weighted_mae", "bias")
    return scores.groupBy("target", "horizon", "family").agg(
        F.count_distinct("fold").alias("n_folds"), F.sum("n").alias("n_rows"), *[F.avg(m).alias(m) for m in means])


def headline_capacity(scenarios: DataFrame) -> DataFrame:
    """Served and unserved demand of each estimate, budget and rule."""
    return scenarios.select("estimate", "budget", "rule", "n_seeds", "mean_energy", "std_energy", "p10", "p90", "mean_unserved", "p90_unserved", "n_zones", "most_points")


def best_by_side(scores: DataFrame, by: list[str], pooled: list[str], own: list[str], score: str = "mase") -> DataFrame:
    """For each group the pooled and the per-zone family with the least mean score, and the pooled one's advantage. Ties go to the lesser name."""
    side = F.when(F.col("family").isin(pooled), "pooled").when(F.col("family").isin(own), "own")
    mean = scores.withColumn("side", side).where("side is not null").groupBy(*by, "side", "family").agg(F.avg(score).alias("score")).where("score is not null")
    best = mean.groupBy(*by).pivot("side", ["pooled", "own"]).agg(F.min(F.struct("score", "family")))
    return best.where("pooled is not null and own is not null").select(
        *by, F.col("pooled.family").alias("pooled_family"), F.col("pooled.score").alias("pooled_score"), F.col("own.family").alias("own_family"),
        F.col("own.score").alias("own_score"), (F.col("own.score") - F.col("pooled.score")).alias("advantage"), (F.col("pooled.score") < F.col("own.score")).alias("pooled_wins"))


def advantage_by_decile(zone_scores: DataFrame, deciles: DataFrame, pooled: list[str], own: list[str]) -> DataFrame:
    """(zone_id, decile, advantage) of the pooled families over the per-zone ones."""
    return best_by_side(zone_scores, ["zone_id"], pooled, own).join(F.broadcast(deciles.select("zone_id", "decile")), "zone_id").select("zone_id", "decile", "advantage")


def decile_table(advantage: DataFrame) -> DataFrame:
    return advantage.groupBy("decile").agg(
        F.count_distinct("zone_id").alias("n_zones"), F.avg("advantage").alias("mean_advantage"), F.median("advantage").alias("median_advantage"),
        F.avg((F.col("advantage") > 0).cast("double")).alias("share_pooled"))


def claim_pooling(comparison: DataFrame, advantage: DataFrame) -> DataFrame:
    """Whether pooled models win most combinations, and the more so the quieter a zone is."""
    wins = comparison.agg(F.count("*").alias("n_combinations"), F.count_if(F.col("pooled_wins")).alias("n_pooled_wins"))
    table = decile_table(advantage)
    ends = table.agg(F.min_by("mean_advantage", "decile").alias("lowest_decile"), F.max_by("mean_advantage", "decile").alias("highest_decile"), F.sum("n_zones").alias("n_zones"))
    row = wins.crossJoin(spearman(advantage, "decile", "advantage")).crossJoin(ends)  # one row each
    holds = (F.col("n_pooled_wins") * 2 > F.col("n_combinations")) & (F.col("spearman") < 0)
    return row.withColumn("verdict", F.when(holds, "supported").otherwise("refuted"))


def claim_delay(sides: DataFrame) -> DataFrame:
    """Whether the input monitors alert later than the residual monitors at most rates; one that never alerts is infinitely late."""
    later = F.count_if(F.col("input_delay") > F.col("residual_delay"))
    return sides.agg(F.count("*").alias("n_rates"), later.alias("n_later"), F.min("input_delay").alias("input_delay"), F.min("residual_delay").alias("residual_delay"),
                     F.when(later * 2 > F.count("*"), "supported").otherwise("refuted").alias("verdict"))


def rank_agreement(zones: DataFrame, a: str, b: str, top: int = 20) -> DataFrame:
    """Rank correlation of two measures of the zones and how many zones are in the first `top` of both."""
    first = lambda c: zones.orderBy(F.desc(c), "zone_id").limit(top).select("zone_id")
    overlap = first(a).intersect(first(b)).agg(F.count("*").alias("top_overlap"))
    return spearman(zones, a, b).crossJoin(overlap).withColumn("disagree", F.col("spearman") <= AGREE)  # one row each


def claim_allocation(scenarios: DataFrame, ranks: DataFrame) -> DataFrame:
    """Whether utilisation and marginal energy rank the zones differently, and the marginal rule serves more at most budgets."""
    wide = scenarios.groupBy("estimate", "budget").pivot("rule", ["by_utilisation", "by_marginal_energy"]).agg(F.first("mean_energy"))
    wide = wide.withColumn("extra", F.col("by_marginal_energy") - F.col("by_utilisation"))
    wins = wide.groupBy("estimate").agg(F.count("*").alias("n_budgets"), F.count_if(F.col("extra") > 0).alias("n_won"), F.avg("extra").alias("mean_extra"))
    holds = F.col("disagree") & (F.col("n_won") * 2 > F.col("n_budgets"))
    return wins.join(ranks, "estimate").withColumn("verdict", F.when(holds, "supported").otherwise("refuted"))


def clean_join(flagged: DataFrame, other: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Rows flagged by one detector with what another says of them."""
    return flagged.where(F.col(flag)).join(other, keys)


def ranked_by_zone(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("zone_id").agg(F.count("*").alias(name))


def first_zones(zones: DataFrame, measure: str, n: int = 30) -> DataFrame:
    """The n zones with most of a measure, ties to the smaller zone."""
    place = F.row_number().over(Window.orderBy(F.desc(F.round(measure, 6)), "zone_id"))  # one row per zone
    return zones.select("zone_id", measure, place.alias("place")).where(F.col("place") <= n)


def histogram(df: DataFrame, measure: str, bins: int = 40, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, from_value, n) of equal bins over [low, high], the last one closed; values outside go to the ends, empty bins count 0."""
    step = (high - low) / bins
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(measure) - low) / step))).cast("int")
    counted = df.where(F.col(measure).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", (low + F.col("bin") * step).alias("from_value"), F.coalesce("n", F.lit(0)).alias("n"))
