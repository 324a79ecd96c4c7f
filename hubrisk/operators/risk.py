"""Normalisation, composite risk score, importance reweighting, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubrisk.operators.common import one_row
from hubrisk.params import REWEIGHT_FEATURES, RISK_WEIGHTS, SCORE_FEATURES, Params


def minmax_normalize(df: DataFrame, cols: list[str], suffix: str = "_norm") -> DataFrame:
    """(x - min) / (max - min) over the whole table with NULL -> 0, constant column -> 0.
    All global min/max come from ONE aggregate row (one job), used as literals: no join."""
    s = one_row(df, *[e for i, c in enumerate(cols) for e in (
        F.min(F.coalesce(F.col(c), F.lit(0.0))).alias(f"mn{i}"),
        F.max(F.coalesce(F.col(c), F.lit(0.0))).alias(f"mx{i}"))])
    out = {}
    for i, c in enumerate(cols):
        mn, mx = F.lit(s[f"mn{i}"]).cast("double"), F.lit(s[f"mx{i}"]).cast("double")
        x = F.coalesce(F.col(c), F.lit(0.0)).cast("double")
        out[f"{c}{suffix}"] = F.when(mx > mn, (x - mn) / (mx - mn)).otherwise(F.lit(0.0))
    return df.withColumns(out)


def scale_0_100(df: DataFrame, raw: str, out: str) -> DataFrame:
    """100 * (x - min) / (max - min) when the column is not constant, else unchanged."""
    s = one_row(df, F.min(raw).alias("mn"), F.max(raw).alias("mx"))
    mn, mx = F.lit(s["mn"]).cast("double"), F.lit(s["mx"]).cast("double")
    return df.withColumn(out, F.when(mx > mn, 100 * (F.col(raw) - mn) / (mx - mn)).otherwise(F.col(raw)))


def competition_rank(df: DataFrame, score: str, out: str) -> DataFrame:
    """Rank descending with ties sharing the lowest rank (1, 1, 3). Computed over the
    distinct scores (a partial-aggregated count per score) and joined back, so the
    ordered window never sees more rows than there are distinct scores."""
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(score, (F.coalesce(F.sum("_n").over(w), F.lit(0)) + 1).cast("int").alias(out))
    return df.join(ranks, score, "left")


def weighted_sum(weights: dict[str, float], suffix: str = "_norm"):
    expr = F.lit(0.0)
    for f, w in weights.items():
        expr = expr + F.lit(float(w)) * F.col(f"{f}{suffix}")
    return expr


def risk_scores(pair_feats: DataFrame, p: Params | None = None) -> DataFrame:
    """Composite 0-100 risk score from 11 normalised features, ranked descending."""
    feats = [f for f in SCORE_FEATURES if f in pair_feats.columns]
    normed = minmax_normalize(pair_feats, feats)
    weights = {f: w for f, w in RISK_WEIGHTS.items() if f in feats}
    scored = normed.withColumn("_risk_raw", weighted_sum(weights))
    return competition_rank(scale_0_100(scored, "_risk_raw", "risk_score").drop("_risk_raw"),
                            "risk_score", "risk_rank")


def importance_weights(importance) -> dict[str, float]:
    """Weights of the 7 reweighted features: importance (missing -> 0.01), normalised to 1.
    ``importance`` is a dict or a (feature, importance) DataFrame; only 7 rows are read."""
    if isinstance(importance, DataFrame):
        rows = importance.where(F.col("feature").isin(*REWEIGHT_FEATURES)).select("feature", "importance").collect()
        importance = {r["feature"]: float(r["importance"]) for r in rows}
    raw = {f: float(importance.get(f, 0.01)) for f in REWEIGHT_FEATURES}
    total = 0.0
    for f in REWEIGHT_FEATURES:
        total += raw[f]
    return {f: raw[f] / total for f in REWEIGHT_FEATURES}


def risk_scores_reweighted(pair_feats: DataFrame, importance, p: Params | None = None) -> DataFrame:
    """Risk score recomputed with importance-derived weights over 7 features."""
    weights = importance_weights(importance)
    normed = minmax_normalize(pair_feats, list(REWEIGHT_FEATURES))
    scored = normed.withColumn("_risk_raw", weighted_sum(weights))
    return competition_rank(scale_0_100(scored, "_risk_raw", "risk_score").drop("_risk_raw"),
                            "risk_score", "risk_rank")
