"""Analyses across runs: regimes, held-out weights, content audits, scaling, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

REGIMES = ("public", "entity", "entity_and_value")


def common_queries(per_query: DataFrame, regimes: tuple[str, ...] = REGIMES) -> DataFrame:
    """J10, U2. Rows of queries that every regime has. per_query: (regime, query_id, ...)."""
    both = per_query.where(F.col("regime").isin(*regimes)).groupBy("query_id").agg(F.countDistinct("regime").alias("n")).where(F.col("n") == len(regimes))
    return per_query.where(F.col("regime").isin(*regimes)).join(both.select("query_id"), "query_id", "left_semi")


def heldout(per_query: DataFrame, dev_fraction: float = 0.3) -> DataFrame:
    """F42. Adds split: dev or test by the hash of the query's id."""
    return per_query.withColumn("split", F.when(T.split_bucket(F.col("query_id").cast("string")) < dev_fraction, "dev").otherwise("test"))


def beta_objectives(per_query: DataFrame, penalty: float = 0.5, metric: str = "ndcg@10") -> DataFrame:
    """B2. (method, beta, public, average, robust) over the dev split: public mean, mean over regimes, public less penalty
    times the mean drop. per_query: (regime, query_id, method, metric columns, split)."""
    means = per_query.where("split = 'dev'").groupBy("method").pivot("regime", list(REGIMES)).agg(F.avg(f"`{metric}`"))
    zero = [F.coalesce(c, F.lit(0.0)) for c in REGIMES]
    public, cf = zero[0], zero[1:]
    drop = sum((public - c for c in cf), F.lit(0.0)) / len(cf)
    return means.select("method", T.beta_of_method(F.col("method")).alias("beta"), public.alias("public"), (sum(zero, F.lit(0.0)) / len(zero)).alias("average"), (public - penalty * drop).alias("robust")).where("beta is not null")


def select_beta(objectives: DataFrame) -> DataFrame:
    """B2, T9. For each objective the best method; ties go to the smaller beta."""
    best = lambda c: F.max_by(F.struct("method", "beta", F.col(c).alias("value")), F.struct(F.round(c, 9), -F.col("beta"))).alias(c)
    one = objectives.agg(*[best(c) for c in ("public", "average", "robust")])
    rows = F.array(*[F.struct(F.lit(c).alias("objective"), F.col(c).alias("b")) for c in ("public", "average", "robust")])
    return one.select(F.explode(rows).alias("r")).select("r.objective", "r.b.method", "r.b.beta", F.col("r.b.value").alias("dev_value"))


def regime_pivot(per_query: DataFrame, metric: str = "ndcg@10", keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """Means of a metric by regime, as columns."""
    return per_query.groupBy(*keys).pivot("regime", list(REGIMES)).agg(F.avg(f"`{metric}`"))


def excess_instability(pivoted: DataFrame, baseline: str = "query_only", penalty: float = 0.5) -> DataFrame:
    """B3, B6, A19, 2.20. Drops from public to each counterfactual regime, less the baseline's; their mean; a robustness-adjusted score."""
    base = pivoted.where(F.col("method") == baseline).agg(F.max(F.col("public") - F.col("entity")).alias("be"), F.max(F.col("public") - F.col("entity_and_value")).alias("bv"))
    e, v = F.col("public") - F.col("entity"), F.col("public") - F.col("entity_and_value")
    rows = pivoted.crossJoin(F.broadcast(base)).withColumns({"drop_entity": e, "drop_value": v, "excess_entity": e - F.col("be"), "excess_value": v - F.col("bv")})  # one row
    mean = (F.col("excess_entity") + F.col("excess_value")) / 2
    robust = (F.col("entity") + F.col("entity_and_value")) / 2 - penalty * F.greatest(F.lit(0.0), mean)
    return rows.select("method", *REGIMES, "drop_entity", "drop_value", "excess_entity", "excess_value", mean.alias("mean_excess"), robust.alias("robust_score"))


def content_audit(per_query: DataFrame, answer_bearing: Column) -> DataFrame:
    """B3, A9. Gain and excess by method, for queries whose text bears the answer, those whose does not, and all.

    per_query: (method, query_id, gain, excess, and what answer_bearing reads). Each row counts in its group and in all.
    """
    rows = per_query.withColumn("bearing", F.coalesce(answer_bearing, F.lit(False)))
    sets = rows.groupingSets([["method", "bearing"], ["method"]], "method", "bearing").agg(F.count("*").alias("n"), F.coalesce(F.avg("gain"), F.lit(0.0)).alias("mean_gain"), F.coalesce(F.avg("excess"), F.lit(0.0)).alias("mean_excess"), F.grouping("bearing").alias("g"))
    return sets.select("method", F.when(F.col("g") == 1, "all").when(F.col("bearing"), "answer_bearing").otherwise("not_answer_bearing").alias("grp"), "n", "mean_gain", "mean_excess")


def scaling(metrics: DataFrame, sizes: list[int], methods: tuple[str, str]) -> DataFrame:
    """B5, J15. (dataset, regime, size, delta) of two methods over a scaffold of sizes: null where a run is missing.

    metrics: (dataset, regime, size, method, value).
    """
    scaffold = metrics.select("dataset", "regime").distinct().select("dataset", "regime", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    side = lambda m: F.max(F.when(F.col("method") == m, F.col("value")))
    values = metrics.groupBy("dataset", "regime", "size").agg((side(methods[0]) - side(methods[1])).alias("delta"))
    return scaffold.join(values, ["dataset", "regime", "size"], "left")


def cross_regime(metrics: DataFrame) -> DataFrame:
    """B1. Means by where the text was generated, which corpus was searched, and how it was used.

    metrics: (generation, corpus, use, query_id, value).
    """
    return metrics.groupBy("generation", "corpus", "use").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
