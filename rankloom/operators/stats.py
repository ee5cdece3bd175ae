"""Bootstrap intervals, permutation tests, win/tie/loss, corrections; an exact mode by seeded Python, a portable one by hashes."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-12


def _hash_int(*parts: Column) -> Column:
    """The first 8 hex digits of the SHA-256 of the parts, joined by |."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def interval_places(resamples: int, alpha: float = 0.05) -> tuple[int, int]:
    """Places, from 0, of the bounds among sorted resampled means."""
    return max(0, math.floor(alpha / 2 * resamples) - 1), min(resamples - 1, math.ceil((1 - alpha / 2) * resamples) - 1)


def bootstrap_exact(values: Sequence[float], resamples: int = 1000, alpha: float = 0.05, seed: int = 13) -> tuple[float, float, float]:
    """M7. Mean and bounds by a seeded generator; zeros for no values."""
    if not values:
        return 0.0, 0.0, 0.0
    rng, n = random.Random(seed), len(values)
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
    low, high = interval_places(resamples, alpha)
    return sum(values) / n, means[low], means[high]


def permutation_exact(deltas: Sequence[float], resamples: int = 1000, seed: int = 13) -> float:
    """M8. Two-sided p of random sign flips; 1 for no values."""
    if not deltas:
        return 1.0
    rng, n = random.Random(seed), len(deltas)
    observed = abs(sum(deltas) / n)
    more = sum(abs(sum(d if rng.random() < 0.5 else -d for d in deltas) / n) >= observed for _ in range(resamples))
    return (more + 1) / (resamples + 1)


def exact_statistics(deltas: DataFrame, keys: tuple[str, ...] = ("comparison", "metric"), order: str = "query_id", resamples: int = 1000, seed: int = 13) -> DataFrame:
    """M7, M8, M11 bit by bit as a seeded generator gives them: a group is the few values of one comparison, in order."""
    schema = ", ".join(f"{k} {t}" for k, t in deltas.dtypes if k in keys) + ", n long, mean double, low double, high double, p_value double"
    names = [c for c, _ in deltas.dtypes if c in keys]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)["delta"].tolist()
        return pd.DataFrame([[*key, len(v), *bootstrap_exact(v, resamples, seed=seed), permutation_exact(v, resamples, seed=seed)]], columns=[*names, "n", "mean", "low", "high", "p_value"])

    return deltas.select(*names, order, "delta").groupBy(*names).applyInPandas(run, schema)


def numbered(deltas: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return deltas.select(*keys, order, "delta").withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))


def bootstrap_hashed(deltas: DataFrame, keys: tuple[str, ...] = ("comparison", "metric"), order: str = "query_id", resamples: int = 200, alpha: float = 0.05, seed: int = 13) -> DataFrame:
    """M7, portable: draw j of resample b takes the value at hash(seed, b, j) modulo n. (keys, n, mean, low, high)."""
    rows = numbered(deltas, keys, order)
    draws = rows.select(*keys, "n", F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    draws = draws.withColumn("i", F.pmod(_hash_int(F.lit(seed), F.col("b"), F.col("j")), F.col("n")))
    # draws are `resamples` times the rows, which the planner does not see: merged, or it would broadcast them
    means = draws.hint("merge").join(rows.select(*keys, "i", "delta"), [*keys, "i"]).groupBy(*keys, "b").agg(F.round(F.avg("delta"), 9).alias("m"))
    low, high = interval_places(resamples, alpha)
    bounds = means.groupBy(*keys).agg(F.sort_array(F.collect_list("m")).alias("ms")).select(*keys, F.col("ms")[low].alias("low"), F.col("ms")[high].alias("high"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("delta").alias("mean")).join(bounds, list(keys))


def permutation_hashed(deltas: DataFrame, keys: tuple[str, ...] = ("comparison", "metric"), order: str = "query_id", resamples: int = 200, seed: int = 13) -> DataFrame:
    """M8, portable: the sign of value i in resample b is the parity of hash(seed, b, i). (keys, n, p_value)."""
    rows = numbered(deltas, keys, order)
    signs = rows.select(*keys, "delta", "i", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    sign = F.when(_hash_int(F.lit(seed), F.col("b"), F.col("i")) % 2 == 0, 1).otherwise(-1)
    sums = signs.groupBy(*keys, "b").agg(F.abs(F.round(F.avg(F.col("delta") * sign), 9)).alias("m"))
    seen = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.abs(F.round(F.avg("delta"), 9)).alias("observed"))
    return sums.join(seen, list(keys)).groupBy(*keys).agg(F.max("n").alias("n"), ((F.count_if(F.col("m") >= F.col("observed")) + 1).cast("double") / (resamples + 1)).alias("p_value"))


def win_tie_loss(deltas: DataFrame, keys: tuple[str, ...] = ("comparison", "metric")) -> DataFrame:
    """M9, A14."""
    d = F.col("delta")
    return deltas.groupBy(*keys).agg(F.count_if(d > TOLERANCE).alias("win"), F.count_if(F.abs(d) <= TOLERANCE).alias("tie"), F.count_if(d < -TOLERANCE).alias("loss"))


def standard_error(df: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """A18. stddev_samp / sqrt(n), 0 for one value."""
    n = F.count(value)
    return df.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), F.when(n > 1, F.stddev_samp(value) / F.sqrt(n.cast("double"))).otherwise(0.0).alias("std_error"))


def corrected(p_values: DataFrame, key: str = "comparison", p: str = "p_value") -> DataFrame:
    """2.20. Holm and Benjamini-Hochberg adjusted p-values over a family of comparisons: a row each, so one window."""
    order = Window.orderBy(p, key)
    rows = p_values.withColumn("r", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy()))
    upto, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    holm = F.max(F.least(F.lit(1.0), (F.col("m") - F.col("r") + 1) * F.col(p))).over(upto)
    bh = F.min(F.least(F.lit(1.0), F.col("m") / F.col("r") * F.col(p))).over(after)
    return rows.select(key, p, holm.alias("holm"), bh.alias("benjamini_hochberg"))


def effect_size(deltas: DataFrame, keys: tuple[str, ...] = ("comparison", "metric")) -> DataFrame:
    """2.20. Mean over standard deviation of paired differences; null where they do not vary."""
    return deltas.groupBy(*keys).agg(F.avg("delta").alias("mean"), F.when(F.stddev_samp("delta") > 0, F.avg("delta") / F.stddev_samp("delta")).alias("effect_size"))
