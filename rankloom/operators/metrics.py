"""Retrieval metrics, comparisons of methods, and audits, as aggregations over rankings and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def per_query_metrics(rankings: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10, 20), keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """M1-M4. (keys, query_id, recall@k..., mrr@10, ndcg@10) for every ranked query; 0 where nothing is relevant.

    rankings: (keys, query_id, doc_id, rank); qrels: (query_id, doc_id, grade). Gains are linear in the grade.
    """
    rel = qrels.where("grade > 0").groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))
    w = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "doc_id")
    ideal = rel.withColumn("r", F.row_number().over(w)).groupBy("query_id").agg(F.count("*").alias("n_rel"), F.sum(F.when(F.col("r") <= 10, F.col("grade") / F.log2(F.col("r") + 1.0)).otherwise(0.0)).alias("idcg"))
    hit = rankings.select(*keys, "query_id", "doc_id", "rank").join(rel, ["query_id", "doc_id"], "left")
    near = F.col("grade").isNotNull()
    sums = [F.sum(F.when(near & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias(f"h{k}") for k in ks]
    per = hit.groupBy(*keys, "query_id").agg(*sums, F.max(F.when(near & (F.col("rank") <= 10), 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr@10"), F.sum(F.when(near & (F.col("rank") <= 10), F.col("grade") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    out = per.join(ideal, "query_id", "left")
    recall = [F.coalesce(F.col(f"h{k}") / F.col("n_rel"), F.lit(0.0)).alias(f"recall@{k}") for k in ks]
    return out.select(*keys, "query_id", *recall, F.col("`mrr@10`"), F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg@10"), F.col("n_rel").isNotNull().alias("judged"))


def long_metrics(per_query: DataFrame) -> DataFrame:
    """M4 in long form: (..., metric, value)."""
    names = [c for c in per_query.columns if "@" in c]
    rest = [c for c in per_query.columns if "@" not in c]
    return per_query.select(*rest, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names])).alias("m")).select(*rest, "m.metric", "m.value")


def macro_metrics(per_query: DataFrame, keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """M5. Means over judged queries; zeros for a method without any."""
    names = [c for c in per_query.columns if "@" in c]
    return per_query.groupBy(*keys).agg(*[F.coalesce(F.avg(F.when(F.col("judged"), F.col(f"`{n}`"))), F.lit(0.0)).alias(n) for n in names], F.sum(F.col("judged").cast("long")).alias("n_queries"))


def method_ranking(metrics: DataFrame, baseline: str = "query_only", metric: str = "ndcg@10") -> DataFrame:
    """M6, T5. Methods by a metric, with their distance from a baseline and their place."""
    base = metrics.agg(F.max(F.when(F.col("method") == baseline, F.col(f"`{metric}`"))).alias("b"))
    rows = metrics.crossJoin(F.broadcast(base)).select("method", F.col(f"`{metric}`").alias("value"), (F.col(f"`{metric}`") - F.col("b")).alias("delta"))  # one row
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.round("value", 9).desc(), "method")))  # a row a method


def paired_deltas(per_query: DataFrame, pairs: list[tuple[str, str]], metrics: tuple[str, ...] = ("ndcg@10",), keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """J9, M11. (comparison, metric, query_id, delta) of judged queries, by conditional aggregation instead of self-joins."""
    long = long_metrics(per_query.where("judged")).where(F.col("metric").isin(*metrics))
    sides = F.array(*[F.struct(F.lit(f"{a}__vs__{b}").alias("c"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    rows = long.select(*keys, "method", "metric", "value", F.explode(F.filter(sides, lambda s: (s["a"] == F.col("method")) | (s["b"] == F.col("method")))).alias("s"))
    both = rows.groupBy(F.col("s.c").alias("comparison"), "metric", *keys).agg(F.max(F.when(F.col("method") == F.col("s.a"), F.col("value"))).alias("va"), F.max(F.when(F.col("method") == F.col("s.b"), F.col("value"))).alias("vb"))
    return both.where("va is not null and vb is not null").select("comparison", "metric", *keys, (F.col("va") - F.col("vb")).alias("delta"))


def mean_deltas(per_query: DataFrame, pairs: list[tuple[str, str]], metric: str = "ndcg@10") -> DataFrame:
    """A13, M13-M15. Mean difference of each pair: rescue by concatenation, dominance of the query, order of parts."""
    return paired_deltas(per_query, pairs, (metric,)).groupBy("comparison").agg(F.avg("delta").alias("mean_delta"), F.count("*").alias("n_queries"))


def duplicate_audit(texts: DataFrame, rankings: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """M12, A12. For pairs of methods: shared queries, share with equal texts, share with equal first ten documents.

    texts: (query_id, method, text); rankings: (query_id, method, doc_id, rank).
    """
    tops = rankings.where("rank <= 10").groupBy("query_id", "method").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("top"))
    both = texts.select("query_id", "method", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).join(tops, ["query_id", "method"], "left")
    sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    rows = both.select("*", F.explode(F.filter(sides, lambda s: (s["a"] == F.col("method")) | (s["b"] == F.col("method")))).alias("s"))
    top = F.coalesce(F.to_json("top"), F.lit("[]"))
    side = lambda x, c: F.max(F.when(F.col("method") == F.col(f"s.{x}"), c))
    per = rows.groupBy(F.col("s.a").alias("method_a"), F.col("s.b").alias("method_b"), "query_id").agg(side("a", F.col("h")).alias("ha"), side("b", F.col("h")).alias("hb"), side("a", top).alias("ta"), side("b", top).alias("tb"))
    return per.where("ha is not null and hb is not null").groupBy("method_a", "method_b").agg(F.count("*").alias("shared_queries"), F.avg((F.col("ha") == F.col("hb")).cast("double")).alias("identical_text_rate"), F.avg((F.col("ta") == F.col("tb")).cast("double")).alias("identical_top10_rate"))


def qrel_coverage(queries: DataFrame, qrels: DataFrame, documents: DataFrame) -> DataFrame:
    """A10, M19. (query_id, n_qrels, n_found, coverage): judged documents that the corpus holds; null coverage without any."""
    found = qrels.where("grade > 0").join(documents.select("doc_id", F.lit(1).alias("hit")).distinct(), "doc_id", "left")
    per = found.groupBy("query_id").agg(F.count("*").alias("n_qrels"), F.count("hit").alias("n_found"))
    n = F.coalesce("n_qrels", F.lit(0))
    return queries.select("query_id").join(per, "query_id", "left").select("query_id", n.alias("n_qrels"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.when(n > 0, F.col("n_found") / n).alias("coverage"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """A10. One row: queries, evaluable, mean and least coverage, and the queries that have none, as a sorted list."""
    c = F.col("coverage")
    zero = F.sort_array(F.collect_list(F.when(F.coalesce(c, F.lit(0.0)) == 0, F.col("query_id").cast("string"))))
    return coverage.agg(F.count("*").alias("n_queries"), F.count_if(c > 0).alias("n_evaluable"), F.avg(c).alias("mean_coverage"), F.min(c).alias("min_coverage"), F.array_join(zero, ",").alias("zero_coverage_ids"))


def retrieval_diagnostics(texts: DataFrame, rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """M17, F41. (query_id, method, input_sha256, top10, relevant): what went in, and what came out."""
    tops = rankings.where("rank <= 10").groupBy("query_id", "method").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("top10"))
    rel = qrels.where("grade > 0").groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("relevant"))
    return texts.select("query_id", "method", F.sha2(F.coalesce("text", F.lit("")), 256).alias("input_sha256")).join(tops, ["query_id", "method"], "left").join(rel, "query_id", "left")


def audit_sample(queries: DataFrame, n: int, seed: int = 13) -> DataFrame:
    """P10, M16. The n queries that come first by a hash of seed and id: a sampling operator."""
    return queries.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string")), 256)).limit(n)


def bucketed_metrics(per_query: DataFrame, buckets: DataFrame, keys: tuple[str, ...] = ("method", "bucket")) -> DataFrame:
    """L10, A8. Macro metrics by a bucket of each query. buckets: (query_id, bucket)."""
    return macro_metrics(per_query.join(buckets, "query_id"), keys)


def rate(flag: Column) -> Column:
    """A6, A16. Share of true among non-null flags, null without any."""
    return F.avg(flag.cast("double"))


def wrong_answer_verification(texts: DataFrame, wrong: DataFrame, queries: DataFrame) -> DataFrame:
    """M18. (query_id, candidate, in_wrong_answer_only, in_concat, differs): what the wrong-answer control must fulfil.

    texts: (query_id, method, text); wrong: (query_id, wrong_answer); queries: (query_id, text). Texts are compared with
    white space and case folded; a method without a text gives nulls.
    """
    of = lambda name: F.max(F.when(F.col("method") == name, F.col("text")))
    both = texts.groupBy("query_id").agg(of("wrong_answer_only").alias("alone"), of("concat_query_wrong_answer").alias("joined"))
    rows = wrong.select("query_id", F.col("wrong_answer").alias("candidate")).join(queries.select("query_id", F.col("text").alias("q")), "query_id").join(both, "query_id", "left")
    return rows.select(
        "query_id", "candidate", T.contains_folded(F.col("alone"), F.col("candidate")).alias("in_wrong_answer_only"), T.contains_folded(F.col("joined"), F.col("candidate")).alias("in_concat"),
        (T.folded(F.col("joined")) != T.folded(F.col("q"))).alias("differs"),
    )


def integrity_rates(verification: DataFrame) -> DataFrame:
    """M18, A16. One row: the share of queries that fulfil each condition, of those where it is known."""
    return verification.agg(*[rate(F.col(c)).alias(f"{c}_rate") for c in ("in_wrong_answer_only", "in_concat", "differs")])


def error_bars(per_query: DataFrame, resamples: int = 1000, keys: tuple[str, ...] = ("method", "metric"), ran: DataFrame | None = None) -> DataFrame:
    """B4, M10, Q11. (method, metric, n, mean, low, high) over all queries of a run or of record files, by bootstrap: those without judgements count as 0.

    ran: (keys but metric, query_id), what was searched, so that queries that found nothing, which have no row in per_query, count as 0 too.
    """
    from . import stats

    if ran is not None:
        on = [*(k for k in keys if k != "metric"), "query_id"]
        names = [c for c in per_query.columns if "@" in c]
        per_query = ran.select(*on).distinct().join(per_query, on, "left").select(*on, *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names])
    long = long_metrics(per_query).select("query_id", *keys, F.col("value").alias("delta"))
    return stats.bootstrap_hashed(long, keys, resamples=resamples)
