"""Leakage of answers into expansion texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def evidence_of(qrels: DataFrame, documents: DataFrame) -> DataFrame:
    """J6. (query_id, evidence): texts of a query's relevant documents, by doc_id."""
    rows = qrels.where("grade > 0").select("query_id", "doc_id").distinct().join(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]).alias("evidence"))


def score_expansions(texts: DataFrame, queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """L1-L6. texts (query_id, method, text) scored against queries (query_id, text, answers, answer_aliases) and evidence.

    Flags on answers are null for a query without any; a null text is empty; a query without evidence has none.
    Candidates, keys and tokens of a query's evidence are derived once a query and joined to its methods.
    """
    keys = lambda values: F.array_distinct(F.transform(values, T.normal_key))
    ev = F.coalesce("evidence", T.strings())
    q = queries.select("query_id", F.col("text").alias("query"), F.coalesce("answers", T.strings()).alias("answers"), T.all_answers(F.col("answers"), F.col("answer_aliases")).alias("strings")).join(evidence, "query_id", "left")
    q = q.select(
        "query_id", "answers", "strings", T.anchor_keys(F.col("query")).alias("known"), keys(F.col("strings")).alias("answer_keys"),
        keys(F.flatten(F.transform("strings", T.candidates))).alias("answer_cands"), keys(F.flatten(F.transform(ev, T.candidates))).alias("evidence_cands"),
        F.filter(F.transform(ev, T.normal_key), lambda k: k != "").alias("evidence_keys"), F.transform(ev, lambda e: F.array_distinct(T.tokens(e))).alias("evidence_tokens"),
    )
    t = texts.select("query_id", "method", F.coalesce("text", F.lit("")).alias("t")).withColumns({"key": T.normal_key(F.col("t")), "own": F.array_distinct(T.tokens(F.col("t"))), "cand": T.candidates(F.col("t"))})
    rows = t.join(q, "query_id")
    fresh = T.first_by_key(F.filter("cand", lambda c: (T.normal_key(c) != "") & ~F.array_contains("known", T.normal_key(c))), T.normal_key)
    rows = rows.withColumn("introduced", fresh)
    n = F.size("own")
    overlap = F.when(n == 0, 0.0).otherwise(F.coalesce(F.array_max(F.transform("evidence_tokens", lambda e: F.size(F.array_intersect("own", e)).cast("double") / n)), F.lit(0.0)))

    def any_of(values: str) -> Column:
        return F.when(F.size(values) == 0, F.lit(None).cast("boolean")).otherwise(F.exists(values, lambda a: F.contains(F.col("key"), T.normal_key(a))))

    inside = lambda c, s: F.array_contains(s, T.normal_key(c))
    entail = (F.col("key") != "") & (F.exists("evidence_keys", lambda k: F.contains(k, F.col("key"))) | ((F.size("evidence_keys") > 0) & (F.col("overlap") >= 0.75)))
    scored = rows.withColumn("overlap", overlap).select(
        "query_id", "method", any_of("answers").alias("exact_answer"), any_of("strings").alias("alias_answer"), (F.size("introduced") > 0).alias("answer_candidate"),
        F.col("overlap").alias("support_overlap"), entail.alias("entailed"), "introduced",
        F.filter("introduced", lambda c: ~inside(c, F.col("evidence_cands")) & ~inside(c, F.col("answer_cands")) & ~inside(c, F.col("answer_keys"))).alias("unsupported"),
        F.filter("introduced", lambda c: ~inside(c, F.col("evidence_cands")) & ~inside(c, F.col("answer_keys"))).alias("wrong_prior"),
        F.filter("introduced", lambda c: inside(c, F.col("evidence_cands")) & ~inside(c, F.col("answer_keys"))).alias("bridge"),
        T.slot_count(F.col("t")).alias("slot_count"),
    )
    return scored.withColumn("bucket", bucket())


def bucket() -> Column:
    """L5. The first that holds: exact, alias, wrong prior, unsupported, entailed; else negative."""
    return (
        F.when(F.col("exact_answer"), "exact_answer_leakage").when(F.col("alias_answer"), "alias_answer_leakage").when(F.size("wrong_prior") > 0, "wrong_prior")
        .when(F.size("unsupported") > 0, "unsupported_candidate").when(F.col("entailed"), "evidence_entailed").otherwise("leakage_negative")
    )


def summarize(scores: DataFrame, keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """L8, A6. Rates of flags over non-null values (null if there is none), means of numbers and of list lengths."""
    rates = [F.avg(F.col(c).cast("double")).alias(f"rate_{c}") for c in ("exact_answer", "alias_answer", "answer_candidate", "entailed")]
    means = [F.avg(c).alias(f"avg_{c}") for c in ("support_overlap", "slot_count")] + [F.avg(F.size(c)).alias(f"avg_{c}") for c in ("introduced", "unsupported", "wrong_prior", "bridge")]
    return scores.groupBy(*keys).agg(F.count("*").alias("n"), *rates, *means)


def generation_features(queries: DataFrame) -> DataFrame:
    """L9. queries (query_id, answers, answer_aliases, expected, masked, hyde): presence of answers, counts of words, spans, slots."""
    strings = T.all_answers(F.col("answers"), F.col("answer_aliases"))
    return queries.select(
        "query_id", T.contains_any(F.col("expected"), F.col("answers")).alias("contains_gold_answer"), T.contains_any(F.col("expected"), strings).alias("contains_answer_alias"),
        T.contains_any(F.col("masked"), F.col("answers")).alias("masked_contains_gold_answer"), T.contains_any(F.col("masked"), strings).alias("masked_contains_answer_alias"),
        F.size(T.words(F.col("expected"))).alias("expected_token_count"), F.size(T.words(F.col("hyde"))).alias("hyde_token_count"),
        F.size(T.capitalised_spans(F.col("expected"))).alias("expected_capitalized_span_count"), F.size(T.capitalised_spans(F.col("hyde"))).alias("hyde_capitalized_span_count"),
        T.slot_count(F.col("masked")).alias("mask_slot_count"),
    )


def summarize_features(features: DataFrame) -> DataFrame:
    """A7. One row: averages of counts (0 without rows), rates of flags."""
    counts = [c for c in features.columns if c.endswith("_count")]
    flags = [c for c in features.columns if "contains" in c]
    return features.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in counts], *[F.avg(F.col(c).cast("double")).alias(f"rate_{c}") for c in flags])


def qualitative_examples(scores: DataFrame, texts: DataFrame, queries: DataFrame, method: str, n: int = 5) -> DataFrame:
    """L11, T6. The n queries with most leakage of a method, 2 for an exact answer and 1 for each unsupported candidate: a top-n report."""
    weight = 2 * F.coalesce(F.col("exact_answer").cast("int"), F.lit(0)) + F.size("unsupported")
    top = scores.where(F.col("method") == method).select("query_id", weight.alias("weight"), "bucket").orderBy(F.desc("weight"), "query_id").limit(n)
    return top.join(texts.where(F.col("method") == method).select("query_id", F.col("text").alias("expansion")), "query_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
