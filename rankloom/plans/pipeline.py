"""A whole experiment as tables: rankings, metrics, leakage and audits of the selected methods, for all queries at once."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import counterfactual, fusion, leakage, metrics, retrieval
from ..sources.datasets import Dataset, completed_queries, fingerprint, record_rankings, remaining_queries
from . import generation
from .methods import Method, registry, required_routes, route_expression, select_methods
from .session import new_path, written

#: Comparisons, suspicious pairs and controls that a run reports.
PRIMARY_METRICS = ("ndcg@10", "recall@10", "recall@20", "recall@100", "mrr@10")
TEMPLATED = "concat_query_answer_candidate_constrained_template"
PRIMARY = [("concat_query_raw_expected", "concat_query_masked_expected"), ("concat_query_raw_expected", TEMPLATED), ("hyde_doc_only", TEMPLATED), ("query2doc_concat", TEMPLATED), ("concat_query_raw_expected", "corpus_steered_expansion_concat"), ("safe_rrf_v0", "query2doc_concat"), ("safe_rrf_v1", "safe_rrf_v0"), ("cf_prompt_query_expansion_rrf", TEMPLATED)]
SUSPICIOUS = [("gold_answer_only", "raw_expected_answer_only"), ("oracle_answer_masked", "raw_expected_answer_only"), ("post_hoc_gold_removed_expected_answer", "raw_expected_answer_only"), ("concat_query_oracle_answer_masked", "concat_query_raw_expected"), ("concat_query_post_hoc_gold_removed_expected", "concat_query_raw_expected"), ("dual_query_masked_expected_rrf", "rrf_query_masked_expected"), ("dual_query_answer_candidate_constrained_template_rrf", "rrf_query_answer_constrained"), ("concat_query_wrong_answer", "wrong_answer_injection")]
RESCUE = [("concat_query_raw_expected", "raw_expected_answer_only"), ("concat_query_masked_expected", "masked_expected_answer_only"), (TEMPLATED, "answer_candidate_constrained_template_only"), ("concat_query_random_span_masking", "random_span_masking"), ("concat_query_entity_only_masking", "entity_only_masking"), ("concat_query_generic_mask_slot", "generic_mask_slot")]
DOMINANCE = [(c, "query_only") for c in ("query_repeated", "query_repeated_length_matched", "query_plus_neutral_filler", "neutral_filler_plus_query", "query_plus_shuffled_expected", "concat_query_wrong_answer")]
POSITION = [("raw_expected_then_query", "concat_query_raw_expected"), ("neutral_filler_plus_query", "query_plus_neutral_filler")]


@dataclass
class Config:
    top_k: int = 20
    ks: tuple[int, ...] = (5, 10, 20)
    profile: str = "full"
    betas: tuple[float, ...] = ()
    rrf_weights: tuple[float, ...] = (0.25, 0.5, 0.75)
    rm3: bool = False
    fb_docs: int = 10
    fb_terms: int = 10
    original_weight: float = 0.5
    grid: bool = False
    controls: bool = False
    control_terms: int = 10
    seed: int = 13
    methods: tuple[str, ...] | None = None
    retriever: str = "bm25"
    encoder: Callable | None = None
    dim: int = 0
    query_prefix: str = "Represent this sentence for searching relevant passages: "


@dataclass
class Result:
    methods: dict[str, Method]
    texts: DataFrame
    rankings: DataFrame
    per_query: DataFrame
    metrics: DataFrame
    leakage: DataFrame
    reports: dict[str, DataFrame] = field(default_factory=dict)


def route_texts(dataset: Dataset, first: DataFrame, terms: DataFrame, routes: tuple[str, ...], config: Config, index: retrieval.LexicalIndex | None = None) -> DataFrame:
    """(query_id, route, text): the expressions of all routes over one row a query."""
    q = dataset.queries
    support = retrieval.support_context(dataset.documents, first, terms)
    g = generation.generate_templates(q, support)
    g = g.join(generation.wrong_answers(q), "query_id", "left")
    g = g.join(retrieval.corpus_steered(dataset.documents, first, 3).withColumnRenamed("expansion", "steered"), "query_id", "left")
    g = g.join(retrieval.corpus_steered(dataset.documents, first, 2, 40).withColumnRenamed("expansion", "steered_short"), "query_id", "left")
    for route, column in (("random_terms_only", "random_terms"), ("idf_matched_terms_only", "idf_terms")):
        if route in routes and index is not None:  # Q27: only where used
            if column == "random_terms":
                found = retrieval.random_terms(index.term_stats, q.select("query_id", "text"), config.control_terms, config.seed)
            else:
                found = retrieval.idf_matched_terms(index.term_stats, g.select("query_id", "text", F.col("expected").alias("reference")), config.control_terms, config.seed)
            joined = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), " ").alias(column))
            g = g.join(joined, "query_id", "left")
    exprs = F.array(*[F.struct(F.lit(r).alias("route"), route_expression(r, config.seed).alias("text")) for r in routes])
    return g.select("query_id", F.explode(exprs).alias("r")).select("query_id", "r.route", "r.text")


def run(dataset: Dataset, config: Config = Config()) -> Result:
    """§3.1. Plans the selected methods and returns lazy tables; texts that occur twice are searched once.

    Rankings of anchor-weighted methods come from untruncated scores, those of fusions from rankings of top_k.
    """
    if config.top_k < max(config.ks):
        import warnings

        warnings.warn(f"top_k {config.top_k} is under the largest k {max(config.ks)}: its recall is that of top_k", stacklevel=2)
    chosen = select_methods(registry(config.betas, config.rrf_weights, config.rm3, config.grid, config.controls), config.profile)
    if config.methods is not None:
        chosen = {n: m for n, m in chosen.items() if n in config.methods}
    docs, q = dataset.documents, dataset.queries
    index = retrieval.store_index(docs.select("doc_id", "text"), new_path(docs.sparkSession, "index"))  # also for support and controls
    engine = retrieval.make_retriever(config.retriever, docs.select("doc_id", "text"), None, config.encoder, config.dim, config.query_prefix, index)
    own = q.select("query_id", "text")
    first = written(engine.search(own, max(config.top_k, 20)), "ranking")
    terms = written(retrieval.support_terms(docs, first, own), "support")
    routes = required_routes(chosen)
    texts = written(route_texts(dataset, first, terms, routes, config, index), "routes")
    route_scores = written(engine.scores(texts, ("query_id", "route"), config.top_k), "scores")
    ranked = retrieval.top_k(route_scores, config.top_k, ("query_id", "route"))

    parts: list[DataFrame] = []
    columns = ["query_id", "method", "doc_id", "score", "rank"]
    single = [m.name for m in chosen.values() if m.mode == "text"]
    if single:
        parts.append(ranked.where(F.col("route").isin(*single)).withColumnRenamed("route", "method").select(columns))
    spec = [(m.name, r, float(w)) for m in chosen.values() if m.mode in ("rrf", "weighted_rrf") for r, w in zip(m.parts, m.weights)]
    spark = docs.sparkSession
    if spec:
        parts.append(fusion.weighted_rrf(ranked, fusion.fusion_spec(spark, spec), config.top_k).select(columns))
    if any(m.mode == "rm3" for m in chosen.values()):
        expansion = retrieval.rm3_terms(index, first, own, config.fb_docs, config.fb_terms)
        parts.append(retrieval.top_k(retrieval.bm25_scores(index, retrieval.rm3_query_terms(expansion, own, config.original_weight)), config.top_k).withColumn("method", F.lit("bm25_rm3_query_only")).select(columns))
    templates = generation.generate_templates(q)
    valid = templates.select("query_id", generation.template_validation(F.col("template"), F.col("text")).alias("v")).select("query_id", "v.valid", "v.has_required_keys")
    feature_routes = [r for r, _ in fusion.SAFE_V0[1:]]
    adaptive = any(m.mode == "adaptive_rrf" for m in chosen.values())
    adaptive_beta = any(m.mode == "anchor_weighted" and m.beta is None for m in chosen.values())
    if adaptive or adaptive_beta:
        need = [r for r in feature_routes if r in routes] or feature_routes
        feature_texts = texts.where(F.col("route").isin(*need)) if all(r in routes for r in need) else route_texts(dataset, first, terms, tuple(feature_routes), config)
        feature_ranks = ranked if all(r in routes for r in need) else engine.search(feature_texts, config.top_k, ("query_id", "route"))
        features = fusion.route_features(docs, own, feature_texts.select("query_id", "route", F.col("text").alias("route_text")), first, feature_ranks)
        if adaptive:
            parts.append(fusion.weighted_rrf(ranked, fusion.safe_v1_spec(features, valid), config.top_k).select(columns))
    weighted = [m for m in chosen.values() if m.mode == "anchor_weighted"]
    if weighted:
        rows = F.array(*[F.struct(F.lit(m.name).alias("method"), F.lit(m.parts[1]).alias("route"), F.lit(m.beta).cast("double").alias("beta")) for m in weighted])
        uses = route_scores.select("*", F.explode(F.filter(rows, lambda r: r["route"] == F.col("route"))).alias("m")).select("query_id", "m.method", "doc_id", "score", "m.beta")
        if adaptive_beta:
            uses = uses.join(fusion.adaptive_beta(features, valid).withColumnRenamed("beta", "b2"), "query_id", "left").withColumn("beta", F.coalesce("beta", "b2", F.lit(0.2)))
        base = route_scores.where("route = 'query_only'").select("query_id", F.explode(F.array(*[F.lit(m.name) for m in weighted])).alias("method"), "doc_id", "score")
        parts.append(fusion.anchor_weighted(base, uses, F.col("beta"), config.top_k, ("query_id", "method")).select(columns))
    if any(m.mode == "subquery_rrf" for m in chosen.values()):
        parts.append(subquery_fusion(dataset, own, first, ranked, terms, engine, config).select(columns))
    rankings = parts[0]
    for p in parts[1:]:
        rankings = rankings.unionByName(p)
    rankings = written(rankings, "rankings")  # metrics and reports all read them

    method_texts = texts.withColumnRenamed("route", "method")
    per_query = metrics.per_query_metrics(rankings, dataset.qrels, config.ks)
    macro = metrics.macro_metrics(per_query)
    ran = q.select("query_id", F.explode(F.array(*[F.lit(m) for m in chosen])).alias("method"))  # also what found nothing
    scores_ = leakage.score_expansions(method_texts, q, leakage.evidence_of(dataset.qrels, docs))
    reports = {
        "method_ranking": metrics.method_ranking(macro), "leakage_summary": leakage.summarize(scores_), "duplicates": metrics.duplicate_audit(method_texts, rankings, SUSPICIOUS),
        "rescue": metrics.mean_deltas(per_query, RESCUE), "dominance": metrics.mean_deltas(per_query, DOMINANCE), "position": metrics.mean_deltas(per_query, POSITION),
        "deltas": metrics.paired_deltas(per_query, PRIMARY, tuple(c for c in per_query.columns if "@" in c)), "diagnostics": metrics.retrieval_diagnostics(method_texts, rankings, dataset.qrels),
        "bucket_metrics": metrics.bucketed_metrics(per_query, scores_.where("method = 'raw_expected_answer_only'").select("query_id", "bucket")),
        "coverage": metrics.qrel_coverage(q, dataset.qrels, docs), "error_bars": metrics.error_bars(per_query, ran=ran),
        "integrity": metrics.integrity_rates(metrics.wrong_answer_verification(method_texts, generation.wrong_answers(q), q)),
    }
    return Result(chosen, method_texts, rankings, per_query, macro, scores_, reports)


def subquery_fusion(dataset: Dataset, own: DataFrame, first: DataFrame, ranked: DataFrame, terms: DataFrame, engine: retrieval.Retriever, config: Config) -> DataFrame:
    """X9-X11. Sub-queries as further routes: searched, weighted, selected, and fused with the query."""
    support = retrieval.support_context(dataset.documents, first, terms)
    g = generation.generate_templates(dataset.queries, support).select("query_id", F.col("text").alias("query"), "subqueries", F.coalesce("support_terms", T.strings()).alias("support_terms"))
    s = F.col("subqueries")
    role = lambda values, name: F.transform(values, lambda v: F.struct(F.lit(name).alias("role"), v.alias("subquery")))
    roles = F.concat(role(s["relation_queries"], "relation"), role(s["evidence_queries"], "evidence"), role(F.array(s["answer_slot_query"]), "answer_slot"), role(F.array(s["bridge_query"]), "bridge"))
    rows = g.select("query_id", "query", "support_terms", F.posexplode(F.filter(roles, lambda r: F.trim(r["subquery"]) != "")).alias("at", "r")).select("query_id", "query", "support_terms", F.concat(F.lit("sub"), F.col("at").cast("string")).alias("route"), "r.role", "r.subquery")
    searched = engine.search(rows.select("query_id", "route", F.col("subquery").alias("text")), config.top_k, ("query_id", "route"))
    features = fusion.route_features(dataset.documents, own, rows.select("query_id", "route", F.col("subquery").alias("route_text")), first, searched)
    weighted = fusion.subquery_weights(rows.join(features, ["query_id", "route"]))
    picked = fusion.select_subqueries(weighted).join(rows.select("query_id", "route", "role", "subquery"), ["query_id", "role", "subquery"])
    name = F.lit("cf_prompt_query_expansion_rrf")
    spec = picked.select("query_id", name.alias("method"), "route", "weight").dropDuplicates(["query_id", "route"])
    spec = spec.unionByName(own.select("query_id", name.alias("method"), F.lit("query_only").alias("route"), F.lit(1.0).alias("weight")))
    pool = ranked.where("route = 'query_only'").select("query_id", "route", "doc_id", "rank").unionByName(searched.select("query_id", "route", "doc_id", "rank"))
    return fusion.weighted_rrf(pool, spec, config.top_k)


def summary(dataset: Dataset, config: Config, result: Result, restored: int = 0) -> dict:
    """S21. The run's summary as one object for datasets.write_json(): what ran, on what, and its reports.

    Reports are tables of a row for a method, comparison or query class; those of a row a query (diagnostics, coverage,
    deltas) stay tables, in the record files.
    """
    rows = lambda df, order: [r.asDict(recursive=True) for r in df.orderBy(order).collect()]
    dense = config.retriever != "bm25"
    return {
        "dataset": dataset.name, "dataset_metadata": dataset.manifest, "num_corpus": dataset.documents.count(), "num_queries": dataset.queries.count(),
        "num_qrels_queries": dataset.qrels.where("grade > 0").select("query_id").distinct().count(), "retriever": config.retriever, "query_prefix": config.query_prefix if dense else None,
        "method_profile": config.profile, "answer_rrf_weights": list(config.rrf_weights), "fawe_betas": list(config.betas), "include_rm3_baseline": config.rm3, "include_fawe_controls": config.controls, "include_fawe_beta_grid": config.grid,
        "rm3_params": {"fb_docs": config.fb_docs, "fb_terms": config.fb_terms, "original_query_weight": config.original_weight} if config.rm3 else None,
        "methods_evaluated": list(result.methods), "top_k": config.top_k, "metric_ks": list(config.ks), "finished": datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds"),
        "resume_summary": {"queries_completed_from_checkpoint": restored}, "frozen_primary_metrics": list(PRIMARY_METRICS), "frozen_primary_comparisons": [f"{a}__vs__{b}" for a, b in PRIMARY],
        "metrics": {r.pop("method"): r for r in rows(result.metrics, "method")}, "metric_error_bars": rows(result.reports["error_bars"], ["method", "metric"]), "method_ranking": rows(result.reports["method_ranking"], "place"),
        "method_leakage_summary": rows(result.reports["leakage_summary"], "method"), "concatenation_rescue_summary": rows(result.reports["rescue"], "comparison"), "query_dominance_summary": rows(result.reports["dominance"], "comparison"),
        "dense_position_audit": rows(result.reports["position"], "comparison"), "duplicate_method_audit": rows(result.reports["duplicates"], ["method_a", "method_b"]), "integrity_summary": rows(result.reports["integrity"], "differs_rate")[0],
    }


def resume(dataset: Dataset, config: Config, records: DataFrame, context: dict[str, str]) -> tuple[Dataset, DataFrame]:
    """S18, S19. The dataset as far as its queries are not done yet, and the rankings (query_id, method, doc_id, rank, score)
    of those that are, restored from records: run() the first, and add the second to its rankings."""
    chosen = select_methods(registry(config.betas, config.rrf_weights, config.rm3, config.grid, config.controls), config.profile)
    names = [n for n in chosen if config.methods is None or n in config.methods]
    done = written(completed_queries(records, dataset.queries, context, names).select("query_id").distinct(), "done")
    w = Window.partitionBy("query_id").orderBy(F.col("ord").desc())
    last = records.join(done, "query_id", "left_semi").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    kept = record_rankings(last).where(F.col("method").isin(*names))
    return replace(dataset, queries=remaining_queries(dataset.queries, done)), kept


def build_counterfactual(dataset: Dataset, style: str = "natural", include_values: bool = False, seed: int = 13, extractor=None) -> tuple[Dataset, DataFrame, DataFrame]:
    """C7. A renamed copy of a dataset: (dataset, aliases, validation). Judgements stay; the manifest says what was done.

    Spans of queries, answers and documents get aliases; documents, queries, answers, their aliases and supporting facts are
    renamed by the same table, and keep their originals.
    """
    spans = counterfactual.collect_spans(dataset.queries, dataset.documents, include_values, *([extractor] if extractor else []))
    aliases = written(counterfactual.alias_table(spans, style), "aliases")
    has = lambda df, names: [c for c in names if c in df.columns]
    docs = written(counterfactual.rename(dataset.documents.drop("original_text"), aliases, "doc_id", has(dataset.documents, ["text", "title"])), "documents")
    queries = written(counterfactual.rename(dataset.queries.drop("original_text"), aliases, "query_id", ["text"], has(dataset.queries, ["answers", "answer_aliases", "supporting_facts"])), "queries")
    name = f"{dataset.name}__entity_counterfactual_{style}{'_with_values' if include_values else ''}"
    manifest = {
        **dataset.manifest, "variant": "entity_counterfactual", "counterfactual_regime": "entity_and_value" if include_values else "entity", "alias_style": style, "include_values": include_values, "seed": seed,
        "alias_table_size": aliases.count(), "source_dataset_name": dataset.name, "source_document_count": dataset.documents.count(), "source_query_count": dataset.queries.count(), "source_dataset_fingerprint": fingerprint(dataset),
    }
    renamed = Dataset(name, docs, queries, dataset.qrels, manifest)
    return renamed, aliases, counterfactual.validation(docs, queries, dataset.qrels, aliases)
