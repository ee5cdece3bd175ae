"""The registry of methods: what text a route searches with, what a fusion is made of. It drives execution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.fusion import DEFAULT_BETAS, SAFE_V0, closest_beta


@dataclass(frozen=True)
class Method:
    """mode: text (one search), rm3, rrf, weighted_rrf, adaptive_rrf, anchor_weighted, subquery_rrf; parts: routes it needs;
    weights: of its parts; beta: of an anchor-weighted one (None: adaptive)."""

    name: str
    mode: str
    parts: tuple[str, ...] = ()
    weights: tuple[float, ...] = ()
    beta: float | None = None


def _col(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _lines(*parts: Column) -> Column:
    return F.trim(F.concat_ws("\n", *parts))


def route_expressions(seed: int = 13) -> dict[str, Column]:
    """Text of each single-search route over columns text, expected, masked, hyde, query2doc, feedback, template, steered,
    steered_short, wrong_answer, answers, answer_aliases, ord."""
    q, e, m = _col("text"), _col("expected"), _col("masked")
    t = F.coalesce(F.col("template.retrieval_text"), F.lit(""))
    strings = T.all_answers(F.col("answers"), F.col("answer_aliases"))
    gold = F.array_join(F.coalesce("answers", T.strings()), " ")
    alone = {
        "hyde_doc_only": _col("hyde"), "raw_expected_answer_only": e, "masked_expected_answer_only": m, "answer_candidate_constrained_template_only": t,
        "gold_answer_only": F.when(gold != "", gold).otherwise(e), "oracle_answer_masked": T.remove_gold(e, strings), "post_hoc_gold_removed_expected_answer": T.remove_gold(e, strings),
        "random_span_masking": T.random_word_mask(e, seed), "entity_only_masking": T.entity_mask(e, q), "generic_mask_slot": T.generic_mask(m), "wrong_answer_only": _col("wrong_answer"),
    }
    after_query = {
        "query2doc_concat": _col("query2doc"), "generative_relevance_feedback_concat": _col("feedback"), "corpus_steered_expansion_concat": _col("steered"), "corpus_steered_short_concat": _col("steered_short"),
        "concat_query_raw_expected": e, "concat_query_masked_expected": m, "concat_query_answer_candidate_constrained_template": t, "concat_query_oracle_answer_masked": alone["oracle_answer_masked"],
        "concat_query_post_hoc_gold_removed_expected": alone["oracle_answer_masked"], "concat_query_random_span_masking": alone["random_span_masking"], "concat_query_entity_only_masking": alone["entity_only_masking"],
        "concat_query_generic_mask_slot": alone["generic_mask_slot"], "concat_query_wrong_answer": _col("wrong_answer"), "wrong_answer_injection": _col("wrong_answer"), "query_repeated": q,
        "query_plus_shuffled_expected": T.shuffled(e, F.lit(seed)),
    }
    other = {
        "query_only": q, "query_repeated_length_matched": T.repeat_to_length(q, e), "length_matched_neutral_filler": T.neutral_filler(q, e), "query_plus_neutral_filler": T.neutral_filler(q, e),
        "neutral_filler_plus_query": T.filler_then_query(q, e), "raw_expected_then_query": _lines(e, q),
    }
    return other | alone | {k: _lines(q, v) for k, v in after_query.items()}


#: Expansion routes of the anchor-weighted families, and of their controls.
FAMILIES = {"raw_expected": "raw_expected_answer_only", "masked_expected": "masked_expected_answer_only", "answer_constrained": "answer_candidate_constrained_template_only", "query2doc": "query2doc_only"}
CONTROLS = {"shuffled_expected": "shuffled_expected_only", "wrong_answer": "wrong_answer_only", "neutral_filler": "length_matched_neutral_filler", "query_repeated": "query_repeated", "random_terms": "random_terms_only", "idf_matched_terms": "idf_matched_terms_only"}
#: Pairs of the fused methods with the query; names that share a definition are computed once.
PAIRS = {
    "dual_query_raw_expected_rrf": "raw_expected_answer_only", "dual_query_masked_expected_rrf": "masked_expected_answer_only", "rrf_query_masked_expected": "masked_expected_answer_only",
    "dual_query_answer_candidate_constrained_template_rrf": "answer_candidate_constrained_template_only", "rrf_query_answer_constrained": "answer_candidate_constrained_template_only",
    "rrf_query_wrong_answer": "wrong_answer_only", "rrf_query_corpus_steered_short": "corpus_steered_short_concat",
}
WEIGHTED = {"weighted_dual_query_raw_expected_rrf": "raw_expected_answer_only", "weighted_dual_query_masked_expected_rrf": "masked_expected_answer_only", "weighted_rrf_query_answer_constrained": "answer_candidate_constrained_template_only"}
#: Methods of the main profile, in its order.
MAIN = (
    "query_only", "bm25_rm3_query_only", "hyde_doc_only", "query2doc_concat", "generative_relevance_feedback_concat", "corpus_steered_short_concat", "raw_expected_answer_only", "concat_query_raw_expected",
    "masked_expected_answer_only", "concat_query_masked_expected", "answer_candidate_constrained_template_only", "concat_query_answer_candidate_constrained_template", "random_span_masking", "safe_rrf_v0", "safe_rrf_v1",
    "cf_prompt_query_expansion_rrf", "concat_query_random_span_masking", "entity_only_masking", "concat_query_entity_only_masking", "generic_mask_slot", "concat_query_generic_mask_slot", "concat_query_wrong_answer",
    "query_repeated", "query_repeated_length_matched", "query_plus_shuffled_expected", "query_plus_neutral_filler", "neutral_filler_plus_query", "raw_expected_then_query", "fawe_raw_expected_beta0p25",
    "fawe_masked_expected_beta0p25", "fawe_answer_constrained_beta0p5", "fawe_query2doc_beta0p25", "fawe_safe_adaptive_beta",
)


def registry(betas: tuple[float, ...] = (), rrf_weights: tuple[float, ...] = (0.25, 0.5, 0.75), rm3: bool = False, grid: bool = False, controls: bool = False) -> dict[str, Method]:
    """§2.11. All methods by name."""
    out = {n: Method(n, "text", (n,), (1.0,)) for n in route_expressions()}
    if rm3:
        out["bm25_rm3_query_only"] = Method("bm25_rm3_query_only", "rm3", ("query_only",))
    for name, route in PAIRS.items():
        out[name] = Method(name, "rrf", ("query_only", route), (1.0, 1.0))
    out["safe_rrf_v0"] = Method("safe_rrf_v0", "weighted_rrf", tuple(r for r, _ in SAFE_V0), tuple(w for _, w in SAFE_V0))
    out["safe_rrf_v1"] = Method("safe_rrf_v1", "adaptive_rrf", tuple(r for r, _ in SAFE_V0))
    out["cf_prompt_query_expansion_rrf"] = Method("cf_prompt_query_expansion_rrf", "subquery_rrf", ("query_only",))
    for family, route in FAMILIES.items():
        beta = closest_beta(list(betas) or sorted(set(DEFAULT_BETAS.values())), DEFAULT_BETAS[family])
        name = f"fawe_{family}_beta{T.weight_suffix(DEFAULT_BETAS[family])}"
        out[name] = Method(name, "anchor_weighted", ("query_only", route), (1.0, beta), beta)
    out["fawe_safe_adaptive_beta"] = Method("fawe_safe_adaptive_beta", "anchor_weighted", ("query_only", FAMILIES["answer_constrained"]))
    if controls:
        for name, route in CONTROLS.items():
            out[f"fawe_{name}_control"] = Method(f"fawe_{name}_control", "anchor_weighted", ("query_only", route), (1.0, 0.25), 0.25)
    for base, route in WEIGHTED.items():
        for w in rrf_weights:
            name = f"{base}_w{T.weight_suffix(w)}"
            out[name] = Method(name, "weighted_rrf", ("query_only", route), (1.0, w))
    if grid:
        for family, route in FAMILIES.items():
            for b in sorted(set(betas) or set(DEFAULT_BETAS.values())):
                name = f"fawe_{family}_beta{T.weight_suffix(b)}"
                out[name] = Method(name, "anchor_weighted", ("query_only", route), (1.0, b), b)
    return out


def select_methods(methods: dict[str, Method], profile: str = "full", extra: tuple[str, ...] = ()) -> dict[str, Method]:
    """P6. All of them, or those of the main profile and the extra ones, in the registry's order."""
    if profile == "full":
        return dict(methods)
    if profile != "main":
        raise ValueError(f"unknown profile {profile!r}")
    return {n: m for n, m in methods.items() if n in MAIN or n in extra}


def required_routes(methods: dict[str, Method]) -> tuple[str, ...]:
    """P7. The routes that must be searched for the selected methods; everything else is never tokenised."""
    return tuple(sorted({r for m in methods.values() for r in m.parts} | ({"query_only"} if methods else set())))


def route_expression(route: str, seed: int = 13) -> Column:
    """The text of a route, those that only fusions use included."""
    only = {"query2doc_only": _col("query2doc"), "shuffled_expected_only": T.shuffled(_col("expected"), F.lit(seed)), "random_terms_only": _col("random_terms"), "idf_matched_terms_only": _col("idf_terms")}
    return only[route] if route in only else route_expressions(seed)[route]
