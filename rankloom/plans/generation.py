"""Texts that routes need: a default provider of templates in the JVM, a cache as a table, and parsing of providers' output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TASKS = ("expected_answer", "hyde_document", "query2doc_document", "relevance_feedback", "query_aware_mask_answer", "answer_candidate_template", "counterfactual_prompt_query_expansion")
#: Sentences of the template provider, before and after the query.
SENTENCES = {
    "expected_answer": ("The answer to the question is a specific entity or value related to: ", ""),
    "hyde_document": ("A relevant passage would directly discuss the subject of the question, provide the requested fact, and include supporting context. Question: ", ""),
    "query2doc_document": ("Relevant background and entities for retrieval: ", ". The document likely states the requested relation explicitly."),
    "relevance_feedback": ("Important feedback terms and relation clues for retrieval: ", ""),
}
TEMPLATE_SCHEMA = "known_anchors array<string>, unknown_slot_type string, relation_intent string, retrieval_text string"
SUBQUERY_SCHEMA = "relation_queries array<string>, evidence_queries array<string>, answer_slot_query string, bridge_query string, queries array<string>"


def prompt_version(task: str) -> str:
    """Version names of prompts; those that carry a version in their name keep it."""
    return task if task.rsplit("_v", 1)[-1].isdigit() else f"{task}_v1"


def sentence(task: str, query: Column) -> Column:
    """G3."""
    before, after = SENTENCES[task]
    return F.concat(F.lit(before), query, F.lit(after))


def template(query: Column) -> Column:
    """G5, as a struct."""
    slot = F.concat(F.lit("["), T.answer_slot_type(query), F.lit("]"))
    return F.struct(T.anchors(query).alias("known_anchors"), T.answer_slot_type(query).alias("unknown_slot_type"), T.relation_intent(query).alias("relation_intent"), F.trim(F.concat_ws(" ", query, slot)).alias("retrieval_text"))


def parsed_template(text: Column, query: Column) -> Column:
    """G10. A provider's JSON with defaults for what it lacks; other text is the retrieval text itself."""
    j, d = F.from_json(text, TEMPLATE_SCHEMA, {"mode": "PERMISSIVE"}), template(query)
    is_object = F.regexp_like(F.coalesce(text, F.lit("")), F.lit(r"(?s)^\s*\{.*\}\s*$")) & j.isNotNull()
    pick = lambda c: F.coalesce(F.when(is_object, j[c]), d[c]).alias(c)
    retrieval = F.when(is_object, F.coalesce(j["retrieval_text"], query)).otherwise(F.trim(F.coalesce(text, F.lit(""))))
    return F.struct(pick("known_anchors"), pick("unknown_slot_type"), pick("relation_intent"), retrieval.alias("retrieval_text"))


def template_validation(payload: Column, query: Column) -> Column:
    """G10. (has_required_keys, introduced, uses_slot, valid)."""
    known = F.transform(T.anchors(query), F.lower)
    new = F.filter(T.anchors(payload["retrieval_text"]), lambda a: ~F.array_contains(known, F.lower(a)))
    required = payload["known_anchors"].isNotNull() & payload["unknown_slot_type"].isNotNull() & payload["relation_intent"].isNotNull() & payload["retrieval_text"].isNotNull()
    slot = F.trim(F.coalesce(payload["unknown_slot_type"], F.lit(""))) != ""
    return F.struct(required.alias("has_required_keys"), new.alias("introduced"), slot.alias("uses_slot"), (required & (F.size(new) == 0) & slot).alias("valid"))


def obfuscation(query: Column) -> Column:
    """G11. (obfuscated_question, entity_map): anchors, longest first, by TYPE_n placeholders counted within a type."""
    found = T.named_anchors(query)
    placed = F.transform(found, lambda a, i: F.struct((-F.length(a)).alias("len"), i.alias("i"), a.alias("a")))
    ordered = F.transform(F.array_sort(placed), lambda x: x["a"])
    kinds = F.transform(ordered, T.obfuscation_type)
    items = F.transform(ordered, lambda a, i: F.struct(
        F.concat(T.obfuscation_type(a), F.lit("_"), F.size(F.filter(F.slice(kinds, 1, i + 1), lambda k: k == T.obfuscation_type(a))).cast("string")).alias("placeholder"),
        a.alias("original"), T.obfuscation_type(a).alias("type"),
    ))
    quote = lambda a: F.concat(F.lit(r"(?U)\b\Q"), F.replace(a, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    return F.struct(F.aggregate(items, query, lambda t, m: F.regexp_replace(t, quote(m["original"]), m["placeholder"])).alias("obfuscated_question"), items.alias("entity_map"))


def subqueries(query: Column, support_terms: Column) -> Column:
    """G6. Relation, evidence, slot and bridge queries from anchors and support terms."""
    names, slot, relation = F.array_join(T.anchors(query), " "), F.concat(F.lit("["), T.answer_slot_type(query), F.lit("]")), T.relation_intent(query)
    phrase = F.array_join(F.slice(support_terms, 1, 3), " ")
    hint = F.when(phrase != "", phrase).otherwise(relation)
    line = lambda *p: F.trim(F.concat_ws(" ", *p))
    relations = F.array(line(names, hint), line(names, F.lit("evidence"), hint))
    evidence = F.array(line(names, relation, F.array_join(F.slice(support_terms, 1, 2), " ")))
    bridge = F.when(T.needs_bridge(query), line(names, F.lit("intermediate evidence"), hint)).otherwise("")
    return F.struct(T.unique_queries(relations).alias("relation_queries"), T.unique_queries(evidence).alias("evidence_queries"), line(names, slot).alias("answer_slot_query"), bridge.alias("bridge_query"), T.unique_queries(F.concat(relations, evidence, F.array(line(names, slot), bridge))).alias("queries"))


def parsed_subqueries(text: Column, query: Column) -> Column:
    """G12. A provider's JSON object or list, or its lines without bullets, or queries from anchors; placeholders resolved."""
    body = F.coalesce(text, F.lit(""))
    j = F.from_json(body, SUBQUERY_SCHEMA)
    listed = F.from_json(body, "array<string>")
    is_object, is_list = F.regexp_like(body, F.lit(r"(?s)^\s*\{.*\}\s*$")) & j.isNotNull(), F.regexp_like(body, F.lit(r"(?s)^\s*\[.*\]\s*$")) & listed.isNotNull()
    emap = obfuscation(query)["entity_map"]
    out = lambda values: T.unique_queries(F.transform(F.coalesce(values, T.strings()), lambda v: T.deobfuscate(v, emap)))
    rel, ev = F.when(is_object, T.cleaned_list(j["relation_queries"])).otherwise(T.strings()), F.when(is_object, T.cleaned_list(j["evidence_queries"])).otherwise(T.strings())
    one = lambda c: F.when(is_object, F.trim(F.coalesce(j[c], F.lit("")))).otherwise("")
    raw = T.unique_queries(F.concat(rel, ev, F.array(one("answer_slot_query"), one("bridge_query")), F.when(is_object, F.coalesce(j["queries"], T.strings())).when(is_list, listed).otherwise(T.strings())))
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*\d.]+\s*", ""))), lambda x: x != "")
    names = F.array_join(F.transform(emap, lambda m: m["original"]), " ")
    default = F.array(F.trim(F.concat_ws(" ", names, T.relation_intent(query))), F.trim(F.concat_ws(" ", names, F.concat(F.lit("["), T.answer_slot_type(query), F.lit("]")))))
    chosen = F.when(F.size(raw) > 0, raw).when(F.size(lines) > 0, lines).otherwise(default)
    return F.struct(out(rel).alias("relation_queries"), out(ev).alias("evidence_queries"), T.deobfuscate(one("answer_slot_query"), emap).alias("answer_slot_query"), T.deobfuscate(one("bridge_query"), emap).alias("bridge_query"), out(chosen).alias("queries"))


def generate_templates(queries: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """G2, G14. queries (query_id, text) with a column for each text: expected, hyde, query2doc, feedback, masked, template
    (struct), subqueries (struct). support: (query_id, support_terms). Everything is expressions; nothing is called."""
    q = queries if support is None else queries.join(support.select("query_id", "support_terms"), "query_id", "left")
    terms = F.coalesce("support_terms", T.strings()) if support is not None else T.strings()
    text = F.coalesce("text", F.lit(""))
    out = q.withColumns({"expected": sentence("expected_answer", text), "hyde": sentence("hyde_document", text), "query2doc": sentence("query2doc_document", text), "feedback": sentence("relevance_feedback", text), "template": template(text), "subqueries": subqueries(text, terms)})
    return out.withColumn("masked", T.mask_answer(F.col("expected"), text))


def cache_key(namespace: Column, task: Column, text: Column) -> Column:
    """G9."""
    return F.concat_ws(":", namespace, task, F.sha2(text, 256))


def cached(requests: DataFrame, cache: DataFrame, namespaces: list[str]) -> tuple[DataFrame, DataFrame]:
    """G9, S15. (hits, misses) of requests (query_id, task, input_text) in cache (namespace, task, text_sha256, output_text).

    Earlier namespaces win; an empty output is a miss.
    """
    order = F.array_position(F.array(*map(F.lit, namespaces)), F.col("namespace"))
    known = cache.where(F.col("namespace").isin(*namespaces) & (F.coalesce("output_text", F.lit("")) != "")).groupBy("task", "text_sha256").agg(F.min_by("output_text", order).alias("output_text"))
    rows = requests.withColumn("text_sha256", F.sha2("input_text", 256))
    return rows.join(known, ["task", "text_sha256"]), rows.join(known.select("task", "text_sha256"), ["task", "text_sha256"], "left_anti")


def require_complete(misses: DataFrame) -> None:
    """G7. Cache-only mode: fails if a text is missing."""
    first = misses.select("task", "text_sha256").limit(1).collect()
    if first:
        raise LookupError(f"no generated text for task {first[0].task}, input {first[0].text_sha256}")


def generate_with(requests: DataFrame, client: Callable[[], Callable[[str, str], str]], namespace: str, provider: str, model: str, retries: int = 2, wait_s: float = 1.5) -> DataFrame:
    """G1, G8, G13, S28. Output of a provider for requests (query_id, task, input_text), as cache rows.

    client() makes, once a partition, a function (task, text) -> text; partitions are the parallelism. A call that fails
    is tried again after wait_s, 2 wait_s, ...; the last failure fails the task, which Spark runs again.
    """
    import pandas as pd

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        from datetime import datetime, timezone

        call = client()
        for pdf in it:
            out = []
            for task, text in zip(pdf["task"], pdf["input_text"]):
                for attempt in range(retries + 1):
                    try:
                        out.append(call(task, text))
                        break
                    except Exception:
                        if attempt == retries:
                            raise
                        time.sleep(wait_s * (attempt + 1))
            yield pdf.assign(output_text=out, timestamp_utc=datetime.now(timezone.utc).isoformat())

    made = requests.select("query_id", "task", "input_text").mapInPandas(run, "query_id string, task string, input_text string, output_text string, timestamp_utc string")
    return made.select(F.lit(namespace).alias("namespace"), "query_id", "task", F.sha2("input_text", 256).alias("text_sha256"), "output_text", F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.to_timestamp("timestamp_utc").alias("ts"))


def wrong_answers(queries: DataFrame, fallback: str = "Wrong Candidate") -> DataFrame:
    """J12, W6, Q18. (query_id, wrong_answer): the first answer of the next query, cyclically, that has one; never the query's own.

    queries: (query_id, ord, answers). Only queries with answers are ordered, so that what one task sees is one short
    column; a query's own answer is skipped by taking the answered query after it.
    """
    from pyspark.sql import Window

    q = queries.select("query_id", "ord", F.element_at(F.coalesce("answers", T.strings()), F.when(F.size(F.coalesce("answers", T.strings())) > 0, 1)).alias("a"))
    w = Window.orderBy("ord")
    ahead = F.first("a", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    behind = F.first("a", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return q.select("query_id", F.coalesce(ahead, behind, F.lit(fallback)).alias("wrong_answer"))
