"""The engine on the toy fixture, against hand-derived or plain-Python values."""

import hashlib
import math
import random
import re
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom import queries
from rankloom.functions import text as T
from rankloom.operators import containment, counterfactual, fusion, leakage, metrics, retrieval, stats
from rankloom.plans import generation, methods, pipeline
from rankloom.sources import datasets


@pytest.fixture(scope="module")
def toy(spark):
    return datasets.toy(spark)


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*cols).first()


def test_tokens_match_before_lower_case(spark):
    assert one(spark, "Mané Kelvin A_1", T.tokens(F.col("t")))[0] == ["man", "elvin", "a_1"]


def test_candidates_and_keys(spark):
    text = 'He read "The Red Book" by Jane Roe in May 1999 and 12/05/2001; jane roe 3.5 The'
    got = one(spark, text, T.candidates(F.col("t")))[0]
    assert got == ["The Red Book", "He", "Jane Roe", "May", "1999", "12/05/2001", "12", "05", "2001", "3.5"]
    assert one(spark, " A--b C ", T.normal_key(F.col("t")))[0] == "a b c"


def test_values_in_lists_are_trimmed(spark):
    assert one(spark, ' "1 a 0 " x', T.candidates(F.col("t")))[0][0] == "1 a 0" and one(spark, "", T.cleaned_list(T.strings(" a ", " ", "1 b", "2")))[0] == ["a", "1 b", "2"]
    assert list(one(spark, "", datasets.formatted(F.lit(None).cast("double")), datasets.formatted(F.lit(0.5), True))) == ["TBD", "+0.500"]


def test_masks(spark):
    q = F.lit("Who met Jane Roe?")
    text = "Jane Roe met John Doe on January 5, 2020 in New York"
    # numbers are masked before dates, so the month's day and year are numbers
    assert one(spark, text, T.mask_answer(F.col("t"), q))[0] == "Jane Roe met [ENTITY] on [DATE] [NUMBER], [NUMBER] in [ENTITY]"
    assert one(spark, "[ENTITY] [ENTITY]  [ENTITY] x", T.collapse_slots(F.col("t")))[0] == "[ENTITY] x"
    assert one(spark, "in Ulm, ULM", T.remove_gold(F.col("t"), F.array(F.lit("Ulm"))))[0] == "in [ANSWER], [ANSWER]"


def test_empty_and_null_text(spark):
    row = one(spark, "", T.tokens(F.col("t")), T.candidates(F.col("t")), T.words(F.col("t")), T.repeat_to_length(F.col("t"), F.lit("a b")))
    assert list(row) == [[], [], [], ""]


def bm25(docs, query, k1=1.5, b=0.75):
    toks = {d: [x.lower() for x in re.findall("[A-Za-z0-9_]+", t)] for d, t in docs.items()}
    avg, n = sum(map(len, toks.values())) / len(toks), len(toks)
    out = {}
    for term in [x.lower() for x in re.findall("[A-Za-z0-9_]+", query)]:
        df = sum(term in t for t in toks.values())
        for d, t in toks.items():
            tf = t.count(term)
            if tf:
                out[d] = out.get(d, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
    return out


def test_bm25_equals_plain_python(spark, toy):
    docs = {r.doc_id: r.text for r in toy.documents.collect()}
    got = {}
    for r in retrieval.bm25_search(toy.documents, toy.queries.select("query_id", "text"), None).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = r.score
    for q in toy.queries.collect():
        want = bm25(docs, q.text)
        assert got[q.query_id].keys() == want.keys()
        assert all(abs(got[q.query_id][d] - s) < 1e-9 for d, s in want.items())


def test_bm25_rank_does_not_depend_on_repetition(spark, toy):
    q = toy.queries.select("query_id", "text")
    twice = q.select("query_id", F.concat_ws(" ", "text", "text").alias("text"))
    rank = lambda x: sorted((r.query_id, r.rank, r.doc_id) for r in retrieval.bm25_search(toy.documents, x).collect())
    assert rank(q) == rank(twice)


def test_rrf_and_anchor_weighting(spark):
    r = spark.createDataFrame([("q", "a", "x", 1), ("q", "a", "y", 2), ("q", "b", "y", 1)], "query_id string, route string, doc_id string, rank int")
    got = {x.doc_id: x.score for x in fusion.rrf(r).collect()}
    assert got == pytest.approx({"y": 1 / 61 + 1 / 62, "x": 1 / 61})
    s = spark.createDataFrame([("q", "x", 2.0), ("q", "y", 1.0)], "query_id string, doc_id string, score double")
    e = spark.createDataFrame([("q", "y", 8.0), ("q", "z", 1.0)], "query_id string, doc_id string, score double")
    assert [(x.doc_id, x.score) for x in fusion.anchor_weighted(s, e, 0.25).orderBy("rank").collect()] == [("y", 3.0), ("x", 2.0), ("z", 0.25)]
    assert [x.doc_id for x in fusion.anchor_weighted(s, e, 0.0, 2).orderBy("rank").collect()] == ["x", "y"]


def test_metrics_linear_gain(spark):
    runs = spark.createDataFrame([("m", "q", "a", 1), ("m", "q", "b", 2), ("m", "q", "c", 3), ("m", "p", "a", 1)], "method string, query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "b", 2), ("q", "z", 1), ("q", "a", 0)], "query_id string, doc_id string, grade int")
    rows = {r.query_id: r for r in metrics.per_query_metrics(runs, qrels).collect()}
    assert rows["q"]["recall@5"] == 0.5 and rows["q"]["mrr@10"] == 0.5
    assert rows["q"]["ndcg@10"] == pytest.approx((2 / math.log2(3)) / (2 + 1 / math.log2(3)))
    assert not rows["p"].judged and rows["p"]["ndcg@10"] == 0
    macro = metrics.macro_metrics(metrics.per_query_metrics(runs, qrels)).first()
    assert macro.n_queries == 1


def test_leakage_flags_and_inclusions(spark, toy):
    texts = toy.queries.select("query_id", F.lit("m").alias("method"), F.concat(F.lit("It was Warsaw, says Zed Zulu: "), "text").alias("text"))
    rows = leakage.score_expansions(texts, toy.queries, leakage.evidence_of(toy.qrels, toy.documents)).collect()
    by = {r.query_id: r for r in rows}
    assert by["q1"].exact_answer and by["q1"].bucket == "exact_answer_leakage" and not by["q2"].exact_answer
    for r in rows:
        assert set(r.unsupported) <= set(r.wrong_prior) <= set(r.introduced)
    none = toy.queries.withColumn("answers", T.strings()).withColumn("answer_aliases", T.strings())
    assert leakage.score_expansions(texts, none, leakage.evidence_of(toy.qrels, toy.documents)).where("exact_answer is not null").count() == 0


def test_exact_statistics_are_seeded(spark):
    values = [random.Random(1).random() - 0.4 for _ in range(5)]
    assert stats.bootstrap_exact(values, 50) == stats.bootstrap_exact(values, 50)
    mean, low, high = stats.bootstrap_exact(values, 200)
    assert low <= mean <= high and 0 < stats.permutation_exact(values, 100) <= 1
    assert stats.bootstrap_exact([]) == (0.0, 0.0, 0.0) and stats.permutation_exact([]) == 1.0


def test_wrong_answers_rotate(spark, toy):
    assert {r.query_id: r.wrong_answer for r in generation.wrong_answers(toy.queries).collect()} == {"q1": "Ulm", "q2": "London", "q3": "Warsaw"}
    alone = toy.queries.where("query_id = 'q1'")
    assert generation.wrong_answers(alone).first().wrong_answer == "Wrong Candidate"


def test_template_parsing(spark):
    q = F.lit("Where is Ulm?")
    row = one(spark, '{"retrieval_text": "Ulm city", "unknown_slot_type": "LOCATION"}', generation.parsed_template(F.col("t"), q))[0]
    assert row.retrieval_text == "Ulm city" and row.known_anchors == ["Ulm"] and row.relation_intent == "location or place relation"
    assert one(spark, "plain words", generation.parsed_template(F.col("t"), q))[0].retrieval_text == "plain words"


def test_renaming_equals_the_unfiltered_loop(spark):
    docs = spark.createDataFrame([("1", "Ann Lee met ann lee near Big City. Bob"), ("2", "nothing here"), ("3", None), ("4", "Bob Ann Lee Lake Varos Bob")], "doc_id string, text string")
    spans = spark.createDataFrame([("Ann Lee", "PERSON"), ("Big City", "LOCATION"), ("Bob", "ENTITY"), ("Varos", "LOCATION")], "span string, type string")
    aliases = counterfactual.alias_table(spans)
    pairs = [(r.source, r.alias) for r in aliases.orderBy("ord").collect()]
    got = {r.doc_id: r for r in counterfactual.rename(docs, aliases, "doc_id", ["text"]).collect()}
    for d in docs.collect():
        assert got[d.doc_id].text == counterfactual.rename_text(d.text, pairs)
        assert got[d.doc_id].original_text == d.text


def test_dataset_round_trip_and_fingerprint(spark, toy, tmp_path):
    datasets.export(toy, f"file://{tmp_path}/toy")
    again = datasets.load(spark, f"file://{tmp_path}/toy")
    assert again.name == "toy" and again.documents.count() == 5 and again.qrels.count() == 3
    assert datasets.load(spark, f"file://{tmp_path}/toy", max_corpus=2).qrels.count() == 2
    assert datasets.fingerprint(toy) == datasets.fingerprint(datasets.Dataset("toy", toy.documents.repartition(3), toy.queries, toy.qrels))
    assert again.queries.where("query_id = 'q1'").first().answers == ["Warsaw"]


def test_tolerant_spellings_and_grades(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id": 7, "text": "x"}\n\n{"id": "8", "title": "T", "text": ""}\n')
    (tmp_path / "r.jsonl").write_text('{"qid": 1, "pid": 7}\n{"qid": 1, "pid": 7, "score": 2}\n{"qid": 1, "pid": 8, "score": 0}\n')
    docs = datasets.documents_from(datasets.read_jsonl(spark, f"file://{tmp_path}/c.jsonl"), True)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [("7", "x"), ("8", "T")]
    rows = datasets.read_jsonl(spark, f"file://{tmp_path}/r.jsonl")
    assert [(r.doc_id, r.grade) for r in datasets.qrels_from(rows).collect()] == [("7", 2)]
    assert datasets.qrels_from(rows, legacy_zero_grade=True).count() == 2


def test_method_registry():
    full = methods.registry(rm3=True)
    assert {"safe_rrf_v0", "safe_rrf_v1", "fawe_safe_adaptive_beta", "cf_prompt_query_expansion_rrf", "bm25_rm3_query_only"} <= full.keys()
    main = methods.select_methods(full, "main")
    assert set(main) == set(methods.MAIN)
    assert methods.required_routes({"safe_rrf_v0": full["safe_rrf_v0"]}) == tuple(sorted(full["safe_rrf_v0"].parts))


def test_pipeline_on_toy(spark, toy):
    result = pipeline.run(toy, pipeline.Config(methods=("query_only", "query_repeated", "rrf_query_wrong_answer", "safe_rrf_v0", "fawe_raw_expected_beta0p25", "concat_query_raw_expected")))
    rows = {r.method: r for r in result.metrics.collect()}
    assert set(rows) == set(result.methods) and all(0 <= r["ndcg@10"] <= 1 and r["recall@5"] <= r["recall@10"] for r in rows.values())
    assert rows["query_only"]["ndcg@10"] == pytest.approx(rows["query_repeated"]["ndcg@10"])


def _encoder():
    """An encoder that counts letters; made here, so that workers need not import this file."""

    def make():
        import numpy as np

        return lambda texts: np.array([[t.lower().count(c) + 0.01 for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts])

    return make


_letters = _encoder()


def test_kinds_of_retrievers(spark, toy):
    import numpy as np

    docs, q = toy.documents.select("doc_id", "text"), toy.queries.select("query_id", "text")
    dense = retrieval.make_retriever("dense", docs, encoder=_letters, dim=26, prefix="find: ")
    unit = lambda t: (lambda v: v / np.linalg.norm(v))(_letters()([t])[0].astype(np.float32))
    vec = {r.doc_id: unit(r.text).astype(float) for r in docs.collect()}
    ranked, want = {}, {}
    for r in q.collect():
        own = unit("find: " + r.text).astype(float)
        want[r.query_id] = sorted(vec, key=lambda d: (-round(float(own @ vec[d]), 9), d))
    for r in dense.search(q, None).orderBy("rank").collect():
        ranked.setdefault(r.query_id, []).append(r.doc_id)
    assert ranked == want
    lexical = retrieval.make_retriever("bm25", docs)
    lex = {}
    for r in lexical.search(q, 10).orderBy("rank").collect():
        lex.setdefault(r.query_id, []).append(r.doc_id)
    hybrid = retrieval.make_retriever("lexical_neural", docs, encoder=_letters, dim=26, prefix="find: ")
    for r in hybrid.search(q, 3).collect():
        both = [1 / (61 + lst.index(r.doc_id)) for lst in (lex[r.query_id], want[r.query_id]) if r.doc_id in lst]
        assert r.score == pytest.approx(sum(both))
    with pytest.raises(ValueError):
        retrieval.make_retriever("sparse", docs)
    with pytest.raises(ValueError):
        retrieval.make_retriever("dense", docs)


@pytest.mark.parametrize("kind", ["dense", "hybrid"])
def test_pipeline_with_other_retrievers(spark, toy, kind):
    result = pipeline.run(toy, pipeline.Config(methods=("query_only", "concat_query_raw_expected", "fawe_raw_expected_beta0p25"), retriever=kind, encoder=_letters, dim=26))
    assert {r.method for r in result.metrics.collect()} == set(result.methods)


def test_summary_records_and_resume(spark, toy, tmp_path):
    config = pipeline.Config(methods=("query_only", "query_repeated", "concat_query_wrong_answer", "wrong_answer_only"))
    result, context = pipeline.run(toy, config), {"retriever": "bm25", "top_k": "20"}
    summary = pipeline.summary(toy, config, result)
    datasets.write_json(spark, f"file://{tmp_path}/summary.json", summary)
    assert set(summary["metrics"]) == set(config.methods) and summary["integrity_summary"]["in_wrong_answer_only_rate"] == 1.0 and summary["num_corpus"] == 5
    assert all(b["low"] <= b["mean"] <= b["high"] for b in summary["metric_error_bars"])
    some = toy.queries.where("query_id <> 'q2'").select("query_id")
    datasets.write_records(result.rankings.join(some, "query_id"), toy.qrels, result.texts, f"file://{tmp_path}/records", queries=toy.queries, context=context)
    records = datasets.read_records(spark, f"file://{tmp_path}/records")
    rest, restored = pipeline.resume(toy, config, records, context)
    assert [r.query_id for r in rest.queries.collect()] == ["q2"]
    key = lambda df: sorted((r.query_id, r.method, r.doc_id, r.rank) for r in df.collect())
    assert key(restored) == key(result.rankings.where("query_id <> 'q2'"))
    assert pipeline.resume(toy, config, records, {"retriever": "dense"})[0].queries.count() == 3


def test_counterfactual_build_renames_aliases_of_answers(spark, toy):
    built, aliases, validation = pipeline.build_counterfactual(toy)
    table = {r.source: r.alias for r in aliases.collect()}
    known = {a for q in toy.queries.collect() for a in [*q.answers, *q.answer_aliases]}
    assert known <= set(table) and built.manifest["alias_table_size"] == len(table)
    text = {r.doc_id: r for r in built.documents.collect()}
    pairs = [(r.source, r.alias) for r in aliases.orderBy("ord").collect()]
    for d in toy.documents.collect():
        assert text[d.doc_id].text == counterfactual.rename_text(d.text, pairs) and text[d.doc_id].original_text == d.text
    for q in built.queries.collect():
        assert not set(q.answers + q.answer_aliases) & known
    (v,) = validation.collect()
    assert v.alias_count == len(table) and v.answer_preservation_rate == 1.0 and v.residual_corpus_sources == 0


def test_aliases_meet_what_other_aliases_write(spark):
    docs = spark.createDataFrame([("1", "Zed met Bob-Ann. - x"), ("2", "nothing"), ("3", None), ("4", "q ... Été")], "doc_id string, text string")
    rows = [((-9, "a"), "Bob-Ann", "Lake Varos"), ((-8, "b"), "Lake", "Region Talor"), ((-7, "c"), "Talor", "End"), ((-6, "d"), "Été", "Ete"), ((-5, "e"), "Nobody", "x")]
    table = spark.createDataFrame(rows, "ord struct<len: int, low: string>, source string, alias string")
    got = {r.doc_id: r.text for r in counterfactual.rename(docs, table, "doc_id", ["text"]).collect()}
    assert got == {"1": "Zed met Region End Varos. - x", "2": "nothing", "3": None, "4": "q ... Ete"}


def test_mentions_equal_containment(spark):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("ab c-") for _ in range(n))
    texts, sources = [(i, make(rng.randint(0, 60))) for i in range(60)] + [(99, None)], sorted({make(rng.randint(1, 22)) for _ in range(80)})
    got = counterfactual.mentions(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(s,) for s in sources], "source string"), "id", "t").collect()
    key = lambda s: " ".join(re.sub("[^a-z0-9]+", " ", (s or "").lower()).split())
    assert {tuple(r) for r in got} == {(i, s) for i, t in texts for s in sources if key(s) and key(s) in key(t)}


def test_store_appends_only_missing(spark, tmp_path):
    store = datasets.embedding_store(spark, f"file://{tmp_path}/e")
    row = lambda i: spark.createDataFrame([("m", i, "h", [1.0])], "model string, doc_id string, text_sha256 string, embedding array<float>")
    store.append(row("a"))
    store.append(row("a").union(row("b")))
    assert store.read().count() == 2 and store.missing(row("b").union(row("c"))).count() == 1


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """A folder of tables with other alphabets, answers and names that stand in documents only."""
    d = str(tmp_path_factory.mktemp("whole"))
    docs = [(1, "Émile Zola met Ada Lovelace in Paris. It was in Paris."), (2, "Only Here University, naïve Köln \"Der Zauberberg\""), (3, None), (4, "plain text"), (5, "Varos saw ada lovelace; PARIS. Ana Ruiz de Mar Azul vio el Lago Verde y una casa")]
    items = [(1, "Ana Ruiz de Mar Azul vio el Lago Verde y una casa"), (2, "Köln liegt am Rhein und Émile Zola war dort im Mai")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, docs, items


def _aliases_by_hand(docs, items):
    runs = lambda s: [m for m in re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,4}\b", s or "") if len(m) >= 3]
    return {x for _, s in docs + items for x in runs(s)} | {" ".join(s.split()[-4:]) for _, s in items} | {x for _, s in docs for x in re.findall(r'"([^"\n]{2,120})"', s or "")}


def test_whole_alias_table(spark, whole):
    d, docs, items = whole
    table = queries.QUERIES["alias_table_full"](spark, d).collect()
    assert {r.source for r in table} == _aliases_by_hand(docs, items)
    assert {r.source for r in queries.QUERIES["alias_table_coded_full"](spark, d).collect()} == {r.source for r in table}
    pairs = sorted(((r.source, r.alias) for r in table), key=lambda p: (-len(p[0]), p[0].lower(), p[0]))
    for r in queries.QUERIES["renamed_queries"](spark, d).collect():
        assert r.text == counterfactual.rename_text(dict(items)[r.query_id], pairs)
    key = lambda s: " ".join(re.sub("[^a-z0-9]+", " ", s.lower()).split())
    true = {(i, s) for i, text in items for s, _ in pairs if key(s) and key(s) in key(text)}
    assert {tuple(r) for r in queries.QUERIES["alias_mentions_full"](spark, d).collect()} == true
    (v,) = queries.QUERIES["counterfactual_validation"](spark, d).collect()
    assert v.alias_count == len(pairs) and v.answerable_queries == 1


def test_whole_corpus_renamed(spark, whole):
    d, docs, _ = whole
    table = queries.QUERIES["alias_table_full"](spark, d).collect()
    pairs = sorted(((r.source, r.alias) for r in table), key=lambda p: (-len(p[0]), p[0].lower(), p[0]))
    got = {r.doc_id: r.text for r in queries.QUERIES["renamed_docs_full"](spark, d).collect()}
    assert got == {i: counterfactual.rename_text(s, pairs) for i, s in docs}
    assert "Lovelace" not in got[1] and "lovelace" not in got[5] and got[3] is None and got[4] == "plain text"


def test_capitals_of_several_characters(spark):
    """an answer with ß equals its own capitals."""
    got = one(spark, "enß aσ", T.all_answers(F.array("t", T.by_character(F.col("t"), F.upper)), T.strings(), lambda v: T.by_character(v, F.lower)), T.by_character(F.col("t"), F.upper))
    assert list(got) == [["enß aσ"], "ENß AΣ"]


def same_as_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    got = queries.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    return rows


@pytest.fixture(scope="module")
def covered(spark, tmp_path_factory):
    """Every passage is in a document; first sentences have quoted lower-case words; an answer has an ß."""
    folder = tmp_path_factory.mktemp("covered")
    docs = [(1, 'alpha beta "gamma" delta gamma ab "ab" one two three four five six seven eight. rest'), (2, "Straße eins zwei drei vier fünf grenß sechs sieben acht neun zehn grenß")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight"), (2, docs[1][1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_strings_of_answers_equal_sql(spark, covered):
    same_as_sql(spark, covered, "all_answer_strings")


def test_no_query_without_coverage_equals_sql(spark, covered):
    """no such query is a null list, not an empty text."""
    assert same_as_sql(spark, covered, "qrel_coverage_summary")[0][4] is None


def test_quoted_words_are_no_tokens(spark, covered):
    """a quoted word counts as a phrase besides, and "ab" is too short for a token."""
    found = {(q, term): n for q, term, n in same_as_sql(spark, covered, "support_tokens")}
    assert found[1, "gamma"] == 2 and (1, "ab") not in found


@pytest.mark.parametrize("cell", [1 << 19, 7])
def test_best_of_cells_equal_all_scores(spark, tmp_path, monkeypatch, cell):
    """Of a stored index only what may be among the k best leaves a cell; ties go by doc_id, across cells too."""
    monkeypatch.setattr(retrieval, "CELL_POSTINGS", cell)
    monkeypatch.setattr(retrieval, "CELL_WEIGHTS", cell)
    draw = random.Random(3)
    docs = [(f"d{i:02}", " ".join(draw.choices("a b c d e f".split(), k=1 + i % 4))) for i in range(60)] + [("e1", ""), ("e2", None), *((f"c{i}", "a b") for i in range(9))]
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    texts = [("q1", "a b"), ("q2", "a a c"), ("q3", "zz"), ("q4", None), ("q5", "f")]
    queries_ = spark.createDataFrame(texts, "query_id string, text string")
    index = retrieval.store_index(frame, str(tmp_path / "index"))
    want = {}
    for q, text in texts:
        scores = bm25({d: t or "" for d, t in docs}, text or "")
        want |= {(q, i + 1): d for i, d in enumerate(sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:5])}
    got = retrieval.bm25_search(frame, queries_, 5, index=index).collect()
    assert {(r.query_id, r.rank): r.doc_id for r in got} == want
    numbered = queries_.select(F.monotonically_increasing_id().alias("text_no"), "text").where("text = 'a b'")
    moved = retrieval.best_scores(index, retrieval.query_terms(numbered, ("text_no",)), 5)
    assert moved.count() <= 5 * moved.rdd.getNumPartitions() and (cell == 7 or moved.count() == 5)


def test_counted_tokens_equal_token_column(spark, monkeypatch):
    """Tokens counted in place are those of T.tokens(), and nothing is shuffled for them."""
    texts = ["", None, "a A b", "a", "A_1", "Mané Kelvin Kelvin İx", "\u0000x\u0000x", "z" * 5000, "\U0001f600ab\U0001f600AB", " ", "x" + " y" * 3000]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts * 3)], "doc_id long, text string").coalesce(1)
    own = frame.select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    want = {(r.doc_id, w): (r.w.count(w), len(r.w)) for r in own.collect() for w in {*r.w, None}}
    want = {k: (1 if k[1] is None else n, size) for k, (n, size) in want.items()}
    schema = to_arrow_schema(retrieval.counted(frame).schema)
    for limit in (retrieval.TEXT_BYTES, 8):
        monkeypatch.setattr(retrieval, "TEXT_BYTES", limit)
        found = pa.Table.from_batches(retrieval._counted(schema)(iter(frame.toArrow().to_batches(20)))) if limit == 8 else retrieval.counted(frame).toArrow()
        rows = found.to_pylist()
        assert len(rows) == len(want) and {(r["doc_id"], r["term"]): (r["tf"], r["doc_len"]) for r in rows} == want
    assert "Exchange" not in retrieval.counted(frame)._jdf.queryExecution().executedPlan().toString()


def shuffled(spark):
    """(rows, bytes) that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in stages), sum(s.shuffleWriteBytes() for s in stages)


def test_search_and_judgements_move_no_postings_or_texts(spark, tmp_path, monkeypatch):
    """Neither the index nor a search moves a row for each token, and no text moves but those that may be judged."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(draw.choices(words, k=300))) for i in range(400)], "doc_id long, text string").repartition(4).persist()
    docs.count()
    asked = spark.createDataFrame([(i, " ".join(words[40 * i : 40 * i + 40])) for i in range(10)], "query_id long, text string")
    before = shuffled(spark)
    index = retrieval.store_index(docs, str(tmp_path / "index"))
    assert retrieval.bm25_search(docs, asked, 5, index=index).count() == 50
    rows = shuffled(spark)[0] - before[0]
    assert rows < 12_000 and index.postings.count() > 80_000  # 400 terms a task and document rows

    passages = docs.where("doc_id % 100 = 7").select(F.col("doc_id").alias("query_id"), F.substring("text", 200, 60).alias("text"))
    monkeypatch.setattr(containment, "BITS", 1 << 14)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # as where there are many hits
    try:
        before = shuffled(spark)
        found = containment.possible(docs, docs.where("doc_id < 4").select("doc_id")).join(docs.where("doc_id < 4").select("doc_id"), "doc_id")
        assert {r.doc_id for r in found.collect()} == {0, 1, 2, 3}
        assert shuffled(spark)[1] - before[1] < 100_000  # the texts have 500,000
        pairs = {(r.query_id, r.doc_id) for r in containment.containing_indexed(index, passages).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert pairs == {(r.doc_id, r.doc_id) for r in docs.where("doc_id % 100 = 7").collect()}


def test_draws_are_not_broadcast(spark):
    """resampling makes many rows of few, whose size the planner takes for small."""
    deltas = spark.createDataFrame([("a", "m", i, i / 7) for i in range(20)], "comparison string, metric string, query_id long, delta double")
    found = stats.bootstrap_hashed(deltas)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString() and found.first()["n"] == 20


def test_error_bars_are_over_all_queries(spark):
    """queries without judgements, and those that found nothing, count as 0."""
    runs = spark.createDataFrame([("m", "a", "x", 1), ("m", "b", "y", 1), ("m", "d", "y", 2)], "method string, query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("a", "x", 1), ("c", "x", 1), ("d", "y", 1)], "query_id string, doc_id string, grade int")
    ran = spark.createDataFrame([("m", q) for q in "abcd"], "method string, query_id string")
    found = {r.metric: r for r in metrics.error_bars(metrics.per_query_metrics(runs, qrels), 50, ran=ran).collect()}
    values = [1.0, 0.0, 0.0, 0.5]  # b is not judged, c found nothing
    place = lambda b, j: int(hashlib.sha256(f"13|{b}|{j}".encode()).hexdigest()[:8], 16) % 4
    means = sorted(sum(values[place(b, j)] for j in range(4)) / 4 for b in range(50))
    low, high = stats.interval_places(50)
    assert found["mrr@10"][2:] == (4, 0.375, means[low], means[high]) and found["recall@5"].mean == 0.5


def test_error_bars_of_all_queries_equal_sql(spark, tmp_path):
    """one query is judged, one is not, and one finds nothing by most methods."""
    spark.createDataFrame([(1, "red green blue one two three four five six seven eight nine ten"), (2, "one two other words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six"), (2, "two one three"), (3, "zzyzx qwrtp")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = same_as_sql(spark, tmp_path, "metric_error_bars")
    assert len(rows) == 32 and {r[2] for r in rows} == {3}


def test_error_bars_of_a_run_are_over_all_queries(spark, toy):
    """a run's report too; its metrics stay those of judged queries."""
    asked = toy.queries.withColumn("text", F.when(F.col("query_id") == "q3", F.lit("zzyzx")).otherwise(F.col("text")))
    result = pipeline.run(replace(toy, queries=asked, qrels=toy.qrels.where("query_id <> 'q2'")), pipeline.Config(methods=("query_only", "query_repeated")))
    bars = result.reports["error_bars"].collect()
    assert len(bars) == 10 and {b.n for b in bars} == {3} and {m.n_queries for m in result.metrics.collect()} == {1}
