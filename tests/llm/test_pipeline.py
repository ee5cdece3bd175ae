"""The corpus pipeline: each stage by itself on nulls, empties, repeats and long texts, then all of them."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


_POOLS = {letters: ["".join(random.Random(letters + str(k)).choices(letters, k=3 + k % 7)) for k in range(300)] for letters in ("abcdefghij", "qrstuvwxyz")}


def words(rng, letters, n):
    return " ".join(rng.choices(_POOLS[letters], k=n))


@pytest.fixture(scope="module")
def rows():
    """Two languages; copies, near copies, a shared passage, blanks, nulls, a repeated row and a long text."""
    rng = random.Random(31)
    out = [(i, words(rng, *(("abcdefghij", 60) if i % 2 else ("qrstuvwxyz", 60))), "xa" if i % 2 else "xb") for i in range(60)]
    out += [(100, out[0][1], "xb"), (101, out[0][1], "xb"), (102, out[1][1], "xa")]
    near = out[3][1].split()
    near[30] = "changed"
    passage = words(rng, "abcdefghij", 60)
    out += [(103, " ".join(near), "xa")] + [(110 + i, f"{words(rng, 'abcdefghij', 40)} {passage} {words(rng, 'abcdefghij', 40)}", "xa") for i in range(3)]
    out += [(120, None, "xa"), (121, "", "xb"), (122, "12 34 !!", "xa"), (123, words(rng, "qrstuvwxyz", 20_000), None), (124, out[5][1], None), (124, out[5][1], None)]
    return [(i, t, y, "s", len(t or "")) for i, t, y in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_empty_tables(spark, docs):
    extra = docs.withColumns({"n": F.lit("x"), "kept": F.lit("y"), "lang_pred": F.lit("z"), "cluster": F.lit(1)})
    for k, (name, stage) in enumerate(cp.STAGES):
        for df in (docs, extra):
            got = stage(spark, df, "")
            assert k == len(cp.STAGES) - 1 or got.columns == df.columns, name
        assert stage(spark, docs.where("false"), "").count() == 0


def test_language_stage_lets_go_what_it_rejects(spark, docs, rows):
    got = cp.language_id(spark, docs, "")
    true = {i: "xa" if i in (102, 103, 110, 111, 112) or i < 100 and i % 2 else "xb" for i, t, *_ in rows if t and any(map(str.isalpha, t))} | {124: "xa"}
    assert {r.doc_id: r.lang for r in got.collect()} == true
    assert got.where("doc_id = 124").count() == 2


def test_exact_stage_keeps_the_largest_id(spark, docs, rows):
    last = {}
    for i, t, *_ in rows:
        last[t or ""] = max(i, last.get(t or "", i))
    assert ids(cp.exact_dedup(spark, docs, "")) == sorted(i for i, t, *_ in rows if last[t or ""] == i)


def test_near_stage_keeps_one_of_each_group(spark, docs, rows):
    sets = {i: {tuple((t or "").lower().split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set() for i, t, *_ in rows}
    gone = {j for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {100, 101, 102, 103, 124} <= gone
    assert ids(cp.minhash_near_dedup(spark, docs, "")) == sorted(i for i, *_ in rows if i not in gone)


def test_substring_stage_removes_a_shared_passage(spark, docs, rows):
    got = {r.doc_id: r for r in cp.substring_dedup(spark, docs, "").collect()}
    text = {i: t for i, t, *_ in rows}
    assert set(got) == set(text) and got[110].text == text[110] and len(got[111].text) < len(text[111]) - 150 and got[120].text is None
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values())
    assert all(got[i].text == text[i] for i in range(2, 60) if i not in (3, 5))


def test_packing_stage_gives_each_document_a_slot(spark, docs, rows):
    got = cp.pack(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in rows) and len({(r.batch_id, r.slot) for r in got}) == len(rows)
    length = {i: len((t or "").split()) for i, t, *_ in rows}
    assert all(r.n_tokens == length[r.doc_id] <= r.bucket_len for r in got)


def test_all_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = ids(cp.run(spark, str(tmp_path)))
    step = docs
    for _, stage in cp.STAGES:
        step = stage(spark, step, "").cache()
    assert got == ids(step) and {110, 111, 112, 123} <= set(got) and not {0, 100, 120, 121, 122} & set(got)
