"""The operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import bpe, chat, exact, forest, langid, licences, near, packing, quality, substring

DOCS = "doc_id long, text string, key string, score string, digest string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Ids and texts: exact, near and chained copies, a shared passage, blanks, nulls, a repeated row, a long text."""
    rng = random.Random(4)
    base = words(rng, 60)
    rows, chain = [(0, base), (1, base), (2, base), (2, base)], base.split()
    for i in range(3, 9):
        chain[rng.randrange(60)] = words(rng, 1)
        rows.append((i, " ".join(chain)))
    passage = words(rng, 60)
    rows += [(i, f"{words(rng, 30)} {passage} {words(rng, 30)}") for i in range(10, 14)]
    rows += [(i, words(rng, 40)) for i in range(20, 30)]
    return [*rows, (30, ""), (31, None), (None, base), (32, " \n\t "), (33, "one"), (34, "ONE"), (35, words(rng, 30_000))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "k", None, "d") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, k):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates(docs, texts):
    sets = [(i, shingles(t, 2)) for i, t in texts]
    comp = {i: i for i, _ in sets if i is not None}
    again = True
    while again:
        again = False
        for i, a in sets:
            for j, b in sets:
                if None not in (i, j) and a and b and 100 * len(a & b) >= 80 * len(a | b) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    again = True
    got = near.near_duplicates(docs, shingle=2).collect()
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sorted((str(i), len(s)) for i, s in sets)
    for r in got:
        assert r.component_id == (comp[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_nothing(empty):
    assert near.near_duplicates(empty).count() == 0


def test_multi_index_reaches_all_pairs():
    index, rng = near.HammingIndex(), np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, index.symbols, dtype=np.uint16)
        b = a.copy()
        b[rng.choice(index.symbols, index.reach, replace=False)] ^= 1
        k = index.keys(np.stack([a, b]))
        assert (k[0] == k[1]).any()


def test_exact_set_blocks_equal_brute_force():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sets = [np.sort(rng.choice(26, 21, replace=False)).astype(np.uint64) + np.uint64(100 * (k % 4)) for k in range(40)]
    n = len(sets)
    t = pa.table({"rep": np.tile(np.arange(n), 2), "other": np.repeat([0, 1], n), "comp": np.tile(np.arange(n), 2), "items": [s.tobytes() for s in sets] * 2})
    found = [tuple(r.values()) for b in near._exact(80, 100)(t) for r in b.to_pylist()]

    def classes(links):
        root = list(range(n))
        for a, b in list(links) * n:
            root[a] = root[b] = min(root[a], root[b])
        return root

    true = [(i, j) for i in range(n) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert true and classes(found) == classes(true)


def test_exact_duplicates(docs, texts, empty):
    by = {}
    for i, t in texts:
        by.setdefault(t or "", []).append(i)
    for history in (None, F.lit(False), F.lit(True), F.col("doc_id") % 2 == 0):
        got = exact.exact_duplicates(docs, is_history=history).collect()
        assert len(got) == len(texts)
        for r in got:
            ids = [i for i in by[r.text or ""] if i is not None]
            assert (r.keep_id, r.group_size) == (max(ids), len(by[r.text or ""])) and r.kept == (r.doc_id == max(ids))
            assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and r.digest == "d"
    assert exact.exact_duplicates(empty).count() == 0


def test_minimal_perfect_hash():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), "<u8").reshape(-1, 4)
    sizes, bits = exact.build_mph(keys)
    assert sorted(exact.lookup_mph(sizes, bits, keys)) == list(range(5000))


def test_substrings(spark, docs, texts, empty):
    c = substring.Chunking()
    rows = sorted({(i, t) for i, t in texts if i is not None and t})
    first = {}
    for i, t in rows:
        b = t.encode()
        ends = substring.cuts(np.frombuffer(b, np.uint8), c)
        for a, e in zip([0, *ends[:-1]], ends):
            first.setdefault(b[a:e], i)
    got = {r.doc_id: r for r in substring.deduplicate_substrings(docs).collect()}
    for i, t in rows:
        b = t.encode()
        ends = substring.cuts(np.frombuffer(b, np.uint8), c)
        seen, again = set(), []
        for a, e in zip([0, *ends[:-1]], ends):
            again.append(first[b[a:e]] != i or b[a:e] in seen)
            seen.add(b[a:e])
        out, at = b"", 0
        for a, e in substring.removed_runs(ends, np.array(again), c.run):
            out, at = out + b[at:a], e
        assert got[i].text == (out + b[at:]).decode(), i
    assert got[10].n_removed == 0 and got[11].removed_chars >= 100 and got[20].n_removed == 0
    assert got[31].text is None and got[30].text == "" and got[None].text == texts[0][1]
    assert substring.deduplicate_substrings(empty).count() == 0


def test_chunks_resist_insertions_and_slices(monkeypatch):
    data = np.frombuffer(words(random.Random(1), 3000).encode(), np.uint8)
    c = substring.Chunking()
    whole = substring.chunks(data, c)
    moved = substring.chunks(np.concatenate([np.frombuffer(b"xyz", np.uint8), data]), c)[1]
    assert np.isin(whole[1], moved).mean() > 0.99
    monkeypatch.setattr(substring, "SLICE_BYTES", 500)
    sliced = substring.chunks(data, c)
    assert (sliced[0] == whole[0]).all() and (sliced[1] == whole[1]).all()


def test_repeated_lines_are_cut_and_removed(spark):
    rng, c = random.Random(9), substring.Chunking()
    for period in (1, 2, 6, 12, 15, 16, 20, 30, 45, 60, 100):
        for _ in range(20):
            line = ("".join(rng.choice("abcdefgh ") for _ in range(period)) + "\n")[-period:]
            before, n = len(words(rng, 40)), max(60, 800 // period)
            text = (words(rng, 40) + line * n + words(rng, 40)).encode()
            ends = substring.cuts(np.frombuffer(text, np.uint8), c)
            inside = ends[(ends > before) & (ends < before + period * n)]
            assert np.diff(inside).max() <= 2 * c.reach + 2 * period + c.gap, (period, inside)
    rows = []
    for period in (6, 12, 20, 30, 45, 60):
        line = "".join(rng.choice("abcdefgh ") for _ in range(period))
        rows += [(2 * period + k, words(rng, 60) + line * 60 + words(rng, 60)) for k in (0, 1)]
    got = {r.doc_id: r for r in substring.deduplicate_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        if i % 2:
            assert got[i].removed_chars >= 0.6 * 60 * (i // 2), i


def test_language(spark, docs, empty):
    rng = random.Random(2)
    alphabets = {k: [("".join(rng.choice(letters) for _ in range(7))) for _ in range(40)] for k, letters in (("aa", "abcdefgh"), ("bb", "opqrstuv"))}
    make = lambda vocabulary, n: " ".join(rng.choice(vocabulary) for _ in range(n))
    learn = spark.createDataFrame([(i, make(a, 80), k) for i, (k, a) in enumerate(list(alphabets.items()) * 20)] + [(99, "null language", None)], "doc_id long, text string, lang string")
    d = langid.learn_dictionaries(learn)
    assert sorted(d) == ["aa", "bb"]
    rows = [(1, make(alphabets["aa"], 30), "x"), (2, make(alphabets["bb"], 3000), "x"), (3, None, "x"), (4, "12 + 3!", "x"), (5, "", None)]
    got = {r.doc_id: r for r in langid.identify_language(spark.createDataFrame(rows, "doc_id long, text string, score string"), d).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["aa", "bb", "und", "und", "und"]
    assert got[1].accepted and not got[3].accepted and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify_language(empty, d).count() == 0 and langid.learn_dictionaries(learn.where("false")) == {}


def test_quality(spark, empty):
    rng = random.Random(3)
    rows = [(i, words(rng, 60) if i % 2 else words(rng, 60).replace(" ", "!! ").upper(), i % 2) for i in range(120)]
    data = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = data.select("doc_id", "quality").where("doc_id < 80").unionByName(spark.createDataFrame([(None, 1), (3, None), (500, 0)], "doc_id long, quality int"))
    net = quality.train(data.select("doc_id", "text"), labels)
    more = data.unionByName(spark.createDataFrame([(900, None, 1), (901, "", 1), (902, words(rng, 9000), 1)], "doc_id long, text string, quality int"))
    got = quality.score_quality(more, net).collect()
    held = [r for r in got if 80 <= r.doc_id < 120]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901] and by[902] > 0.5 and all(0 <= s <= 1 for s in by.values())
    assert quality.score_quality(empty, net).count() == 0
    assert quality.train(data.where("false"), labels).scores(np.zeros(0, np.uint8), np.array([0, 0]))[0] == 0.5


def test_chat(spark):
    rows = [(1, 0, "user", "a\\<|end|>"), (1, 1, "assistant", "</s>[INST] ok"), (2, 0, "assistant", "x"), (3, 0, None, None), (3, 0, None, None), (None, 0, "user", "<|turn|>\\"), (4, 1, "assistant", "two"), (4, 0, "user", "one"), (4, 2, "user", "")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in made.select("*", chat.parse_formatted(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    read = lambda i: [(t.role, t.text) for t in got[i].turns]
    assert read(1) == [("user", "a\\<|end|>"), ("assistant", "</s>[INST] ok")] and got[1].loss == "</s>[INST] ok" and got[1].valid
    assert read(3) == [("", "")] * 2 and read(None) == [("user", "<|turn|>\\")]
    assert (got[2].valid, got[2].first_bad_turn) == (False, 0) and (got[4].valid, got[4].first_bad_turn) == (False, 2)
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert made.where("false").count() == 0


def test_licences(spark, empty):
    t = dict(licences.TEMPLATES)["MIT"]
    rows = [(1, "x\nRELEASED under   the MIT license!"), (2, None), (3, ""), (None, "Released under the MIT License."), (4, f"{t}\n{t}"), (5, "word")]
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        line = set(licences.python_bigrams(dict(rows)[r.doc_id].split("\n")[r.line_no]))
        template = set(licences.python_bigrams(licences.TEMPLATES[r.template_no][1]))
        assert r.dice == pytest.approx(2 * len(line & template) / (len(line) + len(template))) and r.dice >= 0.8
    assert sorted((str(r.doc_id), r.line_no) for r in got) == [("1", 1), ("4", 0), ("4", 1), ("None", 0)]
    assert licences.scan_licences(empty).count() == 0


def spans_by_brute_force(text, scan):
    """All matching spans of all templates, the best of those that overlap."""
    w, p, out = licences.python_words(text or ""), scan.percent, []
    b = [f"{x} {y}" for x, y in zip(w, w[1:])]
    for k, (_, template) in enumerate(scan.templates):
        g, longest, good = set(licences.python_bigrams(template)), (len(licences.python_words(template)) - 1) * (200 - p) // p, []
        for a in range(len(b)):
            for z in range(a, min(len(b), a + longest)):
                if b[a] in g and b[z] in g and 200 * (c := len(g & (n := set(b[a : z + 1])))) >= p * (len(n) + len(g)):
                    good.append((-2 * c / (len(n) + len(g)), a, z))
        kept = []
        for d, a, z in sorted(good):
            if all(z < x or y < a for _, x, y in kept):
                kept.append((d, a, z))
        out += [(k, a, z - a + 2, round(-d, 9)) for d, a, z in kept]
    return sorted(out)


def test_licences_in_whole_texts(spark, empty):
    import textwrap

    scan, rng = licences.TextScan(), random.Random(8)
    whole, notice = dict(licences.WHOLE), dict(licences.TEMPLATES)
    wrap = lambda s: textwrap.fill(s, 60)
    cases = {1: ("MIT", f"Copyright (c) 2020 X\n\n{wrap(whole['MIT'])}"), 2: ("GPL-3.0", wrap(notice["GPL-3.0"])), 3: ("BSD-3-Clause", f"# {wrap(whole['BSD-3-Clause'])}")}
    cases |= {4: ("MIT", "It is small. Released under the MIT License. See the manual for more."), 5: ("MIT", "Released under the MIT License. Copyright 2020 The Project Authors"), 6: ("ISC", wrap(whole["ISC"])), 7: ("GPL-2.0", wrap(dict(licences.OPENINGS)["GPL-2.0"]))}
    rows = [(i, t) for i, (_, t) in cases.items()] + [(20, None), (21, ""), (22, "word"), (None, cases[4][1]), (4, cases[4][1])]
    pool = " ".join(t for _, t in scan.templates[:6]).split()
    rows += [(30 + i, " ".join(rng.choice(pool) if rng.random() < 0.15 else x for x in (notice["MIT"] + " and " + notice["CC-BY-4.0"] + " Released under the the MIT License").split() * 2)) for i in range(12)]
    got = licences.scan_texts(spark.createDataFrame(rows, "doc_id long, text string"), scan).collect()
    key = lambda i: -1 if i is None else i
    true = sorted((key(i), *m) for i, t in rows for m in spans_by_brute_force(t, scan))
    assert sorted((key(r.doc_id), r.template_no, r.word_no, r.n_words, round(r.dice, 9)) for r in got) == true
    for i, (licence, _) in cases.items():
        assert licence in {r.licence for r in got if r.doc_id == i}, i
    assert not {20, 21, 22} & {r.doc_id for r in got} and licences.scan_texts(empty).count() == 0


def padding(bounds, lengths):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


def test_packing(docs, texts, empty):
    from itertools import combinations

    rng = random.Random(5)
    for _ in range(20):
        lengths = [rng.randint(1, 12) for _ in range(30)]
        classes = sorted(set(lengths))
        bounds = packing.optimal_buckets(np.array(classes, float), np.array([lengths.count(n) for n in classes]), 3)
        best = min(padding([*c, classes[-1]], lengths) for c in combinations(classes[:-1], min(2, len(classes) - 1)))
        assert padding(bounds, lengths) == best and len(bounds) <= 3
    got = packing.pack(docs, packing.word_count(F.col("text")), budget=256).collect()
    assert len(got) == len(texts) and len({(r.batch_id, r.slot) for r in got}) == len(texts)
    for r in got:
        assert r.n_tokens == len((r.text or "").split()) <= r.bucket_len and r.slot < r.batch_docs == max(1, 256 // max(1, r.bucket_len))
    assert packing.pack(empty, packing.word_count(F.col("text"))).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 8))
    rows = [(i, [float(x) for x in base[i % 40] + rng.standard_normal(8) * 0.02], i % 3) for i in range(300)]
    rows += [(400, rows[0][1], 0), (401, rows[0][1], None), (402, None, 0), (403, [0.0] * 8, 0), (404, [float("nan")] * 8, 0), (405, [None, 1.0], 0), (406, [1.0, 0.0], 0), (407, [2.0, 0.0], 0), (None, rows[0][1], 0)]
    got = {r.vec_id: r for r in forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), params=forest.ForestParams(leaf=32, sample=256)).collect()}
    ok = [(i, np.array(v) / np.linalg.norm(v), y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: [j for j, w, z in ok if i != j and y == z and len(v) == len(w) and v @ w >= 0.98] for i, v, y in ok}
    found, true = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert len(got) == len(rows) and true and found >= 0.95 * true and all(got[i].n_links <= len(x) for i, x in links.items())
    assert got[406].component_id == 406 == got[407].component_id and got[401].n_links == got[402].n_links == got[403].n_links == got[404].n_links == 0
    assert got[None].component_id is None and got[None].kept


def test_bpe_round_trip(spark, empty):
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    spec = bpe.tokenizer_json(ranks, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "Hällo  wörld\n\n it's 🙂🙂 x "), (2, None), (3, ""), (4, " a  b c　d\n e"), (5, words(random.Random(1), 5000)), (5, "again"), (6, "y" * 3000)]
    made = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), spec, offsets=True), spec).collect()
    for r in made:
        assert r.ids == other.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and len(r.starts) == len(r.ids)
    for r in bpe.digest(spark.createDataFrame(rows, "doc_id long, text string"), spec).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(other.encode_ordinary(r.text or ""), "<u4").tobytes()).hexdigest()
    assert bpe.encode(empty, spec).count() == 0
