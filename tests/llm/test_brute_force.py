"""Operators against plain loops over bytes, words and pairs, written without the operators' own helpers; clashing columns."""

import hashlib
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from rankloom.llm import bpe, chat, components, exact, forest, langid, licences, near, packing, quality, substring


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def united(nodes, links):
    root = {i: i for i in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in nodes}


@pytest.mark.parametrize("kind", ["random", "path", "star", "late hub", "empty"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(None, 1), (2, None), (3, 3)],
        "path": [(i + 1, i) for i in range(200)], "star": [(0, i) for i in range(1, 300)], "late hub": [(1000, i) for i in range(300)], "empty": [],
    }[kind]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    links = [(a, b) for a, b in edges if None not in (a, b) and a != b]
    true = united({x for e in links for x in e}, links)
    assert got == {i: c for i, c in true.items() if i != c}


def test_near_duplicates_of_many_variants(spark):
    rng, rows = random.Random(11), []
    for base in range(6):
        text = words(rng, rng.choice([12, 40, 90])).split()
        for _ in range(60):
            own = list(text)
            for _ in range(rng.randint(0, 1 + len(own) // 8)):
                own[rng.randrange(len(own))] = words(rng, 1)
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    sets = {i: {tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)} for i, t in rows}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    true = united(sets, links)
    assert 30 < len(set(true.values())) < 330  # both linked and not
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert got == true


def plain_cuts(data, c):
    """One pass over the bytes, by the definition in Chunking."""
    table = [int(x) for x in substring._GEAR]
    value, h = [], 0
    for b in data:
        h = ((h << 1) + table[b]) & 0xFFFF
        value.append(h)
    at = {p: (value[p - 1] if data[p] & 0xC0 != 0x80 else 0xFFFF) for p in range(substring.WINDOW, len(data))}
    candidates = []
    for p, v in at.items():
        around = [at[q] for q in range(p - c.reach, p + c.reach + 1) if q in at]
        if v < c.below or v < 0xFFFF and len(around) == 2 * c.reach + 1 and min(around) == v:
            candidates.append(p)
    kept = []
    for p in candidates:
        if not kept or p - kept[-1] >= c.gap:
            kept.append(p)
    return [*kept, len(data)] if data else []


def test_cuts_equal_a_plain_loop():
    rng, c = random.Random(12), substring.Chunking()
    texts = [words(rng, n) for n in (0, 1, 5, 40, 200)] + ["äöü 中文字🙂 " * 30, "a" * 500, "line one\n" * 50, "".join(chr(rng.randrange(32, 1000)) for _ in range(600))]
    for t in texts:
        raw = t.encode()
        assert substring.cuts(np.frombuffer(raw, np.uint8), c).tolist() == plain_cuts(raw, c), t[:40]


def test_substrings_equal_a_plain_loop(spark):
    rng, c = random.Random(13), substring.Chunking()
    passage = words(rng, 60)
    rows = [(i, f"{words(rng, 20)} {passage} {words(rng, 20)}") for i in range(4)] + [(i, words(rng, 50)) for i in range(4, 8)] + [(8, (passage + " ") * 3), (9, None), (10, ""), (None, passage), (11, "ü" * 90 + passage)]
    pieces = {}
    for i, t in rows:
        raw, a = (t or "").encode(), 0
        pieces[i] = []
        for z in plain_cuts(raw, c):
            pieces[i].append(raw[a:z])
            a = z
    first = {}
    for i in sorted(i for i in pieces if i is not None):
        for p in pieces[i]:
            first.setdefault(p, i)
    got = {r.doc_id: r for r in substring.deduplicate_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        if i is None or not t:
            assert got[i].text == t
            continue
        out, run, seen = b"", b"", set()
        for p in [*pieces[i], None]:
            if p is not None and (first[p] != i or p in seen):
                run += p
                continue
            out += run if len(run) < c.run else b""
            run = b""
            out += p or b""
            seen.add(p)
        assert got[i].text == out.decode(), i
        assert sum(s.stop - s.start for s in got[i].removed_spans) == got[i].removed_chars == len(t) - len(got[i].text)
    assert got[1].removed_chars > 100


def test_buckets_of_long_texts():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        m, k = int(rng.integers(1, 50)), int(rng.integers(1, 8))
        lengths, counts = np.sort(rng.choice(20_000, m, replace=False)), rng.integers(1, 50, m)
        docs = np.concatenate([[0], np.cumsum(counts)])
        best, least = [0] + [10**18] * m, 10**18
        for _ in range(k):  # best[j]: the first j lengths in as many buckets as rounds
            best = [10**18] + [min(best[i] + int(lengths[j - 1]) * int(docs[j] - docs[i]) for i in range(j)) for j in range(1, m + 1)]
            least = min(least, best[m])
        bounds = packing.optimal_buckets(lengths, counts, k)
        assert len(bounds) <= k and sum(int(n) * bounds[np.searchsorted(bounds, x)] for x, n in zip(lengths, counts)) == least


def test_packing_of_long_texts(spark):
    rng = random.Random(14)
    rows = [(i, words(rng, rng.choice([0, 3, 300, 301, 700, 2500]))) for i in range(60)] + [(60, None), (None, "a b"), (5, "again")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), packing.word_count(F.col("text")), buckets=3, budget=2000).collect()
    lengths = [len((t or "").split()) for _, t in rows]
    kinds = sorted(set(lengths))
    from itertools import combinations

    best = min(sum(min(b for b in (*some, kinds[-1]) if b >= n) for n in lengths) for some in combinations(kinds[:-1], 2))
    assert sum(r.bucket_len for r in got) == best and len(got) == len(rows)
    full = {}
    for r in got:
        full.setdefault(r.batch_id, []).append(r)
    assert all(len(b) * b[0].bucket_len <= max(2000, b[0].bucket_len) and len({x.bucket for x in b}) == 1 and sorted(x.slot for x in b) == list(range(len(b))) for b in full.values())


def test_scores_equal_a_plain_convolution():
    rng = np.random.default_rng(15)
    params = quality.Training()
    net = quality.Network(params)
    net.b, net.v, net.c = rng.normal(0, 1, net.b.shape).astype(np.float32), rng.normal(0, 1, net.v.shape).astype(np.float32), np.array([0.3], np.float32)
    texts = [rng.integers(1, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 255, 256, 257, 511, 512, 513, 2000)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.scores(np.frombuffer(b"".join(texts), np.uint8), offsets)
    d, f = params.embedding, params.filters
    for text, p in zip(texts, got):
        blocks = max(2, -(-len(text) // 256))
        padded = np.frombuffer(text.ljust(blocks * 256, b"\0"), np.uint8)
        logits = []
        for k in range(blocks - 1):
            chunk = padded[k * 256 : k * 256 + 512]
            top = np.full(f, -np.inf)
            for w in range(0, 508, 4):  # windows of two cells of four bytes
                x0, x1 = net.emb[chunk[w : w + 4]].reshape(-1), net.emb[chunk[w + 4 : w + 8]].reshape(-1)
                top = np.maximum(top, x0 @ net.w[:, :f] + x1 @ net.w[:, f:])
            logits.append(np.maximum(top + net.b, 0) @ net.v + net.c[0])
        assert p == pytest.approx(1 / (1 + np.exp(-np.mean(logits))), abs=1e-5)
        pooled = net.pooled(quality.chunks_of(text))[0]  # what training sees
        assert np.mean(np.maximum(pooled + net.b, 0) @ net.v + net.c[0]) == pytest.approx(np.mean(logits), abs=1e-4)


def test_quality_learns_from_whole_texts_and_repeats(spark):
    rng = random.Random(16)
    rows = [(i, words(rng, 900) + (" zzz qqq" if i % 2 else " kkk vvv") * 60) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] * 2, "doc_id long, quality int")
    net = quality.train(spark.createDataFrame(rows * 2, "doc_id long, text string"), labels, params=quality.Training(epochs=30))
    got = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()
    good, bad = ([r.score for r in got if r.doc_id % 2 == k] for k in (1, 0))
    assert np.mean([x > y for x in good for y in bad]) > 0.95  # told apart by the ends of the texts alone
    small = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, params=quality.Training(bytes=10, epochs=1))
    assert small.scores(np.zeros(5, np.uint8), np.array([0, 5]))[0] == 0.5  # no text fits the sample


def test_language_equals_plain_compression(spark):
    rng = random.Random(17)
    pools = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(150)] for k, letters in (("xa", "abcdefghij"), ("xb", "efghijklmn"), ("xc", "äöüßéèabcd"))}
    make = lambda k, n: " ".join(rng.choice(pools[k]) for _ in range(n))
    learn = [(i, make(k, rng.choice([5, 200, 3000])), k) for i, k in enumerate(list(pools) * 25)] + [(500, "?!", "rare"), (501, None, "xa"), (502, "x", None)]
    d = langid.learn_dictionaries(spark.createDataFrame(learn * 2, "doc_id long, text string, lang string"))
    assert sorted(d) == ["rare", "xa", "xb", "xc"] and max(map(len, d.values())) <= langid.DICT_BYTES
    rows = [(i, make(rng.choice(list(pools)), n)) for i, n in enumerate([1, 2, 5, 30, 200, 3000] * 6)] + [(90, None), (91, ""), (92, "123 !?"), (3, "again"), (3, "again")]
    for r in langid.identify_language(spark.createDataFrame(rows, "doc_id long, text string"), d).collect():
        if r.doc_id in (90, 91, 92):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        text = "".join(c.lower() if c.isascii() and c.isalpha() else (" " if c.isascii() else c) for c in r.text)
        raw = b" ".join(text.encode().split(b" ")) if "  " not in text else " ".join(text.split(" ")).encode()
        sizes = {}
        for k in d:
            own = zstandard.ZstdCompressionDict(d[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=langid.LEVEL)
            press = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[k] = sum(len(press.compress(raw[a : a + langid.BLOCK_BYTES])) for a in range(0, len(raw), langid.BLOCK_BYTES))
        best, second = sorted(sizes, key=lambda k: (sizes[k], k))[:2]
        assert r.lang_pred == best and r.score == pytest.approx((sizes[second] - sizes[best]) / sizes[second])
        assert r.accepted == (r.score >= 0.002)


def test_dictionaries_take_even_shares_of_whole_texts():
    assert langid.shares([5, 100, 100], 65) == [5, 30, 30] and langid.shares([], 9) == [] and langid.shares([3, 2], 99) == [3, 2]
    long = bytes(range(97, 123)) * 4000
    some = langid.spread(long, 4096)
    assert len(some) <= 4096 + 16 and langid.spread(b"short", 4096) == b"short"
    marked = b"a" * 50_000 + b"b" * 50_000
    assert 0.4 < langid.spread(marked, 4096).count(b"b") / 4096 < 0.6


def test_templates_that_read_back_in_one_way_only(spark):
    for close in ("aba", "aa", "<|turn|>"):
        with pytest.raises(ValueError):
            chat.Template(turn_close=close, control=("<|turn|>", "<|text|>", close))
    own = chat.Template(turn_open="[<", text_open=":>", turn_close="%]", control=("[<", ":>", "%]"), loss_roles=("bot",), start="a", final=("a",), transitions={"a": {"user": "b"}, "b": {"bot": "a"}})
    rng = random.Random(18)
    junk = lambda n: "".join(rng.choice("[]<>:%\\ab\n") for _ in range(n))
    rows = [(i, t, "bot" if t % 2 else "user", junk(rng.randint(0, 30)), "x", "y") for i in range(30) for t in range(4)] + [(99, 0, junk(9), junk(200_000), "x", "y")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string, valid string"), own)
    got = {r.conv_id: r for r in made.select("*", chat.parse_formatted(F.col("formatted"), own).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for i in [*range(30), 99]:
        true = [(r[2], r[3]) for r in rows if r[0] == i]
        assert [(t.role, t.text) for t in got[i].turns] == true and got[i].loss == "".join(t for role, t in true if role == "bot")
        assert got[i].valid == (i != 99)


def test_offsets_are_the_library_s(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    spec = bpe.tokenizer_json(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    codec, rng = bpe.Codec.of(spec), random.Random(19)
    texts = ["".join(rng.choice(["a", " ", "\n", "é", "🙂", "中", "'s", "12", "_", "　", "́"]) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for text, e, ids in zip(texts, codec.tokenizer.encode_batch(texts, add_special_tokens=False), codec.encode(texts)):
        assert ids.tolist() == e.ids and [tuple(x) for x in codec.offsets(ids, text).tolist()] == [tuple(x) for x in e.offsets]
    got = bpe.digest(spark.createDataFrame([(t,) for t in texts[:50]], "text string"), spec).collect()
    for r, ids in zip(got, codec.encode([r.text for r in got])):
        assert r.offsets_sha256 == hashlib.sha256(codec.offsets(ids, r.text).astype("<u4").tobytes()).hexdigest()


def test_vectors_in_small_blocks_and_leaves(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 16)
    rng = np.random.default_rng(20)
    base = rng.standard_normal((30, 16))
    rows = [(i, [float(x) for x in base[i % 30] + rng.standard_normal(16) * 0.03], "u" if i % 4 else "v") for i in range(600)]
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v, _ in rows}
    label = {i: y for i, _, y in rows}
    links = [(i, j) for i in unit for j in unit if i < j and label[i] == label[j] and unit[i] @ unit[j] >= 0.98]
    count = {i: 0 for i in unit}
    for i, j in links:
        count[i] += 1
        count[j] += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    one = {r.vec_id: r for r in forest.near_vectors(df, params=forest.ForestParams(leaf=1000)).collect()}
    assert {i: r.n_links for i, r in one.items()} == count and {i: r.component_id for i, r in one.items()} == united(unit, links)
    more = {r.vec_id: r for r in forest.near_vectors(df, params=forest.ForestParams(leaf=40, spill=0.02)).collect()}
    found = sum(r.n_links for r in more.values())
    assert all(r.n_links <= count[i] for i, r in more.items()) and found >= 0.95 * sum(count.values())
    none = forest.near_vectors(df.where("false")).collect()
    assert none == []


EXTRA = [
    "n", "winner", "digest", "id", "list", "made", "found", "label", "group", "h", "per", "state", "old", "key", "rep", "cls", "sig", "comp", "a", "b", "raw", "v", "w", "words", "hits", "ts", "conv", "place", "piece", "h_", "_id", "__id", "__made",
    "keep_id", "group_size", "kept", "text_sha256", "n_chunks", "removed_spans", "lang_pred", "score", "accepted", "predicted", "n_tokens", "bucket", "bucket_len", "batch_id", "slot", "batch_docs", "ids", "starts", "ends", "n_shingles", "component_id",
    "ids_sha256", "decoded_sha256", "line", "m", "k", "s", "n_links", "Text2", "with dot.s", "segments", "valid",
]


def operators():
    def tokens():
        import public_tokenizers

        return bpe.tokenizer_json(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)

    net = quality.Network(quality.Training())
    return {
        "substring": substring.deduplicate_substrings, "exact": exact.exact_duplicates, "near": lambda d: near.near_duplicates(d, shingle=2), "language": lambda d: langid.identify_language(d, {"p": b"abcdabcdabcd", "q": b"efghefghefgh"}),
        "quality": lambda d: quality.score_quality(d, net), "packing": lambda d: packing.pack(d, packing.word_count(F.col("text"))), "licences": licences.scan_texts, "lines": licences.scan_licences,
        "bpe": lambda d: bpe.digest(d, tokens()), "encode": lambda d: bpe.encode(d, tokens(), offsets=True), "vectors": forest.near_vectors, "chat": chat.format_conversations,
        "learn": lambda d: d.sparkSession.createDataFrame(sorted(langid.learn_dictionaries(d).items()), "lang string, d binary"),
    }


@pytest.mark.parametrize("name", list(operators()))
def test_clashing_and_null_columns(spark, name):
    rng = random.Random(21)
    base = words(rng, 80)
    rows = [(i, t, "pq"[i % 2] if i else None, [1.0, float(i)], i, i % 3, "user") for i, t in enumerate([base, base, base + " more", None, "", words(rng, 20), "Released under the MIT License."])]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, embedding array<float>, vec_id long, turn long, role string").withColumns({"conv_id": F.col("doc_id") % 2})
    if name == "vectors":
        plain = plain.withColumn("label", F.lit("y"))
    extra = [c for c in EXTRA if c not in plain.columns]
    wide = plain.select("*", *[F.lit(f"x {c}").alias(c) for c in extra])
    run = operators()[name]
    a, b = run(plain), run(wide)
    key = lambda df: sorted(str([r[c] for c in a.columns]) for r in df.collect())
    assert key(a) == key(b)
    passed = [c for c in extra if c in b.columns and c not in a.columns]
    first = b.first()
    assert all(first[c] == f"x {c}" for c in passed)
    assert not passed or set(passed) == set(extra) - set(a.columns)
    nulls = plain.select(*[F.lit(None).cast(t).alias(c) for c, t in plain.dtypes])
    assert run(nulls).count() >= 0 and run(plain.where("false")).count() == 0


def test_known_matches_equal_the_library(monkeypatch):
    """op10: each match goes to the library once; all characters that are split here, others, and a full memory."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    spec = bpe.tokenizer_json(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    codec, rng = bpe.Codec(spec), random.Random(23)
    chars = [chr(c) for c in (*range(0x250), *range(0x2000, 0x2070), 0x180E, 0x3000, 0x4E2D, 0x1F600)]
    texts = [None, "", *(f"a{c}b {c}c{c}{c} 1{c}  {c} 's{c}\n\n{c}x" for c in chars), *("".join(rng.choices(chars[9:14] + chars[32:127] + chars[160:256], k=200)) for _ in range(300)), *("It's the  same 12 words' " * n for n in range(60))]
    for room in (bpe.KNOWN_CHARS, 3000):
        monkeypatch.setattr(bpe, "KNOWN_CHARS", room)
        codec.room = room
        got = [x.tolist() for x in codec.encode(texts)]
        assert got == [e.ids for e in codec.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    calls, library = [], codec.tokenizer
    codec.tokenizer = type("Counted", (), {"encode_batch_fast": lambda self, part, **k: calls.extend(part) or library.encode_batch_fast(part, **k)})()
    codec.known, codec.room = {}, 1 << 20
    list(codec.encode(["one two one two"] * 50))
    assert sorted(calls) == [" one", " two", "one"]
