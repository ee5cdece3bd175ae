"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact, forest, langid, licences, near, packing, quality, substring
from .common import crc_fold, tune, write_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tune(spark)
    lengths = write_table(docs.select("doc_id", packing.word_count(F.col("text")).alias("words")), "lengths")
    return packing.pack(lengths, F.col("words")).drop("words")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, part=80, whole=100)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    network = quality.train(docs.select("doc_id", "text"), labels.where(~held_out))
    return quality.score_quality(docs.select("doc_id", held_out.alias("held_out"), "text"), network).drop("text")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    dictionaries = langid.learn_dictionaries(docs.where(~held_out))
    found = langid.identify_language(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_texts(table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    spec = bpe.tokenizer_json(bpe.read_ranks(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    return bpe.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), spec).drop("text")


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_chat_format, op3_packing, op4_minhash_near_dedup, op5_quality, op6_exact_dedup, op7_language_id,
        op8_licence_scan, op9_embedding_near_dedup, op10_bpe,
    )
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped_sql(column: str, template: chat.Template) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in sorted(template.control, key=lambda c: (-len(c), c)):
        out = f"replace({out}, {_quoted(c)}, {_quoted(c[0] + chr(92) + c[1:])})"
    return out


def _chat_sql(template: chat.Template) -> str:
    marks = len(template.turn_open + template.text_open + template.turn_close)
    loss = "role IN (" + ", ".join(map(_quoted, template.loss_roles)) + ")"
    state = _quoted(template.start)
    # the state machine, as a recursive walk over the turns
    steps = ", ".join(f"({_quoted(a)}, {_quoted(r)}, {_quoted(b)})" for a, row in template.transitions.items() for r, b in row.items())
    final = ", ".join(map(_quoted, template.final))
    return f"""
        WITH RECURSIVE c AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k, role, text FROM (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
        steps(a, role, b) AS (VALUES {steps}),
        walk AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS k, {state} AS state FROM (SELECT DISTINCT conv_id FROM c)
            UNION ALL
            SELECT w.conv_id, w.k + 1, s.b FROM walk w JOIN c ON c.conv_id = w.conv_id AND c.k = w.k JOIN steps s ON s.a = w.state AND s.role = c.role),
        ends AS (SELECT conv_id, max(k) AS read, max_by(state, k) AS state FROM walk GROUP BY conv_id),
        f AS (
            SELECT conv_id, count(*) AS n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
                CAST(coalesce(sum(length(text)) FILTER (WHERE {loss}), 0) AS BIGINT) AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE {loss}), '')) AS loss_sha256,
                CAST(sum(length({_escaped_sql("role", template)}) + length({_escaped_sql("text", template)}) + {marks}) AS BIGINT) AS formatted_chars
            FROM c GROUP BY conv_id)
        SELECT f.*, read = n_turns AND state IN ({final}) AS valid,
            CAST(CASE WHEN read < n_turns THEN read WHEN state IN ({final}) THEN -1 ELSE n_turns - 1 END AS INTEGER) AS first_bad_turn
        FROM f JOIN ends USING (conv_id)
    """


def _licence_sql(scan: licences.TextScan) -> str:
    p = scan.percent
    templates = ", ".join(
        f"({k}, {_quoted(name)}, [{', '.join(map(_quoted, g))}], {len(g)}, {-(-p * len(g) // (200 - p))}, {(len(licences.python_words(text)) - 1) * (200 - p) // p})"
        for k, (name, text) in enumerate(scan.templates)
        for g in [licences.python_bigrams(text)]
    )
    return f"""
        WITH t(k, licence, g, n_g, least, longest) AS (VALUES {templates}),
        docs AS (
            SELECT row_number() OVER () AS row_no, doc_id, string_split(trim(regexp_replace(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
            FROM documents),
        grams AS (SELECT row_no, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM docs WHERE len(w) > 1),
        pos AS (SELECT row_no, unnest(b) AS x, generate_subscripts(b, 1) - 1 AS i FROM grams),
        known AS (SELECT k, unnest(g) AS x FROM t),
        hits AS (SELECT row_no, k, i, x FROM pos JOIN known USING (x)),
        enough AS (SELECT row_no, k FROM hits JOIN t USING (k) GROUP BY row_no, k HAVING count(DISTINCT x) >= min(least)),
        own AS (SELECT row_no, k, i FROM hits JOIN enough USING (row_no, k)),
        spans AS (
            SELECT a.row_no, a.k, a.i AS a, z.i AS z, list_distinct(list_slice(b, a.i + 1, z.i + 1)) AS s, g, n_g, doc_id
            FROM own a JOIN t USING (k) JOIN own z ON z.row_no = a.row_no AND z.k = a.k AND z.i >= a.i + least - 1 AND z.i < a.i + longest
            JOIN grams ON grams.row_no = a.row_no),
        good AS (SELECT row_no, doc_id, k, a, z, n_g, len(s) AS n, len(list_intersect(s, g)) AS c FROM spans WHERE 200 * len(list_intersect(s, g)) >= {p} * (len(s) + n_g)),
        best AS (
            SELECT row_no, k, any_value(doc_id) AS doc_id, any_value(n_g) AS n_g, list_reduce(
                list([{{'a': a, 'z': z, 'n': n, 'c': c}}] ORDER BY -2 * CAST(c AS DOUBLE) / (n + n_g), a, z),
                lambda kept, s: CASE WHEN len(list_filter(kept, lambda o: o.a <= s[1].z AND s[1].a <= o.z)) > 0 THEN kept ELSE list_concat(kept, s) END) AS kept
            FROM good GROUP BY row_no, k),
        out AS (SELECT doc_id, k, n_g, unnest(kept) AS m FROM best)
        SELECT doc_id, CAST(m.a AS INTEGER) AS word_no, CAST(m.z - m.a + 2 AS INTEGER) AS n_words, licence, CAST(k AS INTEGER) AS template_no, CAST(m.c AS INTEGER) AS common,
            CAST(m.n AS INTEGER) AS span_bigrams, CAST(out.n_g AS INTEGER) AS template_bigrams, 2 * CAST(m.c AS DOUBLE) / (m.n + out.n_g) AS dice
        FROM out JOIN t USING (k)
    """


ORACLE_SQL = {
    "op2_chat_format": _chat_sql(chat.Template()),
    "op8_licence_scan": _licence_sql(licences.TextScan()),
    "op9_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
        m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
    """,
    "op4_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE len(ws) WHEN 0 THEN [] WHEN 1 THEN [ws[1]]
                ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh
            FROM w),
        e AS (SELECT doc_id, unnest(sh) AS x FROM s),
        n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b),
        m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m ON m.a = n.doc_id
    """,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
