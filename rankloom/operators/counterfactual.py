"""Counterfactual copies of a dataset: spans, aliases, consistent renaming, validation."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.session import written

# Hints by which spans are typed, and the vocabulary of aliases.
ORGANISATION_HINTS = ("inc", "corp", "company", "university", "college", "institute", "agency", "team", "band", "committee")
LOCATION_HINTS = ("city", "state", "country", "region", "province", "county", "lake", "river", "mount", "mountain", "street", "avenue")
FIRST_PARTS = ("Mira", "Taren", "Nora", "Levan", "Sorin", "Alto", "Kira", "Varen", "Milo", "Celia")
LAST_PARTS = ("Halden", "Varos", "Norwick", "Talor", "Merin", "Caspel", "Rovik", "Selden", "Maris", "Dorin")
PLACE_PARTS = ("Varos", "Halden", "Merrow", "Calder", "Lunor", "Norwick", "Tavren", "Sorel")
GROUP_PARTS = ("Institute", "Division", "Foundation", "Collective", "Council", "Systems", "Works", "Group")
CODE_PREFIX = {"PERSON": "Person", "ORGANIZATION": "Organization", "LOCATION": "Site", "TITLE": "Work", "DATE": "Date", "NUMBER": "Value", "ENTITY": "Entity"}


def looks_like_value(span: Column) -> Column:
    """F36."""
    return F.regexp_like(F.trim(span), F.lit(r"^(?U)\d+(\.\d+)?$")) | F.regexp_like(span, F.lit(r"(?U)\b\d{4}\b"))


def entity_type(span: Column, context: Column | None = None) -> Column:
    """F37. Values, then organisation and location hints as substrings, quotes, capitalised words, the context, else ENTITY."""
    low = F.lower(span)
    hinted = lambda hints: F.exists(T.strings(*hints), lambda h: F.contains(low, h))
    upper = F.forall(T.words(span), lambda w: F.regexp_like(w, F.lit(r"^\p{Lu}")))
    out = (
        F.when(F.regexp_like(F.trim(span), F.lit(r"^(?U)\d+(\.\d+)?$")), "NUMBER").when(looks_like_value(span), "DATE")
        .when(hinted(ORGANISATION_HINTS), "ORGANIZATION").when(hinted(LOCATION_HINTS), "LOCATION")
        .when(span.startswith('"') & span.endswith('"'), "TITLE").when((F.size(T.words(span)) >= 2) & upper, "PERSON")
    )
    if context is not None:
        out = out.when(F.regexp_like(F.lower(F.coalesce(context, F.lit(""))), F.lit(r"(?U)\b(where|born|located|city|country)\b")), "LOCATION")
    return out.otherwise("ENTITY")


def regex_spans(text: Column, include_values: bool = False, legacy_quotes: bool = False) -> Column:
    """C2. The default span extractor, an array of (span, type): capitalised runs of three letters and more, quoted titles,
    and, if asked for, dates and numbers. legacy_quotes keeps text between two quotations as a title, as pairing quotes
    from the left does; else a title begins and ends with a character that is no space."""
    typed = lambda spans, kind=None: F.transform(spans, lambda s: F.struct(s.alias("span"), (F.lit(kind) if kind else entity_type(s)).alias("type")))
    runs = F.filter(T.extract(text, T.CAPITALISED_5), lambda s: (F.length(s) >= 3) & ~s.isin(*T.ARTICLES))
    titles = T.quoted(text) if legacy_quotes else F.filter(T.quoted(text), lambda s: (F.trim(s) == s))
    parts = [typed(runs), typed(titles, "TITLE")]
    if include_values:
        parts += [typed(T.extract(text, T.DATE), "DATE"), typed(T.extract(text, T.NUMBER), "NUMBER")]
    return F.concat(*parts)


def collect_spans(queries: DataFrame, documents: DataFrame, include_values: bool = False, extractor=regex_spans) -> DataFrame:
    """C1. (span, type): a span's first type wins, in the order of queries, answers and their aliases, then documents.

    queries: (query_id, text, answers, answer_aliases if there); documents: (doc_id, text). extractor(text, include_values)
    -> array column is the point where another recogniser goes in. First-wins is a minimum over (stage, id, place),
    combined before the shuffle.
    """
    def rows(df: DataFrame, stage: int, key: str, spans: Column) -> DataFrame:
        return df.select(F.lit(stage).alias("stage"), F.col(key).cast("string").alias("id"), F.posexplode(spans).alias("at", "s")).select("stage", "id", "at", "s.span", "s.type")

    q = rows(queries, 0, "query_id", extractor(F.col("text"), include_values))
    known = T.all_answers(F.col("answers"), F.col("answer_aliases") if "answer_aliases" in queries.columns else T.strings())
    kept = F.filter(known, lambda a: F.lit(include_values) | ~looks_like_value(a))
    a = rows(queries, 1, "query_id", F.transform(kept, lambda a: F.struct(a.alias("span"), entity_type(a, F.col("text")).alias("type"))))
    text = T.title_and_text(F.col("title"), F.col("text")) if "title" in documents.columns else F.col("text")
    d = rows(documents, 2, "doc_id", extractor(text, include_values))
    return q.unionByName(a).unionByName(d).groupBy("span").agg(F.min_by("type", F.struct("stage", "id", "at")).alias("type"))


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(T.strings(*values), ((index - 1) % len(values) + 1).cast("int"))


def alias_of(kind: Column, index: Column, style: str = "natural") -> Column:
    """F38. By type and the running number within the type (from 1)."""
    n = index.cast("string")
    if style == "coded":
        prefix = F.coalesce(F.create_map(*[F.lit(x) for kv in CODE_PREFIX.items() for x in kv])[kind], F.initcap(kind))
        return F.concat(prefix, F.lit(" "), F.substring(kind, 1, 1), F.lit("-"), F.lpad(n, F.greatest(F.length(n), F.lit(3)), F.lit("0")))
    place = _pick(PLACE_PARTS, index)
    return (
        F.when(kind == "PERSON", F.concat_ws(" ", _pick(FIRST_PARTS, index), _pick(LAST_PARTS, index)))
        .when(kind == "LOCATION", F.concat(F.when(index % 2 == 1, "Lake ").otherwise("Region "), place))
        .when(kind == "ORGANIZATION", F.concat_ws(" ", _pick(LAST_PARTS, index), _pick(GROUP_PARTS, index)))
        .when(kind == "TITLE", F.concat(F.lit("Project "), place, F.lit("-"), n))
        .when(kind == "DATE", F.concat(F.lit("Year "), (index + 2000).cast("string")))
        .when(kind == "NUMBER", (index + 100).cast("string"))
        .otherwise(F.concat(F.lit("Entity "), place, F.lit("-"), n))
    )


def alias_table(spans: DataFrame, style: str = "natural") -> DataFrame:
    """C3, W3. (ord, source, type, alias), longest source first; numbers run within a type.

    Windows by type hold a row for each distinct source of that type. `ord` follows from length and name and is global;
    it is only an order key, so it is a struct and not a number that one task would have to count.
    """
    w = Window.partitionBy("type").orderBy(F.length("span").desc(), F.lower("span"), "span")
    out = spans.withColumn("n", F.row_number().over(w))
    return out.select(F.struct((-F.length("span")).alias("len"), F.lower("span").alias("low"), F.col("span").alias("exact")).alias("ord"), F.col("span").alias("source"), "type", alias_of(F.col("type"), F.col("n"), style).alias("alias"))


@lru_cache(maxsize=100_000)
def _pattern(source: str) -> re.Pattern[str]:
    """C4. Whole words; regardless of case from four characters on."""
    return re.compile(rf"\b{re.escape(source)}\b", re.IGNORECASE if len(source) >= 4 else 0)


def rename_text(text: str | None, pairs: list[tuple[str, str]]) -> str | None:
    """C5. One pair after the other; later ones see what earlier ones wrote."""
    if text:
        for source, alias in pairs:
            text = _pattern(source).sub(lambda _, a=alias: a, text)
    return text


def _word_keys(text: Column) -> Column:
    """Distinct words, lower-cased, of any script: a whole-word match of a source has each of its words as a word."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def _probed(aliases: DataFrame) -> DataFrame:
    """(ord, source, alias, token): each alias under its source's word that the fewest sources have; null without words."""
    al = aliases.select("ord", "source", "alias")
    words = al.select("source", F.explode(_word_keys(F.col("source"))).alias("token"))
    rarest = words.join(words.groupBy("token").agg(F.count("*").alias("n")), "token").groupBy("source").agg(F.min(F.struct("n", "token")).alias("t"))
    return al.join(rarest, "source", "left").select("ord", "source", "alias", F.col("t.token").alias("token"))


def applicable(rows: DataFrame, aliases: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, ord, source, alias): the aliases that can apply to a row, or to what another one of these writes into it.

    Rows and aliases meet by a word of the source, its rarest among the sources, in equi-joins: first by the words of the
    row, then by the words that the aliases found so far would write, until none comes up. Sources without a word, of
    punctuation only, meet every row.
    """
    al = written(_probed(aliases), "aliases")
    word = al.where("token is not null")
    reached = written(rows.select(key, F.explode(_word_keys(text)).alias("token")), "words")
    found = written(reached.join(word, "token").select(key, "ord", "source", "alias").distinct(), "found")
    new = found
    while not new.isEmpty():
        wrote = new.select(key, F.explode(_word_keys(F.col("alias"))).alias("token")).distinct()
        new = written(wrote.join(word, "token").select(key, "ord", "source", "alias").distinct().join(found.select(key, "source"), [key, "source"], "left_anti").select(key, "ord", "source", "alias"), "found")
        found = found.unionByName(new)
    return found.unionByName(rows.select(key).crossJoin(al.where("token is null").select("ord", "source", "alias")))


def rename(df: DataFrame, aliases: DataFrame, key: str, columns: list[str], arrays: list[str] = []) -> DataFrame:
    """C5, C6. Applies an alias table to text columns and arrays of text; originals stay in original_<column>.

    Each row meets only the aliases that can apply (see applicable()), and the exact, sequential substitution runs over that
    short list. key: a column of distinct values. A row's list is as long as its words have sources.
    """
    parts = [F.coalesce(c, F.lit("")) for c in columns] + [F.array_join(F.coalesce(c, T.strings()), "\n") for c in arrays]
    found = applicable(df, aliases, key, F.concat_ws("\n", *parts))
    pairs = found.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("ord", "source", "alias"))).alias("__pairs"))
    listed = df.join(pairs, key, "left")

    @F.arrow_udf("array<string>")
    def apply(values: pa.Array, pairs: pa.Array) -> pa.Array:
        lists = [[(p["source"], p["alias"]) for p in ps or []] for ps in pairs.to_pylist()]
        return pa.array([[rename_text(v, ps) for v in vs] for vs, ps in zip(values.to_pylist(), lists)], pa.list_(pa.string()))

    flat = F.concat(F.array(*[F.col(c) for c in columns]), *[F.coalesce(c, T.strings()) for c in arrays])
    made = listed.withColumn("__made", apply(flat, F.col("__pairs")))
    out, at = {}, F.lit(len(columns) + 1)
    for i, c in enumerate(columns):
        out[c] = F.col("__made")[i]
    for c in arrays:
        n = F.size(F.coalesce(c, T.strings()))
        out[c] = F.slice("__made", at, n)
        at = at + n
    originals = {f"original_{c}": F.col(c) for c in columns if f"original_{c}" not in df.columns}
    return made.withColumns(originals).withColumns(out).select(*df.columns, *originals)


def rename_native(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """C5 for a short, stated list of aliases: a chain of JVM replacements."""
    for source, alias in sorted(pairs, key=lambda p: (-len(p[0]), p[0].lower())):
        text = F.regexp_replace(text, ("(?iu)" if len(source) >= 4 else "") + r"(?U)\b" + re.escape(source) + r"\b", alias.replace("\\", "\\\\").replace("$", "\\$"))
    return text


#: Lengths of the beginnings by which a source is looked for.
GRAMS = (16, 8, 4, 3, 2, 1)


def mentions(texts: DataFrame, aliases: DataFrame, key: str, column: str) -> DataFrame:
    """J7, C10. (key, source): sources whose normal form is within a text's.

    Containment is by characters, so a source may begin and end inside longer words. A source is looked for by its first 16,
    8, 4 or fewer characters, the most that it has; a text has at most as many of each as characters, whatever its words.
    """
    n = T.normal_key(F.coalesce(column, F.lit("")))
    src = aliases.select("source", T.normal_key(F.col("source")).alias("s")).where("s <> ''")
    size = F.coalesce(*[F.when(F.length("s") >= g, g) for g in GRAMS])
    src = src.withColumn("g", size).withColumn("probe", F.xxhash64(F.substr(F.col("s"), F.lit(1), F.col("g"))))

    def beginnings(g: int) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.length("n") - (g - 1)), lambda i: F.xxhash64(F.substr(F.col("n"), i, F.lit(g))))
        return F.when(F.length("n") >= g, F.array_distinct(all_)).otherwise(F.array().cast("array<bigint>"))

    grams = F.flatten(F.array(*map(beginnings, GRAMS)))
    t = texts.select(key, n.alias("n"))
    hits = t.select(key, F.explode(grams).alias("probe")).join(src, "probe").select(key, "source", "s")
    return t.join(hits, key).where(F.contains("n", F.col("s"))).select(key, "source").distinct()


def validation(documents: DataFrame, queries: DataFrame, qrels: DataFrame, aliases: DataFrame) -> DataFrame:
    """C8, C9, A11. One row of counts and rates over renamed tables that kept original_text.

    documents: (doc_id, text, original_text); queries: (query_id, text, original_text, answers). Coverage counts aliases
    whose source the original corpus mentions and whose alias the renamed one does; 1 without aliases.
    """
    d, q = documents.select("doc_id", "text", "original_text"), queries.select("query_id", "text", "original_text")
    before = mentions(d, aliases, "doc_id", "original_text").select("source").distinct()
    as_source = aliases.select(F.col("alias").alias("source")).distinct()
    after = mentions(d, as_source, "doc_id", "text").select(F.col("source").alias("alias")).distinct()
    n = aliases.agg(F.count("*").alias("alias_count"))
    covered = aliases.join(before, "source", "left_semi").join(after, "alias", "left_semi").agg(F.count("*").alias("covered"))
    residual_d = mentions(d, aliases, "doc_id", "text").agg(F.countDistinct("source").alias("residual_corpus_sources"), F.countDistinct("doc_id").alias("residual_documents"))
    residual_q = mentions(q, aliases, "query_id", "text").agg(F.countDistinct("source").alias("residual_query_sources"), F.countDistinct("query_id").alias("residual_queries"))
    answered = queries.where(F.size("answers") > 0).select("query_id", "answers").join(qrels.where("grade > 0"), "query_id").join(documents.select("doc_id", "text"), "doc_id")
    kept = answered.groupBy("query_id").agg(F.bool_or(T.contains_any(F.col("text"), F.col("answers"))).alias("kept")).agg(F.avg(F.col("kept").cast("double")).alias("answer_preservation_rate"), F.count("*").alias("answerable_queries"))
    out = n
    for part in (covered, residual_d, residual_q, kept):
        out = out.crossJoin(part)  # one row each
    return out.select("alias_count", F.when(F.col("alias_count") == 0, 1.0).otherwise(F.col("covered") / F.col("alias_count")).alias("replacement_coverage"), "residual_corpus_sources", "residual_documents", "residual_query_sources", "residual_queries", "answer_preservation_rate", "answerable_queries")
