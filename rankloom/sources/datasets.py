"""Retrieval datasets as DataFrames: readers, writers, fingerprints, caches and checkpoints."""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

DOCUMENTS = "doc_id string, title string, text string, metadata string, original_text string"
QUERIES = "query_id string, text string, answers array<string>, answer_aliases array<string>, supporting_doc_ids array<string>, supporting_facts array<string>, metadata string, original_text string"
QRELS = "query_id string, doc_id string, grade int"
# Accepted spellings of fields, in the order they are tried.
DOC_ID, QUERY_ID = ("doc_id", "_id", "id", "corpus-id"), ("query_id", "_id", "id", "query-id")
QUERY_TEXT, ANSWERS, ALIASES = ("text", "query", "question"), ("answers", "short_answers"), ("answer_aliases", "aliases")
QREL_QUERY, QREL_DOC, QREL_GRADE = ("query-id", "query_id", "qid", "queryId"), ("corpus-id", "corpus_id", "doc_id", "pid", "docId"), ("score", "relevance")


@dataclass
class Dataset:
    """documents (with ord), queries (with ord), qrels, and a free-form manifest."""

    name: str
    documents: DataFrame
    queries: DataFrame
    qrels: DataFrame
    manifest: dict = field(default_factory=dict)


# -- file systems: through Hadoop, so that any store Spark reads works -------


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole, on the driver: manifests only."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file from the driver, written beside and renamed."""
    fs, p = _fs(spark, path)
    tmp = spark._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(p, False)
    fs.rename(tmp, p)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2))


# -- rows -------------------------------------------------------------------


def first_of(row: Column, names: tuple[str, ...]) -> Column:
    """The first of several spellings that is neither null nor empty; row is a VARIANT."""
    return F.coalesce(*[F.nullif(F.try_variant_get(row, f"$['{n}']", "string"), F.lit("")) for n in names])


def list_of(row: Column, names: tuple[str, ...]) -> Column:
    """S7, P3. A list or a single value under the first spelling present, as stripped non-empty strings."""
    def one(n: str) -> Column:
        listed, alone = F.try_variant_get(row, f"$['{n}']", "array<string>"), F.try_variant_get(row, f"$['{n}']", "string")
        return F.coalesce(listed, F.when(alone.isNotNull(), F.array(alone)))

    return T.cleaned_list(F.coalesce(*[one(n) for n in names], T.strings()))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """S6. (ord, row): rows of line-delimited JSON as VARIANT; blank lines are skipped, a bad line fails the read.

    ord is (file, offset-like id): monotonically increasing within the order of the files' splits.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("ord"), F.parse_json("value").alias("row"))


def documents_from(rows: DataFrame, join_title: bool = False) -> DataFrame:
    """S7. Tolerant of spellings; rows without an id fail (they would all become one document)."""
    r = F.col("row")
    title, text = F.coalesce(first_of(r, ("title",)), F.lit("")), F.coalesce(first_of(r, ("text",)), F.lit(""))
    return rows.select(
        F.coalesce(first_of(r, DOC_ID), F.raise_error(F.lit("a document without an id"))).alias("doc_id"), title.alias("title"), (T.title_and_text(title, text) if join_title else text).alias("text"),
        F.to_json(F.try_variant_get(r, "$.metadata", "variant")).alias("metadata"), first_of(r, ("original_text",)).alias("original_text"), "ord",
    )


def queries_from(rows: DataFrame) -> DataFrame:
    r = F.col("row")
    return rows.select(
        F.coalesce(first_of(r, QUERY_ID), F.raise_error(F.lit("a query without an id"))).alias("query_id"), F.coalesce(first_of(r, QUERY_TEXT), F.lit("")).alias("text"), list_of(r, ANSWERS).alias("answers"), list_of(r, ALIASES).alias("answer_aliases"),
        list_of(r, ("supporting_doc_ids",)).alias("supporting_doc_ids"), list_of(r, ("supporting_facts",)).alias("supporting_facts"), F.to_json(F.try_variant_get(r, "$.metadata", "variant")).alias("metadata"), first_of(r, ("original_text",)).alias("original_text"), "ord",
    )


def qrels_from(rows: DataFrame, legacy_zero_grade: bool = False) -> DataFrame:
    """P5. The last of duplicates wins; grades that are not positive are dropped.

    A missing grade is 1. legacy_zero_grade: a numeric 0 counts as missing, too.
    """
    r = F.col("row")
    grade = F.coalesce(*[F.try_variant_get(r, f"$['{n}']", "int") for n in QREL_GRADE], F.lit(1))
    graded = rows.select(first_of(r, QREL_QUERY).alias("query_id"), first_of(r, QREL_DOC).alias("doc_id"), (F.when(grade == 0, 1).otherwise(grade) if legacy_zero_grade else grade).alias("grade"), "ord")
    return graded.groupBy("query_id", "doc_id").agg(F.max_by("grade", "ord").alias("grade")).where("grade > 0")


def take(df: DataFrame, n: int | None) -> DataFrame:
    """P1. The first n rows in file order."""
    return df if n is None else df.orderBy("ord").limit(n)


# -- datasets ---------------------------------------------------------------


def toy(spark: SparkSession) -> Dataset:
    """S2. Five documents, three questions: a fixture for tests."""
    facts = [("d1", "Marie Curie", "Marie Curie was born in Warsaw and later worked in Paris."), ("d2", "Albert Einstein", "Albert Einstein was born in Ulm."), ("d3", "Ada Lovelace", "Ada Lovelace was born in London."), ("d4", "Boston", "Boston is the capital of Massachusetts."), ("d5", "Eiffel Tower", "The Eiffel Tower is a tower in Paris.")]
    asked = [("q1", "Where was Marie Curie born?", "Warsaw", "Poland", "d1"), ("q2", "Where was Albert Einstein born?", "Ulm", "Germany", "d2"), ("q3", "Where was Ada Lovelace born?", "London", "England", "d3")]
    docs = spark.createDataFrame([(i, t, x, None, None, k) for k, (i, t, x) in enumerate(facts)], DOCUMENTS + ", ord long")
    queries = spark.createDataFrame([(i, x, [a], [f"{a}, {c}"], [d], [], None, None, k) for k, (i, x, a, c, d) in enumerate(asked)], QUERIES + ", ord long")
    return Dataset("toy", docs, queries, spark.createDataFrame([(q, d, 1) for q, *_, d in asked], QRELS), {"dataset_type": "toy"})


def local(spark: SparkSession, path: str) -> Dataset:
    """S5, S8. A folder with corpus.jsonl, queries.jsonl, qrels.jsonl and an optional manifest.json."""
    root = path.removeprefix("local:").rstrip("/")
    manifest = json.loads(read_text(spark, f"{root}/manifest.json")) if exists(spark, f"{root}/manifest.json") else {}
    docs, queries = documents_from(read_jsonl(spark, f"{root}/corpus.jsonl")), queries_from(read_jsonl(spark, f"{root}/queries.jsonl"))
    return restricted(Dataset(manifest.get("name") or posixpath.basename(root), docs, queries, qrels_from(read_jsonl(spark, f"{root}/qrels.jsonl")), manifest))


def first_split(spark: SparkSession, root: str, names: tuple[str, ...]) -> str:
    """S4. The first file of several names that exists; an error names them all."""
    for n in names:
        if exists(spark, f"{root}/{n}"):
            return f"{root}/{n}"
    raise FileNotFoundError(f"none of {', '.join(names)} in {root}")


def hub_export(spark: SparkSession, root: str, name: str, max_corpus: int | None = None, max_queries: int | None = None) -> Dataset:
    """S3. A benchmark exported as JSONL: corpus cut first, judgements restricted to it, queries to those judged, then cut."""
    docs = take(documents_from(read_jsonl(spark, first_split(spark, root, ("corpus.jsonl", "corpus.jsonl.gz"))), join_title=True), max_corpus)
    qrels = qrels_from(read_jsonl(spark, first_split(spark, root, ("qrels.jsonl", "qrels/test.jsonl", "qrels/dev.jsonl", "qrels/train.jsonl")))).join(docs.select("doc_id"), "doc_id", "left_semi")
    queries = take(queries_from(read_jsonl(spark, first_split(spark, root, ("queries.jsonl", "queries.jsonl.gz")))).join(qrels.select("query_id"), "query_id", "left_semi"), max_queries)
    return restricted(Dataset(name, docs, queries, qrels, {"dataset_type": "hub", "max_corpus": max_corpus, "max_queries": max_queries}))


def restricted(d: Dataset) -> Dataset:
    """J3. Judgements of kept queries and documents only."""
    return replace(d, qrels=d.qrels.join(d.queries.select("query_id"), "query_id", "left_semi").join(d.documents.select("doc_id"), "doc_id", "left_semi"))


def load(spark: SparkSession, name: str, max_corpus: int | None = None, max_queries: int | None = None, hub_root: str | None = None, query_metadata: str | None = None) -> Dataset:
    """S1. `toy`, a folder (or `local:` folder), or a benchmark under hub_root."""
    if name == "toy":
        d = toy(spark)
    elif name.startswith("local:") or exists(spark, f"{name}/corpus.jsonl"):
        d = local(spark, name)
        d = restricted(replace(d, documents=take(d.documents, max_corpus), queries=take(d.queries, max_queries)))
    elif hub_root:
        d = hub_export(spark, f"{hub_root}/{name}", name, max_corpus, max_queries)
    else:
        raise ValueError(f"no dataset {name!r}")
    return replace(d, queries=merge_metadata(d.queries, queries_from(read_jsonl(spark, query_metadata)))) if query_metadata else d


def merge_metadata(queries: DataFrame, extra: DataFrame) -> DataFrame:
    """J5, P4. Adds answers, aliases and support of a side table; its text wins where it has one."""
    lists = ("answers", "answer_aliases", "supporting_doc_ids", "supporting_facts")
    side = extra.select("query_id", F.col("text").alias("x_text"), *[F.col(c).alias(f"x_{c}") for c in lists])
    j = queries.join(side, "query_id", "left")
    return j.withColumns({"text": F.coalesce(F.nullif("x_text", F.lit("")), F.col("text"))} | {c: T.merged(F.col(c), F.col(f"x_{c}")) for c in lists}).select(queries.columns)


def export(d: Dataset, path: str) -> None:
    """S9, S10. The layout that local() reads; each JSONL is a folder of parts, in order."""
    spark = d.documents.sparkSession
    rows = lambda df: df.select(F.to_json(F.struct("*")).alias("value"))
    rows(d.documents.orderBy("ord").drop("ord") if "ord" in d.documents.columns else d.documents).write.mode("overwrite").text(f"{path}/corpus.jsonl")
    rows(d.queries.orderBy("ord").drop("ord") if "ord" in d.queries.columns else d.queries).write.mode("overwrite").text(f"{path}/queries.jsonl")
    rows(d.qrels.withColumnRenamed("grade", "score")).write.mode("overwrite").text(f"{path}/qrels.jsonl")
    write_json(spark, f"{path}/manifest.json", {"name": d.name, **d.manifest})


def synthetic(spark: SparkSession, n: int = 120, seed: int = 41) -> Dataset:
    """S11. n invented project notes, a question and a judgement each; values are chosen by hash, so any n is one plan."""
    pick = lambda salt, *v: F.element_at(T.strings(*v), (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(len(v))) + 1).cast("int"))
    base = spark.range(n).select("id", F.format_string("d%04d", "id").alias("doc_id"), F.format_string("q%04d", "id").alias("query_id"), F.format_string("PRJ-%05d", F.col("id") * 7 + seed).alias("project"), F.format_string("INC-%05d", F.col("id") * 13 + seed).alias("incident"), F.concat_ws(" ", pick(1, "Ines", "Omar", "Lena", "Pavel", "Rhea", "Jonas"), pick(2, "Quint", "Ashby", "Moreau", "Stahl", "Okoye", "Lind")).alias("owner"), pick(3, "Harbor", "Ridge", "Delta", "Summit", "Grove").alias("location"), pick(4, "amber", "cobalt", "violet", "slate").alias("marker"))
    text = F.format_string("Project %s handled incident %s at %s. The owner is %s. Marker: %s.", "project", "incident", "location", "owner", "marker")
    docs = base.select("doc_id", "project", text.alias("text"), "id").select("doc_id", F.col("project").alias("title"), "text", F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("string").alias("original_text"), F.col("id").alias("ord"))
    queries = base.select("query_id", F.format_string("Who is the owner of project %s that handled incident %s?", "project", "incident").alias("text"), F.array("owner").alias("answers"), T.strings().alias("answer_aliases"), F.array("doc_id").alias("supporting_doc_ids"), T.strings().alias("supporting_facts"), F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("string").alias("original_text"), F.col("id").alias("ord"))
    return Dataset("synthetic", docs, queries, base.select("query_id", "doc_id", F.lit(1).alias("grade")), {"dataset_type": "synthetic", "seed": seed})


def fingerprint(d: Dataset) -> str:
    """S14. SHA-256 of a dataset's name and rows, whatever their order or partitioning.

    Row hashes are summed, so only one number a table comes to the driver.
    """
    import hashlib

    def total(df: DataFrame) -> str:
        h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != "ord"))), 256), 1, 15), 16, 10).cast("decimal(20,0)")
        r = df.agg(F.count("*"), F.sum(h)).first()
        return f"{r[0]}:{r[1]}"

    return hashlib.sha256("|".join([d.name, *map(total, (d.documents, d.queries, d.qrels))]).encode()).hexdigest()


def artifact_dir(root: str, d: Dataset, regime: str, style: str, seed: int, max_corpus: int | None, max_queries: int | None, version: str = "v1") -> str:
    """S13. The folder of a counterfactual copy: it names everything its content depends on."""
    slug = re.sub(r"[^a-z0-9]+", "-", d.name.lower()).strip("-") or "dataset"
    size = lambda n: "all" if n is None else str(n)
    return f"{root.rstrip('/')}/{slug}__{regime}__{style}__seed{seed}__c{size(max_corpus)}__q{size(max_queries)}__{version}__{fingerprint(d)[:12]}"


def export_artifacts(d: Dataset, aliases: DataFrame, validation: DataFrame, path: str) -> None:
    """S12."""
    export(d, path)
    aliases.write.mode("overwrite").parquet(f"{path}/alias_table")
    validation.write.mode("overwrite").parquet(f"{path}/validation")


def load_artifacts(spark: SparkSession, path: str) -> tuple[Dataset, DataFrame | None, DataFrame | None]:
    """S12, C11. Missing tables are None."""
    part = lambda n: spark.read.parquet(f"{path}/{n}") if exists(spark, f"{path}/{n}") else None
    return local(spark, path), part("alias_table"), part("validation")


def preview(d: Dataset, n: int = 3) -> dict:
    """S27. Counts and the first rows: a report."""
    first = lambda df: [r.asDict(True) for r in (df.orderBy("ord") if "ord" in df.columns else df.orderBy(*df.columns)).limit(n).collect()]
    return {"name": d.name, "documents": d.documents.count(), "queries": d.queries.count(), "qrels": d.qrels.count(), "first_documents": first(d.documents), "first_queries": first(d.queries), "first_qrels": first(d.qrels)}


# -- stores -----------------------------------------------------------------


class TableStore:
    """S15-S17. An append-only Parquet table keyed by columns: look up by join, compute and append what is missing."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).dropDuplicates(self.keys)

    def missing(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.read().select(self.keys), self.keys, "left_anti")

    def append(self, rows: DataFrame) -> None:
        self.missing(rows.dropDuplicates(self.keys)).select(*[f.name for f in self.read().schema]).write.mode("append").parquet(self.path)


def embedding_store(spark: SparkSession, path: str) -> TableStore:
    """S16, S17. Embeddings by model, document and text; only texts without one are encoded."""
    return TableStore(spark, path, "model string, doc_id string, text_sha256 string, embedding array<float>", ["model", "doc_id", "text_sha256"])


def completed_queries(records: DataFrame, queries: DataFrame, context: dict[str, str], required: list[str]) -> DataFrame:
    """S18, U6, W8. The last record of each query that has this context, this query text and all required methods.

    records: (ord, query_id, query, context map<string,string>, methods array<string>, ...).
    """
    ok = F.forall(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(str(v)).alias("v")) for k, v in context.items()]) if context else F.array().cast("array<struct<k:string,v:string>>"), lambda c: F.col("context")[c["k"]].eqNullSafe(c["v"]))
    whole = F.size(F.array_except(T.strings(*required), F.col("methods"))) == 0
    last = records.withColumn("__r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("ord").desc()))).where("__r = 1").drop("__r")
    return last.where(ok & whole).join(queries.select("query_id", F.col("text").alias("query")), ["query_id", "query"], "left_semi")


def remaining_queries(queries: DataFrame, completed: DataFrame) -> DataFrame:
    """J8."""
    return queries.join(completed.select("query_id"), "query_id", "left_anti")


def read_records(spark: SparkSession, path: str, keep_duplicates: bool = False, tolerant: bool = True) -> DataFrame:
    """S18, S23, F-6. Run records (query_id, rankings as rows, qrels as rows): bad lines are dropped if tolerant, the last
    record of a query wins unless duplicates are kept."""
    schema = "query_id string, query string, rankings map<string,array<array<string>>>, qrels map<string,int>, retrieval_strings map<string,string>, generation map<string,string>, checkpoint_context map<string,string>"
    lines = spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path).where("query_id is not null").withColumn("ord", F.monotonically_increasing_id())
    lines = lines.withColumn("methods", F.coalesce(F.map_keys("rankings"), T.strings())).withColumn("context", F.coalesce("checkpoint_context", F.create_map().cast("map<string,string>"))).drop("checkpoint_context")
    if keep_duplicates:
        return lines
    return lines.withColumn("__r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("ord").desc()))).where("__r = 1").drop("__r")


def record_rankings(records: DataFrame) -> DataFrame:
    """(query_id, method, doc_id, score, rank) of stored rankings."""
    m = records.select("query_id", F.explode("rankings").alias("method", "l")).select("query_id", "method", F.posexplode("l").alias("at", "x"))
    return m.select("query_id", "method", F.col("x")[0].alias("doc_id"), F.col("x")[1].cast("double").alias("score"), (F.col("at") + 1).alias("rank"))


def record_qrels(records: DataFrame) -> DataFrame:
    return records.select("query_id", F.explode("qrels").alias("doc_id", "grade"))


def run_files(spark: SparkSession, glob: str, pattern: str) -> DataFrame:
    """S26. (file, groups): files under a glob, with what a pattern's groups find in their names."""
    n = re.compile(pattern).groups
    files = spark.read.format("binaryFile").load(glob).select(F.col("path").alias("file")).where(F.regexp_like("file", F.lit(pattern)))
    return files.select("file", F.array(*[F.regexp_extract("file", pattern, i + 1) for i in range(n)]).alias("groups"))


def write_records(rankings: DataFrame, qrels: DataFrame, texts: DataFrame, path: str, mode: str = "append", queries: DataFrame | None = None, context: dict[str, str] | None = None) -> None:
    """S20, S22. A JSON line for each query; an append is a commit of its own, so a lost driver loses one batch.

    queries (query_id, text) and context are what resuming compares: the query's text, and what the run was made with.
    """
    lists = rankings.groupBy("query_id", "method").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))), lambda x: F.array(x["doc_id"].cast("string"), x["score"].cast("string"))).alias("l"))
    ranked = lists.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("method", "l"))).alias("rankings"))
    judged = qrels.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), "grade"))).alias("qrels"))
    strings = texts.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("method", "text"))).alias("retrieval_strings"))
    out = ranked.join(judged, "query_id", "left").join(strings, "query_id", "left")
    if queries is not None:
        out = out.join(queries.select("query_id", F.col("text").alias("query")), "query_id", "left")
    if context:
        out = out.withColumn("checkpoint_context", F.create_map(*[F.lit(str(x)) for kv in context.items() for x in kv]))
    out.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """S24."""
    df.write.mode("overwrite").option("header", True).csv(path)


def formatted(value: Column, signed: bool = False, missing: str = "TBD") -> Column:
    """F44. Three decimals; a mark for null."""
    return F.when(value.isNull(), F.lit(missing)).otherwise(F.format_string("%+.3f" if signed else "%.3f", value))


def markdown_table(df: DataFrame) -> str:
    """S25. A report table; df is as small as a report."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.collect()]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def latex_table(df: DataFrame, missing: str = r"\textcolor{red}{TBD}") -> str:
    """S25."""
    escape = lambda v: missing if v is None else re.sub(r"([&%$#_{}])", r"\\\1", str(v))
    body = [" & ".join(map(escape, r)) + r" \\" for r in df.collect()]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", " & ".join(map(escape, df.columns)) + r" \\", r"\hline", *body, r"\end{tabular}"])
