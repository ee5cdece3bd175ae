"""A corpus pipeline: language, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before it kept. run()
writes each stage's result as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import exact, langid, near, packing, substring
from rankloom.llm.common import crc_fold, drop_table, tune, write_table

#: Not expressible in SQL (compression, rolling hashes, dynamic programming); the tests hold each stage against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough margin; `lang` becomes what was told.

    Documents that the operator rejects go: no letter, or no margin between the two best languages. Dictionaries are
    learned from the documents that bear a language, but for those held out.
    """
    dictionaries = langid.learn_dictionaries(docs.where(crc_fold(F.col("doc_id"), 4) != 2))
    found = langid.identify_language(docs, dictionaries).where("accepted")
    return found.select([F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact.exact_duplicates(docs).where("kept").select(docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Five words, similarity 0.8."""
    found = near.near_duplicates(docs.select("doc_id", "text"))
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that repeat; n_chars becomes the new length."""
    cleaned = substring.deduplicate_substrings(docs)
    return cleaned.select([F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A slot in a token-budget batch for each document."""
    tune(spark)
    lengths = write_table(docs.select("doc_id", packing.word_count(F.col("text")).alias("words")), "lengths")
    return packing.pack(lengths, F.col("words")).drop("words")


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_table(before)  # only the last stage's table stays
    return docs
