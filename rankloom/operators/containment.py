"""Which texts contain which passages, without comparing every text with every passage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.session import written
from .retrieval import LexicalIndex

#: Words of a probe: a run inside the passage, so that its words are whole wherever the passage stands.
PROBE = 5
#: Bits that tell which ids may have been found; for more ids, more rows pass that the join then drops.
BITS = 1 << 23


def containing(documents: DataFrame, passages: DataFrame, doc_id: str = "doc_id", passage_id: str = "query_id") -> DataFrame:
    """(doc_id, passage_id) where the document's text contains the passage's text, character by character. J7.

    documents: (doc_id, text); passages: (passage_id, text). A passage of at least PROBE + 2 words is probed by its
    second to sixth word: runs of words of the documents meet the probes in an equi-join, then containment is tested.
    Shorter passages are tested against each document; they are expected to be few. Empty passages and null texts are in
    nothing.
    """
    words = F.filter(F.split("p", r"[ \t\n\r\f]+"), lambda w: w != "")
    known = passages.select(passage_id, F.col("text").alias("p")).where("p <> ''").withColumn("w", words)
    long = known.where(F.size("w") >= PROBE + 2).select(passage_id, "p", F.xxhash64(F.array_join(F.slice("w", 2, PROBE), " ")).alias("probe"))
    own = F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != "")
    runs = documents.where("text is not null").select(doc_id, own.alias("w")).where(F.size("w") >= PROBE)
    hashes = T.bound(F.col("w"), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - PROBE + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, PROBE), " ")))))
    hits = runs.select(doc_id, F.explode(hashes).alias("probe")).join(long, "probe").select(doc_id, passage_id, "p")
    # the text is fetched again for the few hits, instead of travelling with every run
    found = hits.join(documents.select(doc_id, "text"), doc_id).where(F.contains("text", F.col("p"))).select(doc_id, passage_id)
    short = known.where(F.size("w") < PROBE + 2).select(passage_id, "p")
    also = documents.select(doc_id, "text").join(short, F.contains("text", F.col("p"))).select(doc_id, passage_id)
    return found.unionByName(also).distinct()


def containing_indexed(index: LexicalIndex, passages: DataFrame, passage_id: str = "query_id") -> DataFrame:
    """As containing(), with a stored index: a passage is looked for only in the documents that have its rarest token.

    Tokens that begin or end a passage may be parts of longer ones in a document; a passage is probed by one between them,
    so its documents come from one posting list. Texts of other documents stay where they are read. Passages of fewer than three tokens are tested against each document.
    """
    inner = T.bound(T.tokens(F.coalesce("text", F.lit(""))), lambda w: F.when(F.size(w) > 2, F.array_distinct(F.slice(w, 2, F.size(w) - 2))))
    known = passages.where("text <> ''").select(passage_id, F.col("text").alias("p"), inner.alias("inner"))
    probes = known.where("inner is not null").select(passage_id, "p", F.explode("inner").alias("term")).join(index.term_stats.select("term", "df"), "term", "left")
    # a token that no document has: the passage is in none
    rarest = probes.groupBy(passage_id).agg(F.first("p").alias("p"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("t")).where("t.df > 0")
    hits = index.postings.select("term", "doc_id").join(written(rarest.select(passage_id, "p", F.col("t.term").alias("term")), "probes"), "term")
    docs = index.documents.select("doc_id", "text")
    hits = written(hits.select("doc_id", passage_id, "p"), "hits")
    found = possible(docs, hits).join(hits, "doc_id").where(F.contains("text", F.col("p"))).select("doc_id", passage_id)
    short = known.where("inner is null").select(passage_id, "p")
    also = docs.join(short, F.contains("text", F.col("p"))).select("doc_id", passage_id)
    return found.unionByName(also).distinct()


def possible(docs: DataFrame, hits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is in hits, and few others: ids are looked up in BITS bits, one row of fixed size that
    goes to all tasks. So what the others hold is in no shuffle of the join that follows."""
    bit = F.pmod(F.xxhash64(doc_id), F.lit(BITS))
    words = hits.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits"))
    words = hits.sparkSession.range(BITS >> 6).withColumnRenamed("id", "word").join(words, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    known = written(words.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("known")), "known")
    with_bit = docs.withColumn("bit", bit)
    return with_bit.join(F.broadcast(known), F.expr("shiftrightunsigned(known[CAST(shiftright(bit, 6) AS INT)], CAST(bit & 63 AS INT)) & 1 = 1")).select(*docs.columns)  # one row
