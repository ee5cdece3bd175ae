"""Incremental runs: queries that arrive as files are ranked batch by batch, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import retrieval

QUERY_ROWS = "query_id string, text string, ts timestamp"


def query_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines that appear in a folder; bad lines are dropped."""
    return spark.readStream.schema(QUERY_ROWS).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(folder)


def rank_stream(queries: DataFrame, index_path: str, out: str, checkpoint: str, k: int = 10, delay: str = "1 hour") -> StreamingQuery:
    """Ranks each new query against a written index and appends (query_id, doc_id, score, rank, batch) to out.

    A query id counts once within the watermark. A batch that is run again after a failure replaces what it wrote: results
    are partitioned by batch. Ends when what is there has been read, so it can be scheduled.
    """
    once = queries.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["query_id"])

    def write(batch: DataFrame, number: int) -> None:
        index = retrieval.LexicalIndex.read(batch.sparkSession, index_path)
        ranked = retrieval.top_k(retrieval.bm25_scores(index, retrieval.query_terms(batch.select("query_id", "text"))), k)
        ranked.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of an event stream by window and type; late events beyond the watermark are dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
