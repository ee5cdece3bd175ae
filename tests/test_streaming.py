from pyspark.sql import functions as F

from rankloom.operators import retrieval
from rankloom.sources import datasets
from rankloom.streaming import front


def test_queries_are_ranked_once(spark, tmp_path):
    toy = datasets.toy(spark)
    retrieval.lexical_index(toy.documents.select("doc_id", "text")).write(f"file://{tmp_path}/index", 2)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"query_id": "q1", "text": "born Warsaw", "ts": "2026-01-01T00:00:00Z"}\nbroken\n')
    (tmp_path / "in/b.json").write_text('{"query_id": "q1", "text": "born Warsaw", "ts": "2026-01-01T00:00:10Z"}\n')
    run = lambda: front.rank_stream(front.query_stream(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/index", f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    run()
    first = spark.read.parquet(f"file://{tmp_path}/out").select("query_id", "doc_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in first if r["rank"] == 1] == [("q1", "d1")]
    (tmp_path / "in/c.json").write_text('{"query_id": "q2", "text": "Ulm", "ts": "2026-01-01T00:00:20Z"}\n')
    run()
    again = spark.read.parquet(f"file://{tmp_path}/out")
    assert again.where("query_id = 'q2' and rank = 1").select("doc_id").collect()[0][0] == "d2"
    assert again.where("query_id = 'q1'").count() == len(first)


def test_event_windows(spark):
    e = spark.createDataFrame([("2026-01-01 00:10:00", "a", 1.0), ("2026-01-01 00:50:00", "a", 2.0), ("2026-01-01 01:10:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.n, r.value) for r in front.event_counts(e).collect()) == [(1, 4.0), (2, 3.0)]
