import os

from pyspark.sql import functions as F

from wayfold.operators import retrieval as M
from wayfold.operators import service as S
from wayfold.plans.corpus import finish
from wayfold.sources.scratch import shared_folder
from wayfold.streaming.query_log import answer_stream, dropped_late


def test_stream_with_restart_and_late_rows(spark, tmp_path):
    docs = finish(spark.createDataFrame([("s:1", "street", "Kerkstraat", "Kerkstraat", "Gent", 4, []), ("s:2", "street", "Meir", "Meir", "Antwerpen", 9, [])], "id string, doc_type string, label string, street_name string, municipality_name string, popularity long, aliases array<string>"))
    index = M.Index.of(docs, ("search_text", "name_start"))
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    inbox, out = tmp_path / "in", tmp_path / "out"

    def feed(name, rows):
        frame = spark.createDataFrame(rows, "query_id string, query string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(f"{inbox}/{name}")

    def run():
        stream = spark.readStream.schema("query_id string, query string, ts timestamp").parquet(f"{inbox}/*")
        query = answer_stream(stream, index, lambda hits, n: hits.select("query_id", "id").write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "checkpoint"))
        query.awaitTermination(300)
        return query

    answered = lambda: sorted((r.query_id, r.id) for r in spark.read.parquet(f"{out}/*").collect())
    feed("a", [("1", "kerk", "2024-01-01 10:00:00"), ("1", "kerk", "2024-01-01 10:01:00"), ("2", "meir", "2024-01-01 11:00:00")])
    run()
    assert answered() == [("1", "s:1"), ("2", "s:2")]
    # after a restart: one id again, one too late, one new
    feed("b", [("2", "meir", "2024-01-01 11:02:00"), ("3", "meir", "2024-01-01 08:00:00"), ("4", "meir", "2024-01-01 11:03:00")])
    query = run()
    assert answered() == [("1", "s:1"), ("2", "s:2"), ("4", "s:2")] and dropped_late(query) == 1
    # neither batches nor a single request leave tables behind
    got = S.suggest(spark, S.Request("kerk", methods=("fulltext",)), index)["results"]["fulltext"]
    assert got["suggestions"][0]["id"] == "s:1" and got["total"] == 1
    assert set(os.listdir(folder)) == before
