"""A stream of typed queries answered against a stored index, and its latencies by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfold.operators.retrieval import suggest_fulltext
from wayfold.plans.index import Index
from wayfold.plans.parse import parse_queries
from wayfold.sources.scratch import scope


def answer_stream(queries: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, limit: int = 10, late: str = "10 minutes") -> StreamingQuery:
    """Starts a stream that answers every micro-batch of ``query_id, query`` and hands the hits to ``sink``.

    Where ``queries`` has ``ts``, a query_id that comes again within ``late`` is answered once, also after a restart (the
    ids are kept in the state store until the watermark passes them), and rows behind the watermark are dropped and
    counted (``dropped_late``). A batch that runs again after a failure carries the same number, so a sink that writes by
    it is idempotent. What a batch stores on the way is removed when the sink has read the hits.
    """
    if "ts" in queries.columns:
        queries = queries.withWatermark("ts", late).dropDuplicatesWithinWatermark(["query_id"])

    def batch(rows: DataFrame, number: int) -> None:
        with scope(rows.sparkSession):
            sink(suggest_fulltext(parse_queries(rows), index, limit), number)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped_late(query: StreamingQuery) -> int:
    """How many rows the stream has dropped as too late."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def windowed_latency(samples: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and maximum of ``took_ms`` by engine and tumbling window of ``ts``; works on streams and tables."""
    w = samples.withWatermark("ts", late).groupBy(F.window("ts", window), "engine")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("took_ms").alias("mean_ms"), F.max("took_ms").alias("max_ms"))
