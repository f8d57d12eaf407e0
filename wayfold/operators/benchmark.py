"""Comparison of methods end to end: a warm-up, a timed loop, and a report of latency, agreement and known items."""

from __future__ import annotations

import dataclasses
import functools
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import evaluation as E
from wayfold.sources.scratch import stored

#: A method as the loop sees it: texts in, hits (query_id, id, label, rank) out.
Answer = Callable[[list[str]], DataFrame]

HITS = "engine string, query string, id string, label string, rank long"
SAMPLES = "engine string, query string, took_ms double, iter long"


@dataclasses.dataclass
class Measured:
    """Samples (engine, query, took_ms, iter), the last hits of every method, and its failures."""

    samples: list[tuple] = dataclasses.field(default_factory=list)
    hits: dict[str, DataFrame] = dataclasses.field(default_factory=dict)
    errors: dict[str, list[str]] = dataclasses.field(default_factory=dict)


def measure(methods: dict[str, Answer], queries: list[str], iterations: int = 20, warmup: int = 5, together: bool = True) -> Measured:
    """Runs every method on the queries: ``warmup`` times unmeasured, then ``iterations`` times, methods in turn.

    ``together`` answers all queries as one batch, and a query's time is its share of the batch; otherwise they are asked
    one by one. A method's failure is recorded, and neither the other methods nor its other calls are affected.
    """
    out = Measured(errors={m: [] for m in methods})
    calls = [queries] if together else [[q] for q in queries]
    for call in calls:
        for answer in methods.values():
            for _ in range(warmup):
                try:
                    answer(call).write.format("noop").mode("overwrite").save()
                except Exception:  # counted when it is measured
                    pass
    kept: dict[str, dict[int, DataFrame]] = {m: {} for m in methods}
    for turn in range(iterations):
        for k, call in enumerate(calls):
            for name, answer in methods.items():
                began = time.time()
                try:
                    hits = stored(answer(call).select(F.lit(name).alias("engine"), F.col("query_id").alias("query"), "id", "label", F.col("rank").cast("long").alias("rank")), "hits")
                except Exception as problem:
                    out.errors[name].append(str(problem)[:200])
                    continue
                took = (time.time() - began) * 1000 / len(call)
                out.samples += [(name, q, took, turn) for q in call]
                kept[name][k] = hits
    for name, parts in kept.items():
        for hits in parts.values():
            out.hits[name] = out.hits[name].unionByName(hits) if name in out.hits else hits
    return out


@dataclasses.dataclass
class Report:
    """What ``evaluate`` found; every table is a DataFrame."""

    config: dict
    errors: dict[str, list[str]]
    latency: DataFrame
    agreement: DataFrame
    disagreements: DataFrame
    golden: DataFrame
    verdict: DataFrame

    def long(self) -> DataFrame:
        """``section, engine, query, metric, value`` of everything that is a number."""
        overall, by_query = self.latency.filter("query is null"), self.latency.filter("query is not null")
        metrics = [c for c in self.latency.columns if c not in ("engine", "query")]
        parts = [E.long_format(overall, "latency_overall", metrics), E.long_format(by_query, "latency_by_query", metrics, "query")]
        parts.append(E.long_format(self.agreement, "agreement", [c for c in self.agreement.columns if c != "engine"]))
        parts.append(E.long_format(self.golden, "golden", [c for c in self.golden.columns if c != "engine"]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def write(self, folder: str) -> None:
        """One CSV of all numbers and a JSON table for each section."""
        self.long().write.mode("overwrite").csv(f"{folder}/csv", header=True)
        for name in ("latency", "agreement", "disagreements", "golden", "verdict"):
            getattr(self, name).write.mode("overwrite").json(f"{folder}/{name}")


def evaluate(spark: SparkSession, methods: dict[str, Answer], queries: list[str], golden: DataFrame, iterations: int = 20, warmup: int = 5, together: bool = True) -> Report:
    """Measures the methods on ``queries``; queries of ``golden`` that are not among them are answered once, unmeasured.

    The first method is the baseline of the agreement. A method all of whose calls failed is in ``errors`` alone.
    """
    if not queries or not methods:
        raise ValueError("there must be queries and methods")
    measured = measure(methods, queries, max(1, iterations), max(0, warmup), together)
    more = [r.query for r in golden.select("query").distinct().join(spark.createDataFrame([(q,) for q in queries], "query string"), "query", "left_anti").collect()]
    extra = measure(methods, more, 1, 0, together) if more else Measured()
    samples = spark.createDataFrame(measured.samples, SAMPLES)
    empty = spark.createDataFrame([], HITS)
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts, empty)
    asked = union(measured.hits.values())
    every = union([asked, *extra.hits.values()])
    errors = {m: measured.errors[m] + extra.errors.get(m, []) for m in methods}
    latency, summary = E.latency_rollup(samples), E.golden_summary(E.golden_ranks(golden, every))
    pairs = E.agreement(asked, next(iter(methods)))
    config = {"engines": list(measured.hits), "queries": len(queries), "iterations": iterations, "warmup": warmup, "together": together, "percentiles": "interpolated between closest ranks"}
    verdict = E.verdict(latency.filter("query is null").drop("query"), summary)
    return Report(config, errors, latency, E.agreement_summary(pairs), E.disagreements(pairs), summary, verdict)
