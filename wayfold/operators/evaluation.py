"""Comparison of methods: latencies, agreement, known items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.plans.ordered import numbered, range_begins, ranged

#: Samples of one window of a rolling figure.
CHUNK = 1 << 16
# What a golden expectation may start with to name a document.
ID_PREFIXES = ("address:", "street:", "municipality:", "postcode:", "place:")


PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def percentiles(samples: DataFrame, keys: list[str], value: str = "took_ms", shares: dict[str, float] = PERCENTILES) -> DataFrame:
    """Exact interpolated percentiles of each key's values, however many samples a key has.

    Equal values are counted before anything moves; the distinct ones are dealt to ranges, sums over the ranges tell each
    value which ranks it holds, and only the values that hold a wanted rank go on.
    """
    some = samples.filter(F.col(value).isNotNull())
    counted = some.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    rows = ranged(counted, *keys, value)
    inside = W.partitionBy("_range").orderBy("_in_range").rowsBetween(W.unboundedPreceding, 0)
    held = rows.join(F.broadcast(range_begins(rows, "c")), "_range").withColumn("end", F.col("_begin") + F.sum("c").over(inside))
    held = held.select(*keys, value, (F.col("end") - F.col("c")).alias("begin"), "end")
    first = rows.groupBy(*keys).agg(F.sum("c").alias("n")).join(held.groupBy(*keys).agg(F.min("begin").alias("first")), keys)
    at = F.explode(F.array(*(F.struct(F.lit(a).alias("name"), (F.lit(x) * (F.col("n") - 1)).alias("h")) for a, x in shares.items()))).alias("w")
    wanted = first.select(*keys, "first", "n", at).select(*keys, "w.name", "w.h", F.explode(F.array(F.floor("w.h"), F.ceil("w.h"))).alias("r"), "first")
    wanted = wanted.select(*keys, "name", "h", "r", (F.col("r") + F.col("first")).alias("rank")).distinct()
    met = wanted.join(held, keys).filter((F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("end")))
    low, high = F.min_by(value, "r"), F.max_by(value, "r")
    share = F.first(F.col("h") - F.floor("h"))
    # as Spark's own percentile interpolates
    mixed = met.groupBy(*keys, "name").agg(F.when(F.count(F.lit(1)) == 1, low).otherwise((1 - share) * low + share * high).alias("v"))
    return mixed.groupBy(*keys).pivot("name", list(shares)).agg(F.first("v"))


def latency_summary(samples: DataFrame, *keys: str) -> DataFrame:
    """Count, extremes, exact interpolated percentiles, mean and sample deviation (0 for one sample) of ``took_ms``."""
    out = samples.groupBy(*keys).agg(F.count("took_ms").alias("n"), F.min("took_ms").alias("min_ms"), F.max("took_ms").alias("max_ms"), F.avg("took_ms").alias("mean_ms"), F.coalesce(F.stddev_samp("took_ms"), F.lit(0.0)).alias("stddev_ms"))
    out = out.join(percentiles(samples, list(keys)), list(keys), "left")
    return out.select(*keys, "n", "min_ms", *PERCENTILES, "max_ms", "mean_ms", "stddev_ms")


def latency_rollup(samples: DataFrame) -> DataFrame:
    """The summary of every engine and query, and of every engine over all queries (``query`` null)."""
    overall = latency_summary(samples, "engine")
    return latency_summary(samples, "engine", "query").unionByName(overall.withColumn("query", F.lit(None).cast("string")))


def agreement(hits: DataFrame, baseline: str) -> DataFrame:
    """For each engine and query against the baseline: overlap, Jaccard, Spearman on shared ids (null below two), same first hit.

    ``hits`` has engine, query, id and rank. Queries that neither side answers do not count.
    """
    base = hits.filter(F.col("engine") == baseline).select("query", "id", F.col("rank").alias("rank_b"))
    others = hits.filter(F.col("engine") != baseline)
    engines = others.select("engine").distinct()
    sizes = others.groupBy("engine", "query").agg(F.count(F.lit(1)).alias("n_e"), F.min_by("id", "rank").alias("top_e"))
    wide = engines.crossJoin(base.groupBy("query").agg(F.count(F.lit(1)).alias("n_b"), F.min_by("id", "rank_b").alias("top_b"))).join(sizes, ["engine", "query"], "full")
    shared = others.join(base, ["query", "id"])
    a, b = (F.row_number().over(W.partitionBy("engine", "query").orderBy(c)) for c in ("rank", "rank_b"))
    apart = shared.withColumn("d", a - b).groupBy("engine", "query").agg(F.count(F.lit(1)).alias("overlap"), F.sum(F.col("d") * F.col("d")).alias("d2"))
    out = wide.join(apart, ["engine", "query"], "left").fillna({"overlap": 0, "n_e": 0, "n_b": 0})
    n = F.col("overlap")
    return out.select("engine", "query", "overlap", (n / (F.col("n_e") + F.col("n_b") - n)).alias("jaccard"), F.when(n >= 2, 1 - 6 * F.col("d2") / (n * (n * n - 1))).alias("spearman"), F.coalesce(F.col("top_e") == F.col("top_b"), F.lit(False)).alias("same_top"))


def agreement_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("engine").agg(F.count(F.lit(1)).alias("comparable"), F.avg("overlap").alias("mean_overlap"), F.avg("jaccard").alias("mean_jaccard"), F.avg("spearman").alias("mean_spearman"), F.sum(F.col("same_top").cast("int")).alias("identical_top"))


def disagreements(pairs: DataFrame, limit: int = 20) -> DataFrame:
    return pairs.orderBy("overlap", "engine", "query").limit(limit)


def golden_ranks(golden: DataFrame, hits: DataFrame) -> DataFrame:
    """``engine, query, rank``: the first hit that an entry expects, by id or by a part of the label; null without one."""
    engines = hits.select("engine").distinct()
    wanted = golden.select("query", F.explode("expect").alias("e"))
    by_id = F.lit(False)
    for p in ID_PREFIXES:
        by_id = by_id | F.startswith("e", F.lit(p))
    match = F.when(by_id, F.col("id") == F.col("e")).otherwise(F.contains(F.lower("label"), F.lower("e")))
    found = hits.join(wanted, "query").filter(match).groupBy("engine", "query").agg(F.min("rank").alias("rank"))
    return golden.select("query").distinct().crossJoin(engines).join(found, ["engine", "query"], "left")


def golden_summary(ranks: DataFrame) -> DataFrame:
    within = lambda k: F.sum(F.when(F.col("rank") <= k, 1).otherwise(0))
    return ranks.groupBy("engine").agg(F.count(F.lit(1)).alias("entries"), within(1).alias("hit_1"), within(3).alias("hit_3"), within(10).alias("hit_10"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def verdict(latency: DataFrame, golden: DataFrame) -> DataFrame:
    """One row: fastest and slowest by median, how far apart, and the most relevant engine (null on a tie)."""
    ends = latency.agg(F.min_by("engine", F.struct("p50", "engine")).alias("fastest"), F.max_by("engine", F.struct("p50", "engine")).alias("slowest"), F.round(F.max("p50") / F.min("p50"), 2).alias("p50_factor"), F.round(F.max_by("p95", F.struct("p50", "engine")) / F.min_by("p95", F.struct("p50", "engine")), 2).alias("p95_factor"))
    best = golden.agg(F.max("hit_10").alias("best"))
    at_best = golden.crossJoin(F.broadcast(best)).filter("hit_10 = best").agg(F.when(F.count(F.lit(1)) == 1, F.max("engine")).alias("most_relevant"))
    return ends.crossJoin(at_best)


def rank_comparison(hits: DataFrame, left: str, right: str) -> DataFrame:
    """Two engines' ranks of each (query, document) side by side; ``delta`` is null where only one has it."""
    side = lambda e, n: hits.filter(F.col("engine") == e).select("query", "id", F.col("rank").alias(n))
    return side(left, "rank_left").join(side(right, "rank_right"), ["query", "id"], "full").withColumn("delta", F.col("rank_left") - F.col("rank_right"))


def long_format(summary: DataFrame, section: str, metrics: list[str], query: str | None = None) -> DataFrame:
    """``section, engine, query, metric, value`` rows of a wide summary, for one CSV of everything."""
    wide = summary.select(F.lit(section).alias("section"), "engine", (F.col(query) if query else F.lit("")).alias("query"), *(F.col(m).cast("string").alias(m) for m in metrics))
    return wide.unpivot(["section", "engine", "query"], metrics, "metric", "value")


def rolling_median(samples: DataFrame, last: int = 20) -> DataFrame:
    """The median of an engine's latest samples at every sample, by ``iter``.

    Samples are numbered through and dealt in runs of CHUNK; each run gets the ``last`` - 1 samples before it, so no
    window holds more than a run.
    """
    rows = numbered(samples, "engine", "iter", name="_at").withColumn("_run", F.call_function("div", "_at", F.lit(CHUNK)))
    carried = rows.filter(F.col("_at") % CHUNK > CHUNK - last).withColumns({"_run": F.col("_run") + 1, "_own": F.lit(False)})
    window = W.partitionBy("engine", "_run").orderBy("_at").rowsBetween(1 - last, 0)
    both = rows.withColumn("_own", F.lit(True)).unionByName(carried)
    return both.withColumn("rolling_ms", F.expr("percentile(took_ms, 0.5)").over(window)).filter("_own").select(*samples.columns, "rolling_ms")
