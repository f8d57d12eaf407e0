"""One typed query by the additive method: a lookup and a job for each pass, nothing stored.

A single query asks for a handful of units. Their intervals are looked up by equality in the sorted dictionary and handed
to the plan as constants, so the postings are read from the few buckets and row groups that hold them, each posting says
which units it meets, and one aggregation by document tells who meets all of them. Hits, scores and order are those of
the batch method; only the best rows, and counts of the others, come back.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from wayfold.functions import text as X
from wayfold.operators import retrieval as M
from wayfold.operators.ranking import FUZZY_PENALTY, additive_score, document_side, query_side
from wayfold.plans.index import BLOCK_BITS, LONGEST_GRAM, ROOM_BITS, UNIT, Index, unit_ranges
from wayfold.plans.parse import parse_queries, without_numbers

#: Blocks that are named one by one; more of them are named by their ends.
MOST_BLOCKS = 256
Unit = tuple[str, bool, str]


@dataclasses.dataclass
class Found:
    """The best rows of a query in order, how many documents its first pass admitted, and which pass answered it."""

    rows: list[Row]
    total: int
    passed: str | None


def lookup(index: Index, units: list[Unit]) -> dict[Unit, tuple[int, int]]:
    """The intervals of the units that mean anything."""
    short = [u for u in units if not u[1] or len(u[2]) <= LONGEST_GRAM]
    either = lambda found, column: F.lit(False) if not found else _any([(F.col("field") == f) & (F.col(column) == t) for f, _, t in found])
    whole, opened = [u for u in short if not u[1]], [u for u in short if u[1]]
    terms = index.terms.filter(either(whole, "term")).select("field", F.lit(False).alias("open"), F.col("term").alias("text"), F.col("ord").alias("lo"), F.col("ord").alias("hi"))
    heads = index.prefixes.filter(either(opened, "gram")).select("field", F.lit(True).alias("open"), F.col("gram").alias("text"), "lo", "hi")
    long = [u for u in units if u not in short]
    every = terms.unionByName(heads)
    if long:
        every = every.unionByName(unit_ranges(index.spark.createDataFrame(long, "field string, open boolean, text string"), index).select(*UNIT, "lo", "hi"))
    return {(r.field, r.open, r.text): (r.lo, r.hi) for r in every.collect()}  # a row a unit


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _blocks(ranges: list[tuple[int, int]]) -> Column:
    shift = ROOM_BITS + BLOCK_BITS
    ends = [(lo >> shift, hi >> shift) for lo, hi in ranges]
    if sum(b - a + 1 for a, b in ends) <= MOST_BLOCKS:
        return F.col("block").isin(*sorted({b for a, z in ends for b in range(a, z + 1)}))
    return _any([F.col("block").between(a, b) for a, b in ends])


def admitted(index: Index, tokens: list[str], bare: bool, name: str) -> DataFrame | None:
    """``id, ft_score`` of the documents of both gates; nothing where no unit means anything."""
    tokens = list(dict.fromkeys(tokens))
    slots: list[Unit] = [("search_text", bare or not _is_numeric(t), t) for t in tokens]
    start: Unit = ("name_start", True, name)
    known = lookup(index, [*slots, *([start] if name else [])])
    full = bool(slots) and all(s in known for s in slots)
    wanted = [known[s] for s in slots] if full else []
    if not wanted and start not in known:
        return None
    rare = F.log10(F.lit(index.haystacks) / F.col("df"))
    meets = [F.col("ord").between(lo, hi) for lo, hi in wanted]
    parts = [F.sum(F.when(m, rare * rare * F.col("tf") if len(s[2]) >= M.LEAST_FULLTEXT else F.lit(0.0))).alias(f"ft{k}") for k, (m, s) in enumerate(zip(meets, slots))]
    opens = F.max(F.col("ord").between(*known[start])) if start in known else F.max(F.lit(False))
    posted = index.postings.filter(_blocks([*wanted, *([known[start]] if start in known else [])]))
    met = posted.groupBy("id").agg(*parts, opens.alias("named"))
    of_all, score = F.lit(full), F.lit(0.0)
    for k in range(len(parts)):
        of_all, score = of_all & F.col(f"ft{k}").isNotNull(), score + F.coalesce(F.col(f"ft{k}"), F.lit(0.0))
    return met.withColumn("of_all", of_all).filter("of_all or named").select("id", F.when(F.col("of_all"), score).otherwise(0.0).alias("ft_score"))


def _is_numeric(token: str) -> bool:
    return re.fullmatch(X.NUMERIC, token) is not None


def fulltext_one(query: str, index: Index, limit: int = 10, types: list[str] | None = None, fuzzy: bool = True, tier_sort: bool = True, debug: bool = False, house_numbers_indexed: bool = False) -> Found:
    """As ``suggest_fulltext`` for one query. ``rows`` have ``suggestion`` (JSON), ``rank``, ``pass``, and with ``debug`` the parts."""
    spark = index.spark
    parsed = parse_queries(spark.createDataFrame([("q", query)], "query_id string, query string"), house_numbers_indexed=house_numbers_indexed)
    parsed = parsed.withColumn("fewer", without_numbers(F.col("locative")))
    clean = {c: X.sanitize_tokens(F.col(c)).alias(f"clean_{c}") for c in ("locative", "fewer")}
    asked = M.with_relaxed(parsed).select(*M._QUERY, "fewer", "target", "relaxed", *clean.values()).first()
    if not asked.locative:
        return Found([], 0, None)
    side = query_side(spark.createDataFrame([tuple(asked[c] for c in M._QUERY)], parsed.select(*M._QUERY).schema))
    docs = document_side(index.docs.filter(F.col("doc_type").isin(*types)) if types else index.docs)
    order = [*([F.asc("rank_tier")] if tier_sort else []), F.desc("score"), F.desc("popularity"), F.asc("id")]

    def run(tokens: list[str], name: list[str], label: str, without: list[str] = ()) -> tuple[list[Row], int]:
        pairs = admitted(index, tokens, asked.bare_numeric, " ".join(name))
        if pairs is None:
            return [], 0
        rows = additive_score(pairs.withColumn("query_id", F.lit("q")).join(docs, "id").join(F.broadcast(side), "query_id"), debug)
        if label == "fuzzy":
            target = F.lit(asked.target)
            rows = rows.withColumn("distance", X.name_distance(target, F.col("primary_name_norm"))).filter(F.col("distance") <= X.max_distance(target))
            similar = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("distance") / F.length(target))
            rows = rows.withColumn("score", F.col("score") * similar - FUZZY_PENALTY)
            rows = rows.filter(~F.col("id").isin(*without)) if without else rows
        seen = Observation()
        rows = rows.withColumn("score", F.round("score", M.PLACES)).observe(seen, F.count(F.lit(1)).alias("n"))
        best = rows.orderBy(*order).limit(limit).withColumns({"rank": F.lit(0), "pass": F.lit(label)})
        more = ["pass", "id", "rank_tier", "score", "popularity", "house_number", *(["debug"] if debug else [])]
        got = M.response(best, *(F.col(c).alias(f"_{c}") for c in more)).collect()
        return got, seen.get["n"]

    found, total = run(asked.clean_locative, asked.locative, "exact")
    passed, n = "exact" if total else None, total
    if not n and asked.number_tokens and not asked.bare_numeric:
        found, n = run(asked.clean_fewer, asked.fewer, "no_number")
        passed = "no_number" if n else None
    numbered = any(r["_house_number"] in asked.number_tokens for r in found)
    if fuzzy and n < limit and not numbered and asked.target:
        gate = [*(t for t in asked.locative if t != asked.target), asked.relaxed]
        more, n = run(gate, [asked.relaxed], "fuzzy", [r["_id"] for r in found])
        passed = passed or ("fuzzy" if n else None)
        found = sorted([*found, *more], key=lambda r: (r["_rank_tier"] if tier_sort else 0, -r["_score"], -r["_popularity"], r["_id"]))[:limit]
    return Found(found, total, passed)
