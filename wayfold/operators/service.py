"""One typed query against the methods: request parameters, answers in their outward shape, health."""

from __future__ import annotations

import dataclasses
import json
import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import retrieval as M
from wayfold.operators.single import fulltext_one
from wayfold.plans.index import Index
from wayfold.plans.parse import parse_queries
from wayfold.schema import TYPES, EngineConfig
from wayfold.sources.scratch import scope

# Bounds of a request.
DEFAULT_LIMIT, MOST_LIMIT, LONGEST_QUERY = 10, 50, 120
# What turns a flag off, and what turns a setting on.
OFF, ON = ("0", "false", "no", "off"), ("1", "true", "yes", "on")


def config_from(environment: Mapping[str, str]) -> EngineConfig:
    """Settings by name; a setting that is not there keeps its default."""
    flag = lambda name, default: environment[name].strip().lower() in ON if environment.get(name) else default
    base = EngineConfig()
    return EngineConfig(flag("HOUSE_NUMBERS_INDEXED", base.house_numbers_indexed), flag("TIER_SORT", base.tier_sort), base.fuzzy, base.limit, flag("FULLTEXT_ENABLED", base.fulltext_enabled))


@dataclasses.dataclass(frozen=True)
class Request:
    query: str
    limit: int = DEFAULT_LIMIT
    types: tuple[str, ...] = ()
    fuzzy: bool = True
    methods: tuple[str, ...] = ()
    explain: bool = False


def available(config: EngineConfig) -> list[str]:
    return [m for m in M.REGISTRY if config.fulltext_enabled or m != "fulltext"]


def parse_request(params: Mapping[str, object], config: EngineConfig = EngineConfig()) -> Request:
    """A request out of loose parameters: what is missing or makes no sense becomes the default, never an error.

    A limit below one is the default, above fifty is fifty. Unknown types are left out, none means all. Unknown methods
    are left out, none means all, in the registry's order.
    """

    def flag(name: str, default: bool) -> bool:
        value = params.get(name)
        return value.strip().lower() not in OFF if isinstance(value, str) else default

    def names(name: str) -> list[str]:
        value = params.get(name)
        return [x.strip().lower() for x in value.split(",")] if isinstance(value, str) else []

    raw = params.get("q")
    query = raw.strip()[:LONGEST_QUERY] if isinstance(raw, str) else ""
    try:
        limit = int(params.get("limit", config.limit))
    except (TypeError, ValueError):
        limit = 0
    limit = DEFAULT_LIMIT if limit < 1 else min(limit, MOST_LIMIT)
    types = tuple(dict.fromkeys(t for t in names("types") if t in TYPES))
    chosen = tuple(m for m in M.choose_methods(",".join(names("engine"))) if m in available(config))
    return Request(query, limit, types, flag("fuzzy", config.fuzzy), chosen or tuple(available(config)), flag("explain", False))


def run_method(method: str, queries: DataFrame, index: Index, request: Request, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The hits of one method for parsed queries."""
    more = {} if method == "completion" else {"tier_sort": config.tier_sort}
    if request.explain and method in M.METHODS:
        more["explain"] = True
    if request.explain and method == "fulltext":
        more["debug"] = True
    return M.REGISTRY[method](queries, index, limit=request.limit, types=list(request.types) or None, fuzzy=request.fuzzy, **more)


def candidates(method: str, queries: DataFrame, index: Index, request: Request) -> DataFrame:
    """``query_id, id`` of whom a method's first gate admits."""
    types = list(request.types) or None
    if method == "fulltext":
        return M.fulltext_gate(queries, index, types).select("query_id", "id").union(M.name_prefix_gate(queries, index, types)).distinct()
    if method == "completion":
        return M.suggest_completion(queries, index, M.MOST_TOTAL + 1, types, request.fuzzy).select("query_id", "id")
    return M.gate(queries, index, types=types)


def _entry(method: str, took: float, admitted: int, found: list[dict], debug: list) -> dict:
    total = max(min(admitted, M.MOST_TOTAL), len(found))
    return {
        "engine": method, "label": M.LABELS[method][0], "took_ms": round(took, 2), "total": total, "relation": "gte" if admitted > M.MOST_TOTAL else "eq",
        "count": len(found), "suggestions": found, "debug": debug,
    }


def suggest(spark: SparkSession, request: Request, index: Index, config: EngineConfig = EngineConfig()) -> dict:
    """``query`` and, for every method, its answer or its error: one that fails does not take the others along."""
    queries = parse_queries(spark.createDataFrame([(request.query, request.query)], "query_id string, query string"), house_numbers_indexed=config.house_numbers_indexed)
    results = {}
    for method in request.methods or available(config):
        began = time.time()
        try:
            if method == "fulltext":
                answer = fulltext_one(request.query, index, request.limit, list(request.types) or None, request.fuzzy, config.tier_sort, request.explain, config.house_numbers_indexed)
                took = (time.time() - began) * 1000
                found = [json.loads(r.suggestion) for r in answer.rows]
                results[method] = _entry(method, took, answer.total, found, [r["_debug"].asDict() for r in answer.rows] if request.explain else [])
                continue
            with scope(spark):  # what the method stores goes with the answer
                hits = run_method(method, queries, index, request, config)
                keep = [c for c in ("parts", "debug") if c in hits.columns]
                shown = M.response(hits, *keep).orderBy("rank").collect()  # limit rows
                took = (time.time() - began) * 1000
                total = candidates(method, queries, index, request).agg(F.count(F.lit(1)).alias("n")).first()
            found = [json.loads(r.suggestion) for r in shown]
            results[method] = _entry(method, took, total.n if total else 0, found, [r[c] for r in shown for c in keep])
        except Exception as problem:  # an answer like any other
            results[method] = {"engine": method, "error": str(problem)[:200]}
    return {"query": request.query, "limit": request.limit, "types": list(request.types) or list(TYPES), "results": results}


def health(stores: Mapping[str, object]) -> dict:
    """``ok`` where every store is, and what each says."""
    found = {name: store.health() for name, store in stores.items()}
    return {"ok": all(h["ok"] for h in found.values()), "stores": found}
