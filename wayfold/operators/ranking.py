"""Scores and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import text as X
from wayfold.schema import TYPES

# Weights of the additive score.
W_QUERY_PREFIX, W_EXACT_NAME, W_LAST_TOKEN, W_FIRST_TOKEN = 60.0, 25.0, 28.0, 18.0
W_WORD_PREFIX, W_CONTEXT, W_POSTCODE, W_HOUSE_NUMBER, W_POPULARITY, FULLTEXT_CAP = 8.0, 10.0, 18.0, 20.0, 2.0, 10.0
# Type weights of the additive score, with and without a house number in the query.
TYPE_WEIGHTS = {
    True: {"municipality": 12.0, "postcode": 10.0, "place": 15.0, "street": 2.0, "address": 14.0},
    False: {"municipality": 12.0, "postcode": 10.0, "place": 8.0, "street": 4.0, "address": -20.0},
}
# BM25 parameters and the ceiling of the popularity factor.
K1, B, MAX_BOOST = 1.2, 0.75, 15.0
FUZZY_PENALTY = 15.0


def _one(condition: Column, weight: float) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), weight).otherwise(0.0)


def _by_type(values: dict[str, float]) -> Column:
    out = F
    for name, value in values.items():
        out = out.when(F.col("doc_type") == name, value)
    return out.otherwise(values["address"])


def document_side(docs: DataFrame) -> DataFrame:
    """``docs`` with what the additive score asks of a document alone, made before documents meet queries."""
    folded = {"doc_municipality": X.normalize(F.col("municipality_name")), "doc_post": X.normalize(F.coalesce("post_name", F.lit("")))}
    return docs.withColumns(folded | {"doc_words": F.concat(F.lit(" "), "search_text", F.lit(" "))})


def query_side(queries: DataFrame) -> DataFrame:
    """``queries`` with what the additive score asks of a query alone, made before queries meet documents."""
    tokens = F.col("locative")
    made = {
        "asked_joined": F.array_join(tokens, " "),
        "asked_first": F.when(F.size(tokens) > 1, F.element_at(tokens, 1)),
        "asked_last": F.try_element_at(tokens, F.lit(-1)),
        "asked_lands": F.filter(tokens, lambda t: ~t.rlike("^[0-9]+$")),
        "asked_postcode": F.try_element_at(F.filter("tokens", X.is_postcode), F.lit(1)),
        "asked_number": F.try_element_at(F.filter("tokens", X.is_house_number), F.lit(1)),
    }
    return queries.withColumns(made)


def components() -> dict[str, Column]:
    """The parts of the additive score, by name, over a row of ``query_side`` and ``document_side``."""
    name, joined, first, last = (F.col(c) for c in ("primary_name_norm", "asked_joined", "asked_first", "asked_last"))
    postcode, number = F.col("asked_postcode"), F.col("asked_number")
    lands = F.filter("asked_lands", lambda t: F.startswith(F.col("doc_municipality"), t) | F.startswith(F.col("doc_post"), t))
    in_text = F.contains("doc_words", F.concat(F.lit(" "), number, F.lit(" ")))
    return {
        "fulltext": F.least(F.coalesce("ft_score", F.lit(0.0)), F.lit(FULLTEXT_CAP)),
        "hit_query_prefix": _one(F.startswith(name, joined), W_QUERY_PREFIX),
        "hit_exact_name": _one(name == joined, W_EXACT_NAME),
        "hit_last_token": _one(first.isNotNull() & F.startswith(name, last), W_LAST_TOKEN),
        "hit_first_token": _one(F.startswith(name, first), W_FIRST_TOKEN),
        "hit_word_prefix": _one(F.contains(name, F.concat(F.lit(" "), last)), W_WORD_PREFIX),
        "hit_context": F.size(lands) * F.lit(W_CONTEXT),
        "hit_postcode": _one(F.col("postcode") == postcode, W_POSTCODE),
        "hit_house_number": _one((F.col("house_number") == number) | (F.col("house_number").isNull() & in_text), W_HOUSE_NUMBER),
        "type_weight": F.when(number.isNotNull(), _by_type(TYPE_WEIGHTS[True])).otherwise(_by_type(TYPE_WEIGHTS[False])),
        "popularity": F.log10(F.lit(10) + F.col("popularity")) * F.lit(W_POPULARITY),
    }


def additive_score(rows: DataFrame, debug: bool = False) -> DataFrame:
    """``score``, and with ``debug`` a struct of its parts."""
    parts = components()
    total = sum(parts.values(), F.lit(0.0))
    rows = rows.withColumn("debug", F.struct(*(c.alias(k) for k, c in parts.items()))) if debug else rows
    return rows.withColumn("score", total).drop(*(c for c in rows.columns if c.startswith(("asked_", "doc_")) and c != "doc_type"))


def popularity_factor() -> Column:
    """What the relevance of a document is multiplied with: log10(1 + popularity / 2) times its type's weight, 15 at most."""
    weight = F
    for name, (_, w, _) in TYPES.items():
        weight = weight.when(F.col("doc_type") == name, w)
    return F.least(F.lit(MAX_BOOST), F.log10(F.lit(1.0) + F.lit(0.5) * F.coalesce("popularity", F.lit(1))) * weight.otherwise(1.0))


def idf(docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (docs - df + 0.5) / (df + 0.5))


def length_norm(dl: Column, avgdl: Column) -> Column:
    return F.lit(1 - B) + F.lit(B) * dl / avgdl


def bm25(boost: float | Column, rarity: Column, tf: Column, norm: Column | None = None) -> Column:
    """One term's contribution (or a phrase's); without ``norm`` its field has no length norm."""
    boost = F.lit(boost) if isinstance(boost, float) else boost
    return boost * (K1 + 1) * rarity * tf / (tf + F.lit(K1) * (F.lit(1.0) if norm is None else norm))


def top_k(rows: DataFrame, limit: int, tier_sort: bool = True, by: str = "query_id") -> DataFrame:
    """The ``limit`` best rows of each query with ``rank``; ties go by popularity, then id, so the order is total."""
    order = [F.desc("score"), F.desc("popularity"), F.asc("id")]
    window = W.partitionBy(by).orderBy(*([F.asc("rank_tier")] if tier_sort else []), *order)
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= limit)


def merge_candidates(passes: list[DataFrame]) -> DataFrame:
    """The union of candidate passes with the best score of each (query, document); ties keep the earlier pass."""
    out = None
    for number, p in enumerate(passes):
        p = p.withColumn("pass_no", F.lit(number))
        out = p if out is None else out.unionByName(p)
    window = W.partitionBy("query_id", "id").orderBy(F.desc("score"), F.asc("pass_no"))
    return out.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")
