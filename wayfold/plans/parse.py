"""Parsed queries as columns: which tokens narrow a search, which are address detail, which is still being typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import text as X


def detail_flags(tokens: Column, house_numbers_indexed: bool = False) -> Column:
    """For each token, whether it is address detail: one pass from the left with the token before and its flag.

    Detail are box markers, what follows one, a lone ``b`` after a house number or detail, and house numbers as long as
    no document carries any.
    """
    start = F.struct(F.lit("").alias("before"), F.lit(False).alias("flag"), F.array().cast("array<boolean>").alias("flags"))

    def step(acc: Column, t: Column) -> Column:
        number = F.lit(False) if house_numbers_indexed else X.is_house_number(t)
        lone = (t == "b") & (acc["flag"] | X.is_house_number(acc["before"]))
        value = acc["flag"] & (X.is_box_marker(acc["before"]) | (acc["before"] == "b"))
        flag = number | X.is_box_marker(t) | lone | value
        return F.struct(t.alias("before"), flag.alias("flag"), F.concat(acc["flags"], F.array(flag)).alias("flags"))

    return F.aggregate(tokens, start, step)["flags"]


def parse_queries(queries: DataFrame, raw: str = "query", house_numbers_indexed: bool = False) -> DataFrame:
    """``queries`` with tokens, locative, detail, bare_numeric, typing_locative, number_tokens, needed and prefix.

    ``needed`` are the distinct tokens that must match as whole words, ``prefix`` the one still being typed, or null.
    """
    q = queries.withColumn("tokens", X.tokenize(X.clean_query(F.col(raw))))
    q = q.withColumn("flags", detail_flags(F.col("tokens"), house_numbers_indexed))
    q = q.withColumn("flags", F.when(F.forall("flags", lambda f: f), F.transform("flags", lambda f: F.lit(False))).otherwise(F.col("flags")))
    pick = lambda want: F.filter("tokens", lambda t, i: F.element_at("flags", i + 1) == F.lit(want))
    q = q.withColumns({"locative": pick(False), "detail": pick(True), "bare_numeric": (F.size("tokens") > 0) & F.forall("tokens", X.is_numeric)})
    last = F.coalesce(F.try_element_at("tokens", F.lit(-1)), F.lit(""))
    typing = (F.size("tokens") > 0) & ~F.try_element_at("flags", F.lit(-1)) & (F.col("bare_numeric") | ~X.is_numeric(last))
    q = q.withColumns({"last_token": last, "typing_locative": F.coalesce(typing, F.lit(False)), "normalized": F.array_join("tokens", " "), "number_tokens": F.array_distinct(F.filter("tokens", lambda t: X.is_numeric(t) & ~X.is_postcode(t)))})
    return with_gate(q.drop("flags"), "locative")


def with_gate(q: DataFrame, tokens: str) -> DataFrame:
    """``needed`` and ``prefix`` out of the tokens that narrow the search, and these tokens in order as ``gated``."""
    whole = F.when(F.col("typing_locative"), F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(F.col(tokens))
    return q.withColumns({"gated": F.col(tokens), "needed": F.array_distinct(whole), "prefix": F.when(F.col("typing_locative"), F.try_element_at(F.col(tokens), F.lit(-1)))})


def without_numbers(tokens: Column) -> Column:
    """The tokens less the numbers, unless there is nothing else."""
    named = F.filter(tokens, lambda t: ~X.is_numeric(t))
    return F.when(F.size(named) == 0, tokens).otherwise(named)
