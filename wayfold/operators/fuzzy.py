"""Misspelt tokens against a vocabulary.

Texts within two edits (an exchange of neighbours is one) have a text in common that each becomes by losing at most two
characters, and so have their first STEM characters. A vocabulary is therefore filed by its stems, and its stems under
all that they become by losing up to two characters: a token asks for what its own stem becomes and meets the stems that
are near, by equality alone; only terms of these stems and of about its length are measured.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters by which terms are filed. The first one is never misspelt, so a stem has at most 22 variants.
STEM = 7


def allowed_edits(token: Column) -> Column:
    """0 below three characters, 1 up to five, 2 above."""
    return F.when(F.length(token) < 3, 0).when(F.length(token) <= 5, 1).otherwise(2)


def swaps(token: Column) -> Column:
    """All strings that differ by one exchange of neighbouring characters."""
    at = F.when(F.length(token) > 1, F.sequence(F.lit(1), F.length(token) - 1))
    one = lambda i: F.concat(F.left(token, i - 1), F.substr(token, i + 1, F.lit(1)), F.substr(token, i, F.lit(1)), F.substr(token, i + 2))
    return F.coalesce(F.transform(at, one), F.array().cast("array<string>"))


def swap_distance(a: Column, b: Column) -> Column:
    """Edit distance in which an exchange of neighbours is one edit; exact up to two.

    One edit: a plain edit or an exchange. Two: two plain edits, an exchange in ``a`` and one edit of the result, or an
    exchange in each text that makes them equal.
    """
    plain = F.levenshtein(a, b)
    swapped = F.array_min(F.transform(swaps(a), lambda s: F.levenshtein(s, b))) + 1
    both = F.when(F.arrays_overlap(swaps(a), swaps(b)), 2)
    return F.least(plain, F.coalesce(swapped, plain), F.coalesce(both, plain))


def shortened(text: Column) -> Column:
    """All strings that the text becomes by losing one character after the first."""
    at = F.when(F.length(text) > 1, F.sequence(F.lit(2), F.length(text)))
    return F.coalesce(F.transform(at, lambda i: F.concat(F.left(text, i - 1), F.substr(text, i + 1))), F.array().cast("array<string>"))


def variants(text: Column, edits: Column) -> Column:
    """The text and what it becomes by losing up to ``edits`` (two at most) characters after the first."""
    none = F.array().cast("array<string>")
    once = F.when(edits > 0, shortened(text)).otherwise(none)
    twice = F.when(edits > 1, F.flatten(F.transform(shortened(text), shortened))).otherwise(none)
    return F.array_distinct(F.concat(F.array(text), once, twice))


def stem(text: Column) -> Column:
    return F.left(text, F.lit(STEM))


@dataclasses.dataclass
class Neighbours:
    """A vocabulary filed for misspellings: ``variants`` (variant, stem) and ``members`` (stem, size, term)."""

    variants: DataFrame
    members: DataFrame

    @classmethod
    def of(cls, terms: DataFrame) -> Neighbours:
        """``terms`` has ``term``; repeated terms and empty ones do no harm."""
        members = terms.filter("term <> ''").distinct().select(stem(F.col("term")).alias("stem"), F.length("term").alias("size"), "term")
        stems = members.select("stem").distinct()
        return cls(stems.select(F.explode(variants(F.col("stem"), F.lit(2))).alias("variant"), "stem"), members)

    def near_stems(self, tokens: DataFrame) -> DataFrame:
        """``token, edits, stem``: the stems that may begin a text within a token's edits."""
        t = tokens.select("token").distinct().withColumn("edits", allowed_edits(F.col("token")))
        asked = t.withColumn("variant", F.explode(variants(stem(F.col("token")), F.col("edits"))))
        return asked.join(self.variants, "variant").select("token", "edits", "stem").distinct()


def candidate_terms(tokens: DataFrame, near: Neighbours) -> DataFrame:
    """``token, edits, term``: what is measured: the terms of near stems whose length differs by no more than the edits."""
    found = near.near_stems(tokens).join(near.members, "stem")
    return found.filter(F.abs(F.length("token") - F.col("size")) <= F.col("edits")).select("token", "edits", "term")


def fuzzy_terms(tokens: DataFrame, near: Neighbours) -> DataFrame:
    """``token, term, distance``: the terms within a token's edits that share its first character."""
    # an exchange is two plain edits, so twice the edits bound the plain distance, which is cheap to bound
    found = candidate_terms(tokens, near).filter(F.levenshtein("token", "term", 4) >= 0).withColumn("distance", swap_distance(F.col("token"), F.col("term")))
    return found.filter("distance <= edits").select("token", "term", "distance")
