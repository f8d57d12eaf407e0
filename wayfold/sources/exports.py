"""Readers of the register and place exports, query lists and golden sets."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import text as X
from wayfold.sources.quoted import read_quoted
from wayfold.schema import PLACE_COLUMNS, PLACES, REGISTER, REGISTER_COLUMNS, ImportOptions


class HeaderError(ValueError):
    """A file whose header is not the expected one."""


def normal_header(columns: list[str]) -> list[str]:
    """The header with its two projected-coordinate names brought to the usual EPSG code."""
    return [re.sub(r"^EPSG:\d+_([xy])$", r"EPSG:31370_\1", c) if i < 2 else c for i, c in enumerate(columns)]


def check_header(spark: SparkSession, path: str, expected: tuple[str, ...]) -> None:
    """Raises before anything is read or deleted; the first line comes through Spark, so any store will do."""
    first = spark.read.option("lineSep", "\n").text(path).limit(1).collect()
    found = normal_header([c.strip().strip('"') for c in first[0][0].lstrip("﻿").rstrip("\r").split(",")] if first else [])
    if found != list(expected):
        raise HeaderError(f"{path}: header {found} is not {list(expected)}")


def distinct_paths(paths: list[str]) -> list[str]:
    """Paths in order, those that name the same file once."""
    seen: dict[str, str] = {}
    for p in paths:
        seen.setdefault(p if "://" in p else os.path.realpath(p), p)
    return list(seen.values())


def usable(rows: DataFrame, postcodes: tuple[str, ...] = ()) -> DataFrame:
    """Register rows that are current and have a postcode (one of ``postcodes``, if any are given) and coordinates."""
    ok = (X.trimmed(F.col("status")) == "current") & (X.trimmed(F.col("postcode")) != "") & (F.col("lat") != "") & (F.col("lon") != "")
    return rows.filter(ok & F.col("postcode").isin(*postcodes) if postcodes else ok)


def first_rows(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows of a file; every task keeps its own first ones, so no task sees the whole file."""
    return rows if limit is None else rows.orderBy("ord").limit(limit)


def read_register(spark: SparkSession, paths: list[str], options: ImportOptions = ImportOptions()) -> DataFrame:
    """Usable register rows of all files with ``file`` and ``ord``; a limit counts usable rows of each file."""
    paths = distinct_paths(paths)
    for p in paths:
        check_header(spark, p, REGISTER_COLUMNS)
    parts = [first_rows(usable(read_quoted(spark, p, REGISTER).fillna(""), options.postcodes), options.limit) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_places(spark: SparkSession, path: str, options: ImportOptions = ImportOptions()) -> DataFrame:
    """Raw place rows with ``file`` and ``ord``; a limit counts raw rows. Blank lines are no rows."""
    check_header(spark, path, PLACE_COLUMNS)
    return first_rows(read_quoted(spark, path, PLACES), options.limit)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``query, ord``: distinct lines in order of appearance, without blanks and # comments."""
    lines = spark.read.text(path).select(X.trimmed(F.col("value")).alias("query"), F.monotonically_increasing_id().alias("ord"))
    return lines.filter((F.col("query") != "") & ~F.col("query").startswith("#")).groupBy("query").agg(F.min("ord").alias("ord"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """``query, expect, note`` of a golden file: an object with ``entries``, or a bare array."""
    entry = "struct<query:string,expect:array<string>,note:string>"
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("j"))
    wrapped = F.from_json("j", f"struct<entries:array<{entry}>>")["entries"]
    rows = raw.select(F.explode(F.coalesce(wrapped, F.from_json("j", f"array<{entry}>"))).alias("e")).select("e.*")
    return rows.filter(F.col("query").isNotNull() & (F.size("expect") > 0))
