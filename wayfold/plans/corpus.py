"""Documents out of register rows and place rows."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import text as X
from wayfold.operators.ranking import top_k
from wayfold.schema import DOCUMENT, TYPES, ImportOptions
from wayfold.sources.scratch import stored

#: Popularity of a venue: it stands for no number of addresses.
PLACE_POPULARITY = 24
# Order of preference among a venue's languages.
LANGUAGES = ("nl", "fr", "de", "en")


def tier(doc_type: Column) -> Column:
    out = F
    for name, (t, _, _) in TYPES.items():
        out = out.when(doc_type == name, t)
    return out.otherwise(max(t for t, _, _ in TYPES.values()) + 1).cast("tinyint")


def finish(docs: DataFrame, *more: str) -> DataFrame:
    """Missing columns as nulls, and the derived ones: haystack, primary name, tier. Columns in ``more`` stay."""
    have = {c: F.lit(None).cast(DOCUMENT[c].dataType) for c in ("place_name", "street_name", "house_number", "box_number", "postcode", "post_name", "nis_code", "lat", "lon") if c not in docs.columns}
    docs = docs.withColumns(have) if have else docs
    parts = [F.col(c) for c in ("place_name", "street_name", "house_number", "postcode", "post_name", "municipality_name")]
    name = X.primary_name(*(F.col(c) for c in ("doc_type", "place_name", "street_name", "postcode", "municipality_name")))
    docs = docs.withColumns({"search_text": X.haystack(*parts, F.array_join("aliases", " ")), "primary_name": name})
    docs = docs.withColumns({"primary_name_norm": X.normalize(F.col("primary_name")), "rank_tier": tier(F.col("doc_type"))})
    return docs.select(*(F.col(f.name).cast(f.dataType) for f in DOCUMENT), *more)


def _batch_order(rows: DataFrame) -> Column:
    """Where a row stands among all rows of an import: of several documents of an id the last one counts."""
    return F.struct(*(c for c in ("file", "ord") if c in rows.columns))


def _cell(name: str) -> Column:
    return X.trimmed(F.coalesce(F.col(name), F.lit("")))


def clean_cells(rows: DataFrame) -> DataFrame:
    names = [c for c in rows.columns if c not in ("ord", "file", "lat", "lon")]
    return rows.withColumns({c: _cell(c) for c in names} | {c: F.col(c).cast("double") for c in ("lat", "lon")})


_FIRST = ("streetname_nl", "streetname_fr", "streetname_de", "postname_nl", "postname_fr", "municipality_id", "municipality_name_nl", "municipality_name_fr", "municipality_name_de")


def aggregate(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: first-seen attributes (by file, then order in it), mean coordinates, number of addresses."""
    order = [c for c in ("file", "ord") if c in rows.columns]
    first = F.min_by(F.struct(*(c for c in _FIRST if c not in keys)), F.struct(*order))
    out = rows.groupBy(*keys).agg(first.alias("f"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("popularity"))
    return out.select(*keys, "f.*", "lat", "lon", "popularity")


def aggregate_all(rows: DataFrame) -> DataFrame:
    """All three groupings in one pass by grouping sets; ``level`` names a row's grouping."""
    order = [c for c in ("file", "ord") if c in rows.columns]
    # rows that stand for several count as many times
    n = F.sum("copies") if "copies" in rows.columns else F.count(F.lit(1))
    mean = lambda c: F.sum(F.col(c) * F.col("copies")) / n if "copies" in rows.columns else F.avg(c)
    keyed = rows.withColumns({"k_street": F.col("street_id"), "k_postcode": F.col("postcode"), "k_nis": F.col("municipality_id")})
    sets = [[F.col("k_street"), F.col("k_postcode")], [F.col("k_nis")], [F.col("k_postcode")]]
    grouped = keyed.groupingSets(sets, "k_street", "k_postcode", "k_nis")
    out = grouped.agg(F.grouping_id().alias("g"), F.min_by(F.struct(*_FIRST), F.struct(*order)).alias("f"), mean("lat").alias("lat"), mean("lon").alias("lon"), n.alias("popularity"))
    level = F.when(F.col("g") == 1, "street").when(F.col("g") == 6, "municipality").otherwise("postcode")
    return out.select(level.alias("level"), "k_street", "k_postcode", "k_nis", "f.*", "lat", "lon", "popularity")


def _locality() -> tuple[Column, Column, Column]:
    municipality = X.title_case(F.col("municipality_name_nl"))
    parts = X.post_name_parts(F.col("postname_nl"))
    return municipality, X.display_post_name(parts, municipality), F.concat(parts, X.post_name_parts(F.col("postname_fr")))


def street_documents(rows: DataFrame) -> DataFrame:
    return _streets(aggregate(rows, "street_id", "postcode"))


def municipality_documents(rows: DataFrame) -> DataFrame:
    return _municipalities(aggregate(rows, "municipality_id"))


def postcode_documents(rows: DataFrame) -> DataFrame:
    return _postcodes(aggregate(rows, "postcode"))


def _streets(s: DataFrame) -> DataFrame:
    municipality, post_name, parts = _locality()
    name = X.pick_name(*(F.col(f"streetname_{x}") for x in ("nl", "fr", "de")))
    s = s.withColumns({"name": name, "municipality_name": municipality, "post_name": post_name, "parts": parts}).filter("name <> ''")
    other = X.aliases([F.col("streetname_fr"), F.col("streetname_de")], F.col("parts"), F.col("municipality_name"), [F.col("municipality_name_fr"), F.col("municipality_name_de")])
    label = X.address_line(F.col("name"), F.col("postcode"), F.col("post_name"), F.col("municipality_name"))
    return finish(s.select(F.concat(F.lit("street:"), "street_id", F.lit("|"), "postcode").alias("id"), F.lit("street").alias("doc_type"), label.alias("label"), F.col("name").alias("street_name"), "postcode", "post_name", "municipality_name", F.col("municipality_id").alias("nis_code"), "lat", "lon", "popularity", other.alias("aliases")))


def _municipalities(m: DataFrame) -> DataFrame:
    name = X.title_case(X.pick_name(*(F.col(f"municipality_name_{x}") for x in ("nl", "fr", "de"))))
    m = m.withColumn("municipality_name", name).filter("municipality_name <> ''")
    other = F.filter(F.array(*(X.title_case(F.col(f"municipality_name_{x}")) for x in ("fr", "de"))), lambda a: (a != "") & (a != F.col("municipality_name")))
    return finish(m.select(F.concat(F.lit("municipality:"), "municipality_id").alias("id"), F.lit("municipality").alias("doc_type"), F.col("municipality_name").alias("label"), "municipality_name", F.col("municipality_id").alias("nis_code"), "lat", "lon", "popularity", other.alias("aliases")))


def _postcodes(p: DataFrame) -> DataFrame:
    municipality, post_name, parts = _locality()
    p = p.withColumns({"municipality_name": municipality, "post_name": post_name, "parts": parts})
    other = X.aliases([], F.col("parts"), F.col("municipality_name"), [F.col("municipality_name_fr"), F.col("municipality_name_de")])
    label = F.when(F.col("post_name") == "", F.col("postcode")).otherwise(F.concat_ws(" ", "postcode", "post_name"))
    return finish(p.select(F.concat(F.lit("postcode:"), "postcode").alias("id"), F.lit("postcode").alias("doc_type"), label.alias("label"), "postcode", "post_name", "municipality_name", F.col("municipality_id").alias("nis_code"), "lat", "lon", "popularity", other.alias("aliases")))


def address_ident() -> Column:
    return F.concat_ws(":", F.lit("address"), F.nullif(F.col("region_code"), F.lit("")), "address_id")


def address_documents(rows: DataFrame, ordered: bool = False) -> DataFrame:
    """One document a row; its popularity is the number of addresses in its street.

    What addresses share is formatted once: the rows are counted by all that names, aliases and localities are made of,
    and meet the few results again. ``rows`` are cleaned, so no cell of theirs is null.
    """
    shared = ["street_id", "postcode", *_FIRST]
    counts = rows.groupBy("street_id", "postcode").agg((F.sum("copies") if "copies" in rows.columns else F.count(F.lit(1))).alias("popularity"))
    municipality, post_name, parts = _locality()
    name = X.pick_name(*(F.col(f"streetname_{x}") for x in ("nl", "fr", "de")))
    named = rows.select(*shared).distinct().withColumns({"name": name, "municipality_name": municipality, "post_name": post_name, "parts": parts}).filter("name <> ''")
    other = X.aliases([F.col("streetname_fr"), F.col("streetname_de")], F.col("parts"), F.col("municipality_name"), [F.col("municipality_name_fr"), F.col("municipality_name_de")])
    named = named.select(*shared, "name", "municipality_name", "post_name", other.alias("aliases")).join(counts, ["street_id", "postcode"])
    a = rows.join(named, shared)
    number, box = F.nullif(F.col("house_number"), F.lit("")), F.nullif(F.col("box_number"), F.lit(""))
    street = F.concat(F.col("name"), F.coalesce(F.concat(F.lit(" "), number), F.lit("")), F.coalesce(F.concat(F.lit(" bus "), box), F.lit("")))
    label = X.address_line(street, F.col("postcode"), F.col("post_name"), F.col("municipality_name"))
    ident = F.col("id") if "copies" in rows.columns else address_ident()
    more = ["batch_order"] if ordered else [c for c in ("copies",) if c in rows.columns]
    a = a.withColumn("batch_order", _batch_order(rows)) if ordered else a
    return finish(a.select(*more, ident.alias("id"), F.lit("address").alias("doc_type"), label.alias("label"), F.col("name").alias("street_name"), number.alias("house_number"), box.alias("box_number"), "postcode", "post_name", "municipality_name", F.col("municipality_id").alias("nis_code"), "lat", "lon", "popularity", "aliases"), *more)


def build_corpus(rows: DataFrame, options: ImportOptions = ImportOptions(), ordered: bool = False) -> DataFrame:
    """The documents of the families that ``options`` names. Streets, municipalities and postcodes come out of one pass
    over the rows, whose groups are stored. With ``ordered`` also ``batch_order``, by which the last of an id counts."""
    return _families(clean_cells(rows), options, ordered)


def _families(rows: DataFrame, options: ImportOptions, ordered: bool = False) -> DataFrame:
    parts = []
    if options.streets or options.regions:
        groups = stored(aggregate_all(rows), "groups")
        level = lambda name: groups.filter(F.col("level") == name)
        if options.streets:
            parts.append(_streets(level("street").withColumnsRenamed({"k_street": "street_id", "k_postcode": "postcode"})))
        if options.regions:
            parts.append(_municipalities(level("municipality").drop("municipality_id").withColumnRenamed("k_nis", "municipality_id")))
            parts.append(_postcodes(level("postcode").withColumnRenamed("k_postcode", "postcode")))
    if ordered:
        parts = [p.withColumn("batch_order", F.lit(None).cast(rows.select(_batch_order(rows).alias("o")).schema["o"].dataType)) for p in parts]
    if "copies" in rows.columns:
        parts = [p.withColumn("copies", F.lit(1).cast("bigint")) for p in parts]
        rows = rows.withColumns({"lat": F.col("own.lat"), "lon": F.col("own.lon")})
    if options.addresses:
        parts.append(address_documents(rows, ordered))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ addresses alike

#: The cells that an address document is searched and scored by. Its id, box and coordinates are none of them.
_ALIKE = ("street_id", "house_number", "postcode", *_FIRST)


def _alike() -> list[Column]:
    """What rows are compared by; the hash stands first, so that sorting seldom looks at the texts."""
    return [F.xxhash64(*_ALIKE).alias("alike"), *(F.col(c) for c in _ALIKE)]


def condensed(rows: DataFrame) -> DataFrame:
    """Cleaned ``rows`` that agree in all that an address is searched and scored by as one row, that of the smallest id,
    with ``copies`` (how many they are), the place of the first in the import, and mean coordinates (``own``: the row's)."""
    order = [c for c in ("file", "ord") if c in rows.columns]
    own = F.min(F.struct(address_ident().alias("id"), "box_number", "lat", "lon"))
    out = rows.groupBy(*_alike()).agg(own.alias("own"), F.min(F.struct(*order)).alias("o"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("copies"))
    return out.select("alike", *_ALIKE, "own.id", "own.box_number", "own", "o.*", "lat", "lon", "copies")


@dataclasses.dataclass(frozen=True)
class Condensed:
    """A corpus in which addresses that differ in nothing but id, box and coordinates are one document with ``copies``,
    the one of the smallest id. Every address stays in ``rows``, and ``with_copies`` brings all back into an answer.

    ``rows`` are read twice and not stored here, so that cells that are the same in all of them stay constants of the plan."""

    docs: DataFrame
    rows: DataFrame
    groups: DataFrame

    @classmethod
    def of(cls, rows: DataFrame, options: ImportOptions) -> Condensed:
        plain = clean_cells(rows).withColumn("id", address_ident())
        # as many files as the groups fill, not as many as the rows were shuffled in
        groups = stored(condensed(plain).hint("rebalance"), "alike")
        return cls(_families(groups, options), plain, groups)

    def with_copies(self, hits: DataFrame, limit: int) -> DataFrame:
        """``query_id, id, rank, score, pass`` of the ``limit`` best documents of each query out of ``hits``, the ``limit`` best of ``docs``.

        A document behind so many others of ``docs`` has none among the best that stands for it, so nothing else is asked for;
        of those alike, which differ by id alone, the ``limit`` smallest ids are.
        """
        hits = stored(hits.select("query_id", "id", "rank_tier", "score", "popularity", "pass", "copies"), "hits")
        met = hits.filter("copies > 1").select("id").distinct().join(self.groups, "id").select("alike", *_ALIKE, F.col("id").alias("first"))
        met = stored(met, "met")
        # only rows that may be alike move, and of those no more than the smallest ids of each task
        near = self.rows.select(*_alike(), "id").join(met.select("alike"), "alike", "left_semi")
        least = near.withColumn("n", F.row_number().over(W.partitionBy("alike", *_ALIKE).orderBy("id"))).filter(F.col("n") <= limit)
        some = least.join(met, ["alike", *_ALIKE]).select("first", "id")
        every = hits.filter("copies = 1").drop("copies").unionByName(hits.filter("copies > 1").withColumnRenamed("id", "first").join(some, "first").drop("first", "copies"))
        return top_k(every, limit)


# ------------------------------------------------------------------ places


def json_object(c: Column) -> Column:
    """A JSON object's members that are strings, in document order; empty for anything else."""
    members = F.from_json(c, "map<string,variant>")
    texts = F.map_filter(members, lambda _, v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform_values(texts, lambda _, v: v.cast("string")), F.create_map().cast("map<string,string>"))


def json_name(names: Column) -> Column:
    """The name in the preferred language, else the first that is not empty; white space collapsed."""
    tidy = lambda v: X.collapse_whitespace(F.coalesce(v, F.lit("")))
    preferred = [F.nullif(tidy(F.try_element_at(names, F.lit(x))), F.lit("")) for x in LANGUAGES]
    return F.coalesce(*preferred, F.try_element_at(F.filter(F.transform(F.map_values(names), tidy), lambda v: v != ""), F.lit(1)), F.lit(""))


def json_address(c: Column) -> Column:
    """The address object in the preferred language, else the first; languages that hold anything else are passed over.

    Null where no language holds an object.
    """
    objects = F.map_filter(F.from_json(c, "map<string,variant>"), lambda _, v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
    by_language = F.transform_values(objects, lambda _, v: v.cast("map<string,string>"))
    return F.coalesce(*(F.try_element_at(by_language, F.lit(x)) for x in LANGUAGES), F.try_element_at(F.filter(F.map_values(by_language), lambda v: v.isNotNull()), F.lit(1)))


def split_locality(c: Column) -> tuple[Column, Column]:
    """``Post name (Municipality)`` taken apart; without brackets there is no post name."""
    pattern = r"^(.+?)\s*\((.+)\)$"
    both = c.rlike(pattern)
    return F.when(both, X.trimmed(F.regexp_extract(c, pattern, 1))).otherwise(""), F.when(both, X.trimmed(F.regexp_extract(c, pattern, 2))).otherwise(c)


def judge_places(rows: DataFrame, postcodes: tuple[str, ...] = ()) -> DataFrame:
    """The rows with their parsed parts and ``reject_reason`` (null: kept), the first reason that holds."""
    r = rows.withColumns({"ident": X.trimmed(F.coalesce("place_cdbid", F.lit(""))), "names": json_object(F.col("name")), "where": json_address(F.col("address"))})
    part = lambda k: X.collapse_whitespace(F.coalesce(F.try_element_at(F.col("where"), F.lit(k)), F.lit("")))
    r = r.withColumns({"postcode": part("postalCode"), "street": part("streetAddress"), "place": part("addressLocality"), "chosen": json_name(F.col("names"))})
    reason = F.when((F.col("ident") == "") | F.col("address").isNull(), "unparseable").when(F.col("where").isNull(), "no address")
    reason = reason.when(F.coalesce(F.try_element_at("where", F.lit("addressCountry")), F.lit("")) != "BE", "not in belgium").when(~X.is_postcode(F.col("postcode")), "unusable postcode")
    if postcodes:
        reason = reason.when(~F.col("postcode").isin(*postcodes), "postcode filter")
    return r.withColumn("reject_reason", reason.when(F.col("chosen") == "", "no name"))


def reject_counts(judged: DataFrame) -> DataFrame:
    return judged.filter("reject_reason is not null").groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rows"))


def place_documents(judged: DataFrame, ordered: bool = False) -> DataFrame:
    more = ["batch_order"] if ordered else []
    judged = judged.withColumn("batch_order", _batch_order(judged)) if ordered else judged
    post_name, municipality = split_locality(F.col("place"))
    p = judged.filter("reject_reason is null").withColumns({"post": post_name, "municipality_name": municipality})
    others = F.filter(F.transform(F.map_values("names"), lambda v: X.collapse_whitespace(F.coalesce(v, F.lit("")))), lambda v: (v != "") & (v != F.col("chosen")))
    others = F.array_distinct(F.concat(others, F.filter(F.array("post", "municipality_name"), lambda v: v != "")))
    label = X.place_label(F.col("chosen"), F.col("street"), F.col("postcode"), F.col("post"), F.col("municipality_name"))
    return finish(p.select(*more, F.concat(F.lit("place:"), "ident").alias("id"), F.lit("place").alias("doc_type"), label.alias("label"), F.col("chosen").alias("place_name"), F.nullif("street", F.lit("")).alias("street_name"), "postcode", F.nullif("post", F.lit("")).alias("post_name"), "municipality_name", F.lit(PLACE_POPULARITY).alias("popularity"), others.alias("aliases")), *more)
