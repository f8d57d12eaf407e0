"""The data model's fixed shapes."""

from __future__ import annotations

import dataclasses

from pyspark.sql import types as T

# The register export's columns, in file order; the first two may name any EPSG code.
REGISTER_COLUMNS = (
    "EPSG:31370_x", "EPSG:31370_y", "EPSG:4326_lat", "EPSG:4326_lon", "address_id", "box_number", "house_number", "municipality_id",
    "municipality_name_de", "municipality_name_fr", "municipality_name_nl", "postcode", "postname_fr", "postname_nl", "street_id",
    "streetname_de", "streetname_fr", "streetname_nl", "region_code", "status",
)
# The place export's columns.
PLACE_COLUMNS = ("place_cdbid", "name", "description", "address")
# Document types with their rank tier, ranking weight and filter family.
TYPES = {
    "street": (2, 1.0, "coordinates"),
    "municipality": (0, 1.6, "region"),
    "postcode": (0, 1.35, "region"),
    "address": (2, 0.75, "coordinates"),
    "place": (1, 1.2, "place"),
}
#: A register column's name inside Spark (no colons and digits first).
SHORT = {"EPSG:31370_x": "x", "EPSG:31370_y": "y", "EPSG:4326_lat": "lat", "EPSG:4326_lon": "lon"}
REGISTER = T.StructType([T.StructField(SHORT.get(c, c), T.StringType()) for c in REGISTER_COLUMNS])
PLACES = T.StructType([T.StructField(c, T.StringType()) for c in PLACE_COLUMNS])
_TEXTS = ("id", "doc_type", "label", "place_name", "street_name", "house_number", "box_number", "postcode", "post_name", "municipality_name", "nis_code")
DOCUMENT = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXTS]
    + [T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("popularity", T.LongType()), T.StructField("aliases", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.StringType()) for c in ("search_text", "primary_name", "primary_name_norm")]
    + [T.StructField("rank_tier", T.ByteType())]
)


@dataclasses.dataclass(frozen=True)
class ImportOptions:
    """What an import takes: rows at most, postcodes (none: all), document families."""

    limit: int | None = None
    postcodes: tuple[str, ...] = ()
    streets: bool = True
    regions: bool = True
    addresses: bool = False

    @classmethod
    def level(cls, level: str, **more) -> ImportOptions:
        """``street``, ``address`` or ``all``."""
        streets, regions, addresses = {"street": (True, True, False), "address": (False, False, True), "all": (True, True, True)}[level]
        return cls(streets=streets, regions=regions, addresses=addresses, **more)


@dataclasses.dataclass(frozen=True)
class EngineConfig:
    """Settings of query parsing and ranking."""

    house_numbers_indexed: bool = False
    tier_sort: bool = True
    fuzzy: bool = True
    limit: int = 10
    fulltext_enabled: bool = True
