"""The register, places, queries and samples as deterministic projections of the supplied star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.schema import REGISTER
from wayfold.sources.scratch import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What the register and the typed queries ask of an order line, its part and its customer.
_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "c_custkey", "c_nationkey", "p_name")

#: Order lines that are current addresses.
CURRENT = "l_linestatus = 'O'"


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their customer's key and nation and their part's name."""
    t = lambda n: table(spark, sf_dir, n)
    # orders meet their customers first, so that order lines move twice and not three times
    placed = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return t("lineitem").join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(*_LINE)


def register_rows(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Order lines as addresses: parts name streets, nations are municipalities, and customers pick the postcode. ``lines``:
    ``order_lines`` that are stored already, all or those that are ``CURRENT``."""
    t = lambda n: table(spark, sf_dir, n)
    rows = order_lines(spark, sf_dir) if lines is None else lines
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    odd = F.col("c_custkey") % 2 == 1
    cells = {
        "lat": 50 + F.col("l_discount"),
        "lon": 3 + F.col("l_tax"),
        "address_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "box_number": F.when(F.col("l_linenumber") > 4, F.col("l_linenumber").cast("string")).otherwise(""),
        "house_number": F.col("l_quantity").cast("int").cast("string"),
        "municipality_id": F.col("c_nationkey").cast("string"),
        "municipality_name_nl": F.col("n_name"),
        "postcode": (1000 + F.col("c_nationkey") * 100 + F.col("c_custkey") % 2).cast("string"),
        "postname_nl": F.when(odd, F.concat_ws("/", "n_name", "r_name")).otherwise(F.col("n_name")),
        "street_id": F.col("p_name"),
        "streetname_nl": F.col("p_name"),
        "region_code": F.col("r_name"),
        "status": F.when(F.expr(CURRENT), "current").otherwise("retired"),
    }
    ord_ = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord")
    return rows.select(*(cells.get(c.name, F.lit("")).cast("string").alias(c.name) for c in REGISTER), ord_)


def place_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as venues with JSON names and addresses, some of them unusable in each of the ways that are told apart, and
    some whose preferred language holds no text or no object."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    name = F.when(k % 11 == 0, "{}").when(k % 3 == 0, F.to_json(F.struct(F.col("c_name").alias("fr"), F.concat(F.col("c_mktsegment"), F.lit("  Hall")).alias("nl")))).otherwise(F.to_json(F.struct(F.col("c_name").alias("en"))))
    name = F.when(k % 23 == 0, F.concat(F.lit('{"nl":5,"de":null,"fr":"L\'Éte\u0301 '), "c_name", F.lit('"}'))).when(k % 37 == 0, F.lit('["x"]')).otherwise(name)
    country = F.when(k % 7 == 0, "FR").otherwise("BE")
    postcode = F.when(k % 13 == 0, F.lit("59000")).otherwise((1000 + F.col("c_nationkey") * 100).cast("string"))
    locality = F.when(k % 5 == 0, F.concat(F.lit("Old "), "n_name", F.lit(" ("), "n_name", F.lit(")"))).otherwise(F.col("n_name"))
    street = F.when(k % 4 == 0, "-").when(k % 4 == 1, F.col("n_name")).otherwise(F.concat(F.col("c_mktsegment"), F.lit(" street "), (k % 50).cast("string")))
    address = F.when(k % 17 == 0, "[]").otherwise(F.to_json(F.struct(F.struct(country.alias("addressCountry"), locality.alias("addressLocality"), postcode.alias("postalCode"), street.alias("streetAddress")).alias("nl"))))
    inside = F.to_json(F.struct(country.alias("addressCountry"), locality.alias("addressLocality"), postcode.alias("postalCode"), street.alias("streetAddress")))
    odd = [(29, '{"nl":"-","fr":', "}"), (31, '{"nl":[],"de":null,"pt":', ',"xx":{}}'), (41, "[", "]")]
    for n, before, behind in odd:
        address = F.when(k % n == 0, F.concat(F.lit(before), inside, F.lit(behind))).otherwise(address)
    return rows.select(F.when(k % 19 == 0, " ").otherwise(k.cast("string")).alias("place_cdbid"), name.alias("name"), F.lit(None).cast("string").alias("description"), address.alias("address"))


def typed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p_name, n_nationkey``: each part with the nation it occurs in most, each nation with its most frequent part."""
    met = order_lines(spark, sf_dir)
    # stored, since every kind of query asks for the pairs again
    met = stored(met.groupBy("p_name", "c_nationkey").agg(F.count(F.lit(1)).alias("n")), "met")
    by_part = met.groupBy("p_name").agg(F.max_by("c_nationkey", F.struct("n", -F.col("c_nationkey"))).alias("n_nationkey"))
    # of equally frequent parts the first in the alphabet
    most = met.withColumn("most", F.max("n").over(W.partitionBy("c_nationkey"))).filter("n = most")
    by_nation = most.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("p_name").alias("p_name"))
    return by_part.unionByName(by_nation).distinct()


def typed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, query``: what people might type: parts and nations whole and half, with postcodes, numbers and slips,
    and each part with the nation it occurs in most and with the first three, each nation with its most frequent part."""
    parts = table(spark, sf_dir, "part").select("p_name").distinct()
    nations = table(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    half = F.left("p_name", F.length("p_name") - 2)
    pairs = typed_pairs(spark, sf_dir).unionByName(parts.withColumn("n_nationkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))).distinct().join(nations, "n_nationkey")
    slip = F.concat(F.left("p_name", F.lit(1)), F.substr("p_name", F.lit(3), F.lit(1)), F.substr("p_name", F.lit(2), F.lit(1)), F.substr("p_name", F.lit(4)))
    postcode = (1000 + F.col("n_nationkey") * 100).cast("string")
    made = [
        parts.select(F.col("p_name").alias("query")),
        parts.select(half.alias("query")),
        parts.select(slip.alias("query")),
        nations.select(F.col("n_name").alias("query")),
        nations.select(postcode.alias("query")),
        nations.select(F.left(postcode, F.lit(2)).alias("query")),
        pairs.select(F.concat_ws(" ", "p_name", F.lit("12 bus 5"), "n_name").alias("query")),
        pairs.select(F.concat_ws(" ", postcode, half).alias("query")),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out.distinct().select(F.col("query").alias("query_id"), "query")


def numbered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, query``: streets with a house number that is there, with one that no house has (quantities end at 50),
    with one and a slip in the name, and with a box."""
    pairs = typed_pairs(spark, sf_dir).join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    slip = F.concat(F.left("p_name", F.lit(1)), F.substr("p_name", F.lit(3), F.lit(1)), F.substr("p_name", F.lit(2), F.lit(1)), F.substr("p_name", F.lit(4)))
    known = (1 + F.col("n_nationkey") % 50).cast("string")
    kinds = [("p_name", known), ("p_name", F.lit("77")), (slip, F.lit("88b")), ("p_name", F.concat(known, F.lit(" bus 5")))]
    made = [pairs.select(F.concat_ws(" ", name, number, "n_name").alias("query")) for name, number in kinds]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out.distinct().select(F.col("query").alias("query_id"), "query")


def latency_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measurements: the type is the engine, the user the query, the value the time taken."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.col("user_id").cast("string").alias("query"), F.col("value").alias("took_ms"), F.col("event_id").alias("iter"), "ts")


def ranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers: for each type and user, the ten kinds of value met most, ranked."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.col("user_id").cast("string").alias("query"), F.floor("value").cast("bigint").cast("string").alias("id"))
    n = e.groupBy("engine", "query", "id").agg(F.count(F.lit(1)).alias("n"))
    ranked = n.withColumn("rank", F.row_number().over(W.partitionBy("engine", "query").orderBy(F.desc("n"), "id")).cast("bigint"))
    return ranked.filter("rank <= 10").select("engine", "query", "id", F.concat(F.lit("Value "), "id").alias("label"), "rank")
