from pyspark.sql import functions as F

from wayfold.operators import retrieval as M
from wayfold.plans import corpus as C
from wayfold.plans import index as I  # noqa: E741
from wayfold.plans.parse import parse_queries
from wayfold.schema import REGISTER, ImportOptions
from wayfold.sources import tables as T
from wayfold.sources.exports import usable
from wayfold.sources.scratch import stored


def register(spark):
    """Three streets; of the first one, 14 addresses are number 12 and differ by box alone."""
    made = [("kerkstraat", "12", str(b), f"k-12-{b}") for b in range(14)] + [("kerkstraat", str(n), "", f"k-{n}") for n in (3, 5)]
    made += [("molenweg", "12", "", "m-12"), ("molenweg", "12", "1", "m-12-1"), ("meir", "7", "", "z-7")]
    rows = spark.createDataFrame(made, "street string, house_number string, box_number string, address_id string")
    cells = {
        "street_id": F.col("street"), "streetname_nl": F.col("street"), "municipality_id": F.lit("1"), "municipality_name_nl": F.lit("Gent"), "postname_nl": F.lit("Gent"), "postcode": F.lit("9000"),
        "region_code": F.lit("BE"), "status": F.lit("current"), "lat": F.lit("51.0"), "lon": F.lit("3.7"), **{c: F.col(c) for c in ("house_number", "box_number", "address_id")},
    }
    return rows.select(*(cells.get(f.name, F.lit("")).alias(f.name) for f in REGISTER), F.struct("address_id").alias("ord"))


def test_addresses_alike_are_one_document_and_all_answer(spark):
    rows, options = register(spark), ImportOptions.level("all")
    found, plain = C.Condensed.of(rows, options), C.build_corpus(rows, options)
    addresses = found.docs.filter("doc_type = 'address'").select("id", "copies").collect()
    assert {(r.id, r.copies) for r in addresses} == {("address:BE:k-12-0", 14), ("address:BE:k-3", 1), ("address:BE:k-5", 1), ("address:BE:m-12", 2), ("address:BE:z-7", 1)}
    names = (*I.fields(), "name")
    small, whole = M.Index.of(found.docs, names), M.Index.of(plain, names)
    stats = lambda i: {tuple(r) for r in i.terms.select("field", "term", "df").collect()} | {tuple(r) for r in i.fields.select("field", "docs", "avgdl").collect()}
    assert stats(small) == stats(whole)
    assert 3 * small.postings.count() < 2 * whole.postings.count()
    asked = parse_queries(spark.createDataFrame([(x, x) for x in ("kerkstraat 12 gent", "kerkstraat 77 gent", "kerksrtaat 12 gent", "molenweg 12")], "query_id string, query string"), house_numbers_indexed=True)
    show = lambda hits: [(r.query_id, r["rank"], r.id, r.score, r["pass"]) for r in hits.orderBy("query_id", "rank").select("query_id", "rank", "id", F.round("score", 4).alias("score"), "pass").collect()]
    got = show(found.with_copies(M.suggest_clauses(asked, small, "bool_prefix"), 10))
    assert got == show(M.suggest_clauses(asked, whole, "bool_prefix"))
    assert len([r for r in got if r[0] == "kerkstraat 12 gent"]) == 10


def test_additive_answers_are_those_of_the_whole_index(spark):
    rows, options = register(spark), ImportOptions.level("address")
    names = ("search_text", "name_start")
    found = C.Condensed.of(rows, options)
    small, whole = M.Index.of(found.docs, names), M.Index.of(C.build_corpus(rows, options), names)
    asked = parse_queries(spark.createDataFrame([(x, x) for x in ("kerkstraat gent", "kerkstraat 77")], "query_id string, query string"), house_numbers_indexed=True)
    show = lambda hits: [(r.query_id, r["rank"], r.id, r.score, r["pass"]) for r in hits.orderBy("query_id", "rank").select("query_id", "rank", "id", F.round("score", 4).alias("score"), "pass").collect()]
    got = show(found.with_copies(M.suggest_fulltext(asked, small), 10))
    assert got == show(M.suggest_fulltext(asked, whole))
    assert [r[4] for r in got if r[0] == "kerkstraat gent"] == ["exact"] * 10


def test_lines_joined_once_answer_for_register_and_copies(spark):
    sf = "/root/testdata/sf0.001"
    lines = stored(T.order_lines(spark, sf).filter(T.CURRENT), "lines")
    # the nation and region tables are small enough to go to the lines, which stay where they are
    found = C.Condensed.of(usable(T.register_rows(spark, sf, lines)), ImportOptions.level("address"))
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert "lines-" in plan and "hashpartitioning" not in plan
    key = lambda rows: sorted(tuple(r) for r in rows.select(C.address_ident().alias("id"), *C._ALIKE, "box_number", "lat", "lon").collect())
    assert key(found.rows) == key(C.clean_cells(usable(T.register_rows(spark, sf))))


def test_few_postings_have_few_buckets(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        least = 4 * spark.sparkContext.defaultParallelism
        assert [I.buckets_of(spark, n) for n in (0, 10_000_000, 1_200_000_000)] == [least, 200, 300]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
