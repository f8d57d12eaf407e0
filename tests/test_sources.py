import pytest
from pyspark.sql import functions as F

from wayfold.plans import corpus as C
from wayfold.schema import PLACE_COLUMNS, REGISTER_COLUMNS, ImportOptions
from wayfold.sources.exports import HeaderError, read_golden, read_places, read_queries, read_register
from wayfold.sources.store import DocumentStore, fan_out, merge_by_id


def cells(**given):
    base = {"EPSG:4326_lat": "51.0", "EPSG:4326_lon": "4.0", "address_id": "1", "municipality_id": "11", "municipality_name_nl": "SINT-JOB", "postcode": "2960", "postname_nl": "Sint-Job", "street_id": "s1", "streetname_nl": "Kerkstraat", "region_code": "BE-VLG", "status": "current", "house_number": "1"}
    return [{**base, **given}.get(c, "") for c in REGISTER_COLUMNS]


@pytest.fixture
def register(tmp_path):
    rows = [
        cells(),
        cells(address_id="2", house_number="2a", box_number="3", **{"EPSG:4326_lat": "53.0"}),
        cells(address_id="3", postcode="1000", municipality_id="12", municipality_name_nl="BRUSSEL", postname_nl="A/B"),
        cells(address_id="4", status="retired"),
        cells(address_id="5", postcode=""),
        cells(address_id="6", streetname_nl="", streetname_fr="", street_id="s2"),
        cells(address_id="1", region_code="BE-BRU", streetname_nl="", streetname_fr='Rue "X"', street_id="s3"),
    ]
    path = tmp_path / "register.csv"
    quoted = [",".join('"' + c.replace('"', '""') + '"' if c else "" for c in r) for r in rows]
    path.write_text("\n".join([",".join(REGISTER_COLUMNS), *quoted, "short,row"]) + "\n")
    return str(path)


def test_register_to_documents(spark, register):
    rows = read_register(spark, [register, register])
    assert rows.count() == 5
    docs = {r.id: r for r in C.build_corpus(rows, ImportOptions.level("all")).collect()}
    street = docs["street:s1|2960"]
    assert (street.label, street.popularity, street.lat, street.rank_tier) == ("Kerkstraat, 2960 Sint-Job", 2, 52.0, 2)
    assert docs["street:s1|1000"].post_name == "Brussel"
    assert docs["street:s1|1000"].aliases == ["A", "B", "Brussel"]
    assert docs["municipality:11"].popularity == 4
    assert docs["address:BE-VLG:2"].label == "Kerkstraat 2a bus 3, 2960 Sint-Job"
    assert docs["address:BE-VLG:2"].popularity == 2
    assert docs["address:BE-VLG:2"].search_text == "kerkstraat 2a 2960 sint job"
    assert docs["address:BE-BRU:1"].street_name == 'Rue "X"'
    assert "address:BE-VLG:6" not in docs


def test_limits_filters_headers(spark, register, tmp_path):
    assert read_register(spark, [register], ImportOptions(limit=2)).count() == 2
    assert read_register(spark, [register], ImportOptions(postcodes=("1000",))).count() == 1
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(HeaderError):
        read_register(spark, [str(bad)])


def test_places(spark, tmp_path):
    address = lambda **a: '{"nl":{' + ",".join(f'"{k}":"{v}"' for k, v in a.items()) + "}}"
    ok = {"addressCountry": "BE", "postalCode": "9500", "addressLocality": "Onkerzele (Geraardsbergen)", "streetAddress": "-"}
    rows = [
        ("1", '{"fr":"Le  Lieu","nl":"De\\nPlek"}', address(**ok)), ("", '{"nl":"x"}', address(**ok)), ("2", '{"nl":"x"}', "[]"), ("3", '{"nl":"x"}', address(**{**ok, "addressCountry": "FR"})),
        ("4", '{"nl":"x"}', address(**{**ok, "postalCode": "59000"})), ("5", "{}", address(**ok)), ("6", '{"pt":"So pt"}', address(**ok)),
    ]
    path = tmp_path / "places.csv"
    path.write_text("\n".join([",".join(PLACE_COLUMNS), *(",".join('"' + c.replace('"', '""') + '"' for c in (i, n, "", a)) for i, n, a in rows)]) + "\n")
    judged = C.judge_places(read_places(spark, str(path)))
    assert {r.reject_reason: r.rows for r in C.reject_counts(judged).collect()} == {"unparseable": 1, "no address": 1, "not in belgium": 1, "unusable postcode": 1, "no name": 1}
    docs = {r.id: r for r in C.place_documents(judged).collect()}
    assert docs["place:1"].label == "De Plek (9500 Onkerzele (Geraardsbergen))"
    assert docs["place:1"].aliases == ["Le Lieu", "Onkerzele", "Geraardsbergen"]
    assert docs["place:6"].place_name == "So pt"


def test_query_and_golden_files(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# c\n gent \n\nmeir 20\ngent\n")
    assert {r.query for r in read_queries(spark, str(tmp_path / "q.txt")).collect()} == {"gent", "meir 20"}
    for text in ('{"_readme":"x","entries":[{"query":"a","expect":["b"],"note":"n"}]}', '[{"query":"a","expect":["b"]},{"query":"z"}]'):
        (tmp_path / "g.json").write_text(text)
        assert [(r.query, r.expect) for r in read_golden(spark, str(tmp_path / "g.json")).collect()] == [("a", ["b"])]


def test_store(spark, tmp_path):
    docs = spark.createDataFrame([("a", "street", 1), ("b", "street", 1), ("c", "place", 1)], "id string, doc_type string, v int")
    store = DocumentStore(spark, str(tmp_path / "docs"))
    store.replace(docs)
    store.upsert(spark.createDataFrame([("b", "street", 2), ("d", "street", 2)], "id string, doc_type string, v int"))
    assert {(r.id, r.v) for r in store.read().collect()} == {("a", 1), ("b", 2), ("c", 1), ("d", 2)}
    store.replace(docs.filter("id = 'c'").withColumn("v", F.lit(9)))
    assert store.count() == 4 and store.health()["ok"]
    assert not DocumentStore(spark, str(tmp_path / "none")).health()["ok"]
    last = merge_by_id(docs, docs.filter("id = 'a'").withColumn("o", F.lit(1)).unionByName(docs.filter("id = 'a'").withColumns({"v": F.lit(7), "o": F.lit(2)})), "o")
    assert {(r.id, r.v) for r in last.collect()} == {("a", 7), ("b", 1), ("c", 1)}

    def broken(_):
        raise OSError("full")

    report = fan_out(docs, {"bad": broken, "good": lambda d: d.count()})
    assert (report["bad"]["ok"], report["good"]["ok"]) == (False, True)
