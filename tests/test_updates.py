"""An index after updates against one that is built of the same documents at once."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import retrieval as M
from wayfold.operators.single import fulltext_one
from wayfold.plans import index as I  # noqa: E741
from wayfold.plans import updates as U
from wayfold.plans.corpus import finish
from wayfold.plans.parse import parse_queries

SCHEMA = "id string, doc_type string, street_name string, house_number string, postcode string, municipality_name string, popularity long, aliases array<string>"
QUERIES = ("gent", "kerkstraat gen", "kerkstraat", "k", "meirplein", "me", "nieuwe kerkst", "kerkstrat gent", "2000", "9000 gent", "aalst", "aal", "zz", "kerkstraat 12", "rue hau", "antwrepen")


def street(k, name, town="Gent", popularity=10, aliases=()):
    return (f"s:{k}", "street", name, None, "9000" if town == "Gent" else "2000", town, popularity, list(aliases))


def documents(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    label = F.concat_ws(" ", "street_name", "house_number", "postcode", "municipality_name")
    return finish(docs.withColumns({"label": label, "post_name": F.col("municipality_name")}))


FIRST = [street(1, "Kerkstraat", aliases=["Rue Haute"]), street(2, "Kerkstraat", "Antwerpen", 60), street(3, "Meir", "Antwerpen", 90), ("a:12", "address", "Kerkstraat", "12", "9000", "Gent", 40, []), street(4, "Zavelput")]
SECOND = [street(3, "Meirplein", "Antwerpen", 80), street(5, "Aalstersteenweg", "Gent", 30), street(5, "Aalstersesteenweg", "Gent", 35), street(6, "Nieuwe Kerkstraat", "Gent", 5)]
THIRD = [street(3, "Meir", "Antwerpen", 70), street(7, "Zzz"), ("a:12", "address", "Kerkstraat", "12b", "9000", "Gent", 45, [])]


def final():
    rows = {r[0]: r for r in [*FIRST, *SECOND, *THIRD]}
    return [rows[k] for k in rows if k not in ("s:4", "s:1")]


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


@pytest.fixture(scope="module")
def pair(spark):
    """The index after two updates, and the one built at once."""
    first = M.Index.of(documents(spark, FIRST))
    second = U.updated(first, documents(spark, SECOND).coalesce(1), ids(spark, "s:4", "nobody", None))
    third = U.updated(second, documents(spark, THIRD), ids(spark, "s:1", "s:7"))  # an id in both stays
    return third, M.Index.of(documents(spark, final()))


def answers(spark, index, method, **more):
    q = parse_queries(spark.createDataFrame([(x, x) for x in QUERIES], "query_id string, query string"))
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in M.REGISTRY[method](q, index, **more).collect())


def table(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def same(spark, got, want, methods):
    assert table(got.terms, "field", "term", "df", "pos") == table(want.terms, "field", "term", "df", "pos")
    assert table(got.fields, "field", "docs", "total", "avgdl") == table(want.fields, "field", "docs", "total", "avgdl")
    assert table(got.prefixes, "field", "gram", "first", "last") == table(want.prefixes, "field", "gram", "first", "last")
    named = lambda i: table(i.postings.join(i.terms.select("ord", "field", "term"), "ord"), "field", "term", "id", "tf", "dl", "df")
    assert named(got) == named(want)
    for method in methods:
        assert answers(spark, got, method) == answers(spark, want, method) != []


def test_updates_give_the_index_built_at_once(spark, pair):
    assert len(pair[0].segments) == 3
    same(spark, *pair, M.REGISTRY)


def test_one_query(spark, pair):
    for q in ("kerkstraat gen", "meirplein", "aal", "zz", "kerkstrat gent"):
        got, want = (fulltext_one(q, i) for i in pair)
        assert (got.total, [tuple(r) for r in got.rows]) == (want.total, [tuple(r) for r in want.rows])


def test_compaction(spark, pair):
    one = U.compacted(pair[0])
    assert len(one.segments) == 1
    same(spark, one, pair[1], ("fulltext", "sayt", "completion"))
    again = U.updated(one, documents(spark, [street(8, "Kapelstraat")]))
    assert ("aal", 1, "s:5") in [a[:3] for a in answers(spark, again, "fulltext")] and again.docs.count() == one.docs.count() + 1


def test_older_indexes_stay_and_only_what_is_laid_out_is_there(spark, pair):
    older = M.Index.open(spark, pair[0].segments[1].folder)
    assert {r.id for r in older.docs.collect()} == {"s:1", "s:2", "s:3", "a:12", "s:5", "s:6"}
    assert ("meirplein", 1, "s:3") in [a[:3] for a in answers(spark, older, "fulltext")]


def test_postings_of_no_segment_move(spark, pair):
    units = spark.createDataFrame([("search_text", True, "k")], "field string, open boolean, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = M.range_postings(M.unit_ranges(units, pair[0]), pair[0])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    scans = [k for k, line in enumerate(lines) if "Bucketed: true" in line]
    assert len(scans) == 3 and not any("Exchange" in line for k in scans for line in lines[k - 2 : k])


def test_all_goes_and_comes_back(spark):
    rows = [street(1, "Kerkstraat"), street(2, "Meir")]
    empty = U.updated(M.Index.of(documents(spark, rows), ("search_text", "name_start")), documents(spark, rows).limit(0), ids(spark, "s:1", "s:2"))
    assert empty.docs.isEmpty() and empty.terms.isEmpty() and answers(spark, empty, "fulltext") == []
    back = U.updated(empty, documents(spark, rows))
    same(spark, back, M.Index.of(documents(spark, rows), ("search_text", "name_start")), ("fulltext",))


def test_many_terms_between_two(spark):
    """Numbers keep the order of the alphabet however many terms come between two, over several ranges and updates."""
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))) for _ in range(900)})
    names = ("search_text", "name_start")
    parts = [words[::7], words[1::7], [w for k, w in enumerate(words) if k % 7 > 1]]
    doc = lambda ws: documents(spark, [street(w, w) for w in ws])
    index = M.Index.of(doc(parts[0]), names)
    for ws in parts[1:]:
        index = U.updated(index, doc(ws))
    rows = index.terms.orderBy("field", "term").collect()
    assert [r.pos for r in rows] == list(range(len(rows))) and all(a.ord < b.ord for a, b in zip(rows, rows[1:]))
    same(spark, index, M.Index.of(doc(words), names), ("fulltext",))


def test_no_room_is_built_anew(spark, monkeypatch):
    for module in (I, U):
        monkeypatch.setattr(module, "ROOM_BITS", 0)
    index = U.updated(M.Index.of(documents(spark, [street(1, "Aaa"), street(2, "Ccc")]), ("search_text", "name_start")), documents(spark, [street(3, "Bbb")]))
    assert len(index.segments) == 1 and {r.id for r in index.docs.collect()} == {"s:1", "s:2", "s:3"}
