import json

import pytest
from pyspark.sql import functions as F

from test_sources import cells
from wayfold.operators import retrieval as M
from wayfold.operators import service as S
from wayfold.operators.benchmark import evaluate
from wayfold.operators.evaluation import latency_rollup
from wayfold.operators.single import fulltext_one
from wayfold.plans import corpus as C
from wayfold.plans import imports as P
from wayfold.plans.index import Index
from wayfold.plans.parse import parse_queries
from wayfold.schema import REGISTER_COLUMNS, EngineConfig, ImportOptions
from wayfold.sources.exports import HeaderError
from wayfold.sources.store import BulkError, DocumentStore


@pytest.fixture(scope="module")
def register(tmp_path_factory):
    rows = [cells(), cells(address_id="2", house_number="2a"), cells(address_id="3", postcode="1000", municipality_id="12", municipality_name_nl="BRUSSEL", postname_nl="Brussel", street_id="s2", streetname_nl="Meir"), cells(address_id="4", street_id="s3", streetname_nl="Korte Kerkstraat")]
    path = tmp_path_factory.mktemp("export") / "register.csv"
    path.write_text("\n".join([",".join(REGISTER_COLUMNS), *(",".join(r) for r in rows)]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def store(spark, register, tmp_path_factory):
    store = DocumentStore(spark, str(tmp_path_factory.mktemp("store") / "docs"))
    result = P.import_register(spark, [register], {"main": store}, ImportOptions.level("street"))
    assert result.ok and result.documents == result.sinks["main"]["stored"] == 7
    assert result.types == {"street": 3, "municipality": 2, "postcode": 2}
    return store


@pytest.fixture(scope="module")
def index(store, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "i")
    P.finish(store, folder)
    return Index.open(store.spark, folder)


def test_requests():
    r = S.parse_request({"q": "  " + "x" * 200, "limit": "900", "types": "Street, nowhere,street,place", "fuzzy": "OFF", "engine": "sayt,fulltext,unheard"})
    assert (len(r.query), r.limit, r.types, r.fuzzy, r.methods) == (120, 50, ("street", "place"), False, ("fulltext", "sayt"))
    r = S.parse_request({"q": 5, "limit": "0", "engine": "unheard"})
    assert (r.query, r.limit, r.types, r.fuzzy, r.methods, r.explain) == ("", 10, (), True, tuple(M.REGISTRY), False)
    assert S.parse_request({"limit": "many", "engine": "clauses"}).methods == tuple(M.METHODS)
    config = S.config_from({"HOUSE_NUMBERS_INDEXED": "yes", "TIER_SORT": "0", "FULLTEXT_ENABLED": "off"})
    assert (config.house_numbers_indexed, config.tier_sort) == (True, False) and "fulltext" not in S.parse_request({}, config).methods
    assert S.config_from({}) == EngineConfig()


def test_suggest(spark, index, monkeypatch):
    def broken(*_, **__):
        raise OSError("gone")

    monkeypatch.setitem(M.REGISTRY, "completion", broken)
    got = S.suggest(spark, S.Request("kerks", 1, methods=("fulltext", "bool_prefix", "completion"), explain=True), index)["results"]
    assert got["completion"] == {"engine": "completion", "error": "gone"}
    for m in ("fulltext", "bool_prefix"):
        assert (got[m]["count"], got[m]["total"], got[m]["relation"]) == (1, 2, "eq")
        assert got[m]["suggestions"][0]["id"] == "street:s1|2960" and got[m]["debug"]
    assert got["bool_prefix"]["debug"][0]["gate"] == 1.0  # a typed prefix counts its boost once
    only = S.suggest(spark, S.Request("meir", 5, ("municipality",), methods=("bool_prefix",)), index)["results"]["bool_prefix"]
    assert only["suggestions"] == []


def test_one_query_is_answered_as_in_a_batch(spark, index):
    """Every pass, types, house numbers, ties and texts that mean nothing."""
    asked = ["kerks", "kerkstraat", "korte kerk", "kerkstraat 77 sint job", "kerkstrat", "korte kerkstrat", "meir 1000", "10", "brus", "nowhere", "12", "", "sint", "kerkstraat " + "x" * 60]
    for types in (None, ["street"]):
        q = parse_queries(spark.createDataFrame([(t, t) for t in asked], "query_id string, query string"), house_numbers_indexed=True)
        batch = {}
        for r in M.suggest_fulltext(q, index, 3, types).collect():
            batch.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score, 6), r["pass"]))
        for t in asked:
            found = fulltext_one(t, index, 3, types, house_numbers_indexed=True)
            assert [(k, r["_id"], round(r["_score"], 6), r["_pass"]) for k, r in enumerate(found.rows, 1)] == sorted(batch.get(t, [])), t
    assert {p for hits in batch.values() for *_, p in hits} == {"exact", "no_number", "fuzzy"}
    assert fulltext_one("kerks", index, 1).total == 2


def test_methods_differ_where_their_fields_do(spark, index):
    """A misspelt head of a word is near one of the n-gram method's terms, not near a whole word."""
    q = parse_queries(spark.createDataFrame([("x", "kerkstr meirr")], "query_id string, query string"))
    near = {m: {(r.token, r.text) for r in M.near_texts(q.select(F.explode("tokens").alias("token")), index, m).collect()} for m in ("edge_ngram", "bool_prefix")}
    assert ("meirr", "meir") in near["edge_ngram"] & near["bool_prefix"]
    assert ("kerkstr", "kerkst") in near["edge_ngram"] and not any(t == "kerkstr" for t, _ in near["bool_prefix"])


def test_fuzzy_completion(spark, index):
    q = parse_queries(spark.createDataFrame([(x, x) for x in ("kerkts", "ke", "kx", "xerks")], "query_id string, query string"))
    got = {(r.query_id, r.id): r.score for r in M.suggest_completion(q, index).collect()}
    assert got[("kerkts", "street:s1|2960")] == 2 * 4  # popularity times the characters they share at the start
    assert ("ke", "street:s1|2960") in got and not any(k in ("kx", "xerks") for k, _ in got)
    assert not [r for r in M.suggest_completion(q, index, fuzzy=False).collect() if r.query_id == "kerkts"]


def test_evaluate(spark, index, tmp_path):
    def answer(method):
        return lambda texts: S.run_method(method, parse_queries(spark.createDataFrame([(t, t) for t in texts], "query_id string, query string")), index, S.Request("", 10))

    def broken(texts):
        raise OSError("full")

    golden = spark.createDataFrame([("meir", ["street:s2|1000"], ""), ("nowhere", ["street:x"], "")], "query string, expect array<string>, note string")
    report = evaluate(spark, {"completion": answer("completion"), "broken": broken}, ["kerk", "meir"], golden, iterations=2, warmup=0)
    assert report.errors["broken"] == ["full"] * 3 and report.errors["completion"] == []
    latency = {(r.engine, r.query): r.n for r in report.latency.collect()}
    assert latency == {("completion", None): 4, ("completion", "kerk"): 2, ("completion", "meir"): 2}
    scores = report.golden.first()
    assert (scores.entries, scores.hit_1, scores.mrr) == (2, 1, 0.5)
    assert report.verdict.first().fastest == "completion"
    report.write(f"file://{tmp_path}/report")
    long = {(r.section, r.metric) for r in spark.read.csv(f"file://{tmp_path}/report/csv", header=True).collect()}
    assert ("latency_overall", "p50") in long and ("golden", "mrr") in long
    with pytest.raises(ValueError):
        evaluate(spark, {}, ["x"], golden)


def test_rollup(spark):
    samples = spark.createDataFrame([("a", "q", 1.0), ("a", "r", 3.0)], "engine string, query string, took_ms double")
    assert {(r.engine, r.query): r.mean_ms for r in latency_rollup(samples).collect()} == {("a", "q"): 1.0, ("a", "r"): 3.0, ("a", None): 2.0}


def test_store_moves_types_and_refuses(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "id string, doc_type string, v int")
    store = DocumentStore(spark, str(tmp_path / "docs"))
    store.replace(make([("a", "street", 1), ("b", "place", 1)]))
    store.upsert(make([("b", "street", 2)]))
    assert {(r.id, r.doc_type, r.v) for r in store.read().collect()} == {("a", "street", 1), ("b", "street", 2)}
    with pytest.raises(BulkError, match="planet"):
        store.upsert(make([("c", "planet", 1), (None, "street", 1)]))
    assert store.count() == 2
    store.reset(("street",))
    assert store.health()["documents"] == 0
    store.upsert(make([("z", "place", 1)]))
    assert store.count() == 1


def test_recreate_and_results(spark, register, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "docs"))
    first = P.import_register(spark, [register], {"main": store}, ImportOptions.level("all"))
    again = P.import_register(spark, [register], {"main": store}, ImportOptions.level("street"), recreate=True)
    assert first.types["address"] == 4 and store.count() == again.documents == 7
    both = P.merge_results([first, again])
    assert both.documents == first.documents + 7 and both.sinks["main"]["sent"] == both.documents and both.ok
    bad = tmp_path / "bad.csv"
    bad.write_text("a\n1\n")
    with pytest.raises(HeaderError):
        P.import_register(spark, [str(bad)], {"main": store}, recreate=True)
    assert store.count() == 7 and S.health({"main": store}) == {"ok": True, "stores": {"main": {"ok": True, "detail": "", "documents": 7}}}


def test_members_that_are_no_strings_are_no_names(spark):
    names = [json.dumps(x) for x in ({"nl": 5, "fr": "Le Lieu"}, {"nl": {"x": 1}}, {"nl": None, "pt": "So"}, ["x"], "x")] + ["{broken", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    got = [r.picked for r in rows.select("i", C.json_name(C.json_object(F.col("name"))).alias("picked")).orderBy("i").collect()]
    assert got == ["Le Lieu", "", "So", "", "", "", ""]
