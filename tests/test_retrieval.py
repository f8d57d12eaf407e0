import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import evaluation as E
from wayfold.operators import retrieval as M
from wayfold.operators.fuzzy import STEM, Neighbours, candidate_terms, fuzzy_terms
from wayfold.plans.corpus import finish
from wayfold.plans.parse import parse_queries


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("m:gent", "municipality", "Gent", None, None, None, "Gent", 500, []), ("m:gentb", "municipality", "Gentbrugge", None, None, None, "Gentbrugge", 50, []),
        ("s:1", "street", "Kerkstraat, 9000 Gent", "Kerkstraat", None, "9000", "Gent", 40, ["Rue Haute"]), ("s:2", "street", "Kerkstraat, 2000 Antwerpen", "Kerkstraat", None, "2000", "Antwerpen", 60, []),
        ("a:12", "address", "Kerkstraat 12, 9000 Gent", "Kerkstraat", "12", "9000", "Gent", 40, []), ("s:3", "street", "Meir, 2000 Antwerpen", "Meir", None, "2000", "Antwerpen", 90, []), ("p:2000", "postcode", "2000 Antwerpen", None, None, "2000", "Antwerpen", 150, []),
    ]
    docs = spark.createDataFrame(rows, "id string, doc_type string, label string, street_name string, house_number string, postcode string, municipality_name string, popularity long, aliases array<string>")
    docs = finish(docs.withColumn("post_name", F.col("municipality_name")))
    return M.Index.of(docs)


def ask(spark, index, method, *queries, **more):
    q = parse_queries(spark.createDataFrame([(x, x) for x in queries], "query_id string, query string"))
    out = {}
    for r in M.REGISTRY[method](q, index, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_fulltext(spark, index):
    got = ask(spark, index, "fulltext", "gent", "kerkstraat gent", "kerkstraat 12 bus 5 gent", "kerkstrat gent", "kerkstrat antwerpen", "nowhere")
    assert got["gent"][:2] == ["m:gent", "m:gentb"]
    assert got["kerkstraat gent"][0] == "s:1"
    assert set(got["kerkstraat 12 bus 5 gent"]) == {"s:1", "a:12"}
    assert got["kerkstrat gent"] == ["s:1", "s:2", "a:12"]  # the relaxed name alone admits both streets
    assert "kerkstrat antwerpen" not in got  # of equally long tokens the last one is relaxed
    assert "nowhere" not in got


def test_clause_methods_agree_on_candidates(spark, index):
    queries = ("gent", "kerkstraat gen", "meir 2000", "rue hau", "20")
    gates = [{k: set(v) for k, v in ask(spark, index, m, *queries, limit=50).items()} for m in ("edge_ngram", "bool_prefix")]
    assert gates[0] == gates[1]
    assert gates[0]["kerkstraat gen"] == {"s:1", "a:12"}
    assert gates[0]["rue hau"] == {"s:1"}


def test_clause_methods_score_differently(spark, index):
    q = parse_queries(spark.createDataFrame([("x", "rue hau"), ("y", "kerkstraat gen")], "query_id string, query string"))
    pairs = M.gate(q, index)
    scores = lambda m, **k: {(r.query_id, r.id): r.relevance for r in M.clause_scores(q, pairs, index, m, **k).collect()}
    got = {m: scores(m) for m in ("prefixes", "sayt", "bool_prefix")}
    assert len({frozenset(g) for g in got.values()}) == 1 and len(got["sayt"]) == 3
    for a, b in (("prefixes", "sayt"), ("prefixes", "bool_prefix"), ("sayt", "bool_prefix")):
        assert any(got[a][k] != got[b][k] for k in got[a])
    assert all(got["sayt"][k] >= got["prefixes"][k] for k in got["sayt"])
    bare = scores("prefixes", fuzzy=False)
    assert all(got["prefixes"][k] > bare[k] for k in bare if k[0] == "y")


def test_recovery(spark, index):
    got = ask(spark, index, "prefixes", "kerkstraat 99 gent", "kerkstraat antwrepen")
    assert set(got["kerkstraat 99 gent"]) == {"s:1", "a:12"}
    assert got["kerkstraat antwrepen"] == ["s:2"]


def test_completion(spark, index):
    assert ask(spark, index, "completion", "gent", limit=2)["gent"][0] == "m:gent"
    assert "s:1" in ask(spark, index, "completion", "rue h")["rue h"]


def test_fuzzy_terms(spark):
    tokens = spark.createDataFrame([("antwrepen",), ("gnet",), ("ab",)], "token string")
    terms = spark.createDataFrame([("antwerpen",), ("gent",), ("abc",), ("xntwerpen",)], "term string")
    assert {(r.token, r.term, r.distance) for r in fuzzy_terms(tokens, Neighbours.of(terms)).collect()} == {("antwrepen", "antwerpen", 1), ("gnet", "gent", 1)}


def osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_neighbourhood_loses_nothing(spark):
    """Against every pair, over few letters, so that most texts are near several others; texts shorter and longer than a stem."""
    rnd = random.Random(4)
    texts = sorted({"".join(rnd.choice("ab" if n % 2 else "abc") for _ in range(n)) for n in range(1, STEM + 6) for _ in range(14)})
    df = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {(r.token, r.term, r.distance) for r in fuzzy_terms(df(texts, "token"), Neighbours.of(df([*texts, *texts, ""], "term"))).collect()}
    edits = lambda t: 0 if len(t) < 3 else 1 if len(t) <= 5 else 2
    assert got == {(a, b, osa(a, b)) for a in texts for b in texts if a[0] == b[0] and osa(a, b) <= edits(a)}
    assert {2, 1, 0} == {d for *_, d in got}
    measured = candidate_terms(df(texts, "token"), Neighbours.of(df(texts, "term"))).count()
    assert measured < len(texts) ** 2 / 3


def test_an_empty_query_is_answered_with_nothing(spark, index):
    for method in M.REGISTRY:
        got = ask(spark, index, method, "", " ,", "gent")
        assert set(got) == {"gent"}
    assert ask(spark, index, "fulltext", "") == {}


def test_prefixes_are_intervals(spark, index):
    """A text longer than any stored prefix, one behind the last term, and one that opens everything of a field."""
    units = spark.createDataFrame([("name_start", True, x) for x in ("kerkstraat", "zz", "g", "kerkstraat x")] + [("search_text", False, "gent"), ("search_text", True, "an")], "field string, open boolean, text string")
    got = {(r.field, r.text): r.n for r in M.unit_hits(units, index).groupBy("field", "text").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("name_start", "kerkstraat"): 2, ("name_start", "g"): 2, ("search_text", "gent"): 3, ("search_text", "an"): 3}
    long = finish(spark.createDataFrame([("s:9", "street", "x", "Antwerpsesteenwegdwarsstraat " + "z" * 200, "Gent", 1, [])], "id string, doc_type string, label string, street_name string, municipality_name string, popularity long, aliases array<string>"))
    of_long = M.Index.of(long, ("name_start", "search_text"))
    for query, found in (("antwerpsesteenwegdwarsst", True), ("antwerpsesteenwegdwarsstx", False), ("antwerpsesteenwegdwarsstraat zzz", True)):
        assert bool(ask(spark, of_long, "fulltext", query, fuzzy=False)) == found


def test_lookups_move_no_postings(spark, index):
    """The side of the postings reaches the join from its buckets, whether the other side is broadcast or dealt out."""
    units = spark.createDataFrame([("search_text", True, "g")], "field string, open boolean, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = M.range_postings(M.unit_ranges(units, index), index)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = plan.index("Bucketed: true")
    above = plan[:at].splitlines()[-6:]
    assert "SelectedBucketsCount" in plan and not any("Exchange" in line for line in above[-3:])


def test_completion_of_long_and_many(spark, index):
    """Stored heads, stems and the general way give the same."""
    texts = ("k", "ke", "kerkstra", "kerkstraat", "kerkstrat", "gen", "gnet", "antwerp", "antwrepen", "rue hau", "me", "20")
    for fuzzy in (True, False):
        few, many = (ask(spark, index, "completion", *texts, limit=n, fuzzy=fuzzy) for n in (50, 51))
        assert few == many and "k" in few
    assert ask(spark, index, "completion", "kerkstrat")["kerkstrat"] == ["s:2", "a:12", "s:1"]


def test_evaluation(spark):
    samples = spark.createDataFrame([("a", "q", float(x)) for x in (1, 2, 3, 10)] + [("b", "q", 5.0)], "engine string, query string, took_ms double")
    s = {r.engine: r for r in E.latency_summary(samples, "engine").collect()}
    assert abs(s["a"].p90 - 7.9) < 1e-9 and s["b"].stddev_ms == 0.0
    hits = spark.createDataFrame([("x", "q", i, i, r) for r, i in enumerate("abc", 1)] + [("y", "q", i, i, r) for r, i in enumerate("bad", 1)], "engine string, query string, id string, label string, rank int")
    pair = E.agreement(hits, "x").first()
    assert (pair.overlap, pair.jaccard, pair.spearman, pair.same_top) == (2, 0.5, -1.0, False)
    golden = spark.createDataFrame([("q", ["street:none", "A"], "")], "query string, expect array<string>, note string")
    assert {r.engine: r.mrr for r in E.golden_summary(E.golden_ranks(golden, hits)).collect()} == {"x": 1.0, "y": 0.5}
