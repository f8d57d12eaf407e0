import pytest
from pyspark.sql import functions as F

from wayfold.functions import text as X
from wayfold.plans.parse import parse_queries


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "folded"),
    [("Sint-Genesius-Rode", "sint genesius rode"), ("Rue de l'Église", "rue de l eglise"), ("O.L.V.-straat", "o l v straat"), ("  Œuvre ßæ ", "oeuvre ssae"), ("", ""), ("--", "")],
)
def test_normalize(spark, raw, folded):
    assert one(spark, X.normalize(F.lit(raw))) == folded
    assert one(spark, X.tokenize(F.lit(raw))) == folded.split()


def test_haystack_keeps_first_appearance(spark):
    assert one(spark, X.haystack(F.lit("b a"), F.lit(None).cast("string"), F.lit("A-c B"))) == "b a c"


@pytest.mark.parametrize(("token", "kinds"), [("2230", (True, True, False)), ("0999", (False, True, True)), ("22301", (False, True, False)), ("12a", (False, True, True)), ("3bis", (False, True, True)), ("b12", (False, False, False))])
def test_token_kinds(spark, token, kinds):
    t = F.lit(token)
    assert tuple(one(spark, f(t)) for f in (X.is_postcode, X.is_numeric, X.is_house_number)) == kinds


@pytest.mark.parametrize(("raw", "titled"), [("HERSELT", "Herselt"), ("De Haan", "De Haan"), ("SINT-JOB-IN-'T-GOOR", "Sint-Job-In-'T-Goor"), ("VAN DER AA", "Van der Aa"), ("BRAINE-LE-COMTE", "Braine-le-Comte")])
def test_title_case(spark, raw, titled):
    assert one(spark, X.title_case(F.lit(raw))) == titled


def test_place_labels(spark):
    label = lambda *a: one(spark, X.place_label(*map(F.lit, a)))
    assert label("Yper Museum", "Grote Markt 34", "8900", "", "Ieper") == "Yper Museum (Grote Markt 34, 8900 Ieper)"
    assert label("Brussel", "Brussel", "1000", "", "Brussel") == "Brussel (1000 Brussel)"
    assert label("1000 Brussel", "1000 Brussel", "1000", "", "Brussel") == "1000 Brussel"
    assert one(spark, X.address_line(*map(F.lit, ("Wolterslaan", "9040", "Sint-Amandsberg", "Gent")))) == "Wolterslaan, 9040 Sint-Amandsberg (Gent)"


def test_distances(spark):
    assert one(spark, X.name_distance(F.lit("goorb"), F.lit("goorbaan"))) == 0
    assert one(spark, X.name_distance(F.lit("abc"), F.lit(""))) == 3
    assert [one(spark, X.max_distance(F.lit("x" * n))) for n in (5, 9, 10)] == [1, 2, 3]


def test_white_space(spark):
    assert one(spark, X.collapse_whitespace(F.lit(" a\n\t b  c "))) == "a b c"


def parsed(spark, query, indexed=False):
    return parse_queries(spark.createDataFrame([(query,)], "query string"), house_numbers_indexed=indexed).first()


def test_query_parsing(spark):
    q = parsed(spark, "kerkstraat 12 bus 5 gent")
    assert (q.locative, q.detail, q.prefix) == (["kerkstraat", "gent"], ["12", "bus", "5"], "gent")
    q = parsed(spark, "kerkstraat 12 bus 5 gent", True)
    assert (q.locative, q.detail) == (["kerkstraat", "12", "gent"], ["bus", "5"])
    assert parsed(spark, "bus").locative == ["bus"]
    q = parsed(spark, "22")
    assert (q.locative, q.bare_numeric, q.typing_locative) == (["22"], True, True)
    assert parsed(spark, "kerkstraat 90", True).typing_locative is False
    assert parsed(spark, "meir 12 b 5").detail == ["12", "b", "5"]
    empty = parsed(spark, "")
    assert (empty.tokens, empty.typing_locative, empty.prefix) == ([], False, None)
