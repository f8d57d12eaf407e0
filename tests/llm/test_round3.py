"""The registered queries of sources, spelling and neighbours on small Parquet tables, against plain recounts."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import divergence as D
from wayfold.llm import posting_lists as P
from wayfold.llm import spelling as S
from wayfold.llm.queries import llm_oracle_sql, llm_queries

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["kerkstraat", "kerkstraet", "kerkstrat", "Brücken", "brucken", "BRÜCKEN", "stationsplein", "stationplein", "x", "日本語", "ÀÉÿfoobar", "×÷abcdefg", "naïveté", "naiveté"]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    long = "".join(rnd.choice("ab") for _ in range(3000))
    # a run of three thousand letters, the same with one more, one less and one other
    return [*out, long, long, long[:700] + "c" + long[700:], long[:700] + "c" + long[700:], long[:99] + "c" + long[100:], long[:99] + "c" + long[100:], *[long] * 20, None, "", " \n", "a b", *[out[0]] * 3]


@pytest.fixture(scope="module")
def sf_dir(spark, texts, tmp_path_factory):
    """Documents with nulls everywhere, repeated rows and ids, a hot source, and columns with names that operators use."""
    d = tmp_path_factory.mktemp("sf")
    langs, sources = ["en", "fr", None], ["hot", "hot", "hot", "b", "c", None]
    rows = [(i if i % 40 else None, t, langs[i * 7 % 3], sources[i * 5 % 6], i, "x", 1) for i, t in enumerate(texts)]
    rows += rows[:4]
    schema = "doc_id long, text string, lang string, source string, n_chars long, word string, n int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    x = [(base[i % 12] + 0.3 * rng.normal(size=8)).tolist() for i in range(900)]
    x[40:90] = [[5 * e for e in x[40]]] * 50  # a crowd of copies, longer than the others
    x[7], x[8], x[9], x[10], x[11] = None, [0.0] * 8, [1.0, None, *[0.0] * 6], [float("nan")] * 8, [float("inf")] * 8
    x[12], x[13], x[14] = [1.0, 2.0], [2.0, 1.0], []
    x[20] = (100 * base[0]).tolist()  # far longer than all others
    vectors = [(i if i != 15 else None, v, i % 3, "x", 0.5) for i, v in enumerate(x)]
    vectors += [vectors[100], vectors[41]]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int, key string, score double").repartition(4).write.parquet(f"{d}/embeddings.parquet")
    for name, schema in (("documents", schema), ("embeddings", "vec_id long, embedding array<double>, label int")):
        spark.createDataFrame([], schema).write.parquet(f"{d}/empty/{name}.parquet")
    return str(d)


def duck(sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet/*.parquet')")
    return con.sql(llm_oracle_sql()[name]).fetchall()


def run(spark, sf_dir, name):
    out = llm_queries()[name](spark, sf_dir)
    return out.columns, [tuple(r) for r in out.collect()]


def test_divergence(spark, sf_dir):
    columns, got = run(spark, sf_dir, "op11_divergence")
    assert columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(got) == sorted(duck(sf_dir, "op11_divergence"))
    assert {r[2] for r in got} == {"pair", "term"} and {r[0] for r in got} == {"", "en", "fr"}


def test_divergence_by_hand(spark, sf_dir, texts):
    docs = [(lower(t or ""), ls) for t, ls in ((r.text, (r.lang or "", r.source or "")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())]
    df, n = Counter(), Counter()
    for t, (lang, source) in docs:
        df.update({(lang, w) for w in TERM.findall(t)})
        n.update((lang, source, w) for w in TERM.findall(t))
    lang = "en"
    kept = [w for (x, w), c in df.items() if x == lang and c >= 10]
    sources = {s for _, (x, s) in docs if x == lang}
    size = {s: sum(n[lang, s, w] for w in kept) for s in sources}
    p = {(s, w): 1 + 10**9 * (n[lang, s, w] + 2) // (size[s] + 2 * len(kept)) for s in sources for w in kept}
    want = {(a, b): sum((p[a, w] - p[b, w]) ** 2 // (p[a, w] + p[b, w]) for w in kept) for a in sources for b in sources if a != b}
    got = {(r.source, r.item): r.value for r in D.divergence(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("lang = 'en' and part = 'pair'").collect()}
    assert kept and got == want


def test_sketch_never_underestimates(spark, sf_dir):
    """However narrow the sketch, the report is the same; and a wide one discards before counting."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    narrow, wide = D.sketch(rows, 3), D.sketch(rows, 16)
    exact = {(r.lang, r.term) for r in D.kept_counts(rows).collect()}
    assert {(r.lang, r.term) for r in D.kept_counts(rows, width_bits=3).collect()} == exact
    terms = lambda s: {(r.lang, r.term) for r in D.possible_counts(rows, s, D.LEAST_DOCS).collect()}
    assert exact <= terms(wide) < terms(narrow) | {None}
    # counters stop instead of running over
    many = spark.createDataFrame([("en", "s", "often")] * 700, "lang string, source string, text string")
    assert D.sketch(many, 8).max() == D.CEILING and D.kept_counts(many).first().n == 700


def test_terms_and_shares(spark):
    import pyarrow as pa

    texts = ["Ab\x00cd-日本 É[x]{y}@z", "", None, "end", "@", "x" * 300_000]
    doc, terms = D.terms_of(pa.array(texts))
    assert list(zip(doc.tolist(), terms.to_pylist())) == [(i, w) for i, t in enumerate(texts) for w in TERM.findall(lower(t or ""))]
    big = spark.range(1).select(D.share(F.lit(10**15), F.lit(3 * 10**15), F.lit(7)).alias("p"), D.share(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("none")).first()
    assert big.p == 1 + 10**9 * (10**15 + 2) // (3 * 10**15 + 14) and big.none is None


def words_of(docs):
    n = Counter()
    for doc_id, text in docs:
        for r in RUN.findall(text or ""):
            r = lower(r)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{r}".encode())
            if h % 31 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= 7:
                n[r] += 1
    return {w: c for w, c in n.items() if c >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :]


def expected_variants(n):
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return out


def test_spelling(spark, sf_dir):
    columns, got = run(spark, sf_dir, "op12_spelling_variants")
    assert columns == ["word", "form", "root", "n", "n_near", "form_n"] and len(got) == len(set(got))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = expected_variants(words_of(docs))
    assert set(got) == want == set(duck(sf_dir, "op12_spelling_variants"))
    assert any(len(w[0]) > 2900 and w[1] for w in want)


@pytest.mark.parametrize("long", [3, S.LONG])
def test_spelling_chains(spark, long):
    """Chains of forms, ties, and words that go by fingerprints as they do by themselves."""
    counts = {"aaaaaaa": 5000, "aaaaaab": 500, "aaaaabb": 40, "aaaabbb": 4, "aaaaaaaa": 30, "aaaaaac": 500, "zzzzzzz": 2, "zzzzzzy": 20, "zzzzzzx": 20, "zzzzzzzz": 3}
    docs = spark.createDataFrame([(i, " ".join([w] * c)) for i, (w, c) in enumerate(counts.items())], "doc_id long, text string")
    got = {tuple(r) for r in S.spelling_variants(docs, misspelt=10**9, long=long).collect()}
    assert got == expected_variants(counts)
    by = {r[0]: r for r in got}
    assert by["aaaabbb"][2] == "aaaaaaa" and by["zzzzzzz"][1] == "zzzzzzx"


def test_fingerprints():
    rnd = random.Random(2)
    for _ in range(200):
        w = "".join(rnd.choice("aé") for _ in range(rnd.randint(7, 14)))
        less = {w[:i] + w[i + 1 :] for i in range(len(w))}
        assert sorted(S.deletions(w, 3)) == sorted(S.name_of(x, 3) for x in less) and sorted(S.deletions(w)) == sorted(less)
        i, c = rnd.randrange(len(w)), rnd.choice("bc")
        other = w[:i] + c + w[i + 1 :]
        assert set(S.holes(w, 3)) & set(S.holes(other, 3)) == {S.holes(w, 3)[i]} and set(S.holes(w)) & set(S.holes(other)) == {S.holes(w)[i]}


def usable(v):
    return bool(v) and all(e is not None and np.isfinite(e) for e in v) and any(v)


def test_neighbours(spark, sf_dir):
    columns, got = run(spark, sf_dir, "op13_posting_lists")
    assert columns == ["query_id", "rank", "vec_id", "score"]
    rows = [(r.vec_id, np.array(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.vec_id is not None and usable(r.embedding)]
    by = defaultdict(list)
    for q, rank, v, s in got:
        by[q].append((rank, v, s))
    assert set(by) == {i for i, _ in rows if i % 20 == 0} - {i for i, v in rows if len(v) == 2}
    found = total = 0
    vectors = dict(rows)
    for q, hits in by.items():
        others = {i: float((vectors[q] * v).sum()) for i, v in rows if i != q and len(v) == len(vectors[q])}
        want = sorted(others, key=lambda i: (-others[i], i))[:20]
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21)) and len({h[1] for h in hits}) == 20
        assert all(abs(others[v] - s) <= 1e-12 * abs(s) for _, v, s in hits)
        assert [(v, s) for _, v, s in hits] == sorted(((v, s) for _, v, s in hits), key=lambda x: (-x[1], x[0]))
        found += len({h[1] for h in hits} & set(want))
        total += 20
    assert found >= 0.9 * total
    # copies: the crowd's members are each other's nearest, but for the giant, smallest ids first
    assert [v for _, v, _ in by[60] if v != 20][:19] == [i for i in range(40, 90) if i != 60][:19]


def test_few_neighbours_and_none(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = P.nearest(make([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (20, [-1.0, 0.0])]), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 1.0), (0, 2, 2, 0.0), (0, 3, 20, -1.0), (20, 1, 2, 0.0), (20, 2, 0, -1.0), (20, 3, 1, -1.0)]
    assert P.nearest(make([(0, None)]), F.col("vec_id") % 20 == 0).collect() == []


def test_lists_are_balanced_and_the_graph_hangs_together():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 16))
    lists = P.fit_lists(x, float(np.sqrt((x * x).sum(1)).max()), len(x), 64)
    nearest = np.bincount(lists.walk(lists.place(x), 1.0)[1], minlength=len(lists.centroids))
    assert len(lists.centroids) == 64 and nearest.max() < 5 * 64
    points = lists.ask(x[:50])
    far = np.sqrt(np.maximum(1 + (lists.centroids**2).sum(1) - 2 * points @ lists.centroids.T, 0))
    walked = {(a, b) for a, b in zip(*lists.walk(points, 1.1)[:2], strict=True)}
    meant = {(a, b) for a, b in zip(*np.nonzero(far <= 1.1 * far.min(axis=1, keepdims=True)))}
    assert len(walked & meant) >= 0.99 * len(meant)


def test_empty_tables(spark, sf_dir):
    for name in ("op11_divergence", "op12_spelling_variants", "op13_posting_lists"):
        assert run(spark, f"{sf_dir}/empty", name)[1] == []
