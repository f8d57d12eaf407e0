import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.llm import lsh_forest
from wayfold.llm.common import components, without
from wayfold.llm.lsh_forest import near_dedup, shingle_sets
from wayfold.llm.lsm_dedup import DigestIndex, exact_dedup
from wayfold.llm.pivot_dedup import near_vectors
from wayfold.llm.suffix_dedup import remove_repeats, repeats, suffix_array
from wayfold.llm.toxicity import fit, score_documents, train


def group(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = [text(rnd.randint(1, 80)) for _ in range(40)] + ["", None, "  ", "one", "One", "a b c d", "ab " * 400]
    passage = text(40)
    for i in range(30):  # copies, near copies and a shared passage
        base = texts[i % 8].split()
        if i % 3 == 0 and len(base) > 3:
            base[rnd.randrange(len(base))] = word()
        texts.append(" ".join(base) if i % 3 < 2 else text(10) + passage + text(5))
    rows = [(i, t, "s", False) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, kept boolean").repartition(5).persist()


def texts_by_id(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 540)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    whole = group(edges, {x for e in edges for x in e})
    assert got == {n: whole[n] for n in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_without(spark, docs):
    gone = spark.createDataFrame([(3,), (None,), (3,)], "doc_id long")
    left = without(docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), gone)
    assert left.count() == docs.count() and left.filter("doc_id = 3").count() == 0


@pytest.mark.parametrize("digest", [None, lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1).cast("binary")])
def test_exact_dedup(spark, docs, digest):
    text = texts_by_id(docs)
    n, best = Counter(text.values()), {}
    for i, t in text.items():
        best[t] = max(best.get(t, i), i)
    got = (exact_dedup(docs) if digest is None else exact_dedup(docs, digest=digest)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(i, best[t], n[t], best[t] == i) for i, t in text.items()}
    assert exact_dedup(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup(odd).collect()) == [(0, 0, 1, False), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]


def test_runs_filters_and_compaction_decide(spark, docs, monkeypatch):
    """Results come from the runs: a filter that misses a digest, or ids that compaction loses, show in them."""
    text = texts_by_id(docs)
    index = DigestIndex(spark)
    index.flush(index.digests(docs), 3)
    runs = index.runs().collect()
    assert len({r.run for r in runs}) == 3 and len(runs) > len(set(text.values()))
    several = Counter(r.fingerprint for r in runs)
    assert {r.fingerprint for r in index.suspects().collect()} == {f for f, n in several.items() if n > 1}
    hits = {bytes(r.digest): (r.smallest, r.largest, r.n) for r in index.hits().collect()}
    groups = {}
    for i, t in text.items():
        groups.setdefault(hashlib.sha256(t.encode()).digest(), []).append(i)
    assert hits == {d: (min(g), max(g), len(g)) for d, g in groups.items() if len(g) > 1}
    assert {(r.doc_id, r.keep_id) for r in exact_dedup(docs, keep="smallest").collect()} == {(i, min(g)) for g in groups.values() for i in g}
    monkeypatch.setattr(DigestIndex, "suspects", lambda self: self.runs().select("fingerprint").limit(0))
    assert {(r.doc_id, r.keep_id) for r in exact_dedup(docs).collect()} != {(i, max(g)) for g in groups.values() for i in g}


def brute_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup(spark, docs):
    text = texts_by_id(docs)
    sets = {i: brute_shingles(t) for i, t in text.items()}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    whole = group(edges, sets)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs).collect()}
    assert got == {(i, len(s), whole[i], whole[i] == i) for i, s in sets.items()}
    assert near_dedup(docs.limit(0)).count() == 0


def star(copies=450, words=124):
    """An original and copies, each changed at other places: near to the original, not to each other."""
    rnd = random.Random(12)
    base = [f"w{k}" for k in range(words)]
    out = [" ".join(base)]
    for i in range(copies):
        edited = list(base)
        for k in rnd.sample(range(5, words - 5, 6), 3):
            edited[k] = f"x{i}q{k}"
        out.append(" ".join(edited))
    return out


@pytest.mark.parametrize("block", [512, 60])
def test_near_dedup_of_a_star(spark, monkeypatch, block):
    monkeypatch.setattr(lsh_forest, "BLOCK_ROWS", block, raising=False)
    texts = star()
    rows = [(i, t) for i, t in enumerate(texts[1:])] + [(9000, texts[0]), (9001, "another text of six words")]
    sets = {i: brute_shingles(t) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert sum(b == 9000 for _, b in edges) == 450 and len(edges) < 600
    whole = group(edges, sets)
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == whole


def test_shingles_see_white_space_and_borders():
    texts = ["A b\tC d e f", "a b c d e", "", " \n", "x", "a b\x0bc d e f ", "a b c d\xa0e f"]
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(brute_shingles(t)) for t in texts]
    s = shingle_sets(pa.array(texts))
    assert s[0].tolist() == s[5].tolist() and s[1][0] in s[0]


def test_suffix_array():
    rnd = random.Random(3)
    for _ in range(300):
        t = bytes(rnd.choice(b"abc"[: rnd.randint(1, 3)]) for _ in range(rnd.randint(0, 50)))
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
    assert repeats(b"abcabcx", 3) == [False] * 3 + [True] * 3 + [False]


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_remove_repeats(spark, docs, crowd):
    seen, expected = set(), {}
    for i, t in sorted(texts_by_id(docs).items()):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        expected[i] = (len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), bytes(x for x, g in zip(b, gone) if not g))
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in remove_repeats(docs, crowd=crowd).collect()}
    assert got == expected and sum(x[1] for x in got.values()) > 1000
    assert remove_repeats(docs.limit(0)).count() == 0


def test_remove_repeats_of_odd_ids(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdef ") for _ in range(300))
    rows = [(None, long), (7, long), (7, "other " + long), (8, long[:99]), (9, None)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), carry=["text"]).collect()
    assert len(got) == 5
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert sorted(r.n_removed for r in got if r.doc_id == 7) == [300, 300]
    assert [r.rest.text for r in got if r.doc_id == 8] == [long[:99]]


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[rng.integers(0, 20, 60)] + 0.03 * rng.normal(size=(60, 16))
    x[160:190] = x[5]
    label = rng.integers(0, 2, 300)
    label[160:190] = label[5]
    rows = [(int(i), [float(v) for v in x[i]], int(label[i])) for i in range(300)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[5][1], None), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [], 1)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    whole = group([(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b] + [(905, 906)], [r[0] for r in rows])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block in (1024, 16):
        got = {r.vec_id: r for r in near_vectors(frame, block=block).collect()}
        assert len(got) == len(rows)
        assert all(got[i].n_links <= near[i].sum() for i in range(300))
        assert sum(got[i].n_links for i in range(300)) >= 0.9 * near.sum()
        assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 907))
        assert np.mean([got[i].component_id == whole[i] for i in whole]) > 0.9
    assert near_vectors(frame.limit(0)).count() == 0


def test_toxicity_generalises(spark):
    rnd = random.Random(8)
    plain = ["".join(rnd.choice("aeionrst") for _ in range(rnd.randint(2, 8))) for _ in range(600)]
    bad = ["idiotic", "scumbag", "worthless", "moronic"]

    def text(toxic):
        w = [rnd.choice(plain) for _ in range(rnd.randint(5, 90))]
        for _ in range(3 if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        return " ".join(w)

    y = np.array([i % 4 == 0 for i in range(1200)], float)
    model = train(pa.array([text(t) for t in y], pa.large_string()), y)
    fresh = np.array([i % 2 == 0 for i in range(200)])
    p = model.scores(pa.array([text(t) for t in fresh], pa.large_string()))
    assert ((p >= 0.5) == fresh).mean() > 0.9
    misspelt, clean = (model.scores(pa.array([" ".join([*plain[:10], *w])]))[0] for w in (["worthlesss", "scumbagg", "idiotics"], plain[20:23]))
    assert misspelt > clean
    assert train(pa.array([], pa.large_string()), np.zeros(0)).scores(pa.array(["x", "", None]))[0] < 0.5
    odd = pa.array(["", "x", None, "\0", "x" * 200_000, "a b"], pa.large_string())
    assert ((model.scores(odd) >= 0) & (model.scores(odd) <= 1)).all() and len(model.scores(pa.array([], pa.large_string()))) == 0
    for few in (["bad", "good"], ["", ""], ["x", None, "y"], ["a", "b", "c", "d", "e"]):
        p = train(pa.array(few, pa.large_string()), np.arange(len(few)) % 2 == 1).scores(odd)
        assert np.isfinite(p).all()
    docs = spark.createDataFrame([(1, None, 5), (None, "x", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert score_documents(docs, fit(docs, labels)).count() == 2
    with pytest.raises(ValueError):
        score_documents(docs, model, name="SCORE")
