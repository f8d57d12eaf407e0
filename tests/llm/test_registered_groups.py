"""Registered queries that group, cut or link rows, and the pipeline's first stage, on small tables against plain recounts."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from test_dedup import brute_shingles, group
from wayfold.llm.encoder import tokenizer_path
from wayfold.llm.queries import OP5_SQL, WORD_BPE, llm_queries

BAD = ["idiotic", "scumbag", "worthless", "moronic"]


def texts():
    rnd = random.Random(21)
    plain = ["".join(rnd.choice("aeionrst") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    words = lambda n: [rnd.choice(plain) for _ in range(n)]
    passage = " ".join(words(40)) + " é€ "
    out = [" ".join(words(rnd.randint(5, 90))) for _ in range(80)]
    out += [f"{t} {passage}{t[:20]}" for t in out[:12]]
    for t in out[20:32]:
        w = t.split()
        w[rnd.randrange(len(w))] = "changed"
        out.append(" ".join(w).upper() if len(out) % 2 else " ".join(w))
    out += [out[40]] * 30 + ["three little words"] * 3 + [None, "", " \t", None, "word " * 40_000, "word " * 40_000 + "x"]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d, rnd = tmp_path_factory.mktemp("sf"), np.random.default_rng(4)
    rows = [(i * 3 + 1, t, True, 7, "x", 1) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, kept boolean, group_size int, digest string, component_id int").repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], k % 2, 0) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    vectors = []
    for label in range(3):
        for c in rnd.normal(size=(25, 16)):
            vectors += [(label, (c + s * rnd.normal(size=16)).astype("float32").tolist()) for s in (0, 0.01, 0.05, 0.1, 0.2)]
    vectors += [(0, [0.0] * 16), (0, None), (1, [float("nan")] * 16), (1, [None] + [1.0] * 15), (None, vectors[0][1]), (None, vectors[0][1]), (0, vectors[0][1]), (0, vectors[0][1])]
    spark.createDataFrame([(i, v, g, 3.0) for i, (g, v) in enumerate(vectors)], "vec_id long, embedding array<float>, label int, n_links double").repartition(3).write.parquet(f"{d}/embeddings.parquet")
    return str(d)


def run(spark, sf_dir, name):
    return llm_queries()[name](spark, sf_dir)


def documents(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_op1(spark, sf_dir):
    seen, want = set(), []
    for i, t in sorted(documents(spark, sf_dir).items()):
        t = t.encode()
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            h = hashlib.blake2b(t[k : k + 100], digest_size=16).digest()
            if h in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(h)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    got = run(spark, sf_dir, "op1_suffix_dedup")
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == want and sum(w[2] for w in want) > 200_000


def test_op4(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    good = [r for r in rows if r.label is not None and r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    unit = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) for r in good}
    label = {r.vec_id: r.label for r in good}
    links = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.98]
    whole, n = group(links, [r.vec_id for r in rows]), {r.vec_id: 0 for r in rows}
    for pair in links:
        for v in pair:
            n[v] += 1
    got = {r.vec_id: r for r in run(spark, sf_dir, "op4_pivot_index").collect()}
    assert set(got) == set(n) and len(links) > 100
    assert all(r.n_links <= n[v] and r.kept == (r.component_id == v) for v, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * 2 * len(links)
    assert sum(r.component_id == whole[v] for v, r in got.items()) >= 0.95 * len(got)


def test_op5(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet/*.parquet'")
    want = con.execute(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({OP5_SQL}) order by 1").fetchall()
    got = run(spark, sf_dir, "op5_lsm_dedup").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect())) == want and max(w[2] for w in want) == 31


def test_op8(spark, sf_dir):
    docs = documents(spark, sf_dir)
    sets = {i: brute_shingles(t) for i, t in docs.items()}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    whole = group(near, sets)
    got = run(spark, sf_dir, "op8_lsh_forest").select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted((i, len(s), whole[i], whole[i] == i) for i, s in sets.items())
    assert sum(docs[a] != docs[b] for a, b in near) > 5


def test_op10(spark, sf_dir):
    docs, lib = documents(spark, sf_dir), Tokenizer.from_file(tokenizer_path(WORD_BPE))
    got = {r.doc_id: r for r in run(spark, sf_dir, "op10_cross_entropy").collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
    assert all(abs(r.score - (r.ce_target - r.ce_background)) < 1e-9 for r in got.values())
    assert all(r.score == 0 for i, r in got.items() if not docs[i]) and any(r.score != 0 for r in got.values())


def test_the_pipeline_s_first_stage_rejects_what_op7_predicts(spark, tmp_path):
    rnd = random.Random(5)
    plain = ["".join(rnd.choice("aeionrst") for _ in range(rnd.randint(2, 8))) for _ in range(500)]

    def text(toxic):
        w = [rnd.choice(plain) for _ in range(rnd.randint(8, 60))]
        for _ in range(4 if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(BAD))
        return " ".join(w)

    rows = [(i, text(i % 4 == 0), "en", "s", 1) for i in range(600)] + [(600, None, None, None, 0), (601, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = P.STAGES[0][1](spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    left = {r.doc_id for r in left.collect()}
    rejected = {r.doc_id for r in run(spark, str(tmp_path), "op7_toxicity").filter(F.col("predicted") == 1).collect()}
    assert left == set(range(602)) - rejected
    new = range(500, 600)
    assert sum(i in rejected for i in new if i % 4 == 0) >= 23 and sum(i in left for i in new if i % 4) >= 73 and {600, 601} <= left
