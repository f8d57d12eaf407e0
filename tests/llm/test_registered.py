"""Registered queries of the older operators on small Parquet tables, with nulls, repeated rows and clashing columns."""

import random
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfold.llm.encoder import tokenizer_path
from wayfold.llm.queries import BYTE_BPE, WORD_BPE, llm_queries
from wayfold.llm.toxicity import fit, score_documents

BAD = ["idiotic", "scumbag", "worthless", "moronic"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d, rnd = tmp_path_factory.mktemp("sf"), random.Random(8)
    plain = ["".join(rnd.choice("aeionrst") for _ in range(rnd.randint(2, 8))) for _ in range(600)]

    def text(toxic):
        w = [rnd.choice(plain) for _ in range(rnd.randint(5, 90))]
        for _ in range(3 if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(BAD))
        return " ".join(w)

    rows = [(i, text(i % 4 == 0)) for i in range(700)] + [(700, None), (701, ""), (None, "x"), (702, "word " * 60_000), (3, "again")]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(650)] + [(1, 0, None), (None, 1, 1), (9999, 1, 1)]
    spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id long, text string, toxicity2 double, n_tokens int").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def run(spark, sf_dir, name):
    return llm_queries()[name](spark, sf_dir)


def test_op7(spark, sf_dir):
    out = run(spark, sf_dir, "op7_toxicity")
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == 705 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 700]
    assert len(out) > 100 and sum(r.predicted == (r.doc_id % 4 == 0) for r in out) > 0.9 * len(out)


def test_a_text_above_the_bound_takes_no_other_along(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    # the first in hash order of those that may be fitted on grows beyond the bound
    first = labels.filter("toxic is not null and doc_id is not null and doc_id < 700").filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0).orderBy(F.xxhash64("doc_id")).first().doc_id
    grown = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("word "), 20_000)).otherwise(F.col("text")))
    model = fit(grown, labels, sample_bytes=60_000)
    p = {r.doc_id: r.toxicity for r in score_documents(docs.select("doc_id", "text").filter("doc_id between 650 and 699"), model).collect()}
    assert sum((p[i] >= 0.5) == (i % 4 == 0) for i in p) > 0.85 * len(p)


def test_tokens_of_registered_queries(spark, sf_dir):
    """op2, op3, op6 and op9 give the library's ids, whatever is repeated or null."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    lib = {n: Tokenizer.from_file(tokenizer_path(n)) for n in (WORD_BPE, BYTE_BPE)}
    ids = lambda name, t: lib[name].encode(t, add_special_tokens=False).ids
    raw = lambda xs: b"".join(x.to_bytes(4, "little") for x in xs)
    key = lambda xs: sorted(xs, key=repr)
    want = {(i, t): ids(WORD_BPE, t) for i, t in rows}

    got = run(spark, sf_dir, "op2_token_frames").collect()
    assert key((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == key((i, len(want[i, t]) + 1, zlib.crc32(raw([*want[i, t], 1]))) for i, t in rows)
    laid = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in laid] == [sum(n for _, n in laid[:k]) for k in range(len(laid))]
    named = [(r.start, r.doc_id) for r in got if r.doc_id is not None]
    assert [i for _, i in sorted(named)] == sorted(i for _, i in named)

    import hashlib

    got = run(spark, sf_dir, "op3_bpe_chunks").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    decoded = {k: lib[WORD_BPE].decode(v, skip_special_tokens=False) for k, v in want.items()}
    assert key((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == key((i, len(want[i, t]), sha(raw(want[i, t])), sha(decoded[i, t].encode())) for i, t in rows)

    got = run(spark, sf_dir, "op6_count_transducer").collect()
    counts = {(i, t): len(ids(BYTE_BPE, t)) for i, t in rows}
    assert key((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == key((i, len(t.encode()), counts[i, t], counts[i, t] > 1024) for i, t in rows)

    got = run(spark, sf_dir, "op9_packing").collect()
    assert sum(r.length for r in got) == sum(len(v) + 1 for v in (want[k] for k in rows))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 2048
    single = {i for i, _ in rows if sum(j == i for j, _ in rows) == 1}
    for i, t in rows:
        if i in single:
            whole, at = [*want[i, t], 1], 0
            for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(raw(whole[at : at + r.length]))
                at += r.length
            assert at == len(whole)
