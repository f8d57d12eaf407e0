import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wayfold.llm.bpe_chunks import chunk_encoder, encode_decode
from wayfold.llm.count_transducer import count_tokens, counting_tokenizer
from wayfold.llm.encoder import encoder, tokenizer_path
from wayfold.llm.lm_scoring import score_documents
from wayfold.llm.packing import capacities, pack, pack_documents, sequences
from wayfold.llm.token_frames import ShardReader, open_store, read_token_files, write_token_files

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
ODD = ["", "don't stop.it's we'll", "a.b,c...d ,., x", "<|endoftext|> hi <|ENDOFTEXT|> a<|endoftext|>", "É̀cole Éa  x　y", "K Å ﬁ ß ẞ İ", "123 4a5 'S 's", "x" * 5000, "日本語 テ́." * 300, "a\tb\r\nc  d\n", "\x01 \x00a", "’s ª² µ×", "    ", "ab cd " * 2000, "'re'rx 'v''s"]


def noise(n, seed=1):
    rnd = random.Random(seed)
    bits = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "1", "½", "é", "日", "!", "\x00", "́", "a", "<|endoftext|>", "😀", ".", ", "]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ODD + noise(60) + [None]
    rows = [(i if i != 3 else None, t, i, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, score double").repartition(3).persist()


def test_word_encoder_is_the_library():
    texts, library = ODD + noise(800), Tokenizer.from_file(WORD)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for offsets, ids in (encoder(WORD).encode(pa.array(texts)), chunk_encoder(WORD).encode(pa.array(texts))[:2]):
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == expected
    decoded = encoder(WORD).decode(offsets, ids).to_pylist()
    assert decoded == [library.decode(x, skip_special_tokens=False) for x in expected]


@pytest.mark.parametrize("texts", [[""], ["", ""], [None]])
def test_batches_without_bytes(texts):
    offsets, ids, _ = chunk_encoder(WORD).encode(pa.array(texts, pa.string()))
    assert offsets.tolist() == [0] * (len(texts) + 1) and not len(ids)
    assert encoder(WORD).decode(offsets, ids).to_pylist() == [""] * len(texts)


def test_empty_document_alone(spark):
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string").repartition(1)
    assert [(r.n_tokens, bytes(r.ids), r.decoded) for r in encode_decode(docs, WORD).collect()] == [(0, b"", "")]


def test_transducer_is_the_library():
    texts, library = ODD + noise(1500, 2), Tokenizer.from_file(BYTE)
    assert counting_tokenizer(BYTE).count(pa.array(texts)).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_count_query(spark, docs):
    got = {r.doc_id: r for r in count_tokens(docs, BYTE, 1024).collect()}
    assert len(got) == docs.count() and got[7].n_bytes == 5000 and got[0].n_tokens == 0 and got[len(ODD) + 60].n_tokens == 0
    assert got[13].over_limit is True


def test_encode_decode_query(spark, docs):
    library = Tokenizer.from_file(WORD)
    for d, r in zip(docs.orderBy("n_tokens").collect(), sorted(encode_decode(docs, WORD).collect(), key=lambda r: (3 if r.doc_id is None else r.doc_id))):
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, bytes(r.ids), r.decoded) == (len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))


def test_token_files_round_trip(spark, docs):
    manifest, _ = write_token_files(docs, WORD, shard_docs=20)
    rows = read_token_files(manifest).collect()
    library, at = Tokenizer.from_file(WORD), 0
    order = sorted(docs.collect(), key=lambda d: (d.doc_id is not None, d.doc_id))
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(order) and manifest.count() > 1
    for d in order:
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        r = by[d.doc_id]
        assert (r.start, r.n_tokens, zlib.crc32(r.ids)) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    some = read_token_files(manifest, [5, 40]).collect()
    assert {r.doc_id for r in some} == {5, 40} and all(by[r.doc_id].ids == r.ids for r in some)
    assert write_token_files(docs.limit(0), WORD)[0].count() == 0


def test_damaged_frame_is_found(spark, docs, tmp_path):
    manifest, _ = write_token_files(docs, WORD, f"file://{tmp_path}/t")
    store, path = open_store(manifest.first().path)
    raw = bytearray(open(path, "rb").read())
    with store.open_input_file(path) as f:
        shard = ShardReader(f, len(raw))
        k = int(np.argmax(shard.docs[:, 1]))
        first = shard.docs[k, 2]
        at = int(shard.starts[first] + shard.starts[first + 1]) // 2
    raw[at] ^= 0xFF
    (tmp_path / "bad").write_bytes(raw)
    with open(tmp_path / "bad", "rb") as f, pytest.raises(Exception):  # noqa: B017
        ShardReader(f, len(raw)).ids(k)


def test_pack_fills_everything():
    rnd = random.Random(4)
    lengths = [rnd.choice([1, 5, 300, 2048, 5000]) for _ in range(200)]
    pieces, used = pack(lengths), {}
    for doc, start, n, s, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert used.get(s, 0) == offset and n > 0
        used[s] = offset + n
    assert sorted(used.values(), reverse=True) == capacities(sum(lengths))
    for d, n in enumerate(lengths):
        own = sorted((p[1], p[2]) for p in pieces if p[0] == d)
        assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:])) and sum(own[-1]) == n
    assert pack([]) == [] and all(c & (c - 1) == 0 for c in capacities(12345))


def test_pack_query(spark, docs):
    pieces = pack_documents(docs, WORD, capacity=64).persist()
    assert pieces.groupBy("doc_id").sum("length").count() == docs.count()
    library = Tokenizer.from_file(WORD)
    text = dict((r.doc_id, r.text) for r in docs.collect())
    for r in pieces.collect():
        ids = [*library.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert r.doc_tokens == len(ids) and bytes(r.ids) == np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
    assert all(len(r.ids) == 4 * r.length and r.length <= 64 for r in sequences(pieces).collect())
    assert pack_documents(docs.limit(0), WORD).count() == 0


def test_cross_entropy(spark):
    rows = [(i, "the red house of the king" if i % 2 else "zebra quark flux neutron", "x") for i in range(40)] + [(100, "the red king", "x"), (101, "neutron flux", "x"), (102, None, "x"), (None, "the", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    target = spark.createDataFrame([(i,) for i in range(1, 40, 2)] + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in score_documents(docs, target, WORD, block_tokens=50).collect()}
    assert len(got) == 44 and got[100].score < 0 < got[101].score and got[102].score == 0.0
    # brute force of every document
    library, size = Tokenizer.from_file(WORD), encoder(WORD).size
    def pairs(t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return list(zip([size, *ids], ids))
    def loss(corpus, own, weight=1.0):
        every = [p for t in corpus for p in pairs(t)]
        left = every[:]
        for p in own:
            if p in left:
                left.remove(p)
        out = []
        for a, b in own:
            uni = (weight * sum(w == b for _, w in left) + 1) / (weight * len(left) + size + 1)
            out.append(-np.log((weight * left.count((a, b)) + 20.0 * uni) / (weight * sum(v == a for v, _ in left) + 20.0)))
        return float(np.mean(out))

    seen = [r[1] for r in rows if r[0] in range(1, 40, 2)]
    weight = sum(len(pairs(t)) for t in seen) / sum(len(pairs(r[1])) for r in rows)
    for doc_id, text, _ in rows:
        if text is None:
            continue
        own = pairs(text)
        background = loss([r[1] for r in rows], own, weight)
        foreground = loss(seen, own) if text in seen and doc_id in range(1, 40, 2) else loss([*seen, text], own)
        assert abs(got[doc_id].ce_background - background) < 1e-9 and abs(got[doc_id].ce_target - foreground) < 1e-9
        assert abs(got[doc_id].score - (foreground - background)) < 1e-9 and got[doc_id].n_tokens == len(own)
    assert score_documents(docs.limit(0), target, WORD).count() == 0
    assert {r.score for r in score_documents(docs, target.limit(0), WORD).collect()} == {0.0}


