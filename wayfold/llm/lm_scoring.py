"""Language-model scoring by cross-entropy difference.

Two bigram models over one vocabulary (the tokenizer's), one of a target part of the corpus and one of all of it, give
every token of every document a loss; a document's score is the mean of the per-token differences (target minus
background: the lower, the more like the target). A document's own counts are taken out of the models that saw it. The
models are matched: same vocabulary, same smoothing, and the background's counts weigh as many tokens as the target has
(what a sample of the target's size would hold on average), so that neither is smoother than the other.

Counts cover all documents and grow with them. No model is broadcast: documents are encoded in blocks, each block asks
for its own distinct bigrams, and the corpus-wide sums come back to the block by a join. However often a bigram occurs,
it is one row for each block, and sums are taken before they are shuffled. Only the vocabulary's own counts (one pair of
numbers for each token id) are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import may_be_in, slices, texts_of, tidy, written
from wayfold.llm.encoder import encoder

#: Tokens of a block: documents are gathered until it is full.
BLOCK_TOKENS = 4 << 20
#: Weight of the unigram model in a bigram's estimate, in tokens.
PRIOR = 20.0


def encode_blocks(docs: DataFrame, tokenizer: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``block, doc_id, ids`` (little-endian u32) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, block, held = encoder(tokenizer), TaskContext.get().partitionId() << 24, 0
        for batch in slices(batches):
            offsets, ids = enc.encode(batch.column("text"))
            ends = held + offsets[1:]
            blocks = block + ends // block_tokens
            block, held = int(blocks[-1]), int(ends[-1] % block_tokens)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets * 4), pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), batch.column("doc_id"), raw.cast(pa.binary())], ["block", "doc_id", "ids"])

    return texts_of(docs).mapInArrow(tidy(run), "block long, doc_id long, ids binary")


def bigrams(blobs: list, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (previous id, id; ``start`` before a document's first) of all documents, and the documents' offsets."""
    lengths = np.array([len(b) // 4 for b in blobs], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.frombuffer(b"".join(blobs), "<u4").astype(np.int64)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[offsets[:-1][lengths > 0]] = start
    return before << 32 | ids, offsets


def count_blocks(tokens: DataFrame, start: int) -> DataFrame:
    """``block, key, c``: the distinct bigrams of every block (of every run of rows, where a block comes in several)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        block = None

        def flush() -> pa.RecordBatch:
            keys, c = np.unique(bigrams(held, start)[0], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block, np.int64)), pa.array(keys), pa.array(c.astype(np.int64))], ["block", "key", "c"])

        for batch in batches:
            for b, x in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if b != block and held:
                    yield flush()
                    held = []
                block = b
                held.append(x)
        if held:
            yield flush()

    return tokens.select("block", "ids").mapInArrow(tidy(run), "block long, key long, c long")


def count_runs(tokens: DataFrame, start: int, run_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``key, t``: the distinct bigrams of every ``run_tokens`` tokens that a task meets, whatever blocks they are from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush() -> pa.RecordBatch:
            keys, c = np.unique(bigrams(held, start)[0], return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c.astype(np.int64))], ["key", "t"])

        size = 0
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                held.append(x)
                size += len(x) // 4
                if size >= run_tokens:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return tokens.select("ids").mapInArrow(tidy(run), "key long, t long")


def _vocabulary(counts: DataFrame, column: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each id occurs, and how often it stands before another: two numbers for each id of the vocabulary."""
    out = []
    for part in (F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("key", 32)):
        got = counts.filter(F.col(column) > 0).groupBy(part.alias("id")).agg(F.sum(column).alias("c")).toArrow()
        x = np.zeros(size + 1)
        x[got["id"].to_numpy().astype(np.int64)] = got["c"].to_numpy()
        out.append(x)
    return out[0], out[1]


def losses(pair: np.ndarray, before: np.ndarray, word: np.ndarray, total: float, size: int, prior: float = PRIOR) -> np.ndarray:
    """-log of the interpolated estimate from a bigram's count, its first id's and its second id's counts."""
    unigram = (word + 1) / (total + size + 1)
    return -np.log((pair + prior * unigram) / (before + prior))


def score_documents(docs: DataFrame, target_ids: DataFrame, tokenizer: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, n_tokens, ce_target, ce_background, score`` (nats a token) of every document; ``target_ids`` names the target's doc_ids.

    Null texts are empty; documents without tokens score 0 throughout. Null doc_ids are background only. Rows that share
    a doc_id are scored each for itself. An empty target leaves both models uniform, all scores 0; an empty table gives no rows.
    """
    spark = docs.sparkSession
    size = encoder(tokenizer).size
    tokens, _ = written(encode_blocks(docs, tokenizer, block_tokens), "tokens")
    target = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    flags, _ = written(tokens.select("doc_id", "block").join(target, "doc_id", "left_semi").distinct(), "target-docs")
    of_target = count_runs(may_be_in(tokens, "doc_id", target).join(target, "doc_id", "left_semi"), size, block_tokens)
    zero = F.lit(0).cast("long")
    counts, _ = written(count_blocks(tokens, size), "bigrams")
    both = counts.select("key", F.col("c").alias("b"), zero.alias("t")).unionByName(of_target.select("key", zero.alias("b"), "t"))
    totals, _ = written(both.groupBy("key").agg(F.sum("b").alias("b"), F.sum("t").alias("t")), "bigram-sums")
    words_b, before_b = _vocabulary(totals, "b", size)
    words_t, before_t = _vocabulary(totals, "t", size)
    matched = float(words_t.sum() / max(1.0, words_b.sum()))
    model = spark.sparkContext.broadcast((words_b, before_b, words_t, before_t))
    # a key's rows on the left are its blocks, at most; a block that came in several runs asks once
    sums = counts.select("block", "key").distinct().join(totals, "key").select("block", "key", "b", "t")
    sums = sums.unionByName(flags.select("block", (-1 - F.col("doc_id")).alias("key"), F.lit(-1).cast("long").alias("b"), zero.alias("t")))
    parts = max(1, tokens.select("block").distinct().count())

    def score(blocks: pa.Table, known: pa.Table) -> pa.Table:
        words_b, before_b, words_t, before_t = model.value
        flag = known["b"].to_numpy() < 0
        in_target = set((-1 - known["key"].to_numpy()[flag]).tolist())
        key = known["key"].to_numpy()[~flag]
        order = np.argsort(key)
        key, b, t = key[order], known["b"].to_numpy()[~flag][order], known["t"].to_numpy()[~flag][order]
        keys, offsets = bigrams(blocks["ids"].to_pylist(), size)
        place = np.searchsorted(key, keys)
        doc_ids, out = blocks["doc_id"].to_pylist(), []
        total_b, total_t = words_b.sum(), words_t.sum()
        for k, doc in enumerate(doc_ids):
            lo, hi = offsets[k], offsets[k + 1]
            if lo == hi:
                out.append((0, 0.0, 0.0, 0.0))
                continue
            at = place[lo:hi]
            _, inverse, own = np.unique(at, return_inverse=True, return_counts=True)
            first, second = keys[lo:hi] >> 32, keys[lo:hi] & 0xFFFFFFFF
            own = own[inverse]
            own_first, own_second = (np.unique(x, return_inverse=True, return_counts=True) for x in (first, second))
            own_first, own_second = own_first[2][own_first[1]], own_second[2][own_second[1]]
            less = 1 if doc in in_target else 0
            bg = losses(*(matched * x for x in (b[at] - own, before_b[first] - own_first, words_b[second] - own_second, total_b - (hi - lo))), size)
            tg = losses(t[at] - less * own, before_t[first] - less * own_first, words_t[second] - less * own_second, total_t - less * (hi - lo), size)
            out.append((int(hi - lo), float(tg.mean()), float(bg.mean()), float((tg - bg).mean())))
        n, ct, cb, s = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ce_target": pa.array(ct, pa.float64()), "ce_background": pa.array(cb, pa.float64()), "score": pa.array(s, pa.float64())})

    return tokens.repartition(parts, "block").groupBy("block").cogroup(sums.repartition(parts, "block").groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, ce_target double, ce_background double, score double")
