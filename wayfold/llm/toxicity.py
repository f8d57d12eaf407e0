"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the embeddings of its character n-grams (hashed), so an unseen misspelling lies near the words
it shares n-grams with. A passage of a few words is the average of its words, and a linear softmax on it says whether
it is toxic. A document is as toxic as its worst passage, so a long clean text cannot hide one. Documents are labelled,
passages are not: the first half of the training takes all passages of a toxic document as toxic, the second half only
those that the model itself finds toxic (the worst one at least).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import compact, slices, spans, string_buffer, texts_of, tidy

BUCKET_BITS, DIMENSIONS, SIZES = 18, 4, (3, 4, 5)
#: Words of a passage; a shorter one counts as LEAST words at least.
PASSAGE, LEAST = 16, 8
#: The most labelled rows that the fit takes of each class, and bytes of text of both (the classifier is fitted on a bounded sample).
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_BYTES = 2000, 4000, 32 << 20
#: Bytes of text scored at once: some fifty bytes of arrays stand for each.
PART_BYTES = 2 << 20
ROUNDS, RATE, FLOOR = 100, 0.5, 0.2


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word offsets of the texts, the distinct words, and each word's index among these."""
    x = pc.replace_substring_regex(pc.utf8_lower(compact(texts)), r'[\s.,;:!?"()]+', " ")
    pieces = pc.split_pattern(x, " ")
    coded = pieces.values.cast(pa.large_string()).dictionary_encode()
    at, index, distinct = np.asarray(pieces.offsets).astype(np.int64), np.asarray(coded.indices), coded.dictionary
    empty = pc.index_in(pa.array([""], pa.large_string()), value_set=distinct)[0].as_py()
    if empty is not None:
        full = index != empty
        at = np.concatenate([[0], np.cumsum(full)])[at]
        index = index[full]
    return at - at[0], distinct, index


def ngrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by word, and hash buckets, of the n-grams (SIZES bytes) of every word between two marks, and of the word itself."""
    data, offsets = string_buffer(words)
    lengths = np.diff(offsets) + 2
    marked = np.full(int(lengths.sum()), 1, np.uint8)
    starts = np.cumsum(lengths) - lengths
    marked[spans(starts + 1, lengths - 2)] = data
    h = np.zeros(len(marked), np.uint64)
    found, owners = [], []
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(marked))  # bytes from here to the word's end
    padded = np.concatenate([marked, np.zeros(max(SIZES), np.uint8)])
    for n in range(1, max(SIZES) + 1):
        shifted = padded[n - 1 : n - 1 + len(marked)]
        h = (h * np.uint64(0x100000001B3)) ^ (shifted.astype(np.uint64) + np.uint64(n))
        if n in SIZES:
            ok = left >= n
            found.append(h[ok] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS))
            owners.append(word[ok])
    power = np.cumprod(np.full(int(lengths.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64))
    if len(words):
        weighted = (marked.astype(np.uint64) + np.uint64(7)) * power[left - 1]
        found.append(np.add.reduceat(weighted, starts) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BUCKET_BITS))
        owners.append(np.arange(len(words)))
    buckets, owner = np.concatenate(found).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]).astype(np.int64), buckets[order]


def passages(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of every passage: PASSAGE words each, the last one the text's last PASSAGE words."""
    n = np.diff(at)
    count = -(-n // PASSAGE)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.minimum(k * PASSAGE, np.maximum(n[text] - PASSAGE, 0))
    return at[text] + begin, at[text] + np.minimum(begin + PASSAGE, n[text]), text


def bags(at: np.ndarray, index: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each passage as the set of its words (a word that a junk line repeats counts once): passage and word of every
    member, then each passage's text and its share (1 / words)."""
    begin, end, text = passages(at)
    key = np.unique(np.repeat(np.arange(len(begin)), end - begin) * np.int64(n_words) + index[spans(begin, end - begin)])
    member, word = key // n_words, key % n_words
    return member, word, text, 1 / np.maximum(np.bincount(member, minlength=len(begin)), LEAST)


@dataclasses.dataclass
class Model:
    bucket: np.ndarray  # a bucket's part of the softmax's logit: embedding times the difference of the two weight vectors
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        """The worst passage's logit for each text; the bias where a text has no word."""
        at, words, index = words_of(texts)
        out = np.full(len(texts), self.bias)
        if len(index):
            goff, grams = ngrams(words)
            word = np.add.reduceat(self.bucket[grams], goff[:-1]) / np.diff(goff)
            member, which, text, share = bags(at, index, len(words))
            out[text] = -np.inf
            np.maximum.at(out, text, np.bincount(member, word[which], len(text)) * share + self.bias)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -30, 30)))


def _both(toxic: np.ndarray) -> bool:
    return bool(len(toxic)) and toxic.min() != toxic.max()


def train(texts: pa.Array, toxic: np.ndarray, seed: int = 7) -> Model:
    """Embeddings and softmax weights by full-batch Adam on four rows of five, then a scale for document scores fitted on the rest.

    Rows of one class only, or none, give a model that says that class (clean without rows) of every text; rows of both
    classes without any word give one that says their share of toxic rows. Rows too few to be split serve for both fits.
    """
    toxic = np.asarray(toxic, float)
    if not _both(toxic):
        return Model(np.zeros(1 << BUCKET_BITS), 4.0 if len(toxic) and toxic[0] else -4.0)
    rng = np.random.default_rng(seed)
    apart = np.arange(len(toxic)) % 5 == 4
    if _both(toxic[apart]) and _both(toxic[~apart]):
        fitted, scaled = texts.filter(pa.array(~apart)), texts.filter(pa.array(apart))
        known, toxic = toxic[apart], toxic[~apart]
    else:
        fitted, scaled, known = texts, texts, toxic
    at, words, index = words_of(fitted)
    if not len(index):
        return Model(np.zeros(1 << BUCKET_BITS), float(np.log(toxic.mean() / (1 - toxic.mean()))))
    goff, grams = ngrams(words)
    size = np.diff(goff)
    member, occurrence, text, share = bags(at, index, len(words))
    owner = np.repeat(np.arange(len(words)), size)
    params = {"E": rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)), "W": rng.normal(0, 0.5, (2, DIMENSIONS)), "b": np.zeros(2)}
    first, second = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}
    label = toxic[text]
    use = np.ones(len(text))
    for step in range(1, ROUNDS + 1):
        u = params["W"][1] - params["W"][0]
        e = params["E"] @ u
        word = np.add.reduceat(e[grams], goff[:-1]) / size
        logit = np.bincount(member, word[occurrence], len(text)) * share + params["b"][1] - params["b"][0]
        if step > ROUNDS // 2:
            worst = np.full(len(toxic), -np.inf)
            np.maximum.at(worst, text, logit)
            use = np.where((label == 1) & (logit < np.minimum(worst[text], 0)), 0.0, 1.0)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        weight = use * np.where(label == 1, 0.5 / max(1, (use * label).sum()), 0.5 / max(1, (use * (1 - label)).sum()))
        g = weight * (p - label)
        by_word = np.bincount(occurrence, (g * share)[member], len(words)) / size
        by_bucket = np.bincount(grams, by_word[owner], 1 << BUCKET_BITS)
        du = by_bucket @ params["E"]
        grads = {"E": by_bucket[:, None] * u, "W": np.stack([-du, du]), "b": np.array([-g.sum(), g.sum()])}
        for k, d in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.99 * second[k] + 0.01 * d * d
            scale = np.sqrt(second[k] / (1 - 0.99**step))
            # the floor keeps n-grams of few passages from moving as far as those with evidence
            params[k] -= RATE * (first[k] / (1 - 0.9**step)) / (scale + FLOOR * scale.max() + 1e-12)
    model = Model(params["E"] @ (params["W"][1] - params["W"][0]), float(params["b"][1] - params["b"][0]))
    x = model.logits(scaled)
    scale = max(1e-9, float(np.abs(x).mean()))
    a, c = 1.0, 0.0
    for _ in range(300):  # one-dimensional logistic regression
        p = 1 / (1 + np.exp(-np.clip(a * x / scale + c, -30, 30)))
        a, c = a - ((p - known) * x / scale).mean() * 2 - 0.0002 * a, c - (p - known).mean() * 2
    return Model(model.bucket.astype(np.float32), model.bias, a / scale, c)


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model fitted on at most ``toxic_rows`` and ``clean_rows`` labelled documents that are not held out, taken in hash
    order, whole; a text that would bring the bytes taken above ``sample_bytes`` is passed over and the next one tried.

    The ids come from ``labels`` alone; their texts' lengths are looked at before any text travels, and only the texts
    taken are gathered, in one task. Null labels are left out; a doc_id labelled twice counts as toxic if any label says
    so; of a doc_id's several texts the least is taken (the longest counts against the bound).
    """
    ids = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    some = [ids.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in ((1, toxic_rows), (0, clean_rows))]
    wanted = some[0].unionByName(some[1])
    # at most toxic_rows + clean_rows rows of two numbers
    texts = texts_of(docs)
    lengths = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n"), F.max("toxic").alias("toxic"))
    taken, room = [], sample_bytes
    for r in lengths.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r.n <= room:
            room -= r.n
            taken.append((r.doc_id, r.toxic))
    few = docs.sparkSession.createDataFrame(taken, lengths.select("doc_id", "toxic").schema)
    rows = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int64())])).sort_by("doc_id")
        m = train(table["text"].combine_chunks(), table["toxic"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(m.bucket, np.float32).tobytes()], pa.binary()), *(pa.array([float(x)]) for x in (m.bias, m.slope, m.shift))], ["bucket", "bias", "slope", "shift"])

    # one task holds the bounded sample; the driver gets the model alone
    sample = rows.select("doc_id", F.col("text"), F.col("toxic").cast("long").alias("toxic"))
    got = sample.repartition(1).mapInArrow(tidy(learn), "bucket binary, bias double, slope double, shift double").first()
    if got is None:
        return train(pa.array([], pa.large_string()), np.zeros(0))
    return Model(np.frombuffer(got.bucket, np.float32), got.bias, got.slope, got.shift)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """All columns of ``docs``, then ``name`` (0 to 1). Null texts score as empty ones; an empty table gives no rows."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name} already")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, PART_BYTES):
            yield batch.append_column(name, pa.array(sent.value.scores(batch.column(text_col)), pa.float64()))

    return docs.mapInArrow(tidy(run), docs.withColumn(name, F.lit(0.0)).schema)
