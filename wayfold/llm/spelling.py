"""Spelling variants: words one code point apart, without pairs of words.

Words that differ in one code point at place i share the text before and after i, so they meet in the group (i, prefix,
suffix). A group has at most one word for each letter of the alphabet (90), whatever the corpus; it keeps its size and
its two most frequent words, and each member is told the size less itself and the best of the two that is not itself.
Words that differ by one inserted or deleted code point meet where a word's deletions join the vocabulary. Both give a
word a count of near words and its best near word; these are combined word by word.

Groups and deletions of a word of n code points would take n texts of n code points: words of more than LONG go by
fingerprints of these texts (two polynomials over a prime near 2^61), made in one pass from those of prefixes and suffixes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.llm.common import compact, drop_path, slices, string_buffer, texts_of, tidy, written

#: Code points and occurrences of a word, how many times as frequent its form is, and what part of the runs is misspelt.
LEAST_LENGTH, LEAST_COUNT, TIMES, MISSPELT = 7, 2, 10, 31
LONG = 64
_PRIME, _BASES = (1 << 61) - 1, (911382323, 972663749)
_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b == 0xC3 for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def runs_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text, code points and text of every maximal run of A-Z, a-z and U+00C0 to U+00FF (lead byte C3), A-Z in lower case."""
    data, offsets = string_buffer(texts)
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = inside[edges]
    start = np.flatnonzero(begins)
    held = np.cumsum(inside)
    at = np.concatenate([[0], np.append(held[start[1:]] - 1, held[-1]) if len(start) else []]).astype(np.int64)
    kept = _LOWER[data[inside]]
    points = np.concatenate([[0], np.cumsum((kept < 0x80) | (kept > 0xBF))])
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(kept))
    return np.searchsorted(offsets, start, "right") - 1, np.diff(points[at]), words


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, misspelt: int = MISSPELT) -> DataFrame:
    """``word, n``: how often each word results from the runs of a slice of documents; several rows a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, length, words = runs_of(batch.column("text"))
            long = length >= least_length
            doc = doc[long]
            coded = words.filter(pa.array(long)).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            key, n = np.unique(doc * max(1, len(distinct)) + np.asarray(coded.indices), return_counts=True)
            doc, word = key // max(1, len(distinct)), key % max(1, len(distinct))
            opening = [zlib.crc32(b":" if i is None else b"%d:" % i) for i in batch.column("doc_id").to_pylist()]
            raw = [w.encode() for w in distinct]
            h = np.fromiter((zlib.crc32(raw[w], opening[d]) for d, w in zip(doc.tolist(), word.tolist(), strict=True)), np.int64, len(doc))
            cut = h % misspelt == 0
            out: dict[str, int] = {}
            for w, x, c in zip(word[cut].tolist(), h[cut].tolist(), n[cut].tolist(), strict=True):
                text = distinct[w]
                at = x % len(text)
                if len(text) > least_length:
                    text = text[:at] + text[at + 1 :]
                    out[text] = out.get(text, 0) + c
            whole = np.bincount(word[~cut], n[~cut], len(distinct)).astype(np.int64)
            met = np.flatnonzero(whole)
            texts = pa.concat_arrays([compact(coded.dictionary.take(pa.array(met))), pa.array(list(out), pa.large_string())])
            yield pa.RecordBatch.from_arrays([texts.cast(pa.string()), pa.array(np.concatenate([whole[met], np.array(list(out.values()), np.int64)]))], ["word", "n"])

    return texts_of(docs).mapInArrow(tidy(run), "word string, n long")


# ------------------------------------------------------------------ names of texts


class Prints:
    """Fingerprints of a long word's parts: ``ahead`` of its first i code points, ``behind`` of those from i on."""

    def __init__(self, word: str, base: int):
        self.power, self.ahead, self.behind = [1], [0], [0]
        for c in word:
            self.ahead.append((self.ahead[-1] * base + ord(c) + 1) % _PRIME)
            self.power.append(self.power[-1] * base % _PRIME)
        for k, c in enumerate(reversed(word)):
            self.behind.append((self.behind[-1] + (ord(c) + 1) * self.power[k]) % _PRIME)
        self.behind.reverse()


def name_of(word: str, long: int = LONG) -> str:
    """A word itself, or a long one's fingerprints."""
    if len(word) <= long:
        return word
    return f"#{len(word)}:" + ":".join(f"{Prints(word, b).ahead[-1]:x}" for b in _BASES)


def deletions(word: str, long: int = LONG) -> list[str]:
    """The names of the distinct texts that are the word less one code point; of a run of equal ones the first goes."""
    places = [i for i in range(len(word)) if not i or word[i] != word[i - 1]]
    if len(word) <= long + 1:
        return [word[:i] + word[i + 1 :] for i in places]
    two, n = [Prints(word, b) for b in _BASES], len(word)
    return [f"#{n - 1}:" + ":".join(f"{(p.ahead[i] * p.power[n - 1 - i] + p.behind[i + 1]) % _PRIME:x}" for p in two) for i in places]


def holes(word: str, long: int = LONG) -> list[str]:
    """The group of every place: the text before it and behind it (no letter is a star)."""
    if len(word) <= long:
        return [f"{word[:i]}*{word[i + 1 :]}" for i in range(len(word))]
    two, n = [Prints(word, b) for b in _BASES], len(word)
    return [f"*{n}:{i}:" + ":".join(f"{p.ahead[i]:x}.{p.behind[i + 1]:x}" for p in two) for i in range(n)]


def _expand(vocabulary: DataFrame, kind: str, long: int) -> DataFrame:
    """``at, name, n, letter``: a row for each group (``holes``) or deletion of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word", 1 << 20):
            at, name, n, letter = [], [], [], []
            for word, own, c in zip(*(batch.column(x).to_pylist() for x in ("word", "name", "n")), strict=True):
                found = holes(word, long) if kind == "holes" else deletions(word, long)
                at += found
                name += [own] * len(found)
                n += [c] * len(found)
                letter += list(word) if kind == "holes" else [""] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.string()), pa.array(name, pa.string()), pa.array(n, pa.int64()), pa.array(letter, pa.string())], ["at", "name", "n", "letter"])

    return vocabulary.mapInArrow(tidy(run), "at string, name string, n long, letter string")


def vocabulary_of(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, misspelt: int = MISSPELT, long: int = LONG) -> DataFrame:
    """``word, n, name``."""
    words = count_words(docs, least_length, misspelt).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("name", pa.array([name_of(w, long) for w in batch.column("word").to_pylist()], pa.string()))

    return words.mapInArrow(tidy(run), "word string, n long, name string")


# ------------------------------------------------------------------ near words


def replaced(vocabulary: DataFrame, long: int) -> DataFrame:
    """``name, n, near, best, best_n``: for each word and place, the other words of the group and the most frequent of them."""
    group = W.partitionBy("at")
    ranked = group.orderBy(F.desc("n"), "letter").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    one = F.struct("name", "n")
    rows = _expand(vocabulary, "holes", long).withColumns({"size": F.count(F.lit(1)).over(group), "first": F.first(one).over(ranked), "second": F.nth_value(one, 2).over(ranked)})
    best = F.when(F.col("first.name") == F.col("name"), F.col("second")).otherwise(F.col("first"))
    return rows.filter("size > 1").select("name", "n", (F.col("size") - 1).alias("near"), best["name"].alias("best"), best["n"].alias("best_n"))


def inserted(vocabulary: DataFrame, long: int) -> DataFrame:
    """``name, n, near, best, best_n``: words and those that they become by losing one code point, told to both."""
    shorter = vocabulary.select(F.col("name").alias("at"), F.col("n").alias("m"))
    met = _expand(vocabulary, "deletions", long).select("at", "name", "n").join(shorter, "at")
    one = F.lit(1).cast("long")
    up = met.select("name", "n", one.alias("near"), F.col("at").alias("best"), F.col("m").alias("best_n"))
    return up.unionByName(met.select(F.col("at").alias("name"), F.col("m").alias("n"), one.alias("near"), F.col("name").alias("best"), F.col("n").alias("best_n")))


def spelling_variants(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, misspelt: int = MISSPELT, long: int = LONG
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word.

    Null texts have no words; a null doc_id reads as empty where a run is chosen to be misspelt; repeated rows count as
    often as they stand. An empty table gives no rows.
    """
    spark = docs.sparkSession
    words, words_path = written(vocabulary_of(docs, least_length, least_count, misspelt, long), "words")
    near, near_path = written(replaced(words, long).unionByName(inserted(words, long)), "near-words")
    counts = near.groupBy("name").agg(F.sum("near").alias("n_near"))
    able = near.filter(F.col("best_n") >= times * F.col("n")).withColumn("most", F.max("best_n").over(W.partitionBy("name"))).filter("best_n = most")
    # of equally frequent ones the smallest in code-point order; names of long words are no texts yet
    texts = words.select(F.col("name").alias("best"), F.col("word").alias("best_word"))
    forms = able.select("name", "best", "best_n").distinct().join(texts, "best").groupBy("name").agg(F.min(F.struct("best_word", "best", "best_n")).alias("form"))
    forms, forms_path = written(forms.select("name", "form"), "forms")
    # a form is ``times`` as frequent, so chains are short and doubling ends after a few rounds
    roots, roots_path = written(forms.select("name", F.col("form.best").alias("root")), "roots")
    while True:
        further = roots.select(F.col("name").alias("root"), F.col("root").alias("further"))
        longer = roots.join(further, "root", "left")
        if longer.filter("further is not null").isEmpty():
            break
        new, new_path = written(longer.select("name", F.coalesce("further", "root").alias("root")), "roots")
        drop_path(spark, roots_path)
        roots, roots_path = new, new_path
    ends = roots.join(words.select(F.col("name").alias("root"), F.col("word").alias("root_word")), "root").select("name", "root_word")
    out = words.join(counts, "name", "left").join(forms, "name", "left").join(ends, "name", "left")
    out = out.select("word", F.col("form.best_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("form.best_n").alias("form_n"))
    out, _ = written(out, "spelling-variants")
    for path in (words_path, near_path, forms_path, roots_path):
        drop_path(spark, path)
    return out
