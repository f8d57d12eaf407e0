"""Divergence of the sources of each language: sketch-prefiltered counting, then sparse pair joins.

Every task counts, for each (language, term), the documents that hold it, into a count-min sketch of ROWS rows of
counters that stop at CEILING; the tasks' sketches are added counter by counter. A sketch never underestimates, so a term
whose least counter is below the wanted number of documents is impossible and is dropped where it stands, before
anything is shuffled. The survivors are counted exactly and those that are still too rare go. The sketch has one size
however large the corpus is; when it fills up it only lets more through.

A pair of sources differs by a sum over all kept terms, of which most occur in one of them or in neither. What a term
adds where one side has none of it depends on its count alone, so it is summed over a source's distinct counts; only
terms that both sources hold are met by a join. Quotients are taken in decimals or whole numbers: nothing is rounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.llm.common import drop_path, hot_lookup, slices, spans, string_buffer, tidy, written

#: Documents of its language that a kept term occurs in, and terms that a source's report names.
LEAST_DOCS, TOP = 10, 10
#: The sketch: rows of 2^WIDTH_BITS counters of one byte, 8 MB in all; CEILING is what a counter stops at.
ROWS, WIDTH_BITS, CEILING = 4, 21, 255
#: A task's sketch travels in pieces of so many counters.
PIECE = 1 << 16
SCALE = 1_000_000_000
_IN_TERM = np.array([b > 0x7F or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The text each term stands in, and the terms: runs of ASCII letters (in lower case) and all characters beyond ASCII."""
    data, offsets = string_buffer(texts)
    inside = _IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = inside[edges]  # a text does not go on in the next one
    start = np.flatnonzero(begins)
    held = np.cumsum(inside)
    ends = np.append(held[start[1:]] - 1, held[-1]) if len(start) else np.zeros(0, np.int64)
    at = np.concatenate([[0], ends]).astype(np.int64)
    runs = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(_LOWER[data[inside]]))
    return np.searchsorted(offsets, start, "right") - 1, runs


def _mixed(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(by)
    return h ^ (h >> np.uint64(29))


def hashes(lang: np.ndarray, names: list[str], terms: pa.Array) -> np.ndarray:
    """A 64-bit hash of each term with its language (``lang`` indexes ``names``)."""
    data, offsets = string_buffer(terms)
    lengths = np.diff(offsets)
    power = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    weighted = (data.astype(np.uint64) + np.uint64(7)) * power[place]
    h = np.add.reduceat(weighted, offsets[:-1]) if len(data) else np.zeros(len(lengths), np.uint64)
    seed = np.array([zlib.crc32(n.encode()) for n in names], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return _mixed(_mixed(h, 0xBF58476D1CE4E5B9) + seed[lang], 0x94D049BB133111EB)


def cells(h: np.ndarray, row: int, width_bits: int) -> np.ndarray:
    return (_mixed(h + np.uint64(row * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF), 0xBF58476D1CE4E5B9) >> np.uint64(64 - width_bits)).astype(np.int64)


def term_counts(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[list, list]]:
    """Distinct terms; then, for each (group, term) of the batch, group, term, occurrences and documents; the groups' (lang, source)."""
    pair = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
    group_of, first = {}, []
    index = np.empty(len(pair), np.int64)
    for i, g in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
        index[i] = group_of.setdefault(g, len(group_of))
    first = list(group_of)
    doc, runs = terms_of(batch.column("text"))
    coded = runs.dictionary_encode()
    n_terms = max(1, len(coded.dictionary))
    # within a document first, so that documents count once
    in_doc, n = np.unique(doc * n_terms + np.asarray(coded.indices), return_counts=True)
    key = index[in_doc // n_terms] * n_terms + in_doc % n_terms
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    docs = np.diff(np.append(at, len(key)))
    occurrences = np.add.reduceat(n, at) if len(at) else np.zeros(0, np.int64)
    return coded.dictionary, key[at] // n_terms, key[at] % n_terms, occurrences, docs, ([g[0] for g in first], [g[1] for g in first])


def _langs(group: np.ndarray, langs: list[str]) -> tuple[np.ndarray, list[str]]:
    names = sorted(set(langs))
    return np.array([names.index(x) for x in langs], np.int64)[group] if langs else np.zeros(0, np.int64), names


def sketch(rows: DataFrame, width_bits: int = WIDTH_BITS) -> np.ndarray:
    """ROWS x 2^width_bits counters, at most CEILING each: no (language, term) is in more documents than its least counter."""
    size = ROWS << width_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, any_rows = np.zeros(size, np.uint16), False
        for batch in slices(batches):
            terms, group, term, _, docs, (langs, _) = term_counts(batch)
            lang, names = _langs(group, langs)
            h = hashes(lang, names, terms.take(pa.array(term)))
            for row in range(ROWS):
                at = (row << width_bits) + cells(h, row, width_bits)
                met, which = np.unique(at, return_inverse=True)
                more = np.bincount(which, np.minimum(docs, CEILING))
                mine[met] = np.minimum(mine[met] + np.minimum(more, CEILING).astype(np.uint16), CEILING)
            any_rows = True
        if any_rows:
            yield from pieces(mine)

    def pieces(mine: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = min(PIECE, size)
        for k in range(size // step):
            part = mine[k * step : (k + 1) * step].astype(np.uint8)
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["piece", "counters"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("piece").to_pylist(), batch.column("counters").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.uint8).astype(np.uint16)
                held[k] = np.minimum(held[k] + part, CEILING) if k in held else part
        for k, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(part.astype(np.uint8).tobytes(), 1)], pa.binary())], ["piece", "counters"])

    # pieces are added as they come, so a task holds one array for each of its pieces however many tasks have counted
    parts = rows.mapInArrow(tidy(count), "piece long, counters binary").repartition(min(64, max(1, size // PIECE)), "piece").mapInArrow(tidy(add), "piece long, counters binary")
    out = np.zeros(size, np.uint8)
    got = parts.toArrow()  # the sketch's own size at most
    for k, raw in zip(got["piece"].to_pylist(), got["counters"].to_pylist(), strict=True):
        part = np.frombuffer(zlib.decompress(raw), np.uint8)
        out[k * len(part) : (k + 1) * len(part)] = part
    return out.reshape(ROWS, -1)


def possible_counts(rows: DataFrame, counters: np.ndarray, least: int) -> DataFrame:
    """``lang, source, term, n, docs`` of the terms that may be in ``least`` documents of their language, a row for each slice of a task."""
    sent, width_bits = rows.sparkSession.sparkContext.broadcast(counters), int(counters.shape[1]).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            terms, group, term, n, docs, (langs, sources) = term_counts(batch)
            lang, names = _langs(group, langs)
            h = hashes(lang, names, terms.take(pa.array(term)))
            most = np.full(len(h), CEILING, np.uint8)
            for row in range(ROWS):
                most = np.minimum(most, sent.value[row][cells(h, row, width_bits)])
            may = np.flatnonzero(most >= min(least, CEILING))
            group = pa.array(group[may])
            take = lambda x: pa.array(x, pa.string()).take(group)
            yield pa.RecordBatch.from_arrays([take(langs), take(sources), pc.cast(terms.take(pa.array(term[may])), pa.string()), pa.array(n[may].astype(np.int64)), pa.array(docs[may].astype(np.int64))], ["lang", "source", "term", "n", "docs"])

    return rows.mapInArrow(tidy(run), "lang string, source string, term string, n long, docs long")


def kept_counts(rows: DataFrame, least: int = LEAST_DOCS, width_bits: int = WIDTH_BITS) -> DataFrame:
    """``lang, term, source, n, total``: occurrences in each source, and in the language, of the terms in at least ``least`` documents."""
    counted = possible_counts(rows, sketch(rows, width_bits), least).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = W.partitionBy("lang", "term")  # a row for each source of the language
    both = counted.withColumns({"total": F.sum("n").over(by_term), "in_docs": F.sum("docs").over(by_term)})
    return both.filter(F.col("in_docs") >= least).select("lang", "term", "source", "n", "total")


def share(n: Column, size: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (size + 2 * kept)), exactly; null where nothing is kept."""
    whole = lambda c: c.cast("decimal(20,0)")
    top, bottom = whole(n + 2) * F.lit(SCALE).cast("decimal(10,0)"), whole(size + 2 * kept)
    return F.when(kept > 0, (top - top % bottom) / bottom + 1).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, width_bits: int = WIDTH_BITS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source lies from the others of its language (``pair``) and
    the terms that it has most above its language (``term``).

    Null texts, languages and sources read as empty; repeated rows count as often as they stand; a source without kept
    terms still has its pairs, and a language without kept terms has pairs of value 0. Other columns are not read. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
    counts, counts_path = written(kept_counts(rows, least, width_bits), "kept-counts")
    vocabulary = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("terms"))
    groups = rows.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(vocabulary, "lang", "left").fillna(0, ["size", "terms", "kept"])
    # one row for each source of a language: the report itself has one for each two
    groups = groups.withColumn("none", share(F.lit(0).cast("long"), F.col("size"), F.col("kept")))
    groups = groups.withColumn("lang_size", F.sum("size").over(W.partitionBy("lang")))
    groups, groups_path = written(groups, "groups")
    info = F.struct("size", "kept", "lang_size", "none")
    known = hot_lookup(counts.withColumn("g", F.struct("lang", "source")), "g", groups.select(F.struct("lang", "source").alias("g"), info.alias("i")), "i")
    shares = known.select("lang", "term", "source", "n", share(F.col("n"), F.col("i.size"), F.col("i.kept")).alias("p"), share(F.col("total"), F.col("i.lang_size"), F.col("i.kept")).alias("of_lang"))
    shares, shares_path = written(shares, "shares")

    above = shares.filter("p > of_lang").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("of_lang")).alias("value"))

    one = groups.select("lang", F.col("source").alias("a"), F.col("terms").alias("terms_a"), F.col("none").alias("none_a"), "kept")
    two = groups.select("lang", F.col("source").alias("b"), F.col("terms").alias("terms_b"), F.col("none").alias("none_b"))
    pairs = one.join(two, "lang").filter("a <> b")
    # what a source's terms add beside one that has none of them
    distinct = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    alone = distinct.join(two.select("lang", "b", "none_b"), "lang").filter("source <> b").groupBy("lang", F.col("source").alias("a"), "b").agg(F.sum(F.col("times") * gap(F.col("p"), F.col("none_b"))).alias("alone"))
    # terms of both, each two of sources once
    none = groups.select("lang", "source", "none")
    with_none = hot_lookup(shares.withColumn("g", F.struct("lang", "source")), "g", none.select(F.struct("lang", "source").alias("g"), "none"), "none")
    left = with_none.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("none").alias("none_a"))
    right = with_none.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("none").alias("none_b"))
    met = left.join(right, ["lang", "term"]).filter("a < b")
    more = gap(F.col("p_a"), F.col("p_b")) - gap(F.col("p_a"), F.col("none_b")) - gap(F.col("none_a"), F.col("p_b"))
    met = met.groupBy("lang", "a", "b").agg(F.sum(more).alias("more"), F.count(F.lit(1)).alias("both"))
    met = met.unionByName(met.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "more", "both"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    back = alone.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("alone").alias("alone_b"))
    every = pairs.join(alone, ["lang", "a", "b"], "left").join(back, ["lang", "a", "b"], "left").join(met, ["lang", "a", "b"], "left")
    neither = (F.col("kept") - F.col("terms_a") - F.col("terms_b") + zero(F.col("both"))) * zero(gap(F.col("none_a"), F.col("none_b")))
    value = zero(F.col("alone")) + zero(F.col("alone_b")) + zero(F.col("more")) + neither
    apart = every.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))

    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    # only the best of a source's terms leave a task
    out, _ = written(apart.withColumn("rank", rank).unionByName(above.withColumn("rank", rank).filter(F.col("rank") <= top)), "divergence")
    for path in (counts_path, groups_path, shares_path):
        drop_path(spark, path)
    return out.select("lang", "source", "part", "item", "value", "rank")
