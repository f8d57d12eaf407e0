"""Removal of repeated passages: every byte covered by a LENGTH-byte string that also starts earlier in the corpus.

``suffix_array`` is the linear grouping construction (Lyndon-prefix groups in descending order over previous-smaller
pointers, then each group's order from the order of the suffixes behind it, no renaming). It needs all suffixes of what
it sorts in one process, and in Python takes microseconds for each byte (figures in the README), so it orders single
strings: it serves ``repeats`` and the tests. Over a corpus the same decision is taken by anchored windows:

1. Every LENGTH-byte window has an anchor: the leftmost of its GRAM-byte grams with the least hash. Equal windows have
   equal anchors at equal offsets, so only windows whose anchors hold the same gram are ever compared. An anchor stands
   for the run of consecutive windows it anchors; the run's bytes are its region.
2. Anchors are dealt by gram. Where gram and region equal an earlier one, the whole run repeats. Inside one slice of
   documents that is seen before anything is shuffled, so copied documents leave one anchor for each slice.
3. Where a gram comes with several regions (the ends of repeated passages), the bytes of the first anchor of each region
   are dealt by gram, and their windows are grouped; all but the earliest repeat. Grams with very many regions are dealt
   by window instead.
4. The covered bytes of each document are cut out. Texts travel only for documents with such anchors or cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import may_be_in, slices, spans, string_buffer, tidy, written

LENGTH, GRAM = 100, 32
#: Regions of one gram from which its windows are dealt one by one.
CROWD = 20_000
#: Bytes of text whose anchors one reducer gets.
PART_BYTES = 24 << 20
#: Bytes of text that a worker hashes at once: some twenty bytes of arrays stand for each.
SLICE = 2 << 20
NO_ID = np.iinfo(np.int64).min
_R = 0x9E3779B97F4A7C15


def suffix_array(text: bytes | list[int]) -> list[int]:
    """Starts of all suffixes in lexicographic order, by linear grouping.

    First phase: groups of suffixes that share a Lyndon prefix, highest first. Every member points to the nearest
    earlier suffix of a lower group; those pointed at form higher groups of their own, by how many point at them.
    Second phase: in rising order each suffix places the one before it, and on along its pointers, as the next of its group.
    """
    n = len(text)
    if not n:
        return []
    order = sorted(range(n), key=lambda i: text[i])
    # groups as intervals [begin, end) of one array of suffixes
    place, begin, end = [0] * n, [0] * n, {}
    members = order[:]
    at = 0
    while at < n:
        to = at
        while to < n and text[members[to]] == text[members[at]]:
            place[members[to]], begin[members[to]] = to, at
            to += 1
        end[at] = to
        at = to
    before = [-1] * n
    stop = n
    while stop:
        g = begin[members[stop - 1]]
        mine = members[g:stop]
        inside = set(mine)
        for i in sorted(mine):  # nearest earlier suffix of a lower group, hopping over known pointers
            j = i - 1
            while j >= 0 and (j in inside or begin[j] >= g):
                j = before[j]
            before[i] = j
        pointed: dict[int, int] = {}
        for i in mine:
            if before[i] >= 0:
                pointed[before[i]] = pointed.get(before[i], 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for j, c in pointed.items():
            by_count.setdefault(c, {}).setdefault(begin[j], []).append(j)
        for c in sorted(by_count, reverse=True):
            for h, split in by_count[c].items():
                e = end[h]
                for j in split:  # to the end of its group
                    e -= 1
                    other = members[e]
                    members[place[j]], members[e] = other, j
                    place[other], place[j] = place[j], e
                if e > h:
                    end[e], end[h] = end[h], e
                    for j in split:
                        begin[j] = e
        stop = g
    free = {g: g for g in set(begin)}
    out: list[int] = [-1] * n
    # the empty suffix comes first; it places the last suffix, and so on along the pointers
    def put(j: int) -> None:
        while j >= 0 and not done[j]:
            g = begin[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]

    done = [False] * n
    put(n - 1)
    for k in range(n):
        put(out[k] - 1)
    return out


def repeats(text: bytes, length: int = LENGTH) -> list[bool]:
    """Which bytes of one string are covered by a ``length``-byte string that also starts earlier in it."""
    covered = [False] * len(text)
    run: list[int] = []

    def close() -> None:
        for s in sorted(run)[1:]:
            covered[s : s + length] = [True] * length
        run.clear()

    last = None
    for s in suffix_array(text):
        if s + length > len(text):
            continue
        window = text[s : s + length]
        if window != last:
            close()
        last = window
        run.append(s)
    close()
    return covered


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Hashes of any spans of a byte array: prefix sums of byte values times powers, brought to one origin."""

    values = np.random.default_rng(31).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        power = lambda base: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]))
        self.inverse = power(pow(_R, -1, 1 << 64))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.values[data] * power(_R)[: n - 1])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def anchors(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Document, anchor, first and last window start, and gram hash of every anchor; positions in ``data``."""
    n = len(data)
    sizes = np.diff(offsets)
    grams = np.zeros(n, np.uint64)
    if n >= gram:
        at = np.arange(n - gram + 1)
        grams[: n - gram + 1] = hasher(at, at + gram)
    least = (grams >> np.uint64(30)) << np.uint64(30) | np.arange(n, dtype=np.uint64)
    wide, span = 1, length - gram + 1
    while wide * 2 <= span:
        least = np.concatenate([np.minimum(least[: n - wide], least[wide:]), least[n - wide :]]) if n > wide else least
        wide *= 2
    rest = span - wide
    if rest and n > rest:
        least = np.concatenate([np.minimum(least[: n - rest], least[rest:]), least[n - rest :]])
    starts = spans(offsets[:-1], np.maximum(sizes - length + 1, 0))
    doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    p = (least[starts] & np.uint64((1 << 30) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(first[1:], len(starts)) - 1
    return doc[first], p[first], starts[first], starts[last], grams[p[first]]


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of little-endian integers, each cut to its low bytes, one after another."""
    return b"".join(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k]).tobytes() for x, k in columns)


def _unpack(blobs: list[bytes], widths: tuple[int, ...]) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in widths]
    for blob in blobs:
        n, at = len(blob) // sum(widths), 0
        for k, w in enumerate(widths):
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :w] = np.frombuffer(blob, np.uint8, n * w, at).reshape(n, w)
            out[k].append(wide.reshape(-1).view("<u8"))
            at += n * w
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


#: Bytes kept of: gram, region, document, its tie, anchor, windows before it, windows less one.
_ANCHOR = (6, 6, 8, 8, 4, 1, 1)
_WINDOW = (8, 8, 8, 4)
_ROWS = "doc long, tie long, kind int, gram long, p int, a int, b int"


def _ordered(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(tuple(reversed(keys)))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, in sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _later(order: np.ndarray, groups: tuple[np.ndarray, ...], doc: np.ndarray, tie: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group, doc, tie and p: the first of each group, and the rows strictly after it."""
    first = _first(*(g[order] for g in groups))
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    o = order[head]
    return first, (doc[o] != doc[order]) | (tie[o] != tie[order]) | (p[o] != p[order])


def _runs(doc: np.ndarray, tie: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of the same document that touch, joined."""
    if not len(doc):
        return doc, tie, a, b
    o = _ordered(doc, tie, a, b)
    doc, tie, a, b = doc[o], tie[o], a[o], b[o]
    same = ~_first(doc, tie)
    group = np.cumsum(~same)
    big = np.int64(1) << 32
    reach = np.maximum.accumulate(group * big + b) - group * big
    new = ~same
    new[1:] |= a[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], tie[at], a[at], np.maximum.reduceat(b, at)


def _emit(doc, tie, kind, gram, p, a, b) -> pa.RecordBatch:
    n = len(doc)
    full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x).astype(t), n))
    return pa.RecordBatch.from_arrays([full(doc, np.int64), full(tie, np.int64), full(kind, np.int32), full(gram, np.int64), full(p, np.int32), full(a, np.int32), full(b, np.int32)], ["doc", "tie", "kind", "gram", "p", "a", "b"])


def _blobs(part: np.ndarray, columns: list[tuple[np.ndarray, int]], kind: int) -> pa.RecordBatch:
    o = np.argsort(part, kind="stable")
    ids, starts = np.unique(part[o], return_index=True)
    ends = np.append(starts[1:], len(part))
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(np.full(len(ids), kind, np.int32)), pa.array([_pack(*((c[o[s:e]], w) for c, w in columns)) for s, e in zip(starts, ends, strict=True)], pa.binary())], ["part", "kind", "blob"])


def deal_anchors(docs: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            data, offsets = string_buffer(batch.column("text"))
            if not len(data):
                continue
            hasher = Hasher(data)
            row, p, lo, hi, h = anchors(data, offsets, hasher, length, gram)
            if not len(row):
                continue
            ids, ties = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            region = hasher(lo, hi + length) ^ _mix((p - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64))
            base = offsets[row]
            doc, tie, q = ids[row], ties[row], p - base
            mask = np.uint64((1 << 48) - 1)
            part = (_mix(h) % np.uint64(parts)).astype(np.int64)  # anchors' own hashes are all small
            h, region = h & mask, region & mask
            o = _ordered(h, region, doc, tie, q)
            first, later = _later(o, (h, region), doc, tie, q)
            gone, kept = o[later], o[first]
            if len(gone):
                d, t, a, b = _runs(doc[gone], tie[gone], (lo - base)[gone], (hi - base)[gone] + length)
                yield _blobs(np.arange(len(d)) % parts if len(d) > parts else np.full(len(d), len(data) % parts), [(d, 8), (t, 8), (a, 4), (b, 4)], 1)
            yield _blobs(part[kept], [(h[kept], 6), (region[kept], 6), (doc[kept], 8), (tie[kept], 8), (q[kept], 4), ((p - lo)[kept], 1), ((hi - lo)[kept], 1)], 0)

    return docs.mapInArrow(tidy(run), "part int, kind int, blob binary")


def match_anchors(dealt: DataFrame, length: int, crowd: int) -> DataFrame:
    """kind 0: bytes a to b of a document repeat. kind 1 and 2 (crowded grams): the windows a to b of an anchor are yet to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if kind == 0:
                    blobs.append(blob)
                else:
                    d, t, a, b = _unpack([blob], (8, 8, 4, 4))
                    yield _emit(_signed(d), _signed(t), 0, 0, 0, a, b)
        if not blobs:
            return
        h, region, doc, tie, p, back, more = _unpack(blobs, _ANCHOR)
        blobs.clear()
        doc, tie, p, back, more = (_signed(x) for x in (doc, tie, p, back, more))
        o = _ordered(h, region, doc, tie, p)
        first, later = _later(o, (h, region), doc, tie, p)
        group = np.cumsum(_first(h[o])) - 1
        regions = np.bincount(group, first)
        gone = o[later]
        yield _emit(*(x for x in (doc[gone], tie[gone])), 0, 0, 0, p[gone] - back[gone], p[gone] - back[gone] + more[gone] + length)
        open_ = first & (regions[group] > 1)
        kind = np.where(regions[group[open_]] > crowd, 2, 1)
        at = o[open_]
        yield _emit(doc[at], tie[at], kind, _signed(h[at]), p[at], p[at] - back[at], p[at] - back[at] + more[at])

    return dealt.mapInArrow(tidy(run), _ROWS)


def deal_windows(joined: DataFrame, parts: int, length: int) -> DataFrame:
    """kind 0: regions with their bytes, dealt by gram; kind 1: hashed windows of crowded grams, dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            data, offsets = string_buffer(batch.column("text"))
            opened = batch.column("open")
            flat = opened.flatten()
            n = np.diff(np.asarray(opened.offsets))
            kind, gram, a, b = (flat.field(k).to_numpy() for k in ("kind", "gram", "a", "b"))
            row = np.repeat(np.arange(batch.num_rows), n)
            doc, tie = batch.column("doc").to_numpy()[row], batch.column("tie").to_numpy()[row]
            lo, hi = offsets[row] + a, offsets[row] + b
            some = np.flatnonzero(kind == 1)
            if len(some):
                part = (_mix(gram[some].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                o = some[np.argsort(part, kind="stable")]
                part = np.sort(part)
                ids, starts = np.unique(part, return_index=True)
                rows = []
                for s, e in zip(starts, np.append(starts[1:], len(o)), strict=True):
                    k = o[s:e]
                    size = hi[k] + length - lo[k]
                    rows.append(len(k).to_bytes(8, "little") + _pack((gram[k], 8), (doc[k], 8), (tie[k], 8), (a[k], 4), (b[k] - a[k], 1)) + data[spans(lo[k], size)].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(np.zeros(len(ids), np.int32)), pa.array(rows, pa.binary())], ["part", "kind", "blob"])
            many = np.flatnonzero(kind == 2)
            if len(many):
                count = hi[many] - lo[many] + 1
                start = spans(lo[many], count)
                owner = np.repeat(many, count)
                w = Hasher(data)(start, start + length)
                d, t, s = doc[owner], tie[owner], start - offsets[row[owner]]
                o = _ordered(w, d, t, s)
                first, later = _later(o, (w,), d, t, s)
                gone, kept = o[later], o[first]
                if len(gone):
                    gd, gt, ga, gb = _runs(d[gone], t[gone], s[gone], s[gone] + length)
                    yield _blobs(np.arange(len(gd)) % parts, [(gd, 8), (gt, 8), (ga, 4), (gb, 4)], 2)
                yield _blobs((w[kept] % np.uint64(parts)).astype(np.int64), [(w[kept], 8), (d[kept], 8), (t[kept], 8), (s[kept], 4)], 1)

    return joined.mapInArrow(tidy(run), "part int, kind int, blob binary")


def match_windows(dealt: DataFrame, length: int) -> DataFrame:
    """``doc, tie, a, b`` of the bytes whose windows start earlier elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, chars, hashed = [], [], []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if kind == 0:
                    n = int.from_bytes(blob[:8], "little")
                    head.append(blob[8 : 8 + 29 * n])
                    chars.append(np.frombuffer(blob, np.uint8, offset=8 + 29 * n))
                elif kind == 1:
                    hashed.append(blob)
                else:
                    d, t, a, b = _unpack([blob], (8, 8, 4, 4))
                    yield _emit(_signed(d), _signed(t), 0, 0, 0, a, b)
        w, doc, tie, s = _unpack(hashed, _WINDOW)
        doc, tie, s = _signed(doc), _signed(tie), _signed(s)
        if head:
            _, d, t, a, more = (_signed(x) for x in _unpack(head, (8, 8, 8, 4, 1)))
            data = np.concatenate(chars)
            size = more + length
            base = np.cumsum(size) - size
            start = spans(base, more + 1)
            owner = np.repeat(np.arange(len(d)), more + 1)
            w = np.concatenate([w, Hasher(data)(start, start + length)])
            doc, tie, s = np.concatenate([doc, d[owner]]), np.concatenate([tie, t[owner]]), np.concatenate([s, a[owner] + start - base[owner]])
        if not len(w):
            return
        o = _ordered(w, doc, tie, s)
        gone = o[_later(o, (w,), doc, tie, s)[1]]
        d, t, a, b = _runs(doc[gone], tie[gone], s[gone], s[gone] + length)
        yield _emit(d, t, 0, 0, 0, a, b)

    return dealt.mapInArrow(tidy(run), _ROWS)


def cut_out(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept, rest`` from ``doc, text, rest`` and ``cuts`` (intervals, or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            data, offsets = string_buffer(batch.column("text"))
            cuts = batch.column("cuts")
            flat = cuts.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.nan_to_num(np.asarray(cuts.value_lengths().fill_null(0), np.int64)))
            depth = np.zeros(len(data) + 1, np.int64)
            np.add.at(depth, offsets[row] + flat.field("a").to_numpy(), 1)
            np.add.at(depth, offsets[row] + flat.field("b").to_numpy(), -1)
            gone = np.cumsum(depth[:-1]) > 0
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            starts = offsets[:-1][np.diff(offsets) > 0]
            first[starts] = gone[starts]
            last = gone.copy()
            last[:-1] &= ~gone[1:]
            last[starts[1:] - 1] = gone[starts[1:] - 1]
            a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
            owner = np.searchsorted(offsets, a, "right") - 1
            per = np.bincount(owner, minlength=batch.num_rows)
            pair = pa.StructArray.from_arrays([pa.array(a - offsets[owner], pa.int64()), pa.array(b - offsets[owner], pa.int64())], ["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pair)
            left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[~gone].tobytes())]).cast(pa.binary())
            doc = batch.column("doc").to_pylist()
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([pa.array([None if d == NO_ID else d for d in doc], pa.int64()), pa.array(n, pa.int64()), pa.array(n - np.diff(left), pa.int64()), lists, kept, batch.column("rest")], ["doc_id", "n_bytes", "n_removed", "spans", "kept", "rest"])

    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return docs.select("doc", "text", "cuts", "rest").mapInArrow(tidy(run), schema.add("rest", docs.schema["rest"].dataType))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans`` (start and end of every removed run) and ``kept`` (the bytes left) of every document.

    A string starts earlier in a document of smaller doc_id, or in the same document before. Nulls: a null text is
    empty; a null doc_id is smaller than all others. Rows that share a doc_id are ordered by a hash of their texts, rows
    that share both are one document met twice and get the same cuts. Texts below ``length`` bytes stay whole. An empty
    table gives no rows. The columns named in ``carry`` come along in a struct ``rest``.
    """
    rest = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(None).cast("struct<none:int>")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    again = texts.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    texts = texts.withColumn("doc", F.coalesce("doc_id", F.lit(int(NO_ID))))
    if again.isEmpty():
        keyed = texts.select("doc", F.lit(0).cast("long").alias("tie"), "text", "rest")
    else:
        twice, _ = written(again.select(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc")), "repeated-ids")
        flagged = texts.join(twice.withColumn("_twice", F.lit(True)), "doc", "left")
        keyed, _ = written(flagged.select("doc", F.when(F.col("_twice"), F.xxhash64("text")).otherwise(0).alias("tie"), "text", "rest"), "keyed-texts")
    total = keyed.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES + 1)
    plain = keyed.select("doc", "tie", "text")
    dealt = deal_anchors(plain, parts, length, gram).repartitionById(parts, F.col("part"))
    matched, _ = written(match_anchors(dealt, length, crowd), "matched-anchors")
    opened, _ = written(matched.filter("kind > 0").groupBy("doc", "tie").agg(F.collect_list(F.struct("kind", "gram", "a", "b")).alias("open")), "open-anchors")
    joined = may_be_in(plain, "doc", opened).join(opened, ["doc", "tie"])
    windows, _ = written(match_windows(deal_windows(joined.dropDuplicates(["doc", "tie"]), parts, length).repartitionById(parts, F.col("part")), length), "matched-windows")
    cuts = matched.filter("kind = 0").select("doc", "tie", "a", "b").unionByName(windows.select("doc", "tie", "a", "b"))
    cuts, _ = written(cuts.groupBy("doc", "tie").agg(F.collect_list(F.struct("a", "b")).alias("cuts")), "cuts")
    place = may_be_in(keyed, "doc", cuts).join(cuts, ["doc", "tie"], "left")
    others = may_be_in(keyed, "doc", cuts, absent=True)
    none = F.lit(None).cast("array<struct<a:int,b:int>>").alias("cuts")
    return cut_out(place.select("doc", "text", "cuts", "rest").unionByName(others.select("doc", "text", none, "rest")))
