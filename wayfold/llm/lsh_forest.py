"""MinHash near-deduplication through an LSH forest.

Every document is a set of hashed five-word shingles. Documents with equal sets are one class; its smallest id stands
for it. A class's signature (SIGNATURE MinHash values) is read in TREES orders, each a fixed random sequence of DEPTH
of its values. A region of an order is what shares its first LEAST_DEPTH values; all pairs of a region are candidates,
confirmed on full shingle sets, but for pairs of one component. Each order is sorted as a whole by ranges of the keys:
in thin regions, of at most WINDOW + 1 rows, candidates are neighbours in the sorted order. Crowded regions are dealt in
blocks of bounded size, each block against each other, and compared inside the task, which returns a forest of links: no
table holds the pairs of a crowd, and no crowd lands in one task. Only the nearest neighbours in a few orders come first, so
that a crowd of copies is one component, or a few, before it is dealt.

At a similarity of 0.75 a pair agrees to LEAST_DEPTH values in a given order with probability 0.42. The orders share their
hash functions, so they are not independent: in none of them it agrees with a probability of 8e-5, measured by drawing.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import components, drop_path, hot_lookup, may_be_in, slices, spans, string_buffer, texts_of, tidy, written

WORDS, PERCENT = 5, 75
SIGNATURE, TREES, DEPTH, LEAST_DEPTH, WINDOW = 64, 24, 8, 3, 8
#: Rows and shingles of a block of a crowded region, on average.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 19
#: Orders whose crowded regions are dealt at once: what the first ones link is not compared again in the later ones.
CROWD_TREES = (range(0, 1), range(1, 4), range(4, TREES))
#: Bytes of text whose shingles are made at once.
PART_BYTES = 2 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


@functools.cache
def constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd multipliers of the shingle's words and of the signature's functions; the sequence of functions of each tree."""
    rng = np.random.default_rng(20240607)
    odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(WORDS + 1), odd(SIGNATURE), np.stack([rng.permutation(SIGNATURE)[:DEPTH] for _ in range(TREES)])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (bytes other than white space, A-Z lower-cased), and word offsets by text."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    ink = ~((low == 32) | ((low >= 9) & (low <= 13)))
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = ink[inner]
    begin = np.flatnonzero(first)
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    cut = inner[inner > 0] - 1
    last[cut] = ink[cut]
    end = np.flatnonzero(last) + 1
    length = end - begin
    # a polynomial of the word's bytes: position inside the word picks the factor
    place = np.arange(len(low)) - np.repeat(begin, np.diff(np.append(begin, len(low)))) if len(begin) and begin[0] == 0 else np.arange(len(low)) - np.concatenate([np.zeros(begin[0] if len(begin) else len(low), np.int64), np.repeat(begin, np.diff(np.append(begin, len(low))))])
    powers = np.cumprod(np.full(int(length.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    term = np.where(ink, (low.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(np.maximum(place, 0), len(powers) - 1)], np.uint64(0))
    h = np.add.reduceat(term, begin) if len(begin) else np.zeros(0, np.uint64)
    return mixed(h ^ mixed(length.astype(np.uint64))), np.searchsorted(begin, offsets)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a text of fewer than WORDS words is one shingle, none without words."""
    data, offsets = string_buffer(texts)
    words, at = word_hashes(data, offsets)
    factors = constants()[0]
    n = np.diff(at)
    out = [np.zeros(0, np.uint64)] * len(n)
    if len(words) >= WORDS:
        rows = sum(words[k : len(words) - WORDS + 1 + k] * factors[k] for k in range(WORDS))
        rows = mixed(rows)
    for t in np.flatnonzero(n):
        a, b = at[t], at[t + 1]
        if n[t] >= WORDS:
            out[t] = np.unique(rows[a : b - WORDS + 1])
        else:
            out[t] = mixed((words[a:b] * factors[: b - a]).sum(keepdims=True) + factors[WORDS] * np.uint64(b - a))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SIGNATURE folded MinHash values (16 bits) of every set that is not empty."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.zeros((0, SIGNATURE), np.uint16)
    flat, starts = np.concatenate(full), np.cumsum([0] + [len(s) for s in full[:-1]])
    out = np.empty((len(full), SIGNATURE), np.uint16)
    for k, factor in enumerate(constants()[1]):
        low = np.minimum.reduceat((flat * factor) >> np.uint64(24), starts)
        out[:, k] = (mixed(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest, signature`` of every document; no digest and signature where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=PART_BYTES):
            sets = shingle_sets(batch.column("text"))
            rows = iter(signatures(sets))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "signature"],
            )

    return texts_of(docs).mapInArrow(tidy(run), "doc_id long, n_shingles long, digest binary, signature binary")


def tree_rows(reps: DataFrame, trees: range) -> DataFrame:
    """``tree, key, id, comp, n``: one row for each order in ``trees`` and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = constants()[2]
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, SIGNATURE)
            for tree in trees:
                keys = sig[:, orders[tree]].astype(">u2").tobytes()
                step = 2 * DEPTH
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), tree, np.int32)), pa.array([keys[i : i + step] for i in range(0, len(keys), step)], pa.binary()), batch.column("id"), batch.column("comp"), batch.column("n")], ["tree", "key", "id", "comp", "n"])

    return reps.select("signature", "id", "comp", "n").mapInArrow(tidy(run), "tree int, key binary, id long, comp long, n long")


def neighbours(tree: np.ndarray, key: np.ndarray, ids: np.ndarray, comp: np.ndarray, window: int) -> np.ndarray:
    """Pairs of rows of different components at most ``window`` apart whose keys share LEAST_DEPTH values.

    A region seen to have more than WINDOW + 1 rows is left out of a scan of the whole WINDOW; it is dealt in blocks.
    """
    if len(ids) < 2:
        return np.zeros((0, 2), np.int64)
    head = key[:, :LEAST_DEPTH]
    place = np.cumsum(np.concatenate([[True], (tree[1:] != tree[:-1]) | (head[1:] != head[:-1]).any(1)])) - 1
    if window == WINDOW:
        stay = (np.bincount(place) <= WINDOW + 1)[place]
        place, ids, comp = place[stay], ids[stay], comp[stay]
    found = [np.zeros((0, 2), np.int64)]
    for o in range(1, min(window, len(ids) - 1) + 1):
        ok = (place[o:] == place[:-o]) & (comp[o:] != comp[:-o])
        found.append(np.stack([np.minimum(ids[o:], ids[:-o])[ok], np.maximum(ids[o:], ids[:-o])[ok]], 1))
    return np.unique(np.concatenate(found), axis=0)


_ROW = "a long, b long, tree int, key binary, id long, comp long"


def _scan(window: int, ends: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "key", "id", "comp"]
        held: pa.Table | None = None
        for batch in batches:
            part = pa.table({n: batch.column(n) for n in names})
            first = held is None
            table = part if first else pa.concat_tables([held, part])
            if table.num_rows:
                keys = np.frombuffer(b"".join(table["key"].to_pylist()), ">u2").reshape(-1, DEPTH)
                pairs = neighbours(table["tree"].to_numpy(), keys, table["id"].to_numpy(), table["comp"].to_numpy(), window)
                yield _out(pairs, None)
            if ends and first and part.num_rows:
                yield _out(None, part.slice(0, window))
            held = table.slice(max(0, table.num_rows - 2 * window))
        if ends and held is not None and held.num_rows:
            yield _out(None, held.slice(max(0, held.num_rows - window)))

    def _out(pairs: np.ndarray | None, rows: pa.Table | None) -> pa.RecordBatch:
        n = len(pairs) if pairs is not None else rows.num_rows
        none = lambda t: pa.nulls(n, t)
        if pairs is not None:
            cols = [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none(pa.int32()), none(pa.binary()), none(pa.int64()), none(pa.int64())]
        else:
            cols = [none(pa.int64()), none(pa.int64()), *(rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c] for c in ("tree", "key", "id", "comp"))]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", "tree", "key", "id", "comp"])

    return run


def candidates(reps: DataFrame, trees: range, window: int) -> DataFrame:
    """Distinct pairs (a < b) of neighbours in the sorted orders. The few rows at the ends of partitions are scanned
    once more beside each other, so a partition's border separates nothing."""
    rows = tree_rows(reps, trees).drop("n")
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, _ = written(rows.repartitionByRange(n, "tree", "key", "id").sortWithinPartitions("tree", "key", "id").mapInArrow(_scan(window, True), _ROW), "neighbours")
    edges = found.filter("id is not null").select("tree", "key", "id", "comp").dropDuplicates(["tree", "id"])
    more = edges.coalesce(1).sortWithinPartitions("tree", "key", "id").mapInArrow(_scan(window, False), _ROW)
    return found.unionByName(more).filter("a is not null").select("a", "b").distinct()


def crowded(reps: DataFrame, trees: range) -> DataFrame:
    """``region, x, y, side, id, comp``: the rows of blocks x and y of every region of more than WINDOW + 1 rows and more
    than one component. A component that fills blocks of its own is not dealt against itself."""
    rows = tree_rows(reps, trees).select(F.xxhash64("tree", F.substring("key", 1, 2 * LEAST_DEPTH)).alias("region"), "id", "comp", "n")
    many = rows.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("least"), F.max("comp").alias("most")).filter((F.col("m") > WINDOW + 1) & (F.col("least") < F.col("most"))).select("region", F.lit(True).alias("many"))
    many, _ = written(many, "crowded-regions")
    near, _ = written(may_be_in(rows, "region", many), "crowd-rows")
    near, _ = written(hot_lookup(near, "region", many, "many").filter("many").drop("many"), "crowd-rows")
    blocks = lambda m, n: F.ceil(F.greatest(m / BLOCK_ROWS, n / BLOCK_SHINGLES)).cast("int")
    shares = near.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).withColumn("k", blocks(F.col("m"), F.col("n")))
    own, rest = F.when(F.col("k") > 1, F.struct("comp", "k")), lambda c: F.sum(F.when(F.col("k") <= 1, F.col(c)).otherwise(0))
    layout = shares.groupBy("region").agg(F.sort_array(F.collect_list(own)).alias("own"), blocks(rest("m"), rest("n")).alias("mixed")).select("region", F.struct("own", "mixed").alias("layout"))
    layout, _ = written(layout, "crowd-layout")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for region, i, comp, lay in zip(*(batch.column(c).to_pylist() for c in ("region", "id", "comp", "layout")), strict=True):
                owners = [o["comp"] for o in lay["own"] for _ in range(o["k"])] + [None] * lay["mixed"]
                mine = [b for b, o in enumerate(owners) if o == comp] or range(len(owners) - lay["mixed"], len(owners))
                side = mine[((i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32) % len(mine)]
                out += [(region, min(side, y), max(side, y), side, i, comp) for y, o in enumerate(owners) if o is None or o != owners[side]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["region", "x", "y", "side", "id", "comp"])

    return hot_lookup(near, "region", layout, "layout").mapInArrow(deal, "region long, x int, y int, side int, id long, comp long")


def forest(ids: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Links among the rows of two blocks (or of one) that join all components with a link between them."""
    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.cumsum(size) - size
    holder = np.repeat(np.arange(len(ids)), size)[np.argsort(code, kind="stable")]
    held = np.bincount(code)
    at = np.cumsum(held) - held
    root = np.unique(comp, return_inverse=True)[1]
    one = side.min() == side.max()
    found = []
    for u in np.arange(len(ids)) if one else np.flatnonzero(side == side.min()):
        other = root != root[u]
        other &= np.arange(len(ids)) > u if one else side != side[u]
        if not other.any():
            continue
        mine = code[begin[u] : begin[u] + size[u]]
        both = np.bincount(holder[spans(at[mine], held[mine])], minlength=len(ids))
        near = np.flatnonzero(other & (both > 0) & (100 * both >= PERCENT * (size + size[u] - both)))
        if len(near):
            joined, first = np.unique(root[near], return_index=True)
            found.append(np.stack([np.full(len(first), ids[u]), ids[near[first]]], 1))
            root[np.isin(root, joined)] = root[u]
    return np.sort(np.concatenate(found), axis=1) if found else np.zeros((0, 2), np.int64)


def crowd_links(docs: DataFrame, reps: DataFrame, trees: range) -> DataFrame:
    """Links (a < b) that join all components between whose rows in a crowded region is a link."""
    dealt, _ = written(crowded(reps, trees), "crowds")
    ids, _ = written(dealt.select(F.col("id").alias("doc_id")).distinct(), "crowd-ids")
    sets = sets_of(docs, ids)

    def run(block: pa.Table) -> pa.Table:
        shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in block.column("s").combine_chunks()]
        pairs = forest(*(block.column(c).to_numpy() for c in ("id", "comp", "side")), shingles)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.join(sets, "id").groupBy("region", "x", "y").applyInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, s``: the full shingle sets of the documents in ``ids`` (doc_id), written."""
    texts = may_be_in(texts_of(docs), "doc_id", ids).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=PART_BYTES):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "s"])

    return written(texts.mapInArrow(tidy(to_sets), "id long, s binary"), "sets")[0]


def confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets overlap enough."""
    ids, _ = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                both = 0
                if 100 * len(u) >= PERCENT * len(v):
                    both = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum()) if len(v) else 0
                keep.append(both > 0 and 100 * both >= PERCENT * (len(u) + len(v) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    sets = sets_of(docs, ids)
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(tidy(overlap), "a long, b long")


def near_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Nulls: a null text is empty; an empty set is linked with nothing, its component is its own id. A null doc_id joins
    its class's component and is never kept. Rows that share a doc_id count as one node each through their class. An
    empty table gives no rows.
    """
    sketches, sketches_path = written(sketch(docs), "sketches")
    classes, _ = written(sketches.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "set-classes")
    members, _ = written(hot_lookup(sketches.drop("signature"), "digest", classes, "rep").select("doc_id", "n_shingles", "rep"), "set-members")
    own = sketches.filter("doc_id is not null and digest is not null").join(classes.select(F.col("digest").alias("_d"), F.col("rep").alias("_r")), (F.col("digest") == F.col("_d")) & (F.col("doc_id") == F.col("_r")))
    reps, reps_path = written(own.select(F.col("doc_id").alias("id"), "signature", F.col("n_shingles").alias("n")).dropDuplicates(["id"]).withColumn("comp", F.col("id")), "set-reps")
    drop_path(docs.sparkSession, sketches_path)
    links = labels = None
    # copies first meet their nearest neighbours in a few orders, so that a crowd is few components before it is dealt
    for trees, window in [(range(4), 1), *((t, None) for t in CROWD_TREES), (range(TREES), WINDOW)]:
        if window is None:
            new, _ = written(crowd_links(docs, reps, trees), "links")
        else:
            new, _ = written(confirm(docs, written(candidates(reps, trees, window), "pairs")[0]), "links")
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        labels = components(links)
        fresh, fresh_path = written(hot_lookup(reps.drop("comp"), "id", labels, "component").withColumn("comp", F.coalesce("component", "id")).drop("component"), "set-reps")
        drop_path(docs.sparkSession, reps_path)
        reps, reps_path = fresh, fresh_path
    out = members.withColumn("component", F.lit(None).cast("long")) if labels is None else hot_lookup(members, "rep", labels.withColumnRenamed("id", "rep"), "component")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
