"""Embedding near-deduplication through a pivot-permutation index.

Equal vectors of a label are one class. A class is described by its NEAREST nearest pivots (a bounded sample of the
classes) and filed in inverted lists by pivot. Two classes are candidates when they share at least SHARED pivots; sets
of NEAREST that share SHARED have a common one among their first NEAREST - SHARED + 1 in any fixed order, so a class is
filed under these alone. Inside a list each class counts, through the inverted lists of its other pivots, how many it
shares with whom; only those that reach SHARED have their cosine taken, in double precision. Pivots grow with the square
root of the classes, so lists do no more than that. A list is dealt in blocks, pairs of blocks are the tasks, and only link counts and one edge for each class
leave a task, so neither a list nor a crowd of links has to fit anywhere.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import components, drop_path, hot_lookup, spans, tidy, written

NEAREST, SHARED = 10, 4
THRESHOLD = 0.98
#: Classes of a list that one block holds.
BLOCK = 1024
#: Bytes of pivots that every task holds: the sample's bound, 131,072 pivots of 64 components.
PIVOT_BYTES = 64 << 20
#: Products of vectors and pivots held at once.
PRODUCTS = 1 << 21


def clean(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, v`` (doubles; null where the vector or label takes part in no link) and ``key`` of the class."""
    v = F.col(vector_col).cast("array<double>")
    biggest = F.array_max(F.transform(v, F.abs))
    usable = F.col(label_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & (biggest > 0)
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.when(usable, v).alias("v"))
    return out.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws("|", "label", F.col("v").cast("string")), 256)))


def pick_pivots(classes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Unit vectors of a hash-ordered sample of the classes, by dimension: ``count`` rows at most in all."""
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(count).select("v").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.v), []).append(r.v)
    return {d: unit(np.array(x)) for d, x in by.items()}


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The permutation prefix: indices of each row's nearest pivots, nearest first (ties: the smaller index)."""
    out = []
    step = max(1, PRODUCTS // max(1, len(pivots)))
    for at in range(0, len(x), step):
        far = -(x[at : at + step] @ pivots.T)
        some = np.sort(np.argpartition(far, nearest - 1, axis=1)[:, :nearest], axis=1) if nearest < far.shape[1] else np.tile(np.arange(far.shape[1]), (len(far), 1))
        out.append(np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out).astype(np.int32)


def file_lists(classes: DataFrame, pivots: dict[int, np.ndarray], nearest: int, shared: int) -> DataFrame:
    """One row for each class and inverted list: the list, the class, its vector and its whole set of nearest pivots."""
    sent = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            labels, reps, counts = (batch.column(c).to_pylist() for c in ("label", "rep", "n"))
            sizes = np.diff(np.asarray(batch.column("v").offsets))
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                x = unit(np.asarray(batch.column("v").take(pa.array(rows)).flatten()).reshape(-1, d))
                p = sent.value.get(int(d), np.ones((1, d)))
                near = np.sort(nearest_pivots(x, p, nearest), axis=1)
                filed = near[:, : max(1, near.shape[1] - min(shared, near.shape[1]) + 1)]
                out = [(f"{d}:{q}:{labels[r]}", reps[r], counts[r], int(q), x[i].tobytes(), near[i].tobytes()) for i, r in enumerate(rows) for q in filed[i].tolist()]
                cols = list(zip(*out, strict=True))
                types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["list", "rep", "n", "pivot", "x", "near"])

    return classes.select("label", "rep", "n", "v").mapInArrow(tidy(run), "list string, rep long, n long, pivot int, x binary, near binary")


def link_lists(rows: DataFrame, shared: int, threshold: float, block: int) -> DataFrame:
    """``id, links, root``: for each task and class, how many vectors it links with there, and a class of its local component."""
    counts = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    dealt = hot_lookup(rows, "list", counts, "blocks").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})

    def verify(table: pa.Table) -> pa.Table:
        reps, n, own = table["rep"].to_numpy(), table["n"].to_numpy(), table["own"].to_numpy()
        pivot, lo, cross = table["pivot"][0].as_py(), table["lo"][0].as_py(), table["lo"][0].as_py() != table["hi"][0].as_py()
        x = np.frombuffer(b"".join(table["x"].to_pylist())).reshape(len(reps), -1)
        near = np.frombuffer(b"".join(table["near"].to_pylist()), np.int32).reshape(len(reps), -1)
        need = min(shared, near.shape[1])
        filed = near[:, : max(1, near.shape[1] - need + 1)]
        column = np.unique(near, return_inverse=True)[1].reshape(near.shape)
        holders = np.argsort(column.ravel(), kind="stable") // near.shape[1]
        held = np.bincount(column.ravel())
        at = np.cumsum(held) - held
        links, root, keep = np.zeros(len(reps), np.int64), np.arange(len(reps)), np.zeros(len(reps), bool)
        for u in np.flatnonzero(own == lo) if cross else range(len(reps)):
            shares = np.bincount(holders[spans(at[column[u]], held[column[u]])], minlength=len(reps)) >= need
            shares &= own != lo if cross else np.arange(len(reps)) > u
            v = np.flatnonzero(shares)
            v = v[x[v] @ x[u] >= threshold]
            if not len(v):
                continue
            # counted in the first list that both classes are filed in
            first = v[~np.isin(filed[v], filed[u][filed[u] < pivot]).any(axis=1)]
            links[u] += n[first].sum()
            links[first] += n[u]
            keep[u] = keep[v] = True
            joined = np.append(root[v], root[u])
            root[np.isin(root, joined)] = joined.min()
        return pa.table({"id": reps[keep], "links": links[keep], "root": reps[root[keep]]})

    return pairs.groupBy("list", "lo", "hi").applyInArrow(verify, "id long, links long, root long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", nearest: int = NEAREST, shared: int = SHARED, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without label, link with nothing
    and are components of their own. Vectors of different length never link. A null vec_id takes part through its class
    and is never kept. Equal vectors of a label link with each other and share their class's other links. An empty table
    gives no rows.
    """
    rows, _ = written(clean(vectors, id_col, vector_col, label_col), "vectors")
    classes, _ = written(rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct("label", "v"), F.lit(0)).alias("s")).select("key", "rep", "n", "s.label", "s.v"), "vector-classes")
    size, widest = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    pivots = pick_pivots(classes, int(min(PIVOT_BYTES // (8 * (widest or 1)), max(32, 2 * math.sqrt(size)))))
    lists, lists_path = written(file_lists(classes.filter("rep is not null"), pivots, nearest, shared), "inverted-lists")
    found, _ = written(link_lists(lists, shared, threshold, block), "vector-links")
    drop_path(vectors.sparkSession, lists_path)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    info = classes.select("key", "rep", "n").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    info, _ = written(info.select("key", F.struct((F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")).alias("class")), "vector-info")
    out = hot_lookup(rows.select("vec_id", "key"), "key", info, "class")
    component = F.coalesce("class.component", "vec_id")
    return out.select("vec_id", F.coalesce("class.links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
