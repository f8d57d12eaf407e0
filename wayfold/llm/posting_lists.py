"""Nearest neighbours by inner product through balanced posting lists.

Vectors are brought to unit length by one more component (what is missing to the longest vector's length), so that the
largest inner product is the smallest distance. A bounded sample is halved, by median, along the line between two means
until every part has the same size; the means of the parts are the lists' centroids. Each vector is filed under its
nearest centroid and, at a boundary, under the others that lie at most REPLICATE times as far. Centroids are linked to
their nearest ones, and a query walks this graph in memory: it takes all lists whose centroid lies at most RATIO times as
far as the nearest one. RATIO is found by asking a bounded sample of queries of all vectors and taking what reaches REACHED of
their true neighbours. So vectors without structure make queries read many lists, and clustered ones few.

Equal vectors are one class that carries its smallest ids, which are all that can enter a result. Lists are dealt to
shards (long lists in parts to several), queries of a shard in blocks: tasks are bounded however many vectors a list or
queries a shard has. A query goes to a shard once, and one short list of its best classes comes back.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.llm.common import drop_path, hot_lookup, tidy, written

#: Classes that a list holds before boundary vectors are replicated; lists grow once there are as many as the sample allows.
LIST = 128
#: Bytes of the sample that the centroids are fitted on; a centroid stands for LEAST_SAMPLE of it at least.
SAMPLE_BYTES, LEAST_SAMPLE = 32 << 20, 8
#: A vector is filed under centroids at most this many times as far as the nearest, and under this many at most.
REPLICATE, REPLICAS = 1.03, 4
#: Links of a centroid.
LINKS = 16
#: Queries whose true neighbours are sought in all vectors, and the share of these that the chosen lists must hold.
CALIBRATION, REACHED = 256, 0.97
#: Bytes of vectors of a shard, longest part of a list, and queries of a task.
SHARD_BYTES, PART, QUERIES = 8 << 20, 4096, 2048
#: Vectors that walk the graph together.
WALKERS = 128


@dataclasses.dataclass
class Lists:
    """The centroids of the vectors of one length and the graph between them."""

    longest: float
    centroids: np.ndarray
    graph: np.ndarray

    @property
    def entries(self) -> np.ndarray:
        """Where every walk starts: as many centroids as there are in a square root, evenly spread over the halvings."""
        k = len(self.centroids)
        return np.unique(np.linspace(0, k - 1, math.isqrt(k) + 1).astype(np.int64))

    def place(self, x: np.ndarray) -> np.ndarray:
        """Vectors as points of unit length."""
        x = x / self.longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))
        return np.column_stack([x, rest]).astype(np.float32)

    def ask(self, q: np.ndarray) -> np.ndarray:
        """Queries as points: their direction alone counts."""
        q = q / np.abs(q).max(axis=1, keepdims=True)
        return np.column_stack([q / np.sqrt((q * q).sum(1, keepdims=True)), np.zeros(len(q))]).astype(np.float32)

    def walk(self, points: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Point, list and distance over the nearest distance, for all lists met whose distance is at most ``ratio`` times the nearest."""
        squares = (self.centroids * self.centroids).sum(1)
        entries, out = self.entries, []
        for at in range(0, len(points), WALKERS):
            p = points[at : at + WALKERS]
            far = np.full((len(p), len(squares)), np.inf, np.float32)
            done = np.zeros(far.shape, bool)
            far[:, entries] = np.sqrt(np.maximum(1 + squares[entries] - 2 * p @ self.centroids[entries].T, 1e-9))
            while True:
                who, node = np.nonzero((far <= ratio * far.min(axis=1, keepdims=True)) & ~done)
                if not len(who):
                    break
                done[who, node] = True
                met = np.unique((who[:, None] * len(squares) + self.graph[node]).ravel())
                who, node = met // len(squares), met % len(squares)
                new = np.isinf(far[who, node])
                who, node = who[new], node[new]
                far[who, node] = np.sqrt(np.maximum(1 + squares[node] - 2 * np.einsum("ij,ij->i", p[who], self.centroids[node]), 1e-9))
            near = far.min(axis=1, keepdims=True)
            who, node = np.nonzero(far <= ratio * near)
            out.append((who + at, node, far[who, node] / near[who, 0]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))


def halves(points: np.ndarray, parts: int) -> np.ndarray:
    """Means of parts of equal size (to one), found by halving by median along the line between two means."""
    rng, out, left = np.random.default_rng(11), [], [np.arange(len(points))]
    most = len(points) / max(1, parts) * 1.2
    while left:
        rows = left.pop()
        if len(rows) <= max(most, 1):
            out.append(points[rows].mean(axis=0))
            continue
        a, b = points[rows[rng.permutation(len(rows))[:2]]]
        for _ in range(6):
            order = np.argpartition(points[rows] @ (b - a), len(rows) // 2)
            low, high = rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]
            a, b = points[low].mean(axis=0), points[high].mean(axis=0)
        left += [high, low]
    return np.array(out, np.float32)


def link(centroids: np.ndarray, links: int = LINKS) -> np.ndarray:
    """Each centroid's nearest ones, and its neighbours in the order of the halvings, so that the graph hangs together."""
    k, squares, out = len(centroids), (centroids * centroids).sum(1), []
    take = min(links, k)
    for at in range(0, k, 1024):
        far = squares - 2 * centroids[at : at + 1024] @ centroids.T
        out.append(np.argpartition(far, take - 1, axis=1)[:, :take])
    own = np.arange(k)[:, None]
    return np.concatenate([np.concatenate(out), (own + 1) % k, (own - 1) % k], axis=1)


def fit_lists(sample: np.ndarray, longest: float, count: int, list_size: int = LIST) -> Lists:
    """Lists for ``count`` vectors out of a sample of them."""
    lists = Lists(longest, np.zeros((1, sample.shape[1] + 1), np.float32), np.zeros((1, 1), np.int64))
    points = lists.place(sample)
    lists.centroids = halves(points, max(1, min(count // list_size, len(points) // LEAST_SAMPLE)))
    lists.graph = link(lists.centroids)
    return lists


# ------------------------------------------------------------------ rows


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, key, d, x`` (little-endian doubles) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    usable = (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & usable)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            offsets = np.asarray(column.offsets).astype(np.int64)
            flat = np.asarray(column.values).astype("<f8")[offsets[0] : offsets[-1]] + 0.0  # no negative zeros
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((offsets - offsets[0]) * 8), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(np.diff(offsets).astype(np.int32)), raw.cast(pa.binary())], ["vec_id", "d", "x"])

    return rows.mapInArrow(tidy(run), "vec_id long, d int, x binary").select("vec_id", F.sha2("x", 256).alias("key"), "d", "x")


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """``key, d, x, ids``: distinct vectors with their k + 1 smallest ids; of a crowd of copies, each task hands on so many."""
    some = rows.withColumn("r", F.dense_rank().over(W.partitionBy("key").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    return some.groupBy("key").agg(F.first("d").alias("d"), F.first("x").alias("x"), F.sort_array(F.collect_set("vec_id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a binary column whose values have one length."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of each length of vector, and the vectors."""
    lengths = batch.column("d").to_numpy()
    for d in np.unique(lengths):
        rows = batch.take(pa.array(np.flatnonzero(lengths == d)))
        yield int(d), rows, _matrix(rows.column("x"))


def fit(classes: DataFrame, list_size: int = LIST) -> dict[int, Lists]:
    """Lists by length of vector, each out of its share of the sample."""
    known = classes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(64).collect()  # further lengths have one list
    out: dict[int, Lists] = {}
    longest = classes.mapInArrow(tidy(_longest), "d int, longest double").groupBy("d").agg(F.max("longest").alias("longest")).join(F.broadcast(classes.sparkSession.createDataFrame([(r.d,) for r in known], "d int")), "d").collect() if known else []
    norms, budget = {r.d: r.longest for r in longest}, SAMPLE_BYTES // max(1, len(known))
    for r in known:
        share = min(1.0, budget / (8 * r.d * r.n))
        picked = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))
        sample = classes.filter((F.col("d") == r.d) & picked).select("key", "x").toArrow().sort_by("key")
        if sample.num_rows:
            out[r.d] = fit_lists(_matrix(sample["x"]), norms[r.d], r.n, list_size)
    return out


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    most: dict[int, float] = {}
    for batch in batches:
        for d, _, x in _by_length(batch):
            top = np.abs(x).max()
            most[d] = max(most.get(d, 0.0), float(top * np.sqrt(((x / top) ** 2).sum(1).max())))
    if most:
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int32()), pa.array(list(most.values()), pa.float64())], ["d", "longest"])


def assign(classes: DataFrame, model, replicate: float, replicas: int) -> DataFrame:
    """``classes`` and the ``lists`` each is filed under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in _by_length(batch):
                lists = model.value.get(d)
                if lists is None:
                    yield rows.append_column("lists", pa.array([[0]] * rows.num_rows, pa.list_(pa.int32())))
                    continue
                who, node, far = lists.walk(lists.place(x), replicate)
                order = np.lexsort((node, far, who))
                who, node = who[order], node[order]
                first = np.searchsorted(who, np.arange(rows.num_rows))
                few = np.arange(len(who)) - first[who] < replicas
                ends = np.concatenate([[0], np.cumsum(np.bincount(who[few], minlength=rows.num_rows))]).astype(np.int32)
                yield rows.append_column("lists", pa.ListArray.from_arrays(pa.array(ends), pa.array(node[few].astype(np.int32))))

    return classes.mapInArrow(tidy(run), "key string, d int, x binary, ids array<long>, lists array<int>")


# ------------------------------------------------------------------ how far to look


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest scores, all that may tie with the last of them included."""
    if scores.shape[1] <= k:
        return np.divmod(np.arange(scores.size), scores.shape[1])
    least = np.partition(scores, -k, axis=1)[:, -k]
    return np.nonzero(scores >= (least - 1e-9 * np.abs(least))[:, None])


def calibrate(filed: DataFrame, asking: DataFrame, models: dict[int, Lists], k: int, queries: int, reached: float) -> dict[int, float]:
    """For each length, the ratio of distances within which lists hold ``reached`` of the k nearest of a sample of queries,
    sought among all vectors: each task keeps the k best of every query and hands on no more."""
    sample = asking.orderBy(F.xxhash64("key"), "key").limit(queries).select("d", "x").toArrow()
    by = {d: _matrix(sample.filter(pa.array(sample["d"].to_numpy() == d))["x"]) for d in sorted(set(sample["d"].to_pylist())) if d in models}
    sent = filed.sparkSession.sparkContext.broadcast(by)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for d, rows, x in _by_length(batch):
                if d not in sent.value:
                    continue
                who, col = _best(sent.value[d] @ x.T, k)
                new = pa.table({"q": who, "score": np.einsum("ij,ij->i", sent.value[d][who], x[col]), "lists": rows.column("lists").take(pa.array(col))})
                old = pa.concat_tables([*held.get(d, []), new])
                order = np.lexsort((-old["score"].to_numpy(), old["q"].to_numpy()))
                q = old["q"].to_numpy()[order]
                held[d] = [old.take(pa.array(order[np.arange(len(q)) - np.searchsorted(q, q) < k]))]
        for d, (t,) in held.items():
            t = t.combine_chunks()
            for b in t.append_column("d", pa.array(np.full(t.num_rows, d, np.int32))).to_batches():
                yield b

    found = filed.mapInArrow(tidy(scan), "q long, score double, lists array<int>, d int")
    best = found.withColumn("r", F.row_number().over(W.partitionBy("d", "q").orderBy(F.desc("score")))).filter(F.col("r") <= k).select("d", "q", "lists").toArrow()
    out: dict[int, float] = {}
    for d, q in by.items():
        lists = models[d]
        points = lists.ask(q)
        far = np.sqrt(np.maximum(1 + (lists.centroids**2).sum(1) - 2 * points @ lists.centroids.T, 1e-9))
        far /= far.min(axis=1, keepdims=True)
        mine = best.filter(pa.array(best["d"].to_numpy() == d))
        need = [far[a, b].min() for a, b in zip(mine["q"].to_pylist(), mine["lists"].to_pylist(), strict=True)]
        out[d] = float(np.quantile(need, reached, method="higher")) * (1 + 1e-5) if need else 1.0
    return out


# ------------------------------------------------------------------ search


def _shard(d: Column, no: Column, part: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(d, no, part), F.lit(shards))


def probes(asking: DataFrame, model, ratios: dict[int, float]) -> DataFrame:
    """``key, d, x`` of every query and ``lists``, those it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in _by_length(batch):
                lists = model.value.get(d)
                if lists is None:
                    yield rows.append_column("lists", pa.array([[0]] * rows.num_rows, pa.list_(pa.int32())))
                    continue
                who, node, _ = lists.walk(lists.ask(x), ratios.get(d, math.inf))
                order = np.argsort(who, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=rows.num_rows))]).astype(np.int32)
                yield rows.append_column("lists", pa.ListArray.from_arrays(pa.array(ends), pa.array(node[order].astype(np.int32))))

    return asking.select("key", "d", "x").mapInArrow(tidy(run), "key string, d int, x binary, lists array<int>")


def scan_shard(k: int):
    """The task of a shard and a block of queries: each query's best rows in the lists it reads there."""

    def run(filed: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        at = np.cumsum([0, *(len(u) for u in asked["units"].to_pylist())])
        unit_of = np.concatenate([np.asarray(u, np.int64) for u in asked["units"].to_pylist()]) if len(asked) else np.zeros(0, np.int64)
        asker = np.repeat(np.arange(len(asked)), np.diff(at))
        units, lengths = filed["unit"].to_numpy(), filed["d"].to_numpy()
        least = np.array([i[0] for i in filed["ids"].to_pylist()], np.int64)
        order = np.lexsort((least, units))
        bounds = np.flatnonzero(np.diff(units[order], prepend=units[order][:1] - 1)) if len(order) else []
        for lo, hi in zip(bounds, [*bounds[1:], len(order)], strict=True):
            rows = order[lo:hi]
            for d in np.unique(lengths[rows]):
                mine = rows[lengths[rows] == d]
                who = asker[unit_of == units[rows[0]]]
                who = who[asked["d"].to_numpy()[who] == d]
                if not len(who):
                    continue
                x, q = _matrix(filed["x"].take(pa.array(mine))), _matrix(asked["x"].take(pa.array(who)))
                a, b = _best(q @ x.T, k + 1)
                out.append((who[a], mine[b], np.einsum("ij,ij->i", q[a], x[b])))
        if not out:
            return pa.table({"key": pa.array([], pa.string()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        who, row, score = (np.concatenate(c) for c in zip(*out, strict=True))
        # a boundary vector counts once for a query
        keys = np.unique(np.asarray(filed["key"].to_pylist(), object).astype(str), return_inverse=True)[1] if len(filed) else np.zeros(0, np.int64)
        _, once = np.unique(who * (len(filed) + 1) + keys[row], return_index=True)
        who, row, score = who[once], row[once], score[once]
        order = np.lexsort((least[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        few = np.arange(len(who)) - np.searchsorted(who, who) <= k
        who, row, score = who[few], row[few], score[few]
        ids = filed["ids"].take(pa.array(row)).combine_chunks()
        n = np.diff(np.asarray(ids.offsets).astype(np.int64))
        who, score, ids = np.repeat(who, n), np.repeat(score, n), np.asarray(ids.flatten())
        order = np.lexsort((ids, -score, who))
        who, score, ids = who[order], score[order], ids[order]
        few = np.arange(len(who)) - np.searchsorted(who, who) <= k
        return pa.table({"key": asked["key"].take(pa.array(who[few])), "id": ids[few], "score": score[few]})

    return run


def nearest(
    vectors: DataFrame, asks: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", list_size: int = LIST, reached: float = REACHED, replicate: float = REPLICATE
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``asks`` (a condition on vec_id), its k nearest among all other rows, ties to the smaller id.

    Rows whose id or vector is null, and vectors that are empty, zero or hold null or non-finite components, take no
    part. Only vectors of one length meet. Copies are rows of their own. Rows that share an id are one candidate with its best score; a
    query's own id is never in its result. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows, rows_path = written(packed(vectors, id_col, vector_col), "vectors")
    classes, classes_path = written(vector_classes(rows, k), "vector-classes")
    asking_rows = rows.filter(asks)
    asking, asking_path = written(asking_rows.groupBy("key").agg(F.first("d").alias("d"), F.first("x").alias("x")), "queries")
    models = fit(classes, list_size)
    model = spark.sparkContext.broadcast(models)
    filed, filed_path = written(assign(classes, model, replicate, REPLICAS), "filed-vectors")
    drop_path(spark, classes_path)
    ratios = calibrate(filed, asking, models, k, CALIBRATION, reached) if models else {}
    posted = filed.select("key", "d", "x", "ids", F.explode("lists").alias("no"))
    # how many parts each list has: a row for each centroid
    sizes = posted.groupBy("d", "no").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.octet_length("x")) / SHARD_BYTES).alias("b"))
    sizes, sizes_path = written(sizes.withColumn("parts", F.ceil(F.greatest(F.col("n") / PART, "b")).cast("int")), "list-sizes")
    shards = int(sizes.agg(F.ceil(F.sum("b"))).first()[0] or 1)
    counts = F.broadcast(sizes.select("d", "no", "parts"))  # at most a row for each centroid of the bounded sample
    unit = F.xxhash64("d", "no", "part")
    dealt = posted.join(counts, ["d", "no"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = dealt.select(_shard(F.col("d"), F.col("no"), F.col("part"), shards).alias("shard"), unit.alias("unit"), "key", "d", "x", "ids")
    units = sizes.select("d", "no", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    units = units.select("d", "no", _shard(F.col("d"), F.col("no"), F.col("part"), shards).alias("shard"), unit.alias("unit"))
    reads, reads_path = written(probes(asking, model, ratios), "probes")
    each = reads.select("key", "d", F.explode("lists").alias("no")).join(units, ["d", "no"])
    visits, visits_path = written(each.groupBy("key", "shard").agg(F.collect_set("unit").alias("units")), "visits")
    blocks = visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    blocks, blocks_path = written(blocks, "query-blocks")
    asked = visits.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).join(reads.select("key", "d", "x"), "key")
    held = dealt.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = held.select("shard", "block", "unit", "key", "d", "x", "ids").groupBy("shard", "block")
    right = asked.select("shard", "block", "key", "d", "x", "units").groupBy("shard", "block")
    found = left.cogroup(right).applyInArrow(scan_shard(k), "key string, id long, score double")
    best = found.groupBy("key", "id").agg(F.max("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 1)
    tops, _ = written(best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("top")), "nearest")
    asked_ids, _ = written(asking_rows.select(F.col("vec_id").alias("query_id"), "key").distinct(), "query-ids")
    for path in (rows_path, asking_path, filed_path, sizes_path, reads_path, visits_path, blocks_path):
        drop_path(spark, path)
    out = hot_lookup(asked_ids, "key", tops, "top")
    others = F.slice(F.filter("top", lambda c: c["id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("at", "c"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("c.id").alias("vec_id"), F.col("c.score").alias("score"))

