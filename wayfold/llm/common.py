"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds and processes at once.
SLICE_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty ones; other columns cannot clash after this."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only in local mode, where that may be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder (lineage ends there, any executor can read it) and the table's path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@functools.cache
def _return_at_once() -> Callable[[], None]:
    """From now on this process maps arrays of a megabyte and more one by one, so freeing one hands it back; gives what hands back the rest."""
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "mallopt"):
        return pa.default_memory_pool().release_unused
    pa.set_memory_pool(pa.system_memory_pool())
    libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    return lambda: libc.malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a Python worker that hands free memory back to the system, as it goes and when its partition ends:
    workers outlive their tasks and share an executor's memory with the JVM."""

    @functools.wraps(run)
    def through(batches: Iterator) -> Iterator:
        trim = _return_at_once()
        try:
            yield from run(batches)
        finally:
            trim()

    return through


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def string_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and the n+1 offsets of the texts in them."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def compact(texts: pa.Array) -> pa.LargeStringArray:
    """A large string array without nulls that starts at the start of its own buffers (some kernels misread slices)."""
    data, offsets = string_buffer(texts)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data)))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of each span, one span after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def hot_lookup(left: DataFrame, key: str, right: DataFrame, value: str, share: int = 5000) -> DataFrame:
    """``left`` with ``value`` from ``right`` (unique in ``key``) by a left join that no key can skew.

    A key that holds over 1/share of the rows of ``left``, and over a thousand, is hot: there are at most ``share`` of
    those, so they are broadcast; the other keys are joined by a shuffle. ``left`` is read four times and should be a
    written table. Where no key is hot, one join does.
    """
    rows = left.count()
    least = max(1000, rows // share)
    hot = left.groupBy(key).count().filter(F.col("count") > least).select(key)
    if rows <= least or hot.isEmpty():  # so few rows have no hot key
        return left.join(right.select(key, value), key, "left").select(*left.columns, value)
    hot = hot.join(right.select(key, value), key, "left").select(F.col(key).alias("_wf_key"), F.col(value).alias("_wf_value"), F.lit(True).alias("_wf_hot"))
    marked = left.join(F.broadcast(hot), left[key].eqNullSafe(F.col("_wf_key")), "left")
    warm = marked.filter("_wf_hot").select(*left.columns, F.col("_wf_value").alias(value))
    cold = marked.filter("_wf_hot is null").select(*left.columns).join(right.select(key, value), key, "left").select(*left.columns, value)
    return warm.unionByName(cold)


def may_be_in(left: DataFrame, key: str, keys: DataFrame, bits: int = 24, absent: bool = False) -> DataFrame:
    """The rows of ``left`` whose ``key`` may be among ``keys`` (same column name): a filter before an exact join.

    With ``absent``, all other rows: those whose key is certainly not among ``keys``.

    The filter is a bitmap of 2^bits bits over a hash of the key, broadcast as at most 2^(bits-6) rows (4 MB at 24)
    however many keys there are; with too many keys it only filters less.
    """
    place = F.col("_wf_hash").bitwiseAND(F.lit((1 << bits) - 1))
    hashed = keys.select(F.xxhash64(key).alias("_wf_hash")).select(F.shiftright(place, 6).alias("_wf_word"), F.expr("shiftleft(1L, cast(_wf_hash & 63 as int))").alias("_wf_mask"))
    bitmap = hashed.groupBy("_wf_word").agg(F.bit_or("_wf_mask").alias("_wf_mask"))
    marked = left.withColumn("_wf_hash", F.xxhash64(key))
    marked = marked.join(F.broadcast(bitmap), F.shiftright(place, 6) == F.col("_wf_word"), "left")
    hit = F.expr("coalesce(_wf_mask & shiftleft(1L, cast(_wf_hash & 63 as int)), 0L) <> 0")
    return marked.filter(~hit if absent else hit).select(*left.columns)


def without(docs: DataFrame, removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose ``key`` is in ``removed``. Only rows that the bitmap suspects are shuffled; null keys stay."""
    removed = removed.select(key).filter(F.col(key).isNotNull()).distinct()
    return may_be_in(docs, key, removed, absent=True).unionByName(may_be_in(docs, key, removed).join(removed, key, "left_anti").select(*docs.columns))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every endpoint of ``edges``: component is the smallest id reachable.

    Each round hooks every root to its smallest neighbour, flattens the hooks by pointer doubling, and relabels the
    edges by root; edges inside a component disappear, so the graph shrinks round by round. All tables are written to
    the shared folder, none is gathered.
    """
    spark = edges.sparkSession
    cut, cut_path = written(edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).filter("a < b").distinct(), "edges")
    labels, labels_path = written(cut.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")), "labels")
    while not cut.isEmpty():
        both = cut.unionByName(cut.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks, hooks_path = written(both.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("m")).select("root", F.least("root", "m").alias("p")), "hooks")
        while True:
            up = hooks.select(F.col("root").alias("p"), F.col("p").alias("pp"))
            if hooks.join(up, "p").filter("pp < p").isEmpty():
                break
            flat, flat_path = written(hot_lookup(hooks, "p", up, "pp").select("root", F.coalesce("pp", "p").alias("p")), "hooks")
            drop_path(spark, hooks_path)
            hooks, hooks_path = flat, flat_path
        for end in ("a", "b"):
            ends = hooks.select(F.col("root").alias(end), "p")
            moved, moved_path = written(hot_lookup(cut, end, ends, "p").withColumn(end, F.coalesce("p", end)).drop("p").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct() if end == "b" else hot_lookup(cut, end, ends, "p").withColumn(end, F.coalesce("p", end)).drop("p"), "edges")
            drop_path(spark, cut_path)
            cut, cut_path = moved, moved_path
        onto, onto_path = written(hot_lookup(labels, "root", hooks, "p").select("id", F.coalesce("p", "root").alias("root")), "labels")
        drop_path(spark, labels_path)
        drop_path(spark, hooks_path)
        labels, labels_path = onto, onto_path
    drop_path(spark, cut_path)
    return labels.select("id", F.col("root").alias("component"))
