"""Comma-separated files whose quoted cells may hold line breaks, read in splits.

Whether a line break ends a row depends on everything before it in the file, but only through one bit: does the line
begin inside a quoted cell? Every line maps that bit to the next line's. Each split of a file computes its own map, for
both bits at once; the maps (one row a split) are composed in the order of the splits, which tells each split how it
begins. Then all splits cut rows side by side. A row that lies in one split stays there; of a row that crosses splits,
the pieces (two a split at most, or the split as a whole) are put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A cell is quoted (what follows its closing quote up to the comma belongs to it) or holds no quote at its start.
_CELL = r'(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*|)'
#: Lines that, begun outside a quoted cell, or inside one, end outside.
_CLOSED, _CLOSING = rf"(?s)^{_CELL}(?:,{_CELL})*$", rf'(?s)^(?:[^"]|"")*"(?:[^",][^,]*)?(?:,{_CELL})*$'


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, value``: physical lines; a split's lines stand in order in one task."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def outcomes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each line, whether the next begins inside a cell where this one begins outside, and where it begins inside."""
    from_outside, from_inside = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    quoted = np.flatnonzero(pc.fill_null(pc.match_substring(lines, '"'), False).to_numpy(zero_copy_only=False))
    if len(quoted):
        some = lines.take(pa.array(quoted))
        from_outside[quoted] = ~pc.match_substring_regex(some, _CLOSED).to_numpy(zero_copy_only=False)
        from_inside[quoted] = ~pc.match_substring_regex(some, _CLOSING).to_numpy(zero_copy_only=False)
    return from_outside, from_inside


def walk(from_outside: np.ndarray, from_inside: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Whether each line begins inside a cell, given the first; and the line after the last."""
    begins = np.zeros(len(from_outside), bool)
    openers, closers, at = np.flatnonzero(from_outside), np.flatnonzero(~from_inside), 0
    while at < len(begins):
        if inside:
            k = np.searchsorted(closers, at)
            end = closers[k] + 1 if k < len(closers) else len(begins)
            begins[at:end] = True
            inside = k == len(closers)
        else:
            k = np.searchsorted(openers, at)
            end = openers[k] + 1 if k < len(openers) else len(begins)
            inside = k < len(openers)
        at = end
    return begins, bool(inside)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """A batch's lines by (file, split)."""
    split, file = batch.column("split").to_numpy(), batch.column("file")
    codes = np.asarray(file.dictionary_encode().indices)
    at = np.flatnonzero(np.diff(split, prepend=-1) | np.diff(codes, prepend=-1))
    for lo, hi in zip(at, [*at[1:], batch.num_rows], strict=True):
        yield file[lo].as_py(), int(split[lo]), batch.column("value").slice(lo, hi - lo)


def split_maps(lines: DataFrame) -> DataFrame:
    """``file, split, outside, inside``: where the line after a split's last begins, for either bit its first begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[bool, bool]] = {}
        for batch in batches:
            for file, split, values in _runs(batch):
                o, i = outcomes(values)
                held[file, split] = tuple(walk(o, i, s)[1] for s in held.get((file, split), (False, True)))
        if held:
            keys, ends = list(held), list(held.values())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64()), pa.array([e[0] for e in ends]), pa.array([e[1] for e in ends])], ["file", "split", "outside", "inside"])

    return lines.mapInArrow(run, "file string, split long, outside boolean, inside boolean")


def split_begins(maps: DataFrame) -> DataFrame:
    """``file, split, begins``: the maps composed in the order of each file's splits (a row of some bytes for each split)."""
    ordered = maps.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("split", "outside", "inside"))).alias("maps"))
    start = F.struct(F.lit(False).alias("now"), F.array().cast("array<struct<split:bigint,begins:boolean>>").alias("out"))

    def step(acc, m):
        out = F.concat(acc["out"], F.array(F.struct(m["split"].alias("split"), acc["now"].alias("begins"))))
        return F.struct(F.when(acc["now"], m["inside"]).otherwise(m["outside"]).alias("now"), out.alias("out"))

    return ordered.select("file", F.explode(F.aggregate("maps", start, step)["out"]).alias("o")).select("file", "o.*")


def cut(lines: DataFrame, begins: DataFrame) -> DataFrame:
    """``file, split, no, part, text``: the rows of every split in order. ``part`` is null for whole rows; the piece before a
    split's first row is ``end``, an unfinished last row ``begin``, a split inside one row ``middle``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside: dict[tuple[str, int], bool] = {}
        open_row: dict[tuple[str, int], list[str]] = {}  # a row's lines so far, where it is not finished
        started: dict[tuple[str, int], bool] = {}  # whether the split has begun a row of its own
        numbers: dict[tuple[str, int], int] = {}

        def batch_of(key, texts, parts) -> pa.RecordBatch:
            n, first = len(texts), numbers.get(key, 0)
            numbers[key] = first + n
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.string()), pa.array(np.full(n, key[1], np.int64)), pa.array(np.arange(first, first + n)), pa.array(parts, pa.string()), pa.array(texts, pa.string())],
                ["file", "split", "no", "part", "text"],
            )

        for batch in batches:
            for file, split, values in _runs(pa.RecordBatch.from_arrays([batch.column(c) for c in ("file", "split", "value")], ["file", "split", "value"])):
                key = file, split
                if key not in inside:
                    inside[key] = batch.column("begins")[0].as_py() if batch.num_rows and batch.column("split")[0].as_py() == split else None
                    if inside[key] is None:
                        at = int(np.flatnonzero(batch.column("split").to_numpy() == split)[0])
                        inside[key] = batch.column("begins")[at].as_py()
                    open_row[key], started[key] = [], not inside[key]
                begun, inside[key] = walk(*outcomes(values), inside[key])
                heads = np.flatnonzero(~begun)
                texts, parts = [], []
                before = int(heads[0]) if len(heads) else len(values)
                open_row[key] += values.slice(0, before).to_pylist()
                for k, at in enumerate(heads.tolist()):
                    if open_row[key]:
                        texts.append("\n".join(open_row[key]))
                        parts.append(None if started[key] else "end")
                    started[key] = True
                    to = int(heads[k + 1]) if k + 1 < len(heads) else len(values)
                    open_row[key] = values.slice(at, to - at).to_pylist()
                if texts:
                    yield batch_of(key, texts, parts)
        for key, rest in open_row.items():
            if rest:
                part = ("begin" if inside[key] else None) if started[key] else ("middle" if inside[key] else "end")
                yield batch_of(key, ["\n".join(rest)], [part])

    marked = lines.join(F.broadcast(begins), ["file", "split"]).select("file", "split", "value", "begins")  # a row a split
    return marked.mapInArrow(run, "file string, split long, no long, part string, text string")


def logical_rows(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, no, text``: the rows of a file (or of the files of a folder), line breaks in cells kept; ``split`` and ``no`` order them."""
    lines = file_lines(spark, path)
    rows = cut(lines, split_begins(split_maps(lines)))
    whole = rows.filter("part is null").drop("part")
    # a file's pieces are two a split at most; a row is what stands from one ``begin`` to the next
    order = W.partitionBy("file").orderBy("split", "no")
    pieces = rows.filter("part is not null").withColumn("row", F.sum(F.when(F.col("part") == "begin", 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = pieces.groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("split", "no", "text"))).alias("p"))
    crossing = joined.select("file", F.col("p")[0]["split"].alias("split"), F.col("p")[0]["no"].alias("no"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(crossing)


def read_quoted(spark: SparkSession, path: str, schema) -> DataFrame:
    """The cells of a file with a header line, with ``file`` and ``ord`` (its rows' order); blank rows are none.

    Quotes inside quoted cells are doubled; missing cells are null; a file of which the last cell never closes ends with that row.
    """
    rows = logical_rows(spark, path).filter(~((F.col("split") == 0) & (F.col("no") == 0)))
    rows = rows.withColumn("text", F.regexp_replace("text", r"\r$", "")).filter("text <> ''")
    cells = F.from_csv("text", schema.simpleString() if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return rows.select(cells.alias("c"), "file", F.struct("split", "no").alias("ord")).select("c.*", "file", "ord")
