"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (feed-forward work and attention). Within a block of
documents the number of sequences follows from the tokens; then documents go, longest first, to the sequence of lowest
cost that has capacity left, and are cut where it ends. The last tokens of a block make sequences whose capacities are
powers of two, so nothing is padded; these start with the cost of the capacity they lack, so they fill last.
Blocks are runs of documents inside a partition: there is no shuffle, and a block's size bounds a task's memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfold.llm.common import slices, texts_of, tidy
from wayfold.llm.encoder import encoder

CAPACITY = 2048
#: Tokens of a block: documents are gathered until it is full, then packed together.
BLOCK_TOKENS = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 4096


def cost(n: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


def capacities(total: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences, then the binary parts of what is left, largest first."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece. Ties: the earlier document, the earlier sequence."""
    room = capacities(sum(lengths), capacity)
    whole = cost(capacity, linear, quadratic)
    heap = [(whole - cost(c, linear, quadratic), s) for s, c in enumerate(room)]
    heapq.heapify(heap)
    used, pieces = [0] * len(room), []
    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start = 0
        while start < lengths[doc]:
            spent, s = heapq.heappop(heap)
            n = min(lengths[doc] - start, room[s] - used[s])
            pieces.append((doc, start, n, s, used[s]))
            used[s] += n
            start += n
            if used[s] < room[s]:
                heapq.heappush(heap, (spent + cost(n, linear, quadratic), s))
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Every piece of every document with its ids (little-endian u32) and its place in a sequence.

    A null text is empty and still gives its end id; a null doc_id stays null; rows are packed one by one, so repeated
    doc_ids do no harm; an empty table gives no rows. ``sequence_id`` is the partition's number times 2^33 and a count.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, sequence = encoder(tokenizer), TaskContext.get().partitionId() << 33
        doc_ids: list = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            lengths = [len(x) for x in ids]
            pieces = sorted(pack(lengths, capacity), key=lambda p: (p[3], p[4]))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([doc_ids[p[0]] for p in pieces], pa.int64()),
                    pa.array([p[1] for p in pieces], pa.int64()),
                    pa.array([p[2] for p in pieces], pa.int64()),
                    pa.array([ids[p[0]][p[1] : p[1] + p[2]].tobytes() for p in pieces], pa.binary()),
                    pa.array([lengths[p[0]] for p in pieces], pa.int64()),
                    pa.array([sequence + p[3] for p in pieces], pa.int64()),
                    pa.array([p[4] for p in pieces], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += max(p[3] for p in pieces) + 1
            doc_ids.clear()
            ids.clear()
            held = 0
            return out

        for batch in slices(batches):
            offsets, flat = enc.encode(batch.column("text"))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                doc_ids.append(doc_id)
                ids.append(np.append(flat[offsets[k] : offsets[k + 1]], end_id).astype("<u4"))
                held += len(ids[-1])
                if held >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    return texts_of(docs).mapInArrow(tidy(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``length`` and ``ids``; a group is one sequence at most."""
    from pyspark.sql import functions as F

    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", F.expr("aggregate(parts, cast('' as binary), (x, p) -> concat(x, p.ids))").alias("ids"))
