"""Token-id files: independent zstandard frames, a trailing seek table, a checksum for every frame.

A file (one shard) is a sequence of zstandard frames, each holding little-endian ids of one document (long documents
take several frames), a skippable frame with the shard's document index, and a skippable frame with the seek table of
the public zstd seekable format: compressed size, decompressed size and the low 32 bits of XXH64 of every frame. A
reader takes the two tables from the end of the file and then fetches and decompresses only the frames of the documents
it wants. Shards are cut by ranges of doc_id, so shard order is doc_id order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import new_path, slices, texts_of, tidy, written
from wayfold.llm.encoder import encoder

FRAME_IDS = 1 << 16
SEEK_MAGIC, SEEKABLE, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
#: A null doc_id in a shard's index.
NO_ID = np.iinfo(np.int64).min
#: Documents of one shard, as planned; ranges of doc_id make shards of about this many.
SHARD_DOCS = 20_000


def frames_of(ids: np.ndarray, width: int, compressor) -> tuple[bytes, np.ndarray]:
    """The ids' frames one after another, and a row (compressed, decompressed, checksum) for each."""
    import xxhash

    blob, rows = [], []
    for at in range(0, len(ids), FRAME_IDS):
        raw = ids[at : at + FRAME_IDS].astype(f"<u{width}").tobytes()
        frame = compressor.compress(raw)
        blob.append(frame)
        rows.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
    return b"".join(blob), np.array(rows, "<u4").reshape(-1, 3)


class ShardWriter:
    def __init__(self, out, width: int):
        self.out, self.width, self.table, self.docs = out, width, [], []
        self.frames = 0

    def add(self, doc_id: int | None, n_tokens: int, blob: bytes, rows: np.ndarray) -> None:
        self.out.write(blob)
        self.table.append(rows)
        self.docs.append((NO_ID if doc_id is None else doc_id, n_tokens, self.frames, len(rows)))
        self.frames += len(rows)

    def close(self) -> None:
        docs = np.array(self.docs, "<i8").reshape(-1, 4)
        index = self.width.to_bytes(8, "little") + docs.tobytes()
        self.out.write(INDEX_MAGIC.to_bytes(4, "little") + len(index).to_bytes(4, "little") + index)
        seek = np.concatenate(self.table).astype("<u4").tobytes() if self.table else b""
        seek += self.frames.to_bytes(4, "little") + bytes([0x80]) + SEEKABLE.to_bytes(4, "little")
        self.out.write(SEEK_MAGIC.to_bytes(4, "little") + len(seek).to_bytes(4, "little") + seek)
        self.out.close()


class ShardReader:
    """Random access to one shard through an open seekable file."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        foot = self._at(size - 9, 9)
        if int.from_bytes(foot[5:], "little") != SEEKABLE:
            raise ValueError("no seek table at the end")
        n = int.from_bytes(foot[:4], "little")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        head = self._at(int(self.starts[-1]), 8)
        if int.from_bytes(head[:4], "little") != INDEX_MAGIC:
            raise ValueError("no document index before the seek table")
        index = self._at(int(self.starts[-1]) + 8, int.from_bytes(head[4:], "little"))
        self.width = int.from_bytes(index[:8], "little")
        self.docs = np.frombuffer(index[8:], "<i8").reshape(-1, 4)

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, each frame held against its checksum."""
        import xxhash

        _, n_tokens, first, n = self.docs[k]
        blob, parts, at = self._at(int(self.starts[first]), int(self.starts[first + n] - self.starts[first])), [], 0
        for size, plain, check in self.table[first : first + n]:
            raw = self.unzip.decompress(blob[at : at + size], max_output_size=int(plain))
            if len(raw) != plain or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError("a frame does not match its checksum")
            parts.append(np.frombuffer(raw, f"<u{self.width}"))
            at += int(size)
        out = np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")
        if len(out) != n_tokens:
            raise ValueError("a document's frames hold another number of ids")
        return out

    def find(self, doc_ids: Iterable[int]) -> list[int]:
        wanted = set(doc_ids)
        return [k for k, d in enumerate(self.docs[:, 0]) if int(d) in wanted]


def open_store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def encode_frames(docs: DataFrame, tokenizer: str, end_id: int | None, bounds: list[int]) -> DataFrame:
    """One row for each document: its frames, their table, and the shard its doc_id falls into (null ids: the first)."""
    cuts = np.array(bounds, np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, compressor = encoder(tokenizer), zstandard.ZstdCompressor(level=3)
        width = 2 if max(enc.size, (end_id or 0) + 1) <= 1 << 16 else 4
        for batch in slices(batches):
            offsets, ids = enc.encode(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            blobs, tables, counts, shards = [], [], [], []
            for k, doc_id in enumerate(doc_ids):
                own = ids[offsets[k] : offsets[k + 1]]
                if end_id is not None:
                    own = np.append(own, np.int32(end_id))
                blob, rows = frames_of(own, width, compressor)
                blobs.append(blob)
                tables.append(rows.tobytes())
                counts.append(len(own))
                shards.append(0 if doc_id is None else int(np.searchsorted(cuts, doc_id, "right")))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary()), pa.array(tables, pa.binary()), pa.array([width] * len(doc_ids), pa.int32())], ["shard", "doc_id", "n_tokens", "frames", "table", "width"])

    return texts_of(docs).mapInArrow(tidy(encode), "shard int, doc_id long, n_tokens long, frames binary, table binary, width int")


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = 1, shard_docs: int = SHARD_DOCS) -> tuple[DataFrame, str]:
    """Writes ``docs`` as token files into ``folder``; gives the manifest (a row for each shard) and the folder.

    Nulls: a null text is empty, a null doc_id comes first. Rows that share a doc_id stay beside each other, ordered by
    length and frames. A file's name holds its task attempt, and only the manifest says which files count, so lost and
    repeated tasks leave no wrong reads. An empty input gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    shards = max(1, -(-docs.count() // shard_docs))
    bounds = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / shards for k in range(1, shards)], 10 * shards)).first()[0] if shards > 1 else []
    rows = encode_frames(docs, tokenizer, end_id, sorted(set(bounds or [])))
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n_tokens", "frames")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, store, open_shard, writer, done = TaskContext.get().taskAttemptId(), None, None, None, []

        def finish() -> None:
            writer.close()
            n = np.array([d[1] for d in writer.docs], np.int64)
            done.append((open_shard, f"{folder}/{name}", len(n), int(n.sum())))

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != open_shard:
                    if writer:
                        finish()
                    open_shard, name = row["shard"], f"shard-{row['shard']:06d}-{attempt}.tok.zst"
                    if store is None:
                        store, root = open_store(folder)
                        store.create_dir(root, recursive=True)
                    writer = ShardWriter(store.open_output_stream(f"{root}/{name}", compression=None), row["width"])
                writer.add(row["doc_id"], row["n_tokens"], row["frames"], np.frombuffer(row["table"], "<u4").reshape(-1, 3))
        if writer:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["shard", "path", "n_docs", "n_tokens"])

    manifest, _ = written(dealt.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "manifest")
    return manifest, folder


def read_token_files(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian u32) of every document, or of the few in ``doc_ids``.

    The manifest has one row for each shard, so its order and running sums are taken on the driver.
    """
    spark = manifest.sparkSession
    shards = sorted((r.shard, r.path, r.n_tokens) for r in manifest.collect())
    before = np.concatenate([[0], np.cumsum([s[2] for s in shards])]).astype(int).tolist()
    tasks = spark.createDataFrame([(p, before[k], k) for k, (_, p, _) in enumerate(shards)], "path string, before long, k int").repartitionById(max(1, len(shards)), F.col("k"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                with store.open_input_file(path) as file:
                    shard = ShardReader(file, file.size())
                    starts = row["before"] + np.cumsum(shard.docs[:, 1]) - shard.docs[:, 1]
                    wanted = range(len(shard.docs)) if doc_ids is None else shard.find(doc_ids)
                    for at in range(0, len(wanted), 500):
                        part = wanted[at : at + 500]
                        ids = [None if shard.docs[k, 0] == NO_ID else int(shard.docs[k, 0]) for k in part]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([int(starts[k]) for k in part], pa.int64()), pa.array([int(shard.docs[k, 1]) for k in part], pa.int64()), pa.array([shard.ids(k).tobytes() for k in part], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return tasks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
