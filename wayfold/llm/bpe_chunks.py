"""BPE encoding with reuse of content-defined chunks, and decoding.

A gear rolling hash over the UTF-8 bytes cuts every text into chunks; equal content is cut alike wherever it stands, so
a chunk that many documents share is encoded once (by each Python worker, which keeps what it has encoded; workers do
not exchange chunks, since that would shuffle every text to save a few encodings). Cuts fall inside words. A chunk's
encoding is therefore kept for its body only, from its first to its last white space, where no token can depend on what
lies outside. The text of a join is the last chunk's tail and the next chunk's head; it is encoded again, and while it
ends in a chunk without white space, on which the encoding could still disagree, it is widened by the next chunk. So
the joined ids agree exactly with those of the whole text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfold.llm.common import compact, slices, string_buffer, texts_of, tidy
from wayfold.llm.encoder import WordEncoder, encoder

#: A cut where the low bits of the hash are zero: chunks of 1 KiB on average.
CUT_BITS = 10
#: Bytes of the rolling hash's window, a power of two.
WINDOW = 16
#: Bytes of ids of chunks that a worker remembers; beyond that the memory starts anew.
REMEMBERED_BYTES = 48 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True


@functools.cache
def gears() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_cuts(data: np.ndarray, offsets: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Sorted byte positions where chunks end: every text's end, and content-defined cuts at character starts.

    A hash covers the WINDOW bytes before a cut; cuts within WINDOW bytes of a text's start are left out, so the hash
    never sees another text.
    """
    h, width = gears()[data], 1
    while width < WINDOW:
        h = np.concatenate([h[:width], h[width:] + (h[:-width] << np.uint32(width))])
        width *= 2
    cuts = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    cuts = cuts[cuts < len(data)]
    cuts = cuts[(data[cuts] & 0xC0) != 0x80]
    text = np.searchsorted(offsets, cuts, "right") - 1
    cuts = cuts[cuts - offsets[text] >= WINDOW]
    return np.unique(np.concatenate([cuts, offsets[1:]]))


class ChunkEncoder:
    def __init__(self, words: WordEncoder):
        self.words = words
        self.forget()

    def forget(self) -> None:
        self.bodies: dict[bytes, np.ndarray] = {}
        self.held = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
        """Offsets and ids as WordEncoder.encode gives them for whole texts, and counts of chunks met and encoded."""
        texts = compact(texts)
        data, offsets = string_buffer(texts)
        if not len(data):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32), {"chunks": 0, "encoded": 0}
        ends = chunk_cuts(data, offsets)
        ends = ends[ends > 0]
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        space = np.flatnonzero(_SPACE[data])
        # the first white space at or after each chunk's begin, the last before its end
        first = np.append(space, len(data))[np.searchsorted(space, begins)]
        last = np.concatenate([[-1], space])[np.searchsorted(space, ends)]
        has = first < ends
        raw = data.tobytes()
        body_keys: list[bytes | None] = []
        new: dict[bytes, str] = {}
        for a, b, ok in zip(first.tolist(), last.tolist(), has.tolist(), strict=True):
            if not ok:
                body_keys.append(None)
                continue
            body = raw[a:b]
            key = body if len(body) <= 16 else hashlib.blake2b(body, digest_size=20).digest()
            body_keys.append(key)
            if key not in self.bodies and key not in new:
                new[key] = body.decode("utf-8")
        if self.held > REMEMBERED_BYTES:
            kept = {k: self.bodies[k] for k in set(body_keys) - {None} if k in self.bodies}
            self.forget()
            self.bodies, self.held = kept, sum(x.nbytes + 200 for x in kept.values())
        if new:
            at, ids = self.words.encode(pa.array(list(new.values()), pa.large_string()))
            for k, key in enumerate(new):
                self.bodies[key] = ids[at[k] : at[k + 1]].copy()
                self.held += self.bodies[key].nbytes + 200
        # joins: from one chunk's last white space to the first white space of a later chunk
        bounds = np.searchsorted(ends, offsets, "right").tolist()
        joins: list[bytes] = []
        order: list[list] = []
        for t in range(len(texts)):
            parts: list = []
            at = int(offsets[t])
            for c in range(bounds[t], bounds[t + 1]):
                if has[c]:
                    joins.append(raw[at : first[c]])
                    parts.append(len(joins) - 1)
                    parts.append(body_keys[c])
                    at = int(last[c])
            joins.append(raw[at : int(offsets[t + 1])])
            parts.append(len(joins) - 1)
            order.append(parts)
        coded = pa.array(joins, pa.large_binary()).cast(pa.large_string()).dictionary_encode() if joins else None
        if coded is not None:
            jat, jids = self.words.encode(coded.dictionary)
            jindex = np.asarray(coded.indices)
        out, lengths = [], []
        for parts in order:
            own = [self.bodies[p] if isinstance(p, bytes) else jids[jat[jindex[p]] : jat[jindex[p] + 1]] for p in parts]
            lengths.append(sum(map(len, own)))
            out += own
        flat = np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)
        return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), flat, {"chunks": len(ends), "encoded": len(new)}


@functools.lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(encoder(path))


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian u32) and ``decoded`` (those ids decoded) of every document.

    Null texts are empty: no ids, and the empty text decoded. Null and repeated doc_ids pass through, row by row. An
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_encoder(tokenizer)
        for batch in slices(batches):
            offsets, ids, _ = chunks.encode(batch.column("text"))
            raw = pa.py_buffer(ids.astype("<u4").tobytes())
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets * 4), raw]).cast(pa.binary())
            decoded = chunks.words.decode(offsets, ids).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), binary, decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    return texts_of(docs).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary, decoded string")
