"""Encoding of whole record batches with a public word-level BPE tokenizer.

The tokenizers library encodes each distinct piece once; a document's ids are gathered from its pieces. That is exact
because the tokenizer drops white space and never joins text across it, and because ASCII punctuation other than an
apostrophe after a letter always starts a new piece. Pieces of plain letters go to the library's BPE model without its normaliser, which does
nothing else to them than lower-casing; all others pass the library's whole pipeline.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wayfold.llm.common import compact, spans

#: Pieces whose ids a worker remembers; the memory starts anew beyond that.
REMEMBERED = 1_000_000
_LETTERS = "^(?:[a-zÀ-ÖØ-öø-ÿ]+|[.,])$"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_str(json.dumps(spec))
        self.full.no_truncation()
        self.full.no_padding()
        self.marks = sorted({x["content"][:2] for x in spec["added_tokens"]})
        spec |= {"added_tokens": [], "normalizer": None, "truncation": None, "padding": None}
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        spec["model"]["cache_capacity"] = 0
        self.bare = Tokenizer.from_str(json.dumps(spec))
        size = self.full.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.full.id_to_token(i) or "" for i in range(size)]
        self.ends = np.array([t.endswith("</w>") for t in self.tokens])
        self.size = size
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.Array) -> None:
        plain = pc.match_substring_regex(new, _LETTERS)
        words = pc.utf8_lower(new.filter(plain)).to_pylist()
        ids = [x.ids for x in self.bare.encode_batch_fast([" ".join(words[i : i + 500]) for i in range(0, len(words), 500)], add_special_tokens=False)]
        flat = np.concatenate([np.array(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
        cuts = np.flatnonzero(self.ends[flat]) + 1
        if len(cuts) != len(words):
            raise ValueError("a piece of letters must end in exactly one final token")
        lengths = np.diff(cuts, prepend=0)
        rest = new.filter(pc.invert(plain))
        more = self.encode_whole(rest.to_pylist())
        self.known = pa.concat_arrays([self.known, new.filter(plain), rest])
        at = len(self.ids)
        self.ids = np.concatenate([self.ids, flat, *more])
        lengths = np.concatenate([lengths, np.array([len(x) for x in more], np.int64)]).astype(np.int64)
        self.starts = np.concatenate([self.starts, at + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and the ids of all texts one after another; null counts as empty."""
        texts = compact(texts)
        odd = np.zeros(len(texts), bool)
        for mark in self.marks:  # texts that may hold an added token's string are encoded whole
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts) if odd.any() else texts
        x = pc.ascii_lower(plain)
        for white in "\n\t\r":
            x = pc.replace_substring(x, white, " ")
        x = pc.replace_substring_regex(x, r"(\pL)([!-&(-/:-@\[-`{-~])", r"\1 \2")
        pieces = pc.split_pattern(x, " ")
        at = np.asarray(pieces.offsets).astype(np.int64)
        coded = pieces.values.cast(pa.large_string()).dictionary_encode()
        distinct = coded.dictionary
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        found = pc.index_in(distinct, value_set=self.known)
        if found.null_count:
            self._learn(distinct.filter(pc.is_null(found)))
            found = pc.index_in(distinct, value_set=self.known)
        index = np.asarray(found)[np.asarray(coded.indices)] if len(distinct) else np.zeros(0, np.int64)
        lengths = self.lengths[index]
        ids = self.ids[spans(self.starts[index], lengths)]
        offsets = np.concatenate([[0], np.cumsum(lengths)])[at - at[0]]
        if not odd.any():
            return offsets, ids
        whole = dict(zip(np.flatnonzero(odd), self.encode_whole(texts.filter(pa.array(odd)).to_pylist()), strict=True))
        parts = [whole.get(i, ids[offsets[i] : offsets[i + 1]]) for i in range(len(texts))]
        return np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), np.concatenate(parts).astype(np.int32)

    @functools.cached_property
    def token_array(self) -> pa.Array:
        return pa.array(self.tokens, pa.large_string())

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """What the library's decode(ids, skip_special_tokens=False) gives: this file has no decoder, so tokens joined by spaces."""
        if self.full.decoder is not None:
            return pa.array([self.full.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.large_string())
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), self.token_array.take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    return WordEncoder(path)
