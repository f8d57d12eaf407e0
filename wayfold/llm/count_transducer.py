"""Token counts from a tokenizer compiled to deterministic transducers.

The byte-level BPE tokenizer is compiled in two layers. The splitter is a complete transducer of 12 states over 11
character classes; its transitions tell where pieces start. Each chunk of characters is a map from state to state;
the maps of all chunks are composed by a parallel prefix scan (doubling), after which every chunk runs from its true
state at once. The counter is a transducer over pieces: a transition that ends a piece emits that piece's number of
tokens. Its transitions are compiled when a piece is first met, by the library's own BPE model, and kept. A text's count
is the sum of what its transitions emit, so no token is ever materialised.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wayfold.llm.common import compact, slices, string_buffer, texts_of, tidy

#: Characters of a chunk whose state map is composed with the others'.
CHUNK = 64
#: Pieces whose counts a worker keeps; the memory starts anew beyond that.
REMEMBERED = 1_500_000

LETTER, NUMBER, SPACE, WHITE, OTHER, QUOTE, ONE, R, V, EL, E, STAY = range(12)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, SPACE_1, SPACE_N, WHITE_1, WHITE_N, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
STATES, CLASSES = 12, 12
#: Added to the class of a text's first character.
FIRST = CLASSES
#: What a transition says: a piece starts at this character; one starts at the character before.
HERE, BEFORE = 1, 2
_LETTERS = (LETTER, ONE, R, V, EL, E)


def _enter(kind: int) -> int:
    if kind in _LETTERS:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: QUOTED, SPACE: SPACE_1, WHITE: WHITE_1}[kind]


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state and marks for the public pattern of byte-level BPE: contractions, runs with one leading space, white space."""
    if kind == STAY:
        return state, 0
    white = kind in (SPACE, WHITE)
    fresh = (_enter(kind), HERE)
    if state in (SPACE_1, SPACE_N, WHITE_1, WHITE_N):
        if white:
            return (SPACE_N if kind == SPACE else WHITE_N), 0
        back = BEFORE if state in (SPACE_N, WHITE_N) else 0
        if state in (SPACE_1, SPACE_N):  # the last space belongs to the run that follows; a quote is an ordinary sign there
            return (IN_OTHERS if kind == QUOTE else _enter(kind)), back
        return fresh[0], HERE | back
    if state == IN_LETTERS:
        return (IN_LETTERS, 0) if kind in _LETTERS else fresh
    if state == IN_NUMBERS:
        return (IN_NUMBERS, 0) if kind == NUMBER else fresh
    if state == IN_OTHERS:
        return (IN_OTHERS, 0) if kind in (OTHER, QUOTE) else fresh
    if state == QUOTED:
        if kind in (ONE, R, V, EL):
            return {ONE: START, R: QUOTED_R, V: QUOTED_V, EL: QUOTED_L}[kind], 0
        return (IN_OTHERS, 0) if kind in (OTHER, QUOTE) else fresh
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if kind == (EL if state == QUOTED_L else E):
            return START, 0
        after, mark = _step(IN_LETTERS, kind)  # no contraction: the letter began a run of its own
        return after, mark | BEFORE
    return fresh


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks at [class * STATES + state], classes with FIRST added included."""
    to, marks = np.zeros((2 * CLASSES, STATES), np.uint8), np.zeros((2 * CLASSES, STATES), np.uint8)
    for kind in range(CLASSES):
        for state in range(STATES):
            to[kind, state], marks[kind, state] = _step(state, kind)
            if kind != STAY:
                to[FIRST + kind, state] = _enter(kind)
                marks[FIRST + kind, state] = HERE | (BEFORE if state in (QUOTED_R, QUOTED_V, QUOTED_L) else 0)
    return to.ravel(), marks.ravel()


def states_before(kinds: np.ndarray) -> np.ndarray:
    """The state before each character and, last, the final one: chunk maps, a prefix scan over them, and one run of all chunks."""
    to, _ = tables()
    n = len(kinds)
    rows = max(1, -(-n // CHUNK))
    grid = np.full(rows * CHUNK, STAY, np.int32)
    grid[:n] = kinds
    grid = np.ascontiguousarray((grid * STATES).reshape(rows, CHUNK).T)
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES)).copy()
    for column in grid:
        maps = to[column[:, None] + maps]
    step = 1
    while step < rows:  # afterwards row i holds the map of chunks 0..i
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)])
        step *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    out = np.empty((CHUNK + 1, rows), np.uint8)
    out[0] = state
    for k, column in enumerate(grid):
        out[k + 1] = state = to[column + state]
    return np.append(out[:-1].T.ravel()[:n], state[-1])


class CountingTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or not spec["pre_tokenizer"]["use_regex"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE with its own pattern is compiled")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        self.special = [t["content"] for t in spec["added_tokens"]]
        spec |= {"added_tokens": [], "truncation": None, "padding": None, "post_processor": None}
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"String": "\0"}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        spec["model"]["cache_capacity"] = 0
        self.bare = Tokenizer.from_str(json.dumps(spec))
        self.zero = self.bare.encode("\0", add_special_tokens=False).ids
        if len(self.zero) != 1:
            raise ValueError("the byte 0 must be one token")
        self.probe = ByteLevel(add_prefix_space=False, use_regex=True)
        self.kinds = np.full(0x110000, 255, np.uint8)
        for cp in range(128):
            self.kinds[cp] = self._kind(cp)
        for chars, kind in (("stmd", ONE), ("r", R), ("v", V), ("l", EL), ("e", E), ("'", QUOTE), (" ", SPACE)):
            for c in chars:
                self.kinds[ord(c)] = kind
        self.forget()

    def _kind(self, cp: int) -> int:
        """A character's class as the library's own pattern sees it."""
        c = chr(cp)
        if len(self.probe.pre_tokenize_str(f"x{c}x")) == 1:
            return LETTER
        if len(self.probe.pre_tokenize_str(f"1{c}1")) == 1:
            return NUMBER
        return OTHER if len(self.probe.pre_tokenize_str(f"!{c}!")) == 1 else WHITE

    def forget(self) -> None:
        self.known, self.counts = pa.array([], pa.large_string()), np.zeros(0, np.int64)

    def _learn(self, pieces: pa.Array) -> None:
        odd = pc.match_substring(pieces, "\0")
        plain = pieces.filter(pc.invert(odd))
        words = plain.to_pylist()
        got = [np.array(x.ids, np.int32) for x in self.bare.encode_batch_fast(["\0".join(words[i : i + 500]) + "\0" for i in range(0, len(words), 500)], add_special_tokens=False)]
        flat = np.concatenate(got) if got else np.zeros(0, np.int32)
        counts = np.diff(np.flatnonzero(flat == self.zero[0]), prepend=-1) - 1
        rest = pieces.filter(odd)
        parts = [[len(self.bare.encode(p, add_special_tokens=False).ids) if p == "\0" else self._whole(p)] for p in rest.to_pylist()]
        self.known = pa.concat_arrays([self.known, plain, rest])
        self.counts = np.concatenate([self.counts, counts, np.array(parts, np.int64).ravel()])

    def _whole(self, piece: str) -> int:
        """Tokens of a piece that holds the byte 0, through the model itself."""
        mapped = self.probe.pre_tokenize_str(piece)
        return sum(len(self.bare.model.tokenize(x)) for x, _ in mapped)

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions at which pieces start, for texts that lie one after another in ``data``."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        cp = data[lead].astype(np.int32)
        wide = np.flatnonzero(cp >= 0xC0)
        if len(wide):
            at, b = lead[wide], cp[wide]
            get = lambda k: (data[np.minimum(at + k, len(data) - 1)] & 0x3F).astype(np.int32)
            two, three = (b & 0x1F) << 6 | get(1), (b & 0x0F) << 12 | get(1) << 6 | get(2)
            four = (b & 0x07) << 18 | get(1) << 12 | get(2) << 6 | get(3)
            cp[wide] = np.where(b < 0xE0, two, np.where(b < 0xF0, three, four))
        kinds = self.kinds[cp]
        if (kinds == 255).any():
            for c in np.unique(cp[kinds == 255]).tolist():
                self.kinds[c] = self._kind(c)
            kinds = self.kinds[cp]
        kinds = kinds.astype(np.int32)
        firsts = np.unique(np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0]))
        kinds[firsts] += FIRST
        states = states_before(kinds)
        marks = tables()[1][kinds * STATES + states[:-1]]
        new = (marks & HERE).astype(bool)
        new[:-1] |= (marks[1:] & BEFORE).astype(bool)
        if len(new) and states[-1] in (QUOTED_R, QUOTED_V, QUOTED_L):
            new[-1] = True
        return lead[new]

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text, as the library gives it by default; null counts as empty."""
        texts = compact(texts)
        total = np.zeros(len(texts), np.int64)
        owner = np.arange(len(texts))
        for special in self.special:  # the library first cuts a text at these strings; each is one token
            if pc.any(pc.match_substring(texts, special)).as_py():
                parts = pc.split_pattern(texts, special)
                n = np.diff(np.asarray(parts.offsets).astype(np.int64))
                np.add.at(total, owner, n - 1)
                owner, texts = np.repeat(owner, n), compact(parts.flatten())
        data, offsets = string_buffer(texts)
        if not len(data):
            return total
        starts = self.starts(data, offsets)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        if len(self.known) + len(pieces.dictionary) > REMEMBERED:
            self.forget()
        found = pc.index_in(pieces.dictionary, value_set=self.known)
        if found.null_count:
            self._learn(pieces.dictionary.filter(pc.is_null(found)))
            found = pc.index_in(pieces.dictionary, value_set=self.known)
        emitted = np.concatenate([[0], np.cumsum(self.counts[np.asarray(found)][np.asarray(pieces.indices)])])
        at = np.searchsorted(starts, offsets)
        np.add.at(total, owner, np.diff(emitted[at]))
        return total


@functools.lru_cache(maxsize=2)
def counting_tokenizer(path: str) -> CountingTokenizer:
    return CountingTokenizer(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document.

    A null text is empty and has no tokens; null and repeated doc_ids pass through row by row; an empty table gives no
    rows. Texts of any length are counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counting_tokenizer(tokenizer)
        for batch in slices(batches):
            text = batch.column("text")
            n = machine.count(text)
            size = np.diff(string_buffer(text)[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts_of(docs).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
