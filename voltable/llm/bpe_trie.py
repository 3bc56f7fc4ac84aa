"""BPE encoding by a prefix-sharing trie of distinct words, and decoding.

For every prefix of a word there is exactly one symbol that ends its encoding: the symbol is a suffix of the prefix, and
it may stand after the symbol that ends the encoding of the rest. So the encoding of a prefix is that of a shorter prefix
and one more symbol. Distinct words are put into a trie; going down depth first, each node gets its last symbol and its
encoding from nodes above it, once for all words that share the prefix.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltable.llm.ragged import Merger
from voltable.llm.vocab import Memory, Vocabulary, load, slices

#: Remembered answers to "may this symbol follow that one?" per worker; beyond it the memory starts afresh.
PAIRS = 1_000_000
#: Nodes below this depth hold their last symbol only; a longer word's encoding is read off them backwards, so memory
#: stays in proportion to the word.
DEEP = 256


class TrieEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.packed = [int(i).to_bytes(4, "little") for i in vocabulary.ids]
        # a symbol that its own bytes don't lead to is in no encoding
        sym, seq = Merger(vocabulary).merge(vocabulary.bytes[256:])
        several = self.unreachable = set(np.flatnonzero(np.bincount(seq) > 1).tolist())
        self.suffix: dict[bytes, int] = {}  # every suffix of a symbol -> the symbol with just these bytes, or -1
        for n, b in enumerate(vocabulary.bytes):
            if n < 256 or n - 256 not in several:
                self.suffix[b] = n
                for k in range(1, len(b)):
                    self.suffix.setdefault(b[k:], -1)
        self.size = [len(b) for b in vocabulary.bytes]
        self.may_follow: dict[int, bool] = {}  # by left << 32 | right

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of both symbols' bytes is these two symbols: no merge across the border comes before
        the merges inside that made the symbols next to it. Inner merges are undone from the youngest on."""
        made, halves = self.v.pairs, self.v.halves
        bound = len(halves)  # a merge across the border must be older than what it would break
        while True:
            across = made.get((left, right))
            if across is not None and across < bound:
                return False
            if left < 256 and right < 256:
                return True
            if left >= 256 and left > right:
                bound, left = left, halves[left][1]
            else:
                # of equally old neighbours the left one is made first, so a merge with the right one's half comes in between
                bound, right = right + 1, halves[right][0]

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit numbers."""
        raw = [w.encode("utf-8", "replace") for w in words]
        out: list[bytes] = [b""] * len(raw)
        if len(self.may_follow) > PAIRS:
            self.may_follow.clear()
        suffix, size, packed, known, may, follows = self.suffix.get, self.size, self.packed, self.may_follow, self.may_follow.get, self.follows
        last, code, before = [-1], [b""], b""  # states on the way from the root to the present node
        for i in sorted(range(len(raw)), key=raw.__getitem__):
            word = raw[i]
            depth, most = 0, min(len(word), len(before))
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del last[depth + 1:], code[depth + 1:]  # up to the node where this word leaves the one before
            for end in range(depth + 1, len(word) + 1):
                fits, start = [], end - 1
                while start >= 0 and (s := suffix(word[start:end])) is not None:
                    if s >= 0:
                        fits.append(s)
                    start -= 1
                while True:  # the longest that may stand there, as a rule the first
                    s = fits.pop()
                    at = end - size[s]
                    if not at:
                        break
                    ok = may(key := last[at] << 32 | s)
                    if ok is None:
                        ok = known[key] = follows(last[at], s)
                    if ok:
                        break
                last.append(s)
                if end <= DEEP:
                    code.append(code[at] + packed[s])
            end, tail = len(word), []
            while end > DEEP:
                tail.append(packed[last[end]])
                end -= size[last[end]]
            out[i], before = code[end] + b"".join(reversed(tail)), word
        return out


@lru_cache(maxsize=2)
def _encoding(path: str) -> Memory:
    vocabulary = load(path)
    return Memory(vocabulary, TrieEncoder(vocabulary).encode)


def encode_batch(memory: Memory, texts: list[str]) -> list[bytes]:
    """The ids of whole texts; special strings inside a text become their own ids."""
    v, parts = memory.vocabulary, []
    for text in texts:
        parts.append([v.special[s] if k % 2 else memory.numbers(s) for k, s in enumerate(v.segments(text))])
    memory.settle(b"".join)
    value = memory.value.__getitem__
    out = [b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(value, p)) for p in some) for some in parts]
    memory.trim()
    return out


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and `ids` (array of token ids) of every whole text.

    `vocabulary` is the path of a byte-level BPE file. A null or empty text has no ids; a null id stays null; repeated
    rows are encoded each; other columns are not read. No shuffle.
    """

    def run(batches):
        memory = _encoding(vocabulary)
        for b in slices(batches):
            codes = encode_batch(memory, b.column(1).to_pylist())
            flat = pa.array(memoryview(b"".join(codes)).cast("I"), pa.int32()) if any(codes) else pa.array([], pa.int32())
            ends = [0]
            for c in codes:
                ends.append(ends[-1] + len(c) // 4)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=[id_col, "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and `text` of rows of token ids (null ids: null text); bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        v = load(vocabulary)
        for b in slices(batches):
            texts = [None if ids is None else v.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    rows = encoded.select(F.col(id_col), F.col(ids_col).cast("array<int>"))
    return rows.mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass over it: id, `n_tokens`, `ids_sha256` (of the decimal ids joined by
    commas), `decoded_sha256`. Nulls and repeated rows as for `encode`; the ids are not kept."""

    def run(batches):
        memory = _encoding(vocabulary)
        decimal = {i: str(i) for i in memory.vocabulary.by_id}
        for b in slices(batches):
            n, of_ids, of_text = [], [], []
            for code in encode_batch(memory, b.column(1).to_pylist()):
                ids = memoryview(code).cast("I").tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(memory.vocabulary.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return _rows(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
