"""Rank-synchronous BPE merging of many pre-tokens at once, held as one flat array with sequence starts."""

from __future__ import annotations

import numpy as np

from voltable.llm.vocab import Vocabulary

_NONE = np.iinfo(np.int32).max
#: Symbols merged together at most in one block of pre-tokens (a longer pre-token is a block of its own).
BLOCK = 400_000


class Merger:
    """In each round every sequence applies its own lowest-ranked pair wherever it occurs (left to right, without
    overlap); a sequence leaves as soon as no pair of it can merge. As a merge only makes symbols younger than
    itself, a round is what one-at-a-time merging would have done before it turned to the next rank."""

    def __init__(self, vocabulary: Vocabulary):
        pairs = np.array([(a << 32) | b for a, b in vocabulary.pairs], np.int64)
        made = np.fromiter(vocabulary.pairs.values(), np.int32, len(pairs))
        order = np.argsort(pairs)
        self.keys, self.made, self.ids = pairs[order], made[order], vocabulary.ids
        size = max(256, 1)
        self.of_bytes = np.full(size * size, _NONE, np.int32)  # pairs of two bytes, by far the most asked for
        small = [(a * 256 + b, m) for (a, b), m in vocabulary.pairs.items() if a < 256 and b < 256]
        self.of_bytes[[k for k, _ in small]] = [m for _, m in small]

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def merge(self, words: list[bytes]):
        """(symbols, sequence of each symbol), sequences in no particular order but whole and in order inside."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        seq = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        done_sym, done_seq = [], []
        rank = np.full(len(sym), _NONE, np.int32)
        if len(sym) > 1:
            rank[:-1] = np.where(seq[:-1] == seq[1:], self.of_bytes[sym[:-1] * 256 + sym[1:]], _NONE)
        while len(sym):
            start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            size = np.diff(np.r_[start, len(seq)])
            low = np.minimum.reduceat(rank, start)
            if (low == _NONE).any():
                over = np.repeat(low == _NONE, size)
                done_sym.append(sym[over])
                done_seq.append(seq[over])
                sym, seq, rank = sym[~over], seq[~over], rank[~over]
                size, low = size[low != _NONE], low[low != _NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            # of pairs that overlap (the same symbol three times or more) every second one merges
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = rank[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, seq, rank, at = sym[keep], seq[keep], rank[keep], place[at]
            touched = np.concatenate([at, at[at > 0] - 1])
            rank[touched] = _NONE
            touched = touched[touched < len(sym) - 1]
            touched = touched[seq[touched] == seq[touched + 1]]
            rank[touched] = self._look_up(sym[touched], sym[touched + 1])
        return (np.concatenate(done_sym), np.concatenate(done_seq)) if done_sym else (sym, seq)

    def _blocks(self, words: list[str]):
        block, size = [], 0
        for w in words:
            raw = w.encode("utf-8", "replace")
            if block and size + len(raw) > BLOCK:
                yield block
                block, size = [], 0
            block.append(raw)
            size += len(raw)
        if block:
            yield block

    def count(self, words: list[str]) -> list[int]:
        """Surviving symbols of each word."""
        out: list[int] = []
        for block in self._blocks(words):
            out += np.bincount(self.merge(block)[1], minlength=len(block)).tolist()
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        for block in self._blocks(words):
            sym, seq = self.merge(block)
            order = np.argsort(seq, kind="stable")
            flat = self.ids[sym[order]].astype("<u4").tobytes()
            ends = np.cumsum(np.bincount(seq, minlength=len(block)) * 4).tolist()
            out += [flat[a:b] for a, b in zip([0, *ends], ends)]
        return out
