"""Byte-level BPE vocabularies and the cutting of texts into pieces whose encodings are independent.

A vocabulary file is read once per Python worker from a path given as a parameter (the file of a public
tokenizer that every machine holds); it is never trained, changed or copied.

Numbering: symbols 0-255 are the bytes, symbol 256 + m is made by merge m. A symbol's number is therefore
also its age, which both encoders rely on: `load` checks that no merge uses a symbol made after it.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

#: Fixed value: the pattern by which byte-level BPE of this family cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the code points with Unicode's White_Space property.
WHITE_SPACE = frozenset(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Distinct pieces a worker remembers before it starts afresh; bounds its memory, never changes a result.
REMEMBERED = 400_000
#: Rows of a batch that are worked on together.
ROWS = 3000

_by_pattern = regex.compile(PATTERN).findall


def pretokens(text: str) -> list[str]:
    """What PATTERN finds; letters alone, or letters with a comma or full stop, need no matching."""
    word = text[1:] if text[:1] == " " else text
    if word.isalpha():
        return [text]
    if word[-1:] in (",", ".") and word[:-1].isalpha():
        return [text[:-1], text[-1]]
    return _by_pattern(text)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the file: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, letters = data["model"], _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        number = {}
        self.ids = np.zeros(256 + len(model["merges"]), np.uint32)  # symbol -> the file's id
        self.bytes: list[bytes] = [bytes([b]) for b in range(256)]  # symbol -> its bytes
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        for letter, b in letters.items():
            number[letter] = b
            self.ids[b] = model["vocab"][letter]
        self.pairs: dict[tuple[int, int], int] = {}
        for m, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if left not in number or right not in number or left + right in number:
                raise ValueError(f"{path}: merge {m} uses a symbol that no earlier merge makes, or makes one again")
            pair = (number[left], number[right])
            number[left + right] = self.pairs[pair] = 256 + m
            self.ids[256 + m] = model["vocab"][left + right]
            self.bytes.append(raw(left + right))
            self.halves.append(pair)
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens") or ()}
        self.by_id = {int(i): b for i, b in zip(self.ids, self.bytes)} | {i: s.encode() for s, i in self.special.items()}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def segments(self, text: str) -> list[str]:
        """Ordinary text at even places, special strings at odd ones."""
        return self._cut.split(text) if self._cut and any(s in text for s in self.special) else [text]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.by_id.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def slices(batches):
    """Arrow batches of at most ROWS rows."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


class _Irregular(Exception):
    pass


class Memory:
    """What is known about pieces of text: `value[key]`, filled for many new keys at once by `learn`.

    A text is cut at every space that stands between two characters that are no white space. No pre-token crosses
    such a place, so the pieces are encoded on their own and a text's tokens are its pieces' tokens one after another.
    Texts with other spaces are cut into pre-tokens at once.
    """

    def __init__(self, vocabulary: Vocabulary, learn):
        self.vocabulary, self.learn = vocabulary, learn
        self._clear()

    def _clear(self):
        self.word: dict[str, object] = {}  # by pre-token
        self.value: list[object] = []  # by number of a piece
        self.after_space, self.whole = _Numbers(self, " "), _Numbers(self, "")
        self.pending: list[list[str]] = []

    def number(self, pre: str, piece: str) -> int:
        if pre and (not piece or piece[0] in WHITE_SPACE or piece[-1] in WHITE_SPACE):
            raise _Irregular
        self.pending.append(pretokens(pre + piece))
        return len(self.value) + len(self.pending) - 1

    def numbers(self, segment: str) -> list[int]:
        """The numbers of a segment's pieces; their values are there after `settle`."""
        if not segment:
            return []
        first, *rest = segment.split(" ")
        if rest and (not first or first[-1] in WHITE_SPACE):
            return list(map(self.whole.__getitem__, pretokens(segment)))
        try:
            return [self.whole[first], *map(self.after_space.__getitem__, rest)]
        except _Irregular:
            return list(map(self.whole.__getitem__, pretokens(segment)))

    def settle(self, join) -> None:
        """Learn the pre-tokens of the pieces seen since the last call; `join` makes a piece's value of theirs."""
        fresh = list({w for words in self.pending for w in words} - self.word.keys())
        self.word.update(zip(fresh, self.learn(fresh)))
        known = self.word
        self.value.extend(known[words[0]] if len(words) == 1 else join([known[w] for w in words]) for words in self.pending)
        self.pending = []

    def trim(self) -> None:
        """Call between batches."""
        if len(self.value) > REMEMBERED or len(self.word) > REMEMBERED:
            self._clear()


class _Numbers(dict):
    def __init__(self, memory: Memory, pre: str):
        self.memory, self.pre = memory, pre

    def __missing__(self, piece: str) -> int:
        n = self[piece] = self.memory.number(self.pre, piece)
        return n
