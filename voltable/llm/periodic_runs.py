"""Periodic runs of words by Lyndon roots.

A run is a stretch of words with smallest period q that cannot be extended. Every run has a root, a longest Lyndon word
starting inside it, under the order of words or under its reverse. The first phase of Baier's suffix sorter groups the
suffixes of a text by just these words: it takes the greatest group again and again and appends it to what stands to its
left, so the Lyndon arrays under both orders come out of two such groupings. Each root is then extended to a run by longest
common extensions to both sides (names of blocks of 2^k words).

A run of power e holds every three words in a row at least about e - 1 times, so texts are first cut where no such run can
lie; what is left is grouped whole.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltable.llm.vocab import slices

#: Bytes of text that are worked on together.
TOGETHER = 4_000_000
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def lyndon_array(words: list[int], falling: bool = False) -> list[int]:
    """For each place the length of the longest Lyndon word that starts there, under the rising or falling order of words."""
    n = len(words)
    rank = {w: r for r, w in enumerate(sorted(set(words), reverse=falling))}
    group = [rank[w] for w in words]
    members: list[list[int]] = [[] for _ in rank]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, len(rank) - 1)), list(range(1, len(rank) + 1))
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))  # neighbours among the places not yet taken
    group.append(-1)  # both ends are in no group
    out = [0] * n
    g = len(rank) - 1
    while g >= 0:
        grown: dict[tuple[int, int], list[int]] = {}
        for i in members[g]:
            left = before[i]
            if group[i] != g or group[left] == g:
                continue  # went to a higher group, or is inside a chain
            chain, at = 0, i
            while group[at] == g:
                right = after[at]
                out[at] = right - at
                at = right
                chain += 1
            if at < n:
                before[at] = left
            if left >= 0:
                after[left] = at
                grown.setdefault((chain, group[left]), []).append(left)
        for (_, old), places in sorted(grown.items(), key=lambda x: -x[0][0]) if len(grown) > 1 else grown.items():
            # right above the group they come from; shorter chains come later and so below longer ones
            new, upper = len(members), above[old]
            members.append(places)
            below.append(old)
            above.append(upper)
            above[old] = below[upper] = new
            for j in places:
                group[j] = new
        g = below[g]
    return out


class _Same:
    """Equal blocks of words by name, level k for blocks of 2^k words; a block lies inside one part."""

    def __init__(self, words: np.ndarray, first: np.ndarray, end: np.ndarray):
        self.first, self.end = first, end
        self.levels = [words.astype(np.int32)]
        at, step = np.arange(len(words)), 1
        while len(at := at[at + 2 * step <= end[at]]):
            names = np.full(len(words), -1, np.int32)
            last = self.levels[-1]
            names[at] = np.unique((last[at].astype(np.int64) << 32) | last[at + step], return_inverse=True)[1]
            self.levels.append(names)
            step *= 2

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j > i on are equal."""
        got, room = np.zeros(len(i), np.int64), self.end[i] - j
        for k in reversed(range(len(self.levels))):
            can = np.flatnonzero(got + (1 << k) <= room)
            name = self.levels[k]
            can = can[name[i[can] + got[can]] == name[j[can] + got[can]]]
            got[can] += 1 << k
        return got

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j > i are equal."""
        got, room = np.zeros(len(i), np.int64), i - self.first[np.minimum(i, len(self.first) - 1)]
        for k in reversed(range(len(self.levels))):
            can = np.flatnonzero(got + (1 << k) <= room)
            name, back = self.levels[k], 1 << k
            can = can[name[i[can] - got[can] - back] == name[j[can] - got[can] - back]]
            got[can] += 1 << k
        return got


def _cut(words: np.ndarray, ends: np.ndarray, least: int, power: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, lengths of parts): the parts, one after another, in which runs can lie. `ends`: where the texts end."""
    times = min((max(least, power * q) - 2) // q for q in range(1, least + 2))  # of three words in a row inside a run
    at, lengths = np.arange(len(words)), np.diff(ends, prepend=0)
    while True:
        long = lengths >= least
        keep = np.repeat(long, lengths)
        at, lengths = at[keep], lengths[long]
        if times < 2 or not len(at):
            return at, lengths
        part, w = np.repeat(np.arange(len(lengths)), lengths), words[at].astype(np.uint64)
        h = np.zeros(len(at), np.uint64)
        inside = np.flatnonzero(part[2:] == part[:-2])
        for x in (part[inside].astype(np.uint64), w[inside], w[inside + 1], w[inside + 2]):
            h[inside] = (h[inside] ^ x) * np.uint64(0x9E3779B97F4A7C15)
            h[inside] ^= h[inside] >> np.uint64(29)
        bits = max(8, (4 * len(at)).bit_length())
        slot = (h[inside] * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - bits)
        often = np.zeros(len(at), bool)
        often[inside] = np.bincount(slot.astype(np.int64), minlength=1 << bits)[slot.astype(np.int64)] >= times
        # a part is a stretch of such starts and the two words after the last; it ends where the old one does at the latest
        follows = np.zeros(len(at), bool)
        follows[1:] = often[1:] & often[:-1] & (part[1:] == part[:-1])
        heads = np.flatnonzero(often & ~follows)
        stretch = np.add.reduceat(often.astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
        size = stretch + 2
        places = at[np.repeat(heads - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        done = len(places) > 0.9 * len(at)
        at, lengths = places, size
        if done:
            long = lengths >= least
            return at[np.repeat(long, lengths)], lengths[long]


def runs_of(words: np.ndarray, ends: np.ndarray, least: int = 6, power: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of at least `least` words and `power` (>= 2) periods, by start, then period.
    `words` are the numbered words of texts one after another, `ends` where these end; starts count from the first text."""
    at, lengths = _cut(words, ends, least, power)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    stop = np.cumsum(lengths)
    w = words[at]
    own, root, period = w.tolist(), [], []
    for a, b in zip((stop - lengths).tolist(), stop.tolist()):
        part = own[a:b]
        for falling in (False, True):
            period.append(np.array(lyndon_array(part, falling), np.int64))
            root.append(np.arange(a, b))
    i, p = np.concatenate(root), np.concatenate(period)
    same = _Same(w, np.repeat(stop - lengths, lengths), np.repeat(stop, lengths))
    # words with period p on both sides of the root
    left, right = same.left(i, i + p), same.right(i, i + p)
    start, length = i - left, p + left + right
    good = length >= np.maximum(least, power * p)
    found = np.unique(np.stack([at[start[good]], p[good], length[good]], 1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _portions(texts: list[bytes]):
    """(first, end) of stretches of about TOGETHER bytes."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def find_runs(docs: DataFrame, least: int = 6, power: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, `n_words`, `runs` (start, length and period in words, by start, then period) of at least
    `least` words and `power` periods, and `collapsed`: the text without the words that a run holds after its first period,
    joined by single spaces.

    Words are what ASCII white space separates. A null text counts as empty (no words, no runs, empty `collapsed`); a null
    id stays null; repeated rows are done each; an empty table gives no rows; texts of any length are done whole, in time
    that grows with their length; other columns are not read. No shuffle.
    """

    def run(batches):
        for b in slices(batches):
            texts = [t.encode() for t in b.column(1).to_pylist()]
            for first, end in _portions(texts):
                split = [t.split() for t in texts[first:end]]  # bytes split at ASCII white space
                number = _Numbers()
                words = np.fromiter((number[w] for own in split for w in own), np.int64)
                ends = np.cumsum([len(own) for own in split])
                start, length, period = runs_of(words, ends, least, power)
                # words that go: +1 and -1 at the ends of each run's rest, summed up
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
                stays = np.cumsum(edge[:-1]) == 0
                rows = np.searchsorted(start, np.r_[0, ends])
                collapsed = []
                for own, e, a, z in zip(split, ends.tolist(), rows.tolist(), rows[1:].tolist()):
                    collapsed.append((b" ".join(own if a == z else compress(own, stays[e - len(own): e].tolist()))).decode())
                start -= np.r_[0, ends][np.searchsorted(ends, start, "right")]
                fields = [pa.array(x, pa.int64()) for x in (start, length, period)]
                runs = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
                counts = pa.array([len(own) for own in split], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0)[first:end], counts, runs, pa.array(collapsed, pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, runs {RUNS}, collapsed string")
