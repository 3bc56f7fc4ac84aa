"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked ids.

The cumulative ends of both token lists are the keys of two dictionaries; the ends they share, in order, slice both lists
into groups, and each slice is expanded into its links, the pairs of tokens whose bytes overlap. Both tokenizers start a
new token at every space between two other characters (checked when the vocabularies are read), so a text's alignment is
that of its pieces one after another, and a piece is aligned once as long as it is remembered.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltable.llm.joins import join_checked
from voltable.llm.packing import FAST_PATTERN
from voltable.llm.vocab import load, slices
from voltable.plans.lineage import materialize

#: Distinct pieces a worker remembers before it starts afresh; bounds its memory, never changes a result.
REMEMBERED = 400_000
#: Longer pieces are encoded by the tokenizers library, whose matching has no limit on backtracking.
LONG = 10_000
#: Bytes of text whose pairs are sorted together.
TOGETHER = 2_000_000
#: Pairs that are broadcast at most: those that hold more than one of so many shares of all (document, pair) rows.
HOT = 1 << 17
_SPACE = re.compile(r"(?<=\S) (?=\S)")


class _Byte:
    """Byte-level BPE: ids of a text with special strings as plain text, and the bytes of each id."""

    def __init__(self, path: str):
        v = load(path)
        self.bytes = {int(i): b for i, b in zip(v.ids, v.bytes)}
        self._slow = tokenizers.Tokenizer.from_file(path)
        self._slow.encode_special_tokens = True
        ranks = (np.diff(v.ids[256:].astype(np.int64)) > 0).all()  # ids in the order of merges serve as ranks
        self._fast = tiktoken.Encoding("own", pat_str=FAST_PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={}) if ranks else None
        self.size = max(self.bytes) + 1

    def __call__(self, text: str) -> list[int]:
        if self._fast is None or len(text) > LONG:
            return self._slow.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


class _Piece:
    """Sentencepiece: ids of a text (to which the model adds a space), and the bytes of each id."""

    def __init__(self, path: str):
        self._model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.cuts_at_spaces = not any("▁" in p.lstrip("▁") for p in names)

    def several(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


def slice_groups(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The places in a and in b of each group's last token, from the rising ends of both token lists."""
    of_a, of_b = (dict(zip(ends, range(len(ends)))) for ends in (a, b))
    return [(of_a[end], of_b[end]) for end in sorted(of_a.keys() & of_b.keys())]


def expand(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of all tokens whose byte ranges overlap: between two neighbouring ends, of whichever list, there is
    just one token of each, and no two such stretches have the same two."""
    ends = np.union1d(a, b)
    return np.searchsorted(a, ends), np.searchsorted(b, ends)


class Aligner:
    """Pieces (each stands for itself with a space before it) by number: counts, groups as text, links as pairs of ids."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = _Byte(byte_path), _Piece(piece_path)
        self._len_a, self._len_b = np.zeros(self.a.size, np.int64), np.array([len(x) for x in self.b.bytes])
        for i, x in self.a.bytes.items():
            self._len_a[i] = len(x)
        most = max(self.a.size, self.b.size)
        self._text = [f"{i}{end}" for end in ",|;\n" for i in range(most)]  # decimal ids with what follows them
        self._most = most
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers(self)
        self.pending: list[str] = []
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # of a, b, groups, links; -1: bytes differ
        self.links = np.zeros(0, np.int64)
        self.firsts = np.zeros(0, np.int64)

    def settle(self) -> None:
        """Learn the pieces met since the last call, all in one."""
        new, self.pending = self.pending, []
        if not new:
            return
        a, b = [self.a(" " + p) for p in new], self.b.several(new)
        text = [(" " + p).encode() for p in new]
        bad = [k for k, (x, y, t) in enumerate(zip(a, b, text)) if b"".join(map(self.b.bytes.__getitem__, y)) != t or b"".join(map(self.a.bytes.__getitem__, x)) != t]
        for k in bad:
            a[k], b[k] = [], []
        n_a, n_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(self._len_a[a]), np.cumsum(self._len_b[b])  # of all pieces one after another
        last = np.array(slice_groups(ends_a.tolist(), ends_b.tolist()), np.int64).reshape(-1, 2)
        at_a, at_b = expand(ends_a, ends_b)
        of_a, of_b = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        n_groups, n_links = np.bincount(of_a[last[:, 0]], minlength=len(new)), np.bincount(of_a[at_a], minlength=len(new))

        # text: a group's a ids, then its b ids, each with the sign that follows it
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[last[:, 0]], sign_b[last[:, 1]] = 1, 2
        sign_b[(np.cumsum(n_b) - 1)[n_b > 0]] = 3  # a piece ends
        group_a, group_b = (np.repeat(np.arange(len(last)), np.diff(last[:, k], prepend=-1)) for k in (0, 1))
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        codes = np.r_[sign_a * self._most + a, sign_b * self._most + b][order]
        texts = iter("".join(map(self._text.__getitem__, codes.tolist())).split("\n"))
        self.groups += [next(texts) if n else "" for n in n_b.tolist()]

        counts = np.stack([n_a, n_b, n_groups, n_links], 1)
        counts[bad, 0] = -1
        self.firsts = np.r_[self.firsts, len(self.links) + np.cumsum(n_links) - n_links]
        self.counts = np.r_[self.counts, counts]
        self.links = np.r_[self.links, a[at_a] * self.b.size + b[at_b]]

    def pieces(self, text: str) -> list[int]:
        """Numbers of a text's pieces; what is known of them is there after `settle`."""
        if not text:
            return []
        if not self.b.cuts_at_spaces:
            return [self.number.once(text)]
        try:
            return list(map(self.number.__getitem__, text.split(" ")))
        except _Irregular:
            return [self.number.once(p) if p[0].isspace() or p[-1].isspace() else self.number[p] for p in _SPACE.split(text)]


class _Irregular(Exception):
    pass


class _Numbers(dict):
    def __init__(self, aligner: Aligner):
        self.aligner = aligner

    def once(self, piece: str) -> int:
        """A number that is not remembered."""
        self.aligner.pending.append(piece)
        return len(self.aligner.groups) + len(self.aligner.pending) - 1

    def __missing__(self, piece: str) -> int:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Irregular  # a space beside other white space is no place to cut
        n = self[piece] = self.once(piece)
        return n


@lru_cache(maxsize=1)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _portions(texts: list[str]):
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def _aligned(aligner: Aligner, texts: list[str]):
    """Per text counts (a, b, groups, links), groups as text; and the distinct pairs with their numbers, text after text."""
    numbers = [aligner.pieces(t) for t in texts]
    aligner.settle()
    sizes = np.array(list(map(len, numbers)), np.int64)
    flat = np.fromiter(chain.from_iterable(numbers), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    counts = aligner.counts[flat]
    bad = np.zeros(len(texts), bool)
    bad[owner[counts[:, 0] < 0]] = True
    keep = ~bad[owner]
    flat, owner, counts = flat[keep], owner[keep], counts[keep]
    sums = np.stack([np.bincount(owner, counts[:, k], len(texts)) for k in range(4)], 1).astype(np.int64)
    groups = ["" if bad[i] else ";".join(map(aligner.groups.__getitem__, x)) for i, x in enumerate(numbers)]
    each = counts[:, 3]
    keys = aligner.links[np.arange(int(each.sum())) + np.repeat(aligner.firsts[flat] - (np.cumsum(each) - each), each)]
    keys += np.repeat(owner << 40, each)  # a pair is below 2^40
    keys.sort()
    head = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=head[1:])
    at = np.flatnonzero(head)
    keys = keys[at]
    return sums, groups, keys >> 40, keys & ((1 << 40) - 1), np.diff(at, append=len(head))


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """One row per row of `docs`: id, `n_a`, `n_b`, `n_groups`, `n_links`, `groups_sha256` ('' without tokens), `pairs` (distinct
    linked ids, as a id times B's vocabulary size plus b id, rising), `times` (links of each), and with `groups` the groups'
    text (`a1,a2|b1;...`).

    A null or empty text, and one whose joined token bytes of either tokenizer differ from a space and the text, has no
    tokens. A null id stays null; repeated rows are done each; an empty table gives no rows; texts of any length are done
    whole; other columns are not read. No shuffle.
    """

    def run(batches):
        aligner = _aligner(byte_path, piece_path)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            for first, end in _portions(texts):
                sums, text, owner, pairs, times = _aligned(aligner, texts[first:end])
                ends = pa.array(np.searchsorted(owner, np.arange(end - first + 1)), pa.int32())
                arrays = [b.column(0)[first:end], *(pa.array(sums[:, k], pa.int64()) for k in range(4)), pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in text], pa.string())]
                arrays += [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(text, pa.string())] if groups else []), names=names)
                if len(aligner.groups) > REMEMBERED:
                    aligner.clear()

    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *(["groups"] if groups else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema + (", `groups` string" if groups else ""))


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """`pair`, `n` (rows of `aligned` that hold it), `best` (whether no other pair of its a id has more); a written table."""
    counts = materialize(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a = F.expr(f"pair div {b_size}")
    most = materialize(counts.groupBy(a.alias("_a")).agg(F.max("n").alias("_most")), "most")  # a row per id of the vocabulary
    return materialize(join_checked(counts, most, a == F.col("_a"), "inner").select("pair", "n", (F.col("n") == F.col("_most")).alias("best")), "counted")


def linked(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`align` with `n_best` (links whose pair has the highest count of its a id, ties included) and `count_sum` (the counts of
    a row's links summed), without pairs. A pair's count is the number of rows that hold it.

    The few pairs that very many rows hold are broadcast (at most HOT: each has more than one of HOT shares of all rows of
    documents and pairs); the others, each in few rows, meet their counts by a shuffle. Nulls as for `align`.
    """
    b_size = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    aligned = materialize(align(docs, byte_path, piece_path, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counted = pair_counts(aligned, b_size)
    least = (counted.agg(F.sum("n")).first()[0] or 0) // HOT
    hot, rest = counted.where(F.col("n") > least), counted.where(F.col("n") <= least)
    each = aligned.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_x")).select("_row", F.col("_x.pairs").alias("pair"), F.col("_x.times").alias("_times"))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("_times")).otherwise(0)).alias("_best"), F.sum(F.col("_times") * F.col("n")).alias("_sum"))

    by_hot = summed(each.join(F.broadcast(hot), "pair"))
    by_rest = summed(each.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(rest, "pair"))
    sums = by_hot.unionByName(by_rest).groupBy("_row").agg(F.sum("_best").alias("_best"), F.sum("_sum").alias("_sum"))
    zero = F.lit(0).cast("bigint")
    return aligned.drop("pairs", "times").join(sums, "_row", "left").select(
        id_col, "n_a", "n_b", "n_groups", "n_links", F.coalesce("_best", zero).alias("n_best"), F.coalesce("_sum", zero).alias("count_sum"), "groups_sha256")
