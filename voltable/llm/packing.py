"""Packing of documents into sequences of a fixed number of tokens by best-fit decreasing.

Whole windows are cut off a document's front; what is left (shorter than a window) is packed whole. Best-fit decreasing
looks at lengths only, and there are at most `size` of them, so it runs exactly and over the whole corpus on the counts
per length: a segment tree over remaining capacities finds the tightest open windows for a length, and all windows and
documents in the same situation are handled at once. The outcome, a list of moves whose number depends on `size` and not
on the documents, tells every document its place by its rank among those of its length.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltable.llm.bpe_trie import _encoding, encode_batch
from voltable.llm.joins import join_checked
from voltable.llm.vocab import load, slices
from voltable.plans.lineage import materialize

#: Fixed value: the pre-token pattern of `vocab.PATTERN`, written with possessive quantifiers (same matches, less backtracking).
FAST_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Longer texts are encoded by the trie, whose matching has no limit on backtracking.
LONG = 200_000
#: Ids that a batch of pieces holds about.
TOGETHER = 500_000


@lru_cache(maxsize=2)
def _ranked(path: str) -> bool:
    """Whether the file's ids serve as ranks: they follow the order of merges, and every symbol is what its bytes merge to."""
    return (np.diff(load(path).ids[256:].astype(np.int64)) > 0).all() and not _encoding(path).learn.__self__.unreachable


@lru_cache(maxsize=2)
def _matcher(path: str) -> tiktoken.Encoding:
    v = load(path)
    return tiktoken.Encoding("own", pat_str=FAST_PATTERN, mergeable_ranks={b: int(i) for i, b in zip(v.ids, v.bytes)}, special_tokens=v.special)


def _encoder(path: str, ranked: bool, long: int):
    """Texts to their ids as little-endian unsigned 32-bit numbers. The trie is built where a text needs it."""

    def encode(text: str) -> bytes:
        if not ranked or len(text) > long:
            return encode_batch(_encoding(path), [text])[0]
        return _matcher(path).encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4").tobytes()

    return encode


def cut(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of documents: id, `start`, `length`, `ids_crc32`, `doc_tokens` (and `ids`), and each piece's place `_local` among
    those of its length in its task `_task`. A document's ids end with `end_id`, so an empty or null text is one piece of one
    token. Batches of pieces hold about TOGETHER ids, or one document's."""
    end = int(end_id).to_bytes(4, "little")
    kind = docs.schema[id_col].dataType.simpleString()
    ranked = _ranked(vocabulary)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "_task", "_local", *(["ids"] if with_ids else [])]

    def run(batches):
        encode, task = _encoder(vocabulary, ranked, LONG), TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        for b in slices(batches):
            row, numbers, ids, held = [], [], [], 0

            def pieces():
                columns = zip(*numbers) if numbers else [()] * 6
                arrays = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in columns)]
                return pa.RecordBatch.from_arrays([*arrays, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=names)

            for k, text in enumerate(b.column(1).to_pylist()):
                code = encode(text) + end
                n = len(code) // 4
                for s in range(0, n, size):
                    part = code[4 * s: 4 * (s + size)]
                    length = len(part) // 4
                    row.append(k)
                    numbers.append((s, length, zlib.crc32(part), n, task, seen[length]))
                    seen[length] += 1
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                held += n
                if held > TOGETHER:
                    yield pieces()
                    row, numbers, ids, held = [], [], [], 0
            yield pieces()

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, _task bigint, _local bigint"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


class _Open:
    """Open windows by remaining capacity: runs of window numbers, and a segment tree of how many there are."""

    def __init__(self, size: int):
        self.runs: list[list[list[int]]] = [[] for _ in range(size + 1)]  # capacity -> [first window, number]
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def _add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.tree[node] += n
            node >>= 1

    def put(self, capacity: int, first: int, n: int) -> None:
        if capacity and n:
            self.runs[capacity].append([first, n])
            self._add(capacity, n)

    def take(self, capacity: int, n: int):
        """Up to n windows of that capacity that are numbered in a row: (first, number)."""
        run = self.runs[capacity][0]
        first, got = run[0], min(n, run[1])
        run[0], run[1] = first + got, run[1] - got
        if not run[1]:
            self.runs[capacity].pop(0)
        self._add(capacity, -got)
        return first, got

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that an open window has."""
        node = self.leaves + least
        if self.tree[node]:
            return least
        while node > 1 and not (node % 2 == 0 and self.tree[node + 1]):
            node >>= 1
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Moves (length, first rank, number, first window, offset): piece `first rank + i` of that length goes into window
    `first window + i` at that offset. Lengths come in falling order; each piece goes into the tightest open window."""
    open_windows, windows, moves = _Open(size), 0, []

    def fill(length: int, rank: int, first: int, n: int, capacity: int, each: int) -> int:
        for k in range(each):
            moves.append((length, rank + k * n, n, first, size - capacity + k * length))
        open_windows.put(capacity - each * length, first, n)
        return rank + each * n

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = open_windows.tightest(length)
            # the window just used stays the tightest while the length fits, so it takes `each` pieces before another does
            each = min((size if capacity is None else capacity) // length, left)
            if capacity is None:
                first, n = windows, left // each
                windows += n
            else:
                first, n = open_windows.take(capacity, left // each)
            rank = fill(length, rank, first, n, size if capacity is None else capacity, each)
            left = counts[length] - rank
    return moves


def place(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """`pieces` (what `cut` gives, as a written table: it is read three times) with `sequence_id` and `offset`.

    A piece's rank among all of its length is its place in its task and the number of such pieces in the tasks before, so
    pieces are neither sorted nor sent to Python again; the moves of best fit are one row per length."""
    spark = pieces.sparkSession
    per_task = pieces.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    base = materialize(per_task.select("_task", "length", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "bases")
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `size` rows
    moves: dict[int, list] = {}
    for length, rank, _, first, offset in sorted(best_fit(counts, size)):
        moves.setdefault(length, []).append((rank, first, offset))
    plan = spark.createDataFrame([(k, *map(list, zip(*v))) for k, v in moves.items()], "length bigint, _ranks array<bigint>, _firsts array<bigint>, _offsets array<bigint>")
    ranked = join_checked(pieces, base.drop("_n"), ["_task", "length"], "inner").join(F.broadcast(plan), "length")
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_local"))
    ranked = ranked.withColumn("_move", F.size(F.filter("_ranks", lambda x: x <= F.col("_rank"))))  # ranks are rising
    sequence = F.element_at("_firsts", F.col("_move")) + F.col("_rank") - F.element_at("_ranks", F.col("_move"))
    columns = [c for c in pieces.columns if c not in ("_task", "_local")]
    return ranked.select(*columns, sequence.alias("sequence_id"), F.element_at("_offsets", F.col("_move")).alias("offset"))


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document of `docs` in sequences of at most `size` tokens; one row per piece: id, `start`, `length`,
    `ids_crc32`, `doc_tokens`, (`ids`,) `sequence_id`, `offset`.

    A null text counts as empty and is one piece of one token (`end_id`); a null id stays null; repeated rows are packed
    each; an empty table gives no rows; texts of any length are cut whole; other columns are not read. Pieces of one length
    are interchangeable: ties go by the order in which they were cut.
    """
    return place(materialize(cut(docs, vocabulary, size, end_id, id_col, text_col, with_ids), "pieces"), size)
