"""Document fingerprints by winnowing: the least hash of every window of k-grams, with its position.

Every k code points give a rolling hash; every `window` consecutive hashes give their least, of equal ones the last.
Two texts that share `k + window - 1` code points in a row thus share a fingerprint, at known positions in both.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltable.llm.joins import unused
from voltable.llm.vocab import slices

#: Code points of a k-gram, and k-grams of a window: shared passages of 64 code points are found for certain.
GRAM, WINDOW = 20, 45
#: Code points that are worked on together: few enough for the arrays to stay in a processor's cache.
TOGETHER = 100_000
#: Base of the rolling hash (odd, so that its powers can be inverted modulo 2^64).
_BASE = 0x9E3779B97F4A7C15
MARKS = "array<struct<position: int, hash: bigint>>"


@lru_cache(maxsize=4)
def _power_table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(base: int, n: int) -> np.ndarray:
    return _power_table(base, 1 << n.bit_length())[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def winnow(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the positions (code points, rising) and hashes (signed 64-bit) of its fingerprint.

    A text shorter than a k-gram is one k-gram; one with fewer k-grams than a window is one window; an empty one has none.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int32), np.zeros(0, np.int64))] * len(texts)
    rows = [i for i, t in enumerate(texts) if t]
    if not rows:
        return out
    chars = np.array([len(texts[i]) for i in rows], np.int64)
    room = np.maximum(chars, gram) + window  # a gap after each text, so that no window reaches into the next
    starts = np.cumsum(room) - room
    size = int(room.sum())
    codes = np.zeros(size, np.uint64)
    flat = np.frombuffer("".join(texts[i] for i in rows).encode("utf-32-le"), np.uint32)
    codes[np.arange(len(flat)) + np.repeat(starts - (np.cumsum(chars) - chars), chars)] = flat + np.uint32(1)

    # prefix sums of code times power; a difference divided by its first power is the k-gram's polynomial
    codes *= _powers(_BASE, size)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(codes, out=sums[1:])
    hashes = np.zeros(size, np.uint64)
    np.subtract(sums[gram:], sums[:-gram], out=hashes[: size + 1 - gram])
    hashes *= _powers(pow(_BASE, -1, 1 << 64), size)
    hashes = _mixed(hashes)

    # the order of k-grams in a window: by the upper bits of the hash, then the later position first
    bits = np.uint64(max(24, size.bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    keys = (hashes & ~mask) | (mask - np.arange(size, dtype=np.uint64))
    grams = np.maximum(chars - gram + 1, 1)
    edge = np.zeros(size + 1, np.int8)
    edge[starts] += 1
    edge[starts + grams] -= 1
    keys[np.cumsum(edge[:-1]) == 0] = np.uint64(0xFFFFFFFFFFFFFFFF)  # starts of no k-gram
    span = 1
    while 2 * span <= window:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    if span < window:
        keys = np.minimum(keys[: span - window], keys[window - span:])
    windows = np.maximum(grams - window + 1, 1)
    at = np.arange(int(windows.sum())) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    chosen = (mask - (keys[at] & mask)).astype(np.int64)
    fresh = np.ones(len(chosen), bool)
    fresh[1:] = chosen[1:] != chosen[:-1]
    chosen, owner = chosen[fresh], np.repeat(np.arange(len(rows)), windows)[fresh]
    ends = np.searchsorted(owner, np.arange(len(rows) + 1))
    for k, i in enumerate(rows):
        own = chosen[ends[k]: ends[k + 1]]
        out[i] = (own - starts[k]).astype(np.int32), hashes[own].view(np.int64)
    return out


def _portions(texts: list[str]):
    """(first, end) of stretches of about TOGETHER code points."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def _marks(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) for p, _ in found)])
    fields = [pa.array(np.concatenate([np.zeros(0, t), *(x[k] for x in found)]), kind) for k, (t, kind) in enumerate([(np.int32, pa.int32()), (np.int64, pa.int64())])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["position", "hash"]))


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id and `marks` (position and hash, by position).

    A null text counts as empty and has no marks; a null id stays null; repeated rows are done each; an empty table gives
    no rows; texts of any length are done whole; other columns are not read. No shuffle.
    """

    def run(batches):
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            for first, end in _portions(texts):
                yield pa.RecordBatch.from_arrays([b.column(0)[first:end], _marks(winnow(texts[first:end], gram, window))], names=[id_col, "marks"])

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, marks {MARKS}")


def likeness(a: set[int], b: set[int]) -> float:
    """Shared hashes out of all; 1 for two empty ones."""
    return len(a & b) / len(a | b) if a or b else 1.0


def compared(docs: DataFrame, others: list[str], keep: tuple[str, ...] = (), gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, the columns of `keep`, `marks` of its text, and for each text column `x` of `others`
    `x_marks` and `x_near`, its fingerprint's likeness (0 to 1) to the text's. Nulls, repeated rows, empty tables and other
    columns as for `fingerprints`."""
    last = 2 + len(others)  # the first of the kept columns

    def run(batches):
        for b in slices(batches):
            columns = [b.column(1 + k).to_pylist() for k in range(1 + len(others))]
            every = list(dict.fromkeys(t for texts in columns for t in texts))  # a text that is another's neighbour is done once
            found = {t: mark for first, end in _portions(every) for t, mark in zip(every[first:end], winnow(every[first:end], gram, window))}
            sets = {t: set(h.tolist()) for t, (_, h) in found.items()}
            arrays = [b.column(0), *b.columns[last:], _marks([found[t] for t in columns[0]])]
            for texts in columns[1:]:
                near = [likeness(sets[t], sets[x]) for t, x in zip(columns[0], texts)]
                arrays += [_marks([found[t] for t in texts]), pa.array(near, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [id_col, *keep, "marks", *(f"{x}{end}" for x in others for end in ("_marks", "_near"))]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep)] + [f"marks {MARKS}"] + [f"`{x}_marks` {MARKS}, `{x}_near` double" for x in others]
    rows = docs.select(F.col(id_col), *(F.coalesce(F.col(c), F.lit("")).alias(f"_{k}") for k, c in enumerate([text_col, *others])), *(F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)))
    return rows.mapInArrow(run, ", ".join(kinds))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the rising `bounds` are at most `key`, by halving."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    edges = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    return F.aggregate(F.lit(steps), F.lit(0), lambda n, s: F.when((n + s <= len(bounds)) & (F.get(edges, n + s - 1) <= key), n + s).otherwise(n)) if bounds else F.lit(0)


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, `text` and `next_text`: the text of the document with the next smaller id, for the smallest that of the largest.

    Documents are dealt to ranges of ids, so each text is shuffled once and no task holds more than its ranges; the first
    document of a range is a guest at the end of the one before. Rows that share an id follow each other by text. Null
    texts count as empty; rows with a null id have no place in the order and are followed by an empty text.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = rows.where("_id IS NOT NULL")
    ranges = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / ranges for k in range(1, ranges)]
    cuts = placed.agg(F.percentile_approx("_id", shares, 20 * ranges)).first()[0] or []
    bounds = sorted(set(cuts))
    bucket = _bucket(F.col("_id"), bounds)
    first = {r["b"]: r["first"] for r in placed.groupBy(bucket.alias("b")).agg(F.max("_id").alias("first")).collect()}  # a row per range
    used = sorted(first)
    host = {b: used[(k + 1) % len(used)] for k, b in enumerate(used)}  # whose last document the first of b follows
    n = len(bounds) + 1
    firsts, hosts = (F.lit([own.get(b, -1) for b in range(n)]) for own in (first, host))
    home = placed.withColumn("_bucket", bucket)
    guest = F.when(F.col("_id") == F.get(firsts, F.col("_bucket")), F.get(hosts, F.col("_bucket")))
    seats = F.filter(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("g")), F.struct(guest.alias("b"), F.lit(True).alias("g"))), lambda s: s.getField("b").isNotNull())
    seated = home.select("_id", "text", F.explode(seats).alias("_seat")).select("_id", "text", F.col("_seat.b").alias("_bucket"), F.col("_seat.g").alias("_guest"))
    order = Window.partitionBy("_bucket").orderBy("_guest", F.col("_id").desc(), "text")
    out = seated.withColumn("next_text", F.lead("text").over(order)).where("NOT _guest")
    alone = rows.where("_id IS NULL").withColumn("next_text", F.lit(""))
    return out.select(F.col("_id").alias(id_col), "text", "next_text").unionByName(alone.select(F.col("_id").alias(id_col), "text", "next_text"))
