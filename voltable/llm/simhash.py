"""SimHash near-deduplication with BK-trees.

Fingerprints are dealt to shards so that any two that are to be linked meet in one at least: for exact Hamming search by
every two of six blocks of bits (four flipped bits leave two blocks whole), for similarity search by bands of min-wise
hashes of the shingles. Each shard holds its fingerprints in a BK-tree, where a child hangs on its parent by their Hamming
distance, and a search follows only edges within the radius. A shard with very many fingerprints becomes several trees of
bounded size, and every part of it is searched in every tree. In similarity search the trees only propose: two texts are
linked if the Jaccard similarity of their shingle sets says so. A shard passes on a spanning forest of its links, so a group
of copies never yields all its pairs; the forests are joined to components by repeated star contraction.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltable.llm import bloom
from voltable.llm.joins import join_checked
from voltable.plans.lineage import materialize

#: Distinct fingerprints in a tree at most (up to the chance of an uneven deal).
TREE = 1024
#: Bytes of shingle sets in a tree at most, likewise; a single longer text is a tree of its own.
TREE_BYTES = 16 << 20
#: Radius of the exact search, and blocks into which it cuts 64 bits: two of them stay whole.
RADIUS, BLOCKS = 4, 6
#: Bits of the fingerprint for similarity search, bands of min-wise hashes and hashes in a band. Pairs with a Jaccard
#: similarity of 0.8 share a band with probability 0.997.
WIDE, BANDS, IN_BAND = 1024, 8, 3

#: Standard deviations by which the radius of a proposed pair exceeds the bits expected at the similarity.
MARGIN = 4.0

_SEED = 42
_FACTORS = np.random.default_rng(_SEED).integers(1 << 62, size=(BANDS, IN_BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WIDENING = np.random.default_rng(_SEED + 1).integers(1 << 62, size=(1, WIDE // 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = [(p, q) for p, q in combinations(range(BLOCKS), 2)]


def _hashes(text: str, k: int) -> np.ndarray:
    """XXH64 of the word shingles (repeats included), big-endian bytes: (shingles, 8)."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]]
    n = max(1, len(words) - k + 1)
    spans = list(map(slice, starts[:n].tolist(), (ends[min(k, len(words)) - 1:] - 1).tolist()))
    shingles = list(map(joined.__getitem__, spans))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(s, _SEED) for s in shingles]), np.uint8).reshape(-1, 8)


def _widened(hashes: np.ndarray) -> np.ndarray:
    """WIDE well-mixed bits of each hash, as bytes."""
    mixed = hashes.copy().view(">u8").astype(np.uint64) * _WIDENING
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.uint8)


def _majority(hashes: np.ndarray, wide: bool = False) -> bytes:
    """Bits that are set in over half of the hashes; none of no hashes."""
    n, count = len(hashes), np.zeros(WIDE if wide else 64, np.int64)
    for at in range(0, n, 2048):
        block = hashes[at: at + 2048]
        count += np.unpackbits(_widened(block) if wide else block, axis=1).sum(0, dtype=np.uint16)
    return np.packbits(count * 2 > n).tobytes()


def _block_keys(fingerprint: bytes) -> list[int]:
    value = int.from_bytes(fingerprint, "big")
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    block = [(value >> a) & ((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
    return [(j << 40) | (block[p] << 20) | block[q] for j, (p, q) in enumerate(_MASKS)]


def _band_keys(hashes: np.ndarray) -> list[int]:
    """Equal for two texts in a band if all its min-wise hashes are equal."""
    if not len(hashes):
        return list(range(BANDS))
    first = np.unique(hashes.copy().view(">u8").astype(np.uint64))
    keys = []
    for band, factors in enumerate(_FACTORS):
        key = b"%d" % band
        for a in factors:
            mixed = first * a
            key += (mixed ^ (mixed >> np.uint64(29))).min().tobytes()
        keys.append(int.from_bytes(xxhash.xxh64_digest(key), "big", signed=True))
    return keys


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """The hashes in order, each once."""
    return np.unique(hashes.copy().view(">u8")).view(np.uint8).reshape(-1, 8)


def _wide_node(distinct: np.ndarray) -> bytes:
    """Wide fingerprint of a set of hashes, and a digest of the set, so that only equal sets are one node."""
    return _majority(distinct, True) + xxhash.xxh3_128_digest(distinct.tobytes())


def fingerprints(docs: DataFrame, shingle: int, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, `_fp` (big-endian bytes: 8, or if `wide` WIDE bits of the distinct shingles and a digest of them), `_keys`
    (shards) of every whole text."""

    def run(batches):
        for b in batches:
            fps, keys = [], []
            for text in b.column(1).to_pylist():
                h = _distinct(_hashes(text, shingle)) if wide else _hashes(text, shingle)
                fps.append(_wide_node(h) if wide else _majority(h))
                keys.append(_band_keys(h) if wide else _block_keys(fps[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["_id", "_fp", "_keys"])

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, _fp binary, _keys array<bigint>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int, text_col: str = "text") -> DataFrame:
    """`_digest`, `_set` (distinct shingle hashes in order, big-endian): the sets whose digest `wanted` (a written table) has, each once."""

    def run(batches):
        for b in batches:
            sets = [_distinct(_hashes(text, shingle)).tobytes() for text in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["_digest", "_set"])

    found = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(run, "_digest binary, _set binary")
    # most sets nobody asks for; they go before anything is shuffled
    _, maybe = bloom.ask(found, "_digest", materialize(bloom.filter_of(wanted, "_digest"), "filter"))
    return join_checked(maybe, wanted, "_digest", "left_semi").groupBy("_digest").agg(F.any_value("_set").alias("_set"))


class BKTree:
    """Children are keyed by their distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        number = len(self.values)
        at = 0
        while number:
            d = (value ^ self.values[at]).bit_count()
            child = self.children[at].get(d)
            if child is None:
                self.children[at][d] = number
                break
            at = child
        self.values.append(value)
        self.children.append({})
        return number

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the values at a distance of at most `radius`: below a node at distance d they hang on edges d +- radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            todo += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]
        return found


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted) have that Jaccard similarity at least; empty ones are equal."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _forest(parts: list[int], fps: list[bytes], radius: int, sets: list[bytes] | None = None, similarity: float = 0.0) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links in a cell: one part searched in its own tree, or a part in the other's tree. With
    `sets` (of shingle hashes), what the tree finds is a link only if the sets have the similarity."""
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, tree, inside = [], BKTree(), []
    lower, alike = min(parts), min(parts) == max(parts)
    value = [int.from_bytes(f if sets is None else f[: WIDE // 8], "big") for f in fps]
    hashes = None if sets is None else [np.frombuffer(s, ">u8").astype(np.uint64) for s in sets]

    def search(x: int) -> None:
        for n in tree.within(value[x], radius):
            a, b = root(x), root(inside[n])
            if a != b and (hashes is None or _similar(hashes[x], hashes[inside[n]], similarity)):
                parent[a] = b
                links.append((fps[x], fps[inside[n]]))

    for x in sorted(range(len(fps)), key=parts.__getitem__):
        if alike or parts[x] > lower:
            search(x)
        if alike or parts[x] == lower:
            tree.add(value[x])
            inside.append(x)
    return links


def links(nodes: DataFrame, radius: int, similarity: float | None = None, sets_of=None) -> DataFrame:
    """(`_a`, `_b`): links between distinct fingerprints of `nodes` (a written table) that hold its groups together.

    With a `similarity` the fingerprints are wide, and `sets_of` gives the shingle sets of a written table of digests.
    """
    exact = similarity is not None
    shards = nodes.select(F.explode("_keys").alias("_key")).groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1")
    if not exact:
        shards = materialize(shards, "shards")
        members = nodes.select("_fp", F.explode("_keys").alias("_key")).join(shards, "_key")
        parts = F.ceil(F.col("_n") / TREE).cast("int")
    else:
        members = nodes.select("_fp", F.explode("_keys").alias("_key")).join(materialize(shards.select("_key"), "shards"), "_key")
        members = materialize(members.withColumn("_digest", F.expr(f"substring(_fp, {WIDE // 8 + 1})")), "members")
        sets = materialize(sets_of(materialize(members.select("_digest").distinct(), "wanted")), "sets")
        weights = members.join(sets.select("_digest", F.octet_length("_set").alias("_bytes")), "_digest")
        shards = materialize(weights.groupBy("_key").agg(F.count("*").alias("_n"), F.sum("_bytes").alias("_bytes")), "weights")
        members = members.join(shards, "_key")
        parts = F.least(F.greatest(F.ceil(F.col("_n") / TREE), F.ceil(F.col("_bytes") / TREE_BYTES)), F.col("_n")).cast("int")
    members = members.select("_key", "_fp", *(["_digest"] if exact else []), parts.alias("_parts"), F.pmod(F.xxhash64("_fp"), parts).cast("int").alias("_part"))
    cells = members.select("_key", "_fp", *(["_digest"] if exact else []), "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
    if exact:
        cells = cells.join(sets, "_digest")
    cells = cells.groupBy("_key", F.least("_part", "_other").alias("_tree"), F.greatest("_part", "_other").alias("_asked"))
    columns = ["_part", "_fp", *(["_set"] if exact else [])]
    cells = cells.agg(F.collect_list(F.struct(*columns)).alias("_members")).where(F.size("_members") > 1)

    def run(batches):
        for b in batches:
            out = []
            for cell in b.column(0):  # one cell at a time becomes Python objects
                of = cell.values
                found = [of.field(c).to_pylist() for c in columns]
                out += _forest(found[0], found[1], radius, *([found[2], similarity] if exact else []))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["_a", "_b"])

    return cells.select("_members").mapInArrow(run, "_a binary, _b binary").distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of star contraction over edges (`_a` > `_b`): every node's neighbours are tied to its least neighbour,
    the larger ones in a large step, the smaller ones and the node itself in a small step."""
    sides = edges.unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))) if large else edges
    least = materialize(sides.groupBy("_a").agg(F.min("_b").alias("_m")).select(F.col("_a").alias("_of"), F.least("_a", "_m").alias("_m")), "least")
    met = sides.join(least, F.col("_a") == F.col("_of"))
    if large:
        out = met.where("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
    else:
        out = met.where("_b <> _m").select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).unionByName(least.select(F.col("_of").alias("_a"), F.col("_m").alias("_b")))
    return materialize(out.distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(`_a`, `_root`): every node that is linked to a smaller one, and the least node it can reach.

    Each round has a large and a small star step; it ends when a round changes nothing, after about as many rounds as the
    longest path has binary digits.
    """
    now = materialize(edges.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).where("_a <> _b").distinct(), "edges")
    mark = [F.count("*"), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))]
    before, seen = None, now.agg(*mark).first()
    while before != seen:
        now = _star(_star(now, large=True), large=False)
        before, seen = seen, now.agg(*mark).first()
    return now.withColumnRenamed("_b", "_root")


def classes(docs: DataFrame, shingle: int = 4, radius: int = RADIUS, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, `fingerprint` (hex), `component_id`: the smallest id reachable over links.

    Words are what ASCII white space separates, A-Z lower-cased; a text with fewer words than a shingle is one shingle, and
    one without words (also a null text) has fingerprint zero and is linked like any other. Fingerprints at `radius` or
    fewer differing bits are linked; up to four bits of 64 every link is found. With a `similarity`, fingerprints are wide and
    of distinct shingles (`fingerprint` ends with a digest of them), and of those within `radius` the texts are linked whose
    shingle sets have at least that Jaccard similarity. Rows of one fingerprint count as one in
    the search. A null id is never a `component_id` unless all ids of the component are null. Other columns are not read.
    """
    wide = similarity is not None
    if not wide and radius > RADIUS:
        raise ValueError(f"blocks of 64 bits find all links up to radius {RADIUS}; use wide fingerprints")
    of_docs = materialize(fingerprints(docs, shingle, wide, id_col, text_col), "fingerprints")
    nodes = materialize(of_docs.groupBy("_fp").agg(F.min("_id").alias("_least"), F.any_value("_keys").alias("_keys")), "nodes")
    roots = components(links(nodes, radius, similarity, lambda wanted: shingle_sets(docs, wanted, shingle, text_col)))
    named = materialize(nodes.select("_fp", "_least").join(roots, F.col("_fp") == F.col("_a"), "left").select("_fp", "_least", F.coalesce("_root", "_fp").alias("_root")), "roots")
    smallest = materialize(named.groupBy("_root").agg(F.min("_least").alias("component_id")), "smallest")
    named = materialize(named.join(smallest, "_root").select(F.col("_fp").alias("_of"), "component_id"), "classes")
    joined = of_docs.select("_id", "_fp").join(named, F.col("_fp") == F.col("_of"))
    return joined.select(F.col("_id").alias(id_col), F.lower(F.hex("_fp")).alias("fingerprint"), "component_id")


def radius_for(similarity: float, margin: float = 1.0) -> int:
    """Bits in which wide fingerprints of texts with that Jaccard similarity differ, and `margin` standard deviations more, for
    pairs that differ by chance in more bits than expected."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(WIDE * p + margin * np.sqrt(WIDE * p * (1 - p)))


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each group of near copies the one with the smallest id.

    Similarity is the Jaccard similarity of the sets of shingles. Pairs are proposed by wide fingerprints, with a radius of
    `MARGIN` standard deviations above that of the similarity, and checked on the sets. Rows with a null id stay, and rows that repeat an
    id share its fate.
    """
    found = classes(docs, shingle, radius_for(similarity, MARGIN), similarity, id_col, text_col)
    gone = materialize(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "gone")
    return join_checked(docs, gone, id_col, "left_anti")
