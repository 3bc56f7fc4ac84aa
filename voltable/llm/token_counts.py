"""Token counts of whole texts without building their ids (rank-synchronous array merging)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltable.llm.ragged import Merger
from voltable.llm.vocab import Memory, load, slices


@lru_cache(maxsize=2)
def _counting(path: str) -> Memory:
    vocabulary = load(path)
    return Memory(vocabulary, Merger(vocabulary).count)


def _count(memory: Memory, texts: list[str]) -> list[int]:
    flat: list[int] = []
    ends, special = [], []
    for text in texts:
        segments = memory.vocabulary.segments(text)
        for s in segments[::2]:
            flat += memory.numbers(s)
        ends.append(len(flat))
        special.append(len(segments) // 2)
    memory.settle(sum)
    sums = np.r_[0, np.cumsum(np.array(memory.value, np.int64)[flat] if flat else np.zeros(0, np.int64))]
    memory.trim()
    return (sums[ends] - sums[[0, *ends[:-1]]] + np.array(special)).tolist() if texts else []


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of `docs`: id, `n_bytes` (UTF-8), `n_tokens`, `over_limit` (n_tokens > limit).

    `vocabulary` is the path of a byte-level BPE file. Special strings inside a text count as one token, as the
    tokenizer's default does. A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows
    are counted each; other columns are not read. Texts of any length are counted whole. No shuffle.
    """

    def run(batches):
        memory = _counting(vocabulary)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            n = _count(memory, texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
