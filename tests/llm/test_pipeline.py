import random
import zlib

import corpus_pipeline
import numpy as np
from __spark_entry__ import oracle_sql, queries


def test_stages_on_a_small_corpus(spark, make, hard, tmp_path):
    rnd = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "bdgklmn" for b in "aeiou" for c in ("r", "st", "nd", "l")]
    bodies = {100 + i: " ".join(rnd.choices(vocabulary, k=150)) for i in range(20)}
    rows = [*bodies.items(), (200, bodies[100] + " \n"), (201, bodies[101].replace("bar", "bur", 1) + " end"), (202, bodies[102] + " write to a.b@mail.example now"), (203, "123 456"), (204, None), (205, "")]
    folder = str(tmp_path)
    make(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert name == "packing" or docs.columns == before
        seen[name] = docs
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert ids["language"] == set(bodies) | {200, 201, 202}
    assert ids["exact_dedup"] == ids["language"] - {100}  # 200 is the longer one
    assert ids["near_dedup"] == ids["exact_dedup"] - {201, 202}
    assert ids["pii"] == ids["packing"] == ids["near_dedup"]
    assert seen["pii"].where("n_chars <> length(text)").count() == 0
    tokens = seen["packing"].groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in tokens) <= 1024
    assert corpus_pipeline.run(spark, folder).count() == seen["packing"].count()


def test_every_query_is_registered():
    names = [n for n in queries() if n.startswith("op") or n == "pipeline"]
    assert {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 14)), "pipeline"} and len(names) == 14
    assert set(oracle_sql()) <= set(queries())


def test_packed_sequences_hold_their_tokens(spark, make, tmp_path):
    pieces = corpus_pipeline.pack(spark, make([(1, "alpha beta gamma"), (2, None), (3, "word " * 2000)]), str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3} and all(len(r.ids) == r.length for r in pieces)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in pieces)


def test_stages_on_hard_rows_and_on_none(spark, make, hard, tmp_path):
    """Null texts and ids, repeated rows, a very long text and columns with clashing names through all stages; an empty table."""
    rows = hard + [(20 + i, f"the report of the day {i} was read by all and by nobody else at {i}", "en") for i in range(30)]
    for folder, docs in ((f"{tmp_path}/hard", make(rows)), (f"{tmp_path}/none", make(rows).where("doc_id < 0"))):
        docs.write.parquet(f"{folder}/documents.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, now, folder)
            assert after.columns == docs.columns
            after.write.parquet(f"{folder}/{name}")
            now = spark.read.parquet(f"{folder}/{name}")
        kept = {r.doc_id: r.text for r in now.collect()}
        packed = corpus_pipeline.pack(spark, now, folder).collect()
        assert {r.doc_id for r in packed} == set(kept)
        if folder.endswith("none"):
            assert not kept
        else:
            assert {7, None, *range(20, 50)} <= set(kept) and not {1, 2, 3} & set(kept) and len({4, 5, 6} & set(kept)) == 1
            assert kept[7] == dict(hard)[7] and sum(r.doc_tokens for r in packed if r.start == 0) == sum(len(r.ids) for r in packed)
