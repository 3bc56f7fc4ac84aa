import numpy as np

from voltable.llm import nearest as ann


def brute(rows, queries, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0}
    out = {}
    for i, v in queries:
        if i in ok:
            score = sorted((-round(float(ok[i] @ w / (np.linalg.norm(ok[i]) * np.linalg.norm(w))), 12), j) for j, w in ok.items() if j != i)
            out[i] = [(j, -s) for s, j in score[:k]]
    return out


def test_recall_scores_and_order(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 128)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 24))
    v = (centres[rng.integers(20, size=1500)] + 0.4 * rng.standard_normal((1500, 24))).astype(np.float32)
    v[200:700] = v[3]  # a third of all rows are one vector
    rows = [(i, [float(x) for x in v[i]], i % 7) for i in range(1500)]
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] + [1.0] * 23, 1), (2003, [None] + [1.0] * 23, 1), (None, [1.0] * 24, 1), (2004, [float("inf")] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, _rank int").repartition(5)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute([r[:2] for r in rows], [r[:2] for r in rows if r[0] is not None and r[0] % 20 == 0], 5)
    assert set(got) == set(want)
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and q not in [i for _, i, _ in own]
        assert all(abs(float(v[q].astype(float) @ v[i].astype(float) / (np.linalg.norm(v[q].astype(float)) * np.linalg.norm(v[i].astype(float)))) - s) < 1e-12 for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for i, _ in want[q]})
    assert hits >= 0.95 * 5 * len(want)
    assert [i for _, i, _ in got[300]] == [3, 200, 201, 202, 203]  # ties go to the smaller id


def test_few_candidates_and_empty(spark):
    schema = "vec_id bigint, embedding array<double>"
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1e-300, 1e-300]), (4, [1.0])], schema)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest(df, df, k=5).collect())
    half = round(0.5 ** 0.5, 9)
    assert got == [(1, 1, 3, half), (1, 2, 2, 0.0), (2, 1, 3, half), (2, 2, 1, 0.0), (3, 1, 1, half), (3, 2, 2, half)]
    empty = spark.createDataFrame([], schema)
    assert ann.nearest(empty, empty).count() == 0 and ann.nearest(df, empty).count() == 0


def test_quantile():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(ann.chi_square_quantile(0.5, 2) - 1.386) < 1e-3
