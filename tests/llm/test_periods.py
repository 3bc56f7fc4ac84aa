"""Periodic runs and document fingerprints against plain versions."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from voltable.llm import periodic_runs, queries, winnowing

WHITE = "\t\n\x0b\x0c\r "


def words_of(text):
    for c in WHITE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_runs(w, least, power):
    found = []
    for p in range(1, len(w) // power + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            own = w[i: i + length]
            if length >= max(least, power * p) and not any(own[q:] == own[:-q] for q in range(1, p)):
                found.append((i, length, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_lyndon(w, falling):
    w = [-x for x in w] if falling else w
    return [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) - i for i in range(len(w))]


def some_words(seed):
    r = random.Random(seed)
    n, k = r.randint(0, 45), r.randint(1, 4)
    w = [r.randrange(k) for _ in range(n)]
    if n and r.random() < 0.6:
        a, p = r.randrange(n), r.randint(1, 5)
        w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
    return w


@pytest.mark.parametrize("power,least", [(4, 6), (3, 3), (2, 2)])
def test_runs_of_words(power, least):
    for seed in range(600):
        w = some_words(seed)
        for falling in (False, True):
            assert periodic_runs.lyndon_array(w, falling) == plain_lyndon(w, falling)
        got = periodic_runs.runs_of(np.array(w, np.int64), np.array([len(w)]), least, power)
        assert list(zip(*(x.tolist() for x in got))) == plain_runs(w, least, power)


def test_runs_end_with_their_text():
    one, two = [1, 2] * 4, [1, 2] * 5
    got = periodic_runs.runs_of(np.array(one + [] + two), np.array([8, 8, 18]))
    assert list(zip(*(x.tolist() for x in got))) == [(0, 8, 2), (8, 10, 2)]


def planted(i, text):
    w = words_of(text or "")
    if i is None or not w:
        return w
    h, n = zlib.crc32(str(i).encode()), len(w)
    if h % 10:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_periodic_runs_query(spark, make, hard, tmp_path):
    ten = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    r = random.Random(4)
    rows = hard + [(i, " ".join(r.choice("a b c d e".split()) + WHITE[k % 6] * (k % 3) for k in range(r.randint(0, 60)))) for i in ten] + [(90, "x x x x x x\x0by\x0by\x0by z"), (91, "a b " * 5)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for i, text in rows:
        w = planted(i, text)
        found = plain_runs(w, 6, 4) if len(w) < 5000 else []
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_long_periodic_text_takes_time_in_proportion():
    w = np.array([k % 7 for k in range(300_000)])
    assert [x.tolist() for x in periodic_runs.runs_of(w, np.array([len(w)]))] == [[0], [300_000], [7]]


def plain_marks(text, gram, window):
    base, full = winnowing._BASE, 1 << 64
    codes = [ord(c) + 1 for c in text] + [0] * (gram - len(text))
    polynomial = [sum(codes[i + j] * pow(base, j, full) for j in range(gram)) % full for i in range(len(codes) - gram + 1)]
    hashes = winnowing._mixed(np.array(polynomial, np.uint64)).tolist()
    marks = []
    for s in range(max(len(hashes) - window + 1, 1) if text else 0):
        own = hashes[s: s + window]
        at = s + max(k for k, h in enumerate(own) if h == min(own))
        if not marks or marks[-1][0] != at:
            marks.append((at, hashes[at] - full * (hashes[at] >> 63)))
    return marks


@pytest.mark.parametrize("gram,window", [(20, 45), (5, 4), (3, 1)])
def test_winnowing(gram, window):
    r = random.Random(3)
    texts = ["".join(r.choice("ab é東👍") for _ in range(r.randint(0, 90))) for _ in range(60)] + ["a" * 99, "", "\x00", "\x00\x00"]
    assert [list(zip(p.tolist(), h.tolist())) for p, h in winnowing.winnow(texts, gram, window)] == [plain_marks(t, gram, window) for t in texts]


def test_shared_passages_share_a_mark():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij ") for _ in range(500))
    for _ in range(50):
        passage, a, b = word()[: winnowing.GRAM + winnowing.WINDOW - 1], word(), word()
        (p, h), (q, g) = winnowing.winnow([a + passage + b, b + passage + a])
        shared = {(x - 500, y) for x, y in zip(p.tolist(), h.tolist())} & {(x - 500, y) for x, y in zip(q.tolist(), g.tolist())}
        assert any(0 <= x < winnowing.WINDOW for x, _ in shared)


def test_fingerprints_of_hard_rows(make, hard):
    got = [(r.doc_id, [tuple(m) for m in r.marks]) for r in winnowing.fingerprints(make(hard)).collect()]
    want = [(i, [(p, h) for p, h in zip(*(x.tolist() for x in winnowing.winnow([t or ""])[0]))]) for i, t in hard]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert winnowing.fingerprints(make([(1, "x")]).where("doc_id < 0")).count() == 0


def test_fingerprints_query(spark, make, hard, tmp_path):
    r = random.Random(8)
    rows = [x for x in hard if x[0] != 6] + [(20 + 3 * i, "".join(r.choice("abcd é👍") for _ in range(r.randint(0, 400)))) for i in range(120)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    ordered = sorted(((i, t or "") for i, t in rows if i is not None), reverse=True)
    follow = {i: ordered[(k + 1) % len(ordered)][1] for k, (i, _) in enumerate(ordered)}
    got = {x.doc_id: x for x in queries.op13_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    text_of = lambda marks: ",".join(f"{p}:{h & (1 << 64) - 1:x}" for p, h in marks)
    for i, text in rows:
        text, after, x = text or "", follow.get(i, ""), got[i]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert (x.n_chars, x.edited_sha256) == (len(text), sha(edited))
        if len(text) + len(after) < 5000:
            own, changed, other = ([(p, h) for p, h in zip(*(v.tolist() for v in m))] for m in winnowing.winnow([text, edited, after]))
            assert (x.fingerprint, x.edited_fingerprint) == (text_of(own), text_of(changed))
            near = lambda a, b: len({h for _, h in a} & {h for _, h in b}) / len({h for _, h in a} | {h for _, h in b}) if a or b else 1.0
            assert (x.near_edited, x.near_next) == (near(own, changed), near(own, other))


def test_one_and_no_document(spark, make, tmp_path):
    make([(7, "alone with itself")]).write.parquet(f"{tmp_path}/one/documents.parquet")
    make([(7, "x")]).where("doc_id < 0").write.parquet(f"{tmp_path}/none/documents.parquet")
    (row,) = queries.op13_fingerprints(spark, f"{tmp_path}/one").collect()
    assert (row.n_chars, row.near_next, row.edited_sha256) == (17, 1.0, sha("alone witalone wi"[:9] + "alone wi"))
    assert queries.op13_fingerprints(spark, f"{tmp_path}/none").count() == queries.op11_periodic_runs(spark, f"{tmp_path}/none").count() == 0
