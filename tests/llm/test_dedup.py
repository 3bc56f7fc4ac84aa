import hashlib
import random
import time
import re
from collections import Counter

import numpy as np
import xxhash

from voltable.llm import bloom, exact_dedup, line_dedup, simhash


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_groups(make, hard):
    rows = hard + [(20 + i, " same text" + " " * (i % 5)) for i in range(40)]
    want = Counter()
    for i, t in rows:
        group = [r for r in rows if bare(r[1]) == bare(t)]
        keep = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        want[i, keep, len(group), i == keep, hashlib.sha256(bare(t).encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.groups(make(rows)).collect())) == want
    docs = make(rows)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(bare(r.text) for r in kept.collect()) == Counter({bare(t): 1 for _, t in rows})
    assert {r.doc_id for r in kept.collect()} == {k[1] for k in want}


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).selectExpr("cast(id as string) as k")
    out, maybe = bloom.ask(keys, "k", bloom.filter_of(keys.where("k % 3 = 0"), "k"))
    assert maybe.where("k % 3 = 0").count() == 1000 and out.where("k % 3 = 0").count() == 0
    assert out.count() + maybe.count() == 3000 and maybe.count() < 1100
    twice = keys.unionAll(keys.where("k < 50"))
    assert bloom.ask(twice, "k", bloom.repeated(twice, "k"))[1].where("k < 50").count() == 100


def test_empty_tables(make):
    empty = make([(1, "x")]).where("doc_id < 0")
    assert exact_dedup.groups(empty).count() == exact_dedup.drop_copies(empty).count() == 0
    assert simhash.classes(empty).count() == simhash.drop_near_copies(empty).count() == line_dedup.drop_repeated_lines(empty).count() == 0


def plain_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= radius:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_classes(make, hard):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [r for r in hard if r[0] not in (None, 6)]
    for g in range(12):
        words = rnd.choices(vocabulary, k=rnd.choice([1, 3, 40, 300]))
        for c in range(rnd.randint(1, 6)):
            own = list(words)
            if c and len(own) > 3:
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append((100 + 10 * g + c, " ".join(own).title() if c % 2 else "  ".join(own)))
    got = simhash.classes(make(rows)).collect()
    fps = {i: plain_fingerprint(t, 4) for i, t in rows}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps and all(len(r.fingerprint) == 16 for r in got)
    assert {r.doc_id: r.component_id for r in got} == plain_components(fps, 4)


def test_links_of_one_crowded_shard(spark, monkeypatch):
    """More fingerprints in a shard than a tree holds: chains are still joined."""
    monkeypatch.setattr(simhash, "TREE", 16)
    rnd = random.Random(8)
    values = [0]
    while len(values) < 300:
        values.append(rnd.choice(values[-3:]) ^ (1 << rnd.randrange(24)) ^ (1 << rnd.randrange(24)))
    values = sorted(set(values))
    rows = [(bytearray(v.to_bytes(8, "big")), v, simhash._block_keys(v.to_bytes(8, "big"))) for v in values]
    from voltable.plans.lineage import materialize

    nodes = materialize(spark.createDataFrame(rows, "_fp binary, _least bigint, _keys array<bigint>"))
    roots = {int.from_bytes(r._a, "big"): int.from_bytes(r._root, "big") for r in simhash.components(simhash.links(nodes, 4)).collect()}
    assert {v: roots.get(v, v) for v in values} == plain_components({v: v for v in values}, 4)


def test_bk_tree_finds_what_a_scan_finds():
    rnd = random.Random(1)
    values = [rnd.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        for radius in (0, 1, 3):
            assert sorted(tree.within(q, radius)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= radius]


def test_near_copies_go_and_others_stay(make):
    rnd = random.Random(4)
    vocabulary = [f"term{i}" for i in range(3000)]
    rows, groups = [], {}
    for g in range(25):
        words = rnd.choices(vocabulary, k=rnd.randint(120, 400))
        for c in range(3 if g % 2 else 1):
            own = list(words)
            for at in range(c):  # each change touches five shingles
                own[(at + 1) * 37] = rnd.choice(vocabulary)
            rows.append((g * 10 + c, " ".join(own)))
            groups[g * 10 + c] = g * 10
    kept = {r.doc_id for r in simhash.drop_near_copies(make(rows)).collect()}
    assert kept == set(groups.values())


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(200, 201)]
    rows = [tuple(bytearray(v.to_bytes(8, "big")) for v in e) for e in edges]
    got = {int.from_bytes(r._a, "big"): int.from_bytes(r._root, "big") for r in simhash.components(spark.createDataFrame(rows, "_a binary, _b binary")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{x: 100 for x in range(101, 140)}, 201: 200}


def plain_lines(rows, run, words=50):
    seen, places = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        own = [(k, x.strip(" \t\r\x0b\f")) for k, x in enumerate((t or "").split("\n"))]
        own = [x for x in own if x[1]]
        gone = set()
        for size in range(1, run + 1):
            for s in range(len(own) - size + 1):
                window = tuple(x for _, x in own[s:s + size])
                if (size == run or sum(len(x.split()) for x in window) >= words) and seen.setdefault(window, (i, s)) < (i, s):
                    gone |= set(range(s, s + size))
        if 0 < len(own) < run and seen.setdefault(("whole", *(x for _, x in own)), (i, 0)) < (i, 0):
            gone |= set(range(len(own)))
        places.append((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in {own[g][0] for g in gone})))
    return places


def test_repeated_lines(make, hard):
    rnd = random.Random(2)
    rows = [r for r in hard if r[0] not in (None, 6)]
    for i in range(60):
        rows.append((50 + i, "\n".join(rnd.choice(["a", "b", "c ", " c", "", "d", "e"]) for _ in range(rnd.randint(0, 25)))))
    rows.append((300, "same\n" * 500))
    docs = make(rows)
    clean = line_dedup.drop_repeated_lines(docs)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in clean.collect()) == sorted((i, t or "") for i, t in plain_lines(rows, 3))
    assert clean.where("doc_id = 1 and text is null").count() == 1


def test_short_repeats_of_many_words_and_whole_documents(make):
    """Two-line copies go, passages of 50 words in one or two lines go; short lines and other documents' lines stay."""
    long = " ".join(f"word{k}" for k in range(50))
    half, rest = " ".join(f"part{k}" for k in range(30)), " ".join(f"rest{k}" for k in range(20))
    rows = [
        (1, "Dear all,\nsee you"), (2, " Dear all,\n\nsee you\t"), (3, "Dear all,\nsee you\nlater"), (4, "Thanks"), (5, "Thanks"), (6, "Thanks\nagain"),
        (10, f"a1\n{long}\nb1"), (11, f"a2\n{long}\nb2\n{long}"), (12, f"{half}\n{rest}\nend"), (13, f"start\n{half}\n{rest}"), (14, f"other\n{half}\nline"), (15, long[:-2]),
    ]
    clean = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(make(rows)).collect()}
    assert clean == dict(plain_lines(rows, 3))
    assert [clean[i] for i in (1, 2, 3, 4, 5, 6)] == ["Dear all,\nsee you", "", "Dear all,\nsee you\nlater", "Thanks", "", "Thanks\nagain"]
    assert (clean[11], clean[13], clean[14]) == ("a2\nb2", "start", f"other\n{half}\nline")


def test_many_lines_in_one_text_take_time_in_proportion(make):
    def took(n):
        text = "\n".join(f"line {k % (n // 2)} of the text" for k in range(n))
        began = time.time()
        (row,) = line_dedup.drop_repeated_lines(make([(1, text)], 1)).collect()
        assert row.text.count("\n") == n // 2 - 1
        return time.time() - began

    took(100)
    small, large = took(6_000), took(60_000)
    assert large < 12 * small + 3


def test_majority_and_wide_fingerprints():
    h = simhash._hashes("a b c d e f g", 4)
    assert h.shape == (4, 8) and simhash._majority(h) == plain_fingerprint("a b c d e f g", 4).to_bytes(8, "big")
    assert len(simhash._majority(h, wide=True)) == simhash.WIDE // 8 and simhash._majority(h[:0], wide=True) == bytes(simhash.WIDE // 8)
    assert 155 <= simhash.radius_for(0.8) <= 172 and simhash.radius_for(0.9) < simhash.radius_for(0.8)
    assert np.array_equal(simhash._band_keys(h), simhash._band_keys(h[::-1]))


def test_wide_fingerprints_measure_similarity():
    rnd = random.Random(6)
    for _ in range(40):
        words = [str(rnd.random()) for _ in range(600)]
        other = list(words)
        for at in rnd.sample(range(600), 14):
            other[at] = "x"
        one, two = ({tuple(w[i:i + 5]) for i in range(596)} for w in (words, other))
        j = len(one & two) / len(one | two)
        a, b = (int.from_bytes(simhash._majority(simhash._hashes(" ".join(w), 5), True), "big") for w in (words, other))
        assert abs((a ^ b).bit_count() - simhash.radius_for(j, 0)) < 48


def test_near_copies_are_those_of_exact_similarity(make):
    """Around the threshold, pairs above it are found and pairs below it stay; repeated shingles count once."""
    rnd = random.Random(12)
    rows = []
    for g in range(60):
        words = [f"g{g}w{k}" for k in range(rnd.randint(150, 400))]
        rows.append((10 * g, " ".join(words)))
        for c in range(1, 3):
            own = list(words)
            for at in rnd.sample(range(0, len(own), 6), len(own) * rnd.randint(10, 40) // 1000):
                own[at] = f"x{g}c{c}at{at}"
            rows.append((10 * g + c, " ".join(own)))
    body = [f"b{k}" for k in range(300)]
    rows += [(900, " ".join(body + ["one", "two", "three", "four", "five", "six"] * 60)), (901, " ".join(body + ["six", "four", "three", "one", "seven", "eight"] * 60))]

    def shingles(text):
        w = text.split()
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}

    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for i in sets:
        for k in sets:
            if k < i and k // 10 == i // 10 and root[k] != root[i] and 10 * len(sets[i] & sets[k]) >= 8 * len(sets[i] | sets[k]):
                a, b = sorted((root[i], root[k]))
                root = {x: a if r == b else r for x, r in root.items()}
    near = [len(sets[i] & sets[k]) / len(sets[i] | sets[k]) for i in sets for k in sets if k < i and k // 10 == i // 10]
    assert sum(0.7 <= x < 0.8 for x in near) > 20 and sum(0.8 <= x < 0.9 for x in near) > 20 and root[901] == 900
    assert {r.doc_id for r in simhash.drop_near_copies(make(rows)).collect()} == {i for i, r in root.items() if i == r}


def test_large_sets_make_more_trees_with_the_same_result(make, monkeypatch):
    rows = [(i, " ".join(f"w{k}" for k in range(200)) + f" end{i}") for i in range(30)] + [(50, "alone")]
    monkeypatch.setattr(simhash, "TREE_BYTES", 4096)
    assert {r.doc_id for r in simhash.drop_near_copies(make(rows)).collect()} == {0, 50}
