import hashlib
import random
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voltable.llm import bpe_trie, packing, token_counts
from voltable.llm.ragged import Merger
from voltable.llm.vocab import load

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def expected():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def odd_texts(n=300, seed=5):
    rnd = random.Random(seed)
    letters = [chr(x) for x in range(0x20, 0x7F)] + list("éüßñ東京한국👍🏽\t\n\r\x0b\x0c\x85\xa0 　\x1c​٣²½Ⅷ'") + [" "] * 40 + ["\n"] * 8
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(n)] + ["aaaa " * 90, " " * 60, "ab" * 900, " x", "x ", "it's we'll", "\n x \n"]


def test_counts_equal_the_tokenizer(make, hard, expected):
    rows = hard + [(100 + i, t) for i, t in enumerate(odd_texts())]
    got = Counter(map(tuple, token_counts.count_tokens(make(rows), PATH, limit=12).collect()))
    want = Counter((i, len((t or "").encode()), len(expected(t)), len(expected(t)) > 12) for i, t in rows)
    assert got == want


def test_encode_decode_round_trip(make, hard, expected):
    rows = [r for r in hard + [(100 + i, t) for i, t in enumerate(odd_texts(seed=6))] if r[0] is not None and r[0] != 6]
    ids = bpe_trie.encode(make(rows), PATH)
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got == {i: expected(t) for i, t in rows}
    assert {r.doc_id: r.text for r in bpe_trie.decode(ids, PATH).collect()} == {i: t or "" for i, t in rows}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digest = {tuple(r) for r in bpe_trie.round_trip(make(rows), PATH).collect()}
    assert digest == {(i, len(expected(t)), sha(",".join(map(str, expected(t)))), sha(t or "")) for i, t in rows}


def test_trie_and_arrays_agree_on_every_symbol_and_on_deep_words():
    v = load(PATH)
    words = [b.decode("latin-1") for b in v.bytes[256:3000]] + ["ab" * 400, "z" * 1000, "abcdefgh" * 60 + "q"]
    assert bpe_trie.TrieEncoder(v).encode(words) == Merger(v).encode(words)


def test_empty_tables(make):
    empty = make([(1, "x")]).where("doc_id < 0")
    assert token_counts.count_tokens(empty, PATH).count() == bpe_trie.encode(empty, PATH).count() == packing.pack(empty, PATH).count() == 0


def plain_best_fit(lengths, size):
    rest = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, c in enumerate(rest) if c >= n]
        if fits:
            rest[min(fits, key=rest.__getitem__)] -= n
        else:
            rest.append(size - n)
    return sorted(rest)


@pytest.mark.parametrize("seed", range(40))
def test_moves_are_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    size = rnd.choice([1, 7, 16, 33, 64])
    lengths = [rnd.randint(1, size) for _ in range(rnd.randint(0, 150))]
    windows, ranks = {}, {}
    for length, rank, n, first, offset in packing.best_fit(Counter(lengths), size):
        ranks.setdefault(length, []).extend(range(rank, rank + n))
        for i in range(n):
            windows.setdefault(first + i, []).append((offset, length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    assert sorted(size - sum(x for _, x in p) for p in windows.values()) == plain_best_fit(lengths, size)
    assert {k: sorted(r) for k, r in ranks.items()} == {k: list(range(n)) for k, n in Counter(lengths).items()}


@pytest.mark.parametrize("long", [packing.LONG, 2])
def test_packing_holds_every_id_once(make, hard, expected, monkeypatch, long):
    """Also with every text going through the trie, as very long ones do."""
    monkeypatch.setattr(packing, "LONG", long)
    rows = [r for r in hard if r[0] is not None]
    out = packing.pack(make(rows), PATH, size=64, end_id=0, with_ids=True).collect()
    windows, pieces = {}, {}
    texts = dict(rows)
    whole = {i: expected(t) + [0] for i, t in texts.items()}
    assert max(len(t or "") for t in texts.values()) > packing.LONG
    for r in out:
        ids = whole[r.doc_id]
        part = ids[r.start: r.start + r.length]
        assert r.ids == part and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, Counter())[r.start] += r.length
    times = Counter(i for i, _ in rows)
    for key, starts in pieces.items():
        assert sum(starts.values()) == times[key] * len(whole[key])
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    rest = [len(whole[i]) for i, _ in rows]
    assert len(windows) == sum(n // 64 for n in rest) + len(plain_best_fit([n % 64 for n in rest if n % 64], 64))
    assert sorted(windows) == list(range(len(windows)))
