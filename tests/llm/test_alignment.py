"""Token alignment against a plain version with the tokenizer libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from voltable.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    v = alignment.load(A)
    raw = {int(i): x for i, x in zip(v.ids, v.bytes)}

    def ranges(ids, of):
        at, out = 0, []
        for i in ids:
            out.append((at, at := at + len(of(i))))
        return out

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def one(text):
        text = text or ""
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        want = (" " + text).encode()
        if not text or b"".join(map(raw.get, x)) != want or b"".join(map(piece, y)) != want:
            return [], [], [], []
        p, q = ranges(x, raw.get), ranges(y, piece)
        ends = sorted({e for _, e in p} & {e for _, e in q})
        groups, i, j = [], 0, 0
        for e in ends:
            n, m = i, j
            while i < len(p) and p[i][1] <= e:
                i += 1
            while j < len(q) and q[j][1] <= e:
                j += 1
            groups.append((x[n:i], y[m:j]))
        links, first = [], 0
        for i, (s, e) in zip(x, p):
            while q[first][1] <= s:
                first += 1
            k = first
            while k < len(q) and q[k][0] < e:
                links.append((i, y[k]))
                k += 1
        return x, y, groups, links

    return one


def expected(plain, texts):
    each = [plain(t) for t in texts]
    counts = Counter(pair for *_, links in each for pair in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for x, y, groups, links in each:
        line = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(x), len(y), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(line.encode()).hexdigest() if line else ""))
    return out


def odd_texts(seed, n=250):
    r = random.Random(seed)
    letters = [chr(x) for x in range(0x20, 0x7F)] + list("éüßñ東京한국👍🏽\t\n\r\x0b\x85\xa0 　\x1c​▁٣²½Ⅷ'") + [" "] * 40 + ["\n"] * 6
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["<s> </s> <|endoftext|>", " x", "x ", "a  b", "\n\n x", "it's we'll", "▁", "a▁b", "<0x41>", "\x00 \x00", "word " * 30]


@pytest.mark.parametrize("hot,remembered", [(1 << 17, 300_000), (3, 20)])
def test_alignment_query(spark, make, hard, plain, tmp_path, monkeypatch, hot, remembered):
    """Also with few broadcast pairs and a memory that is cleared again and again."""
    monkeypatch.setattr(alignment, "HOT", hot)
    monkeypatch.setattr(alignment, "REMEMBERED", remembered)
    rows = hard + [(100 + i, t) for i, t in enumerate(odd_texts(2))]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_token_alignment(spark, str(tmp_path)).collect()
    want = [(i, *x) for (i, _), x in zip(rows, expected(plain, [t for _, t in rows]))]
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_groups_and_empty_table(make, plain):
    texts = odd_texts(7, 40)
    got = {r.doc_id: r for r in alignment.align(make(list(enumerate(texts))), A, B, groups=True).collect()}
    for i, t in enumerate(texts):
        x, y, groups, links = plain(t)
        assert got[i].groups == ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        assert Counter(dict(zip(got[i].pairs, got[i].times))) == Counter(a * 32000 + b for a, b in links)
    assert alignment.linked(make([(1, "x")]).where("doc_id < 0"), A, B).count() == 0


def test_long_words_take_the_library(plain, make):
    text = "ab" * 8_000 + " " * 12_000 + "x"
    (row,) = alignment.align(make([(1, text)]), A, B).collect()
    x, y, groups, links = plain(text)
    assert (row.n_a, row.n_b, row.n_groups, row.n_links) == (len(x), len(y), len(groups), len(links))
