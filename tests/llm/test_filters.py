import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import regex

from voltable.llm import language, pii, url_filter

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
TEXTS = [
    "1.2.3.4.5.6.7.8 999.1.2.3.4 a@b.c_x@d.e a@b.com. +1 (988) 555-2485 4041894974608795", "4041-8949-7460-8795 4041 8949 7460 8795 40418949746087951 12 4041894974608795",
    "x@y é@b.com ééa@b.co.uk.+12345678901 ", "1 2 3 4 5", "1 " * 3000, "1.2.3.4" * 3, "a@b.c@d.e", "a@-.x", "0000255.1.1.1 256.1.1.1", "東京 a@b.jp 👍👍 10.0.0.1",
    "+1234567890+1234567890", "4111 1111 1111 1111  4111111111111111", "4111 1111 1111 1111 4111111111111111", "+1 2", "+12 34567890.", "mail me: a.b-c%d@x-y.org, or not",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def base(text):
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in BASE]


def test_base_spans(make, hard):
    rows = [r for r in hard if r[0] not in (None, 6)] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in pii.spans(make(rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = base(t)
        flat = sum(want, [])
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in want]
        assert r.base_sha256 == hashlib.sha256(",".join(flat).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("term")] == flat


def test_matching_takes_linear_time(make):
    long = ["a" * 300_000, "9" * 300_000, ". " * 100_000, "+1" + " " * 300_000, "a." * 100_000 + "@b", "1-" * 100_000]
    assert [r.n_email for r in pii.spans(make(list(enumerate(long)))).collect()] == [0] * 6


def test_disclosing_terms_are_found_and_taken_out(make):
    common = [(1000 + i, f"the report of day {i} was sent to everyone and read by nobody") for i in range(60)]
    rows = [(i, f"the report of day {i}x was sent by zyx to who@corp.example and filed as {i}") for i in range(3)] + [(50, "nothing of zebra here"), (51, "copy to one@corp.example"), (52, "copy to one@corp.example")]
    docs = make(rows + common)
    got = {r.doc_id: r for r in pii.spans(docs).collect()}
    for i in range(3):
        t = rows[i][1]
        at = t.index("zyx")
        assert f"term:{at}:{at + 3}" in got[i].spans.split(",") and f"term:{t.index('report')}:{t.index('report') + 6}" not in got[i].spans.split(",")
    assert got[50].spans == "" and "term" not in got[51].spans  # copies are one neighbourhood
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert "[EMAIL]" in texts[0] and "zyx" not in texts[0] and "corp" not in texts[0] and "report of day" in texts[0]
    assert texts[50] == rows[3][1] and texts[1000] == common[0][1]


def test_pii_keeps_nulls_repeats_and_empty_tables(make, hard):
    clean = pii.sanitise(make(hard + [(None, "a@b.com"), (30, "a@b.com"), (30, "a@b.com")])).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in clean if r.text == "[EMAIL]") == [(-1, "[EMAIL]"), (30, "[EMAIL]"), (30, "[EMAIL]")]
    assert len(clean) == len(hard) + 3 and sum(r.text is None for r in clean) == 1
    empty = make([(1, "x")]).where("doc_id < 0")
    assert pii.spans(empty).count() == pii.sanitise(empty).count() == 0


WORDS = {"aa": "the and of with ing that", "bb": "der und die nicht ung schön", "cc": "el los una que ción"}


def test_language(make, hard):
    rows = [(i, " ".join((WORDS[k].split() * 3)[i % 5:][:9]), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    extra = [(500, "12 34 !!", "aa"), (501, None, "bb"), (502, "", "cc"), (503, "nicht schön", None), (None, "the and of", "aa"), (504, "x" * 900_000, None)]
    docs = make(rows + extra)
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None) and got[None].held_out
    assert all(got[i].lang_pred == k for i, _, k in rows) and got[503].lang_pred == "bb" and got[None].lang_pred == "aa"
    assert [(got[i].lang_pred, got[i].score) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values()) and got[504].lang_pred in WORDS
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got) - {500, 501, 502}


def test_language_never_reads_labels_of_the_held_out(make):
    rows = [(i, " ".join(WORDS[k].split()[i % 3:]), k) for i, k in enumerate(["aa", "bb", "cc"] * 20)]
    turned = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else k) for i, t, k in rows]
    one, two = ({tuple(r) for r in language.identify(make(x)).collect()} for x in (rows, turned))
    assert {r[:3] for r in one} == {r[:3] for r in two}


def test_language_without_labels(make):
    assert {r.lang_pred for r in language.identify(make([(1, "words", None), (2, None, None)])).collect()} == {"und"}
    assert language.identify(make([(1, "x")]).where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("rules", [[("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")], []])
def test_urls(spark, rules):
    urls = [
        None, "", "no scheme", "http://", "http://Example.COM", "https://example.com/", "http://example.com/en/x?y=1", "http://a.WWW.example.com/en/x#z", "http://ample.com/en/", "http://xexample.com/en/",
        "ftp://host.net/es/1", "ftp://host.net/ES/1", "http://net/es/", "http://m.site.org/p.html?utm_source=a&b=2&a=1", "https://www.site.org/p/?a=1&b=2", "http://site.org/p?b=2&a=1&ref=q", "http://site.org/q?x://y/z", "a://b://c/d",
    ]
    pages = spark.createDataFrame([(i if i else None, u, "n", "l") for i, u in enumerate(urls * 2)], "page_id bigint, url string, _name string, _listed string").repartition(3)
    listed = spark.createDataFrame([("http://site.org/p?a=1&b=2",), ("x://host.net/ES/1/",), (None,), ("junk",)] * 2, "url string")

    def want(url):
        host = path = ""
        name = None
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            raw, path, query = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", rest, re.S).groups()
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
            kept = sorted(p for p in (query or "").split("&") if p and not re.match(r"(utm_[^=]*|ref)(=|$)", p))
            name = re.sub(r"^(www|m)\.", "", host) + re.sub(r"(/|\.html)$", "", path) + ("?" + "&".join(kept) if kept else "")
        fits = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        if fits:
            return (host, path, max(fits)[1], max(fits)[2])
        return (host, path, None, "block" if name in ("site.org/p?a=1&b=2", "host.net/ES/1") else "allow")

    got = sorted((r.page_id or 0, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge(pages, rules, listed).collect())
    assert got == sorted((i, *(x or "" for x in want(u))) for i, u in enumerate(urls * 2))
    assert url_filter.judge(pages.where("page_id < 0"), rules, listed).count() == 0
    again = {r.name for r in url_filter.seen_again(pages).collect()}
    assert "site.org/p?a=1&b=2" in again and url_filter.seen_again(pages.where("page_id < 0")).count() == 0


def test_canonical_names_are_not_made_canonical_again(spark):
    """Pages seen twice under a name that looks like a longer URL are blocked, a page under the shorter name is not."""
    twice = ["http://www.www.q.org/p", "http://m.www.r.org/p", "http://z.org/a//", "http://z.org/b.html/", "http://z.org/c/.html"]
    once = ["http://www.q.org/p", "http://r.org/p", "http://z.org/a/", "http://z.org/b", "http://z.org/c"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(twice * 2 + once)], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, [], url_filter.seen_again(pages), listed_col="name", by_name=True).collect()}
    assert got == {i: "block" if i < 10 else "allow" for i in range(15)}


def test_large_sides_are_shuffled_with_the_same_result(make, hard, monkeypatch):
    from voltable.llm import joins, line_dedup

    rows = hard + [(i, f"the report of day {i}x was sent by zyx to who@corp.example and filed\nsame a\nsame b\nsame c\nend {i}") for i in range(20, 24)] + [(60 + i, "the report of the day and others") for i in range(30)]
    docs = make(rows)

    def outcome():
        return [sorted(map(str, df.collect())) for df in (pii.spans(docs), pii.sanitise(docs), line_dedup.drop_repeated_lines(docs))]

    small = outcome()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    assert outcome() == small and any("term" in x for x in small[0])


def test_disclosing_terms_go_wherever_they_stand(make):
    """Far from the entity, again later in its text, and in documents without it; near copies of a text disclose nothing."""
    rnd = random.Random(5)
    filler = lambda n: " ".join(rnd.choice("the of and to in is for on with as by at from report".split()) for _ in range(n)).replace(" ", "q ") + " "
    common = [(1000 + i, "the report of the day " + filler(60)) for i in range(80)]
    rows = [(i, f"Zyx{' wrote' * (i + 1)} {filler(150)}who@corp.example {filler(150)}zyx {i}") for i in range(3)]
    near = "mail one@corp.example " + filler(100) + "rareword " + filler(40)
    rows += [(50, near), (51, near + "more")]
    docs = make(rows + common)
    got = {r.doc_id: r.spans for r in pii.spans(docs).collect()}
    for i in range(3):
        want = {f"term:{m.start()}:{m.end()}" for m in re.finditer("zyx", rows[i][1].lower())}
        assert len(want) == 2 and want <= set(got[i].split(","))
    assert "term" not in got[50] and "term" not in got[51]
    # in one of 4 documents the term stands without the entity: it still discloses, log2(86 * 3 / (3 * 4)) / log2(86 / 3) > 0.75
    docs = make(rows + common + [(60, "nobody but ZYX knows"), (61, None)])
    got = {r.doc_id: r for r in pii.spans(docs).collect()}
    assert got[60].spans == "term:11:14" and got[60].base_sha256 == hashlib.sha256(b"").hexdigest() and got[61].spans == ""
    texts = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert texts[60] == "nobody but [TERM] knows" and texts[61] is None and texts[1000] == common[0][1]
    assert all("zyx" not in texts[i].lower() and "[EMAIL]" in texts[i] for i in range(3))


def test_every_labelled_row_is_learned(spark):
    """Counts of more than 20,000 rows, and thresholds from all of their means."""
    docs = spark.range(0, 32_000, 1, 4).selectExpr("id AS doc_id", "concat('ab', id % 10) AS text", "IF(id % 3 = 0, 'xx', 'yy') AS lang")
    learned = docs.where(~language.held_out(docs.doc_id))
    model = language.fit(docs)
    n = {r.lang: r["count"] for r in learned.groupBy("lang").count().collect()}
    assert model.languages == ["xx", "yy"]
    assert [round(x) for x in (model.counts - 0.5).sum(axis=0)] == [n[k] * 5 * 3 for k in model.languages]  # 5 characters with the spaces, three orders
    assert sum(n.values()) > 20_000 and set(language.floors(docs, model)) <= set(n)


def test_texts_in_no_learned_language_go(make):
    """An unlearned language and noise go with `open_set`, clean rows stay, also those that are not learned from."""
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(WORDS[k].split(), k=40)), k) for i, k in enumerate(["aa", "bb", "cc"] * 60)]
    odd = [(500, "это просто русское предложение о погоде и о реке", None), (501, "今日は天気がとても良いので散歩に行きます", None), (502, "x 1234 #### 99", None)]
    odd += [(503, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)), None)]
    docs = make(rows + odd)
    assert {r.doc_id for r in language.keep_identified(docs).collect()} > {500, 501, 502, 503}
    assert {r.doc_id for r in language.keep_identified(docs, open_set=True).collect()} == {i for i, _, _ in rows}


def plain_grams(text):
    codes = [ord(c) for c in f" {text.lower()} "]
    full, out = 1 << 32, []
    for at in range(len(codes)):
        mixed = 0
        for order in language.ORDERS:
            ahead = codes[at + order - 1] if at + order - 1 < len(codes) else 0
            mixed = ((mixed ^ (ahead * int(language._FACTORS[order - 1]) % full)) * 0x85EBCA6B) % full
            out.append((mixed ^ (mixed >> 15)) % language.BUCKETS)
    return out


def test_language_equals_a_plain_naive_bayes(make, hard):
    """Counts, smoothing, priors and posteriors of a classifier written out in loops; also for repeated rows."""
    rnd = random.Random(11)
    every = " ".join(WORDS.values()).split()
    rows = [(100 + i, " ".join(rnd.choices(WORDS[k].split(), k=rnd.randint(1, 6)) + rnd.choices(every, k=rnd.randint(0, 6))), k) for i, k in enumerate(rnd.choices(["aa", "bb", "bb", "cc"], k=80))]
    rows += [rows[0], rows[0]] + [r for r in hard if r[0] != 7]
    counts, seen = {}, Counter()
    for r in rows:
        lang = r[2] if len(r) > 2 else "en"
        if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(plain_grams(r[1]))
            seen[lang] += 1
    names = sorted(counts)
    total = {k: sum(counts[k].values()) + 0.5 * language.BUCKETS for k in names}
    want = {}
    for r in rows:
        text = r[1] or ""
        joint = [math.log(seen[k] / sum(seen.values())) + sum(math.log((counts[k][g] + 0.5) / total[k]) for g in plain_grams(text)) for k in names]
        best = max(range(len(names)), key=lambda k: joint[k])
        want[r[0], r[1]] = (names[best], 1 / sum(math.exp(x - joint[best]) for x in joint)) if any(map(str.isalpha, text)) else ("und", 0.0)
    docs = make(rows)
    got = language.identify(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    of = {i: x for (i, _), x in want.items()}  # rows that share an id share their text
    for r in got:
        lang, score = of[r.doc_id]
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6, r


def plain_terms(rows):
    """The flagged terms of a corpus by the formula, in loops: {term: removed}."""
    reach, around, n = pii.REACH, pii.AROUND, len(rows)
    words = lambda t: [m.lower() for m in regex.findall(r"[\p{L}\p{N}]+", t)]
    masked, met = {}, []  # met: (row, entity, neighbourhood)
    for i, text in rows:
        found = [(int(x.split(":")[1]), int(x.split(":")[2])) for x in base(text)[0]]
        if found:
            own = text
            for s, e in found:
                own = own[:s] + "\x01" * (e - s) + own[e:]
            masked[i] = own
            met += [(i, text[s:e].lower(), own[max(0, s - reach): e + reach]) for s, e in found]
    n_c = Counter(c for _, c in {(i, c) for i, c, _ in met})
    n_c = {c: k for c, k in n_c.items() if 2 <= k <= n - 1}
    met = [x for x in met if x[1] in n_c]
    held = {i: [w for w in words(masked[i]) if len(w) >= pii.SHORTEST] for i in {x[0] for x in met}}
    n_t = Counter(w for _, t in rows for w in set(words(t or "")))
    flagged = {}
    for t in {t for t, k in Counter(w for own in held.values() for w in set(own)).items() if k >= 2}:
        for c in n_c:
            in_rows, whose, owns, beside = set(), set(), set(), set()
            for i, entity, context in met:
                if entity != c:
                    continue
                if t in held[i]:
                    k = held[i].index(t)
                    in_rows.add(i), whose.add(context), owns.add(tuple(held[i][max(0, k - around): k + around + 1]))
                if t in words(context):
                    in_rows.add(i), whose.add(context), owns.add(context), beside.add(context)
            if min(len(in_rows), max(len(beside), min(len(whose), len(owns)))) >= pii.SUPPORT:
                d = math.log2(n * len(in_rows) / (n_c[c] * n_t[t])) / math.log2(n / n_c[c])
                if d >= pii.GENERALISE:
                    flagged[t] = flagged.get(t, False) or d >= pii.REMOVE
    return flagged, masked


def test_disclosing_terms_equal_a_plain_computation(make):
    rnd = random.Random(21)
    vocabulary = [f"word{k}" for k in range(60)] + ["a", "of"]
    rows = []
    for i in range(90):
        text = rnd.choices(vocabulary, k=rnd.randint(8, 40))
        if i % 3 == 0:
            who = rnd.randrange(6)
            text.insert(rnd.randrange(len(text)), f"p{who}@corp.example")
            text += [f"alias{who}"] * (rnd.random() < 0.9) + [f"team{who % 3}"] * (rnd.random() < 0.8) + [f"u{i}"]
        elif i % 7 == 0:
            text.append(f"Alias{rnd.randrange(6)}")
        rows.append((i, " ".join(dict.fromkeys(text))))
    flagged, masked = plain_terms(rows)
    assert len(flagged) >= 4 and True in flagged.values() and False in flagged.values()
    got = {r.doc_id: r.spans for r in pii.spans(make(rows)).collect()}
    for i, text in rows:
        want = {f"term:{m.start()}:{m.end()}" for m in re.finditer(r"\w+", masked.get(i, text)) if m.group().lower() in flagged}
        assert {x for x in got[i].split(",") if x.startswith("term")} == want, (i, text)
