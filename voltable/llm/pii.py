r"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Base spans (e-mail, IP, card and phone numbers) are protected entities. A term discloses an entity the more, the nearer the
pointwise mutual information of both comes to the entity's information content: disclosure is
log2(N n(c,t) / n(c) n(t)) / log2(N / n(c)), with document counts of the whole corpus, wherever in a document both stand; it
is 1 if the term is only ever met with the entity. Terms that disclose an entity are sanitised wherever they stand, in
documents without the entity too: removed from `REMOVE` on, generalised to their class from `GENERALISE` on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltable.llm.joins import join_checked, unused
from voltable.plans.lineage import materialize

KINDS = ("email", "ip", "card", "phone", "term")
#: The four patterns, written so that no character is tried twice: possessive quantifiers where nothing can be given back,
#: and starts only where no longer match could start (`\G` is the end of the match before). The card pattern finds chains of
#: digits of the right length at once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[\p{L}\p{N}]+"
#: Code points on either side of an entity that are its neighbourhood, and words on either side of a term that are its own;
#: both only tell copies from independent documents.
REACH, AROUND = 120, 5
#: A term needs so many documents with the entity, with as many different neighbourhoods of the entity and, where it stands
#: outside of these, of its own; copies of a text give one neighbourhood.
SUPPORT = 2
GENERALISE, REMOVE = 0.75, 0.999
SHORTEST = 3

_SPAN = "array<struct<s:int,e:int,v:string>>"


def _located(text: Column, pattern: str, matches: Column, wanted=None) -> Column:
    """Start, end (code points) and text of the pattern's matches, or of the `wanted` ones: the gaps between them are what
    `split` leaves."""
    gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)), 1, F.size(matches))
    steps = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc.getField("at") + x.getField("g")
        e = s + F.length(x.getField("m"))
        out = F.concat(acc.getField("out"), F.array(F.struct(s.alias("s"), e.alias("e"), x.getField("m").alias("v"))))
        return F.struct(e.alias("at"), (out if wanted is None else F.when(wanted(x.getField("m")), out).otherwise(acc.getField("out"))).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(steps, start, step).getField("out")).otherwise(F.array().cast(_SPAN))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Every second digit from the right counts twice, its own digits added up; the sum ends in 0."""
    digits = F.transform(F.split(F.reverse(_digits(v)), ""), lambda d: d.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(v, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.concat(F.lit("0"), F.substring(part(p), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return _luhn(v)
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with a column of located, valid matches for each base kind: `_email`, `_ip`, `_card`, `_phone`."""
    t, none = F.col(text), F.array().cast("array<string>")
    maybe = {"email": t.contains("@"), "phone": t.contains("+"), "ip": t.contains("."), "card": F.lit(True)}
    found = docs.withColumns({f"_{k}": F.when(maybe[k], _matches(t, p)).otherwise(none) for k, p in PATTERNS.items()})
    found = found.withColumns({f"_{k}": _located(t, p, F.col(f"_{k}")) for k, p in PATTERNS.items()})
    return found.withColumns({f"_{k}": F.filter(F.col(f"_{k}"), _keeps(k)) for k in PATTERNS})


def _keeps(kind: str):
    return lambda x: _valid(kind, x.getField("v"))


def _protected(kind: str):
    """A located match as a span with its kind's number and its entity."""
    return lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x.getField("s").alias("s"), x.getField("e").alias("e"), _entity(kind, x.getField("v")).alias("c"))


def _entity(kind: str, v: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(v) if kind in ("email", "ip") else _digits(v))


def _with_entities(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with `_spans`: base spans of all kinds with kind number, start, end and entity."""
    parts = [F.transform(F.col(f"_{k}"), _protected(k)) for k in PATTERNS]
    return base_spans(docs, text).withColumn("_spans", F.concat(*parts)).drop(*(f"_{k}" for k in PATTERNS))


def _rewritten(text: Column, spans: Column, new) -> Column:
    """`text` with `new(span)` in place of each span (in order of start; of overlapping ones the first, the rest of the other without text)."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc.getField("at")
        gap = F.substring(text, at + 1, F.greatest(x.getField("s") - at, F.lit(0)))
        piece = F.when(x.getField("s") >= at, new(x)).otherwise(F.lit(""))
        return F.struct(F.greatest(at, x.getField("e")).alias("at"), F.concat(acc.getField("out"), gap, piece).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc.getField("out"), F.substring(text, acc.getField("at") + 1, F.length(text))))


def _masked(text: Column, spans: Column) -> Column:
    """`text` of the same length with nothing to read where base spans are."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at, s, e = acc.getField("at"), x.getField("s"), x.getField("e")
        gap = F.substring(text, at + 1, F.greatest(s - at, F.lit(0)))
        return F.struct(F.greatest(at, e).alias("at"), F.concat(acc.getField("out"), gap, F.repeat(F.lit("\x01"), F.greatest(e - F.greatest(at, s), F.lit(0)))).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc.getField("out"), F.substring(text, acc.getField("at") + 1, F.length(text))))


def _words(text: Column) -> Column:
    return F.transform(_matches(text, WORD), F.lower)


def _masked_rows(entities: DataFrame) -> DataFrame:
    by_start = F.array_sort(F.transform("_spans", lambda x: F.struct(x.getField("s").alias("s"), x.getField("e").alias("e"), x.getField("k").alias("k"), x.getField("c").alias("c"))))
    return entities.select("_row", "_key", "_text", by_start.alias("_spans")).withColumn("_masked", _masked(F.col("_text"), F.col("_spans")))


def _neighbourhoods(rows: DataFrame) -> DataFrame:
    """One row per entity occurrence: `_row`, `_c`, `_context` (hash), `_near` (terms)."""
    rows = rows.select("_row", "_masked", F.explode("_spans").alias("_x"))
    s, e = F.col("_x.s"), F.col("_x.e")
    low, high = F.greatest(s - REACH, F.lit(0)), F.least(e + REACH, F.length("_masked"))
    rows = rows.select("_row", F.col("_x.c").alias("_c"), F.substring("_masked", low + 1, high - low).alias("_near"))
    return rows.select("_row", "_c", F.xxhash64("_near").alias("_context"), F.array_distinct(_words(F.col("_near"))).alias("_near"))


def disclosing_terms(entities: DataFrame, texts: DataFrame) -> DataFrame:
    """(`_t`, `_remove`) of every term that discloses an entity, as a written table.

    `entities` is a written table of rows with base spans; `texts` has the whole corpus as `_text`, over which the terms'
    document counts are taken.
    """
    rows = materialize(_masked_rows(entities).withColumn("_words", F.filter(_words(F.col("_masked")), lambda w: F.length(w) >= SHORTEST)), "masked")
    near = materialize(_neighbourhoods(rows), "near")
    n = float(max(texts.count(), 1))
    # an entity of fewer documents has no term with enough support, and every term is in the documents of the others
    of_entities = materialize(near.groupBy("_c").agg(F.countDistinct("_row").alias("_n_c")).where(F.col("_n_c").between(SUPPORT, n - 1)), "of_entities")
    known = materialize(join_checked(near, of_entities, "_c", "inner"), "known")
    in_row = materialize(known.groupBy("_row", "_c", "_n_c").agg(F.min("_context").alias("_context")), "in_row")
    wanted = materialize(in_row.select("_row").distinct(), "rows_with_entities")
    of_rows = materialize(join_checked(rows.select("_row", "_words"), wanted, "_row", "left_semi"), "words")
    terms = of_rows.select(F.explode(F.array_distinct("_words")).alias("_t")).groupBy("_t").agg(F.count("*").alias("_n")).where(F.col("_n") >= SUPPORT)
    terms = materialize(terms.select("_t"), "terms")
    counted = texts.select(F.explode(F.array_distinct(_words(F.col("_text")))).alias("_t")).groupBy("_t").agg(F.count("*").alias("_n_t"))
    # as n(c,t) <= n(c), a term of more documents than N^(1-d) n(c)^d stays below the disclosure d
    most = lambda n_c: 1.000001 * n ** (1 - GENERALISE) * F.pow(n_c, F.lit(GENERALISE))
    largest = of_entities.agg(F.max("_n_c")).first()[0] or 0
    of_terms = materialize(join_checked(counted, terms, "_t", "left_semi").where(F.col("_n_t") <= most(F.lit(float(largest)))), "of_terms")

    around = F.transform("_words", lambda w, i: F.struct(w.alias("t"), F.xxhash64(F.slice("_words", F.greatest(i - AROUND, F.lit(0)) + 1, F.least(i, F.lit(AROUND)) + AROUND + 1)).alias("own")))
    places = of_rows.select("_row", F.explode(around).alias("_w")).select("_row", F.col("_w.t").alias("_t"), F.col("_w.own").alias("_own"))
    places = join_checked(places, of_terms, "_t", "inner").groupBy("_row", "_t", "_n_t").agg(F.min("_own").alias("_own"))
    pairs = places.join(in_row, "_row").where(F.col("_n_t") <= most(F.col("_n_c"))).select("_row", "_c", "_t", "_n_c", "_n_t", F.col("_context").alias("_whose"), "_own", F.lit(None).cast("bigint").alias("_beside"))
    beside = join_checked(known.select("_row", "_c", "_n_c", "_context", F.explode("_near").alias("_t")), of_terms, "_t", "inner")
    beside = beside.select("_row", "_c", "_t", "_n_c", "_n_t", F.col("_context").alias("_whose"), F.col("_context").alias("_own"), F.col("_context").alias("_beside"))
    met = pairs.unionByName(beside).groupBy("_c", "_t", "_n_c", "_n_t").agg(*(F.countDistinct(x).alias(x) for x in ("_row", "_whose", "_own", "_beside")))
    met = met.where(F.least("_row", F.greatest("_beside", F.least("_whose", "_own"))) >= SUPPORT)
    disclosure = F.log2(n * F.col("_row") / (F.col("_n_c") * F.col("_n_t"))) / F.log2(n / F.col("_n_c"))
    return materialize(met.withColumn("_d", disclosure).where(F.col("_d") >= GENERALISE).groupBy("_t").agg((F.max("_d") >= REMOVE).alias("_remove")), "flagged")


def _key(text: Column, some: Column) -> Column:
    """Equal for equal texts; texts with and without base spans are told apart."""
    return F.concat(F.when(some, F.lit("")).otherwise(F.lit("-")), F.sha2(text.cast("binary"), 256))


def _term_spans(texts: DataFrame, flagged: DataFrame) -> DataFrame:
    """(`_key`, `_terms`: start, end, `_remove`) of the flagged terms in `texts` (`_key`, `_text`), wherever they stand."""
    words = texts.select("_key", F.explode(F.array_distinct(_words(F.col("_text")))).alias("_t"))
    held = join_checked(words, flagged, "_t", "inner").groupBy("_key").agg(F.collect_set("_t").alias("_all"), F.collect_set(F.when(F.col("_remove"), F.col("_t"))).alias("_gone"))
    held = join_checked(texts, materialize(held, "held"), "_key", "inner").withColumn("_matches", _matches(F.col("_text"), WORD))
    at = _located(F.col("_text"), WORD, F.col("_matches"), lambda v: F.array_contains("_all", F.lower(v)))
    spans = F.transform(at, lambda x: F.struct(x.getField("s").alias("s"), x.getField("e").alias("e"), F.array_contains("_gone", F.lower(x.getField("v"))).alias("_remove")))
    return held.select("_key", spans.alias("_terms")).dropDuplicates(["_key"])


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(base spans of every row: `_id`, `_key`, `_spans`, `_text` where there are spans; term spans by `_key`)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found, some = _with_entities(rows, "_text"), F.size("_spans") > 0
    found = found.select("_id", "_spans", F.when(some, F.col("_text")).alias("_text"), _key(F.col("_text"), some).alias("_key"), F.monotonically_increasing_id().alias("_row"))
    found = materialize(found, "base")
    flagged = disclosing_terms(found.where(some), rows.select("_text"))
    # a text with base spans comes masked, and a second time as if it had none, under a key that nobody asks for
    plain = rows.select(_key(F.col("_text"), F.lit(False)).alias("_key"), "_text")
    texts = plain.unionByName(_masked_rows(found.where(some)).select("_key", F.col("_masked").alias("_text")))
    return found, materialize(_term_spans(texts, flagged), "term_spans")


def _listed(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x.getField("k").alias("k"), x.getField("s").alias("s"), x.getField("e").alias("e"))))
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(kinds, x.getField("k") + 1), x.getField("s"), x.getField("e"))), ",")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, `n_email`, `n_ip`, `n_card`, `n_phone`, `base_sha256` (of the listed base spans),
    `spans` (base and term spans).

    Positions count code points, the end is exclusive. Term spans are those of a disclosing term in any document, with or
    without base spans. A null text counts as empty; a null id stays null; repeated rows get the same spans, and a copy adds
    no neighbourhood. An empty table gives no rows; other columns are not read.
    """
    found, terms = _prepared(docs, id_col, text_col)
    number = lambda k: F.size(F.filter("_spans", lambda x: x.getField("k") == k)).cast("bigint")
    base = [F.col("_id").alias(id_col), *(number(n).alias(f"n_{k}") for n, k in enumerate(PATTERNS)), F.sha2(_listed(F.col("_spans")).cast("binary"), 256).alias("base_sha256")]
    extra = F.coalesce(F.transform("_terms", lambda x: F.struct(F.lit(KINDS.index("term")).alias("k"), x.getField("s").alias("s"), x.getField("e").alias("e"))), F.array().cast("array<struct<k:int,s:int,e:int>>"))
    both = F.concat(F.transform("_spans", lambda x: F.struct(x.getField("k").alias("k"), x.getField("s").alias("s"), x.getField("e").alias("e"))), extra)
    return join_checked(found, terms, "_key", "left").select(*base, _listed(both).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with sanitised texts: entities become their kind in brackets, disclosing terms their class or nothing.

    All rows and columns stay as they are but for these texts; a null text stays null.
    """
    _, terms = _prepared(docs, id_col, text_col)
    key, there = unused(docs, "_key"), unused(docs, "_spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = _with_entities(docs.withColumn("_text", text) if there == "_spans" else docs.select(*docs.columns, text.alias("_text")), "_text")
    marked = marked.withColumn(key, _key(F.col("_text"), F.size("_spans") > 0))
    joined = join_checked(marked, terms.withColumnRenamed("_key", key), key, "left")
    item = lambda x, k: F.struct(x.getField("s").alias("s"), x.getField("e").alias("e"), k.alias("k"))
    base = F.transform("_spans", lambda x: item(x, x.getField("k")))
    extra = F.transform("_terms", lambda x: item(x, F.when(x.getField("_remove"), F.lit(-1)).otherwise(F.lit(KINDS.index("term")))))
    every = F.array_sort(F.concat(base, F.coalesce(extra, F.array().cast("array<struct<s:int,e:int,k:int>>"))))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    value = F.col("_text")

    def new(x: Column) -> Column:
        number = F.regexp_replace(F.substring(value, x.getField("s") + 1, x.getField("e") - x.getField("s")), "[0-9]", "") == ""
        general = F.when(number, F.lit("[NUMBER]")).otherwise(F.lit("[TERM]"))
        return F.when(x.getField("k") < 0, F.lit("")).when(x.getField("k") == KINDS.index("term"), general).otherwise(F.element_at(names, F.greatest(x.getField("k"), F.lit(0)) + 1))

    clean = F.when((F.size("_spans") > 0) | F.col("_terms").isNotNull(), _rewritten(value, every, new)).otherwise(F.col(text_col))
    return joined.select(*(clean.alias(c) if c == text_col else F.col(c) for c in docs.columns))
