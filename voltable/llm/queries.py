"""The operators of this subpackage as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltable.llm import alignment, bpe_trie, exact_dedup, language, line_dedup, nearest, packing, periodic_runs, pii, simhash, token_counts, url_filter, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Fixed values: (verdict, host and path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), VOCABULARY, limit=512)


@query
def op6_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_trie.round_trip(table(spark, folder, "documents"), VOCABULARY)


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), VOCABULARY, size=1024, end_id=0)


@query
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.groups(table(spark, folder, "documents"))


oracle("op7_exact_dedup", r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
    FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)""")


@query
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.classes(table(spark, folder, "documents"), shingle=4, radius=4)


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.spans(table(spark, folder, "documents"))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


@query
def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return nearest.nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


@query
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return url_filter.judge(pages, URL_RULES, url_filter.seen_again(pages), listed_col="name", by_name=True)


oracle("op5_url_filter", r"""
    WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
    p AS (SELECT page_id, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS q FROM u),
    c AS (SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)\z', '') ||
                 coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|\z)'))), '&'), ''), '') END AS name FROM p),
    n AS (SELECT *, count(*) OVER (PARTITION BY name) AS times FROM c),
    r AS (SELECT page_id, host, path, times, name, CASE
            WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM n)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
           WHEN name IS NOT NULL AND times > 1 THEN 'block' ELSE 'allow' END AS verdict FROM r""")


@query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The text without repeated lines, by its number of lines and hash, next to the original number of lines."""
    docs = table(spark, folder, "documents")
    number = F.when(F.col("text") == "", 0).otherwise(F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))).cast("bigint")
    clean = line_dedup.drop_repeated_lines(docs.select("doc_id", "text", number.alias("n_lines")))
    return clean.select("doc_id", "n_lines", number.alias("n_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("clean_sha256"))


oracle("op2_line_dedup", r"""
    WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
    s AS (SELECT doc_id, i, trim(line, E' \t\r\x0b\f') AS line FROM l),
    p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM s WHERE line <> ''),
    q AS (SELECT *, len(string_split_regex(line, '[\x20\x09-\x0D]+')) AS words, count(*) OVER (PARTITION BY doc_id) AS n FROM p),
    w AS (SELECT *, lead(line) OVER v AS b, lead(line, 2) OVER v AS c, lead(words) OVER v AS words2 FROM q WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
    r AS (SELECT doc_id, p, 3 AS r, 'run' AS kind, [line, b, c] AS own FROM w WHERE c IS NOT NULL
          UNION ALL SELECT doc_id, p, 2, 'run', [line, b] FROM w WHERE b IS NOT NULL AND words + words2 >= 50
          UNION ALL SELECT doc_id, p, 1, 'run', [line] FROM w WHERE words >= 50
          UNION ALL SELECT doc_id, p, n, 'whole', CASE WHEN n = 1 THEN [line] ELSE [line, b] END FROM w WHERE n < 3 AND p = 1),
    f AS (SELECT doc_id, p, r, row_number() OVER (PARTITION BY kind, own ORDER BY doc_id, p) AS k FROM r),
    g AS (SELECT DISTINCT doc_id, unnest(range(p, p + r)) AS p FROM f WHERE k > 1),
    k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS clean, count(*) AS n
          FROM l LEFT JOIN p USING (doc_id, i) LEFT JOIN g ON g.doc_id = p.doc_id AND g.p = p.p WHERE g.p IS NULL GROUP BY 1)
    SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE coalesce(len(lines), 0) END AS n_lines,
           CASE WHEN coalesce(clean, '') = '' THEN 0 ELSE n END AS n_kept, CASE WHEN text IS NOT NULL THEN sha256(coalesce(clean, '')) END AS clean_sha256
    FROM d LEFT JOIN k USING (doc_id)""")


def with_period(docs: DataFrame) -> DataFrame:
    """doc_id and text; in one of ten texts, picked by the id's checksum, the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    picked = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    picked = picked.withColumn("n", F.size("words").cast("bigint")).withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    picked = picked.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("slice(flatten(array_repeat(slice(words, int(a) + 1, int(p)), int((n - a + p - 1) div p))), 1, int(n - a))")
    text = F.array_join(F.concat(F.expr("slice(words, 1, int(a))"), again), " ")
    return picked.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find_runs(with_period(table(spark, folder, "documents")), least=6, power=4)
    # runs come by start and period, so the first of equal powers stays; powers are compared crosswise and so exactly
    best = F.expr("aggregate(slice(runs, 2, size(runs)), runs[0], (x, r) -> IF(r.length * x.period > x.length * r.period, r, x))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumn("best", F.when(F.size("runs") > 0, best)).withColumn("lines", lines)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.linked(table(spark, folder, "documents"), VOCABULARY, PIECES)


@query
def op13_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = winnowing.followed(table(spark, folder, "documents"))
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("half", F.expr("int(n_chars div 2)"))
    docs = docs.withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars) - half), substring(next_text, 1, half))"))
    docs = docs.withColumn("edited_sha256", F.sha2("edited", 256))
    found = winnowing.compared(docs, ["edited", "next_text"], keep=("n_chars", "edited_sha256"))
    hashes = lambda c: F.expr(f"array_join(transform({c}, x -> concat(x.position, ':', lower(hex(x.hash)))), ',')")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", hashes("marks").alias("fingerprint"),
        hashes("edited_marks").alias("edited_fingerprint"), F.col("edited_near").alias("near_edited"), F.col("next_text_near").alias("near_next"))
