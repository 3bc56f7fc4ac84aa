r"""URL filtering by rules on hosts and paths, and by a list of URLs behind a blocked Bloom filter.

The list's canonical URLs fill a filter of bounded size, which is broadcast. Most pages are not in it and are done; the few
possible hits meet the list itself in an exact hash join, which takes the false positives out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltable.llm import bloom
from voltable.llm.joins import join_checked
from voltable.plans.lineage import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters that say where a reader came from and not what the page is.
TRACKING = r"^(utm_[^=]*|ref)(=|\z)"


def _rest(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.` or `m.`, path without its last `/` or `.html`, other parameters in order; null without `://`."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    page = F.concat(F.regexp_replace(host(url), r"^(www|m)\.", ""), F.regexp_replace(path(url), r"(/|\.html)\z", ""))
    return F.when(F.instr(url, "://") > 0, F.concat(page, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def _fitting(rules: list[tuple[str, str]], host_: Column, path_: Column) -> Column:
    """The longest rule that fits, with its verdict; of equally long ones the first by text."""
    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(slash + rest)

    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    return F.coalesce(*(F.when(fits(rule), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))) for verdict, rule in ordered)) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", by_name: bool = False) -> DataFrame:
    """One row per row of `pages`: id, `host`, `path`, `rule`, `verdict` (`allow` or `block`).

    `rules` is a short list of (verdict, `host/path`): a rule fits its host and all subdomains if the path starts with its
    own, and the longest wins. Where none fits, a page is blocked if its canonical URL is that of a row of `listed`. A
    null URL or one without `://` has empty host and path and is never listed; a null id stays null; repeated rows are
    judged each; null and repeated rows of the list count for nothing more; empty tables of pages or of the list are fine.
    With `by_name`, `listed_col` holds canonical names already (`seen_again`): a name is no URL and is not made canonical
    a second time. Other columns are not read.
    """
    name = F.col(listed_col) if by_name else canonical(F.col(listed_col))
    names = materialize(listed.select(name.alias("_name")).where("_name IS NOT NULL").distinct(), "listed")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    rows = rows.select("_id", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"), canonical(F.col("_url")).alias("_name"))
    rows = rows.withColumn("_rule", _fitting(rules, F.col("host"), F.col("path")))
    # a page that a rule decides asks for nothing
    rows = rows.withColumn("_name", F.when(F.col("_rule").isNull(), F.col("_name")))
    clear, possible = bloom.ask(rows, "_name", materialize(bloom.filter_of(names, "_name"), "filter"))
    hits = join_checked(possible, names.select(F.col("_name").alias("_listed")), F.col("_name") == F.col("_listed"), "left")

    def judged(df: DataFrame, otherwise: Column) -> DataFrame:
        return df.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", otherwise).alias("verdict"))

    return judged(clear, F.lit("allow")).unionByName(judged(hits, F.when(F.col("_listed").isNotNull(), "block").otherwise("allow")))


def seen_again(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """A list for `judge` with `by_name`: the canonical names (`name`) under which more than one row was fetched. URLs that are
    null or have no `://` have no name; an empty table gives an empty list."""
    name = pages.select(canonical(F.col(url_col)).alias("name")).where("name IS NOT NULL")
    return name.groupBy("name").agg(F.count("*").alias("_n")).where("_n > 1").select("name")
