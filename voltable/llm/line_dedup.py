r"""Deduplication of lines by winnowing, in DataFrame operations only.

A repeat is a run of lines, equal but for white space at their ends, that starts earlier in the order of id and line too: a
run of `RUN` lines or more, a run of one or two lines that has `WORDS` words or more, or a whole document of one or two lines
that repeats a whole document. Every window of lines that can be such a run selects its least line hash (the last of equal
ones) as a fingerprint, so equal windows select the same line. Fingerprints that occur at one position only are set aside.
The others' positions are joined by the lines around them, window by window, as far as an earlier occurrence of the same
lines goes on; what lies in a window that occurred before is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltable.llm.joins import join_checked, unused
from voltable.plans.lineage import materialize

#: Lines in a repeated run at least, and words in a shorter one.
RUN, WORDS = 3, 50
_BLANK = " \t\r\x0b\f"
WINDOWS = "array<struct<s: int, r: int, p: int, f: bigint, a: bigint, b: bigint>>"


def _lines(text: Column) -> Column:
    """Lines that are not blank: their place among all lines, hash and number of words."""
    every = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(_BLANK)).alias("x")))
    return F.transform(F.filter(every, lambda x: x.getField("x") != ""), lambda x: F.struct(
        x.getField("i").alias("i"), F.xxhash64(x.getField("x")).alias("h"), F.size(F.split(x.getField("x"), r"[\x20\x09-\x0D]+")).alias("w")))


def _window(hashes: Column, start: Column, size: int, kind: str) -> Column:
    """A window's start, size, fingerprint (place and hash) and two hashes of its lines. Windows of different kinds share none."""
    own = F.array(*(F.get(hashes, start + k) for k in range(size)))  # `slice` would copy the whole array each time
    least = F.array_min(own)
    back = F.array_position(F.reverse(own), least)  # the last of equal ones
    return F.struct(
        start.alias("s"), F.lit(size).alias("r"), (start + size - back.cast("int")).alias("p"), (F.xxhash64(least, F.lit(kind)) if kind else least).alias("f"),
        F.xxhash64(own, F.lit(kind)).alias("a"), F.xxhash64(F.reverse(own), F.lit(kind + "reversed")).alias("b"))


def _windows(hashes: Column, words: Column, run: int, least_words: int) -> Column:
    """Every window of lines that can be a repeated run by itself."""
    n = F.size(hashes)
    at = F.sequence(F.lit(0), n - 1)

    def of_size(size: int) -> Column:
        def enough(s: Column) -> Column:
            has = F.element_at(words, s + 1)
            for k in range(1, size):
                has = has + F.element_at(words, s + 1 + k)
            return (s + size <= n) & (F.lit(True) if size == run else has >= least_words)

        return F.transform(F.filter(at, enough), lambda s: _window(hashes, s, size, ""))

    whole = [F.when(n == size, F.array(_window(hashes, F.lit(0), size, "whole"))).otherwise(F.array().cast(WINDOWS)) for size in range(1, run)]
    return F.concat(*(of_size(size) for size in range(1, run + 1)), *whole)


def repeated_lines(docs: DataFrame, run: int = RUN, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and `_gone`: places (from 0) of the lines of a document that lie in a repeat: a run that starts earlier in the order
    of id and line too, of `run` lines or more, or of fewer lines with `words` words or more; or a whole document of fewer
    lines than `run` that an earlier whole document equals. Blank lines don't count as lines.

    Null ids take no part; null and empty texts have no lines; an empty table gives no rows; texts of any length are done
    whole, in time that grows with their lines.
    """
    lines = docs.select(F.col(id_col).alias("_id"), _lines(F.coalesce(F.col(text_col), F.lit(""))).alias("_lines")).where((F.size("_lines") > 0) & F.col("_id").isNotNull())
    # by `transform`, which is worked out once a row; a mere field of `_lines` would be taken again for every window
    lines = lines.select("_id", F.transform("_lines", lambda x: x.getField("i")).alias("_places"), F.transform("_lines", lambda x: x.getField("h")).alias("_hashes"), F.transform("_lines", lambda x: x.getField("w")).alias("_words"))
    lines = materialize(lines.select("_id", "_places", _windows(F.col("_hashes"), F.col("_words"), run, words).alias("_windows")), "windows")

    # windows in a row that select the same line count once; `array_distinct` would compare all structs with each other
    fresh = F.filter("_windows", lambda w, i: (i == 0) | (F.get("_windows", i - 1).getField("p") != w.getField("p")))
    selected = F.transform(fresh, lambda w: F.struct(w.getField("p").alias("p"), w.getField("f").alias("f")))
    fingerprints = lines.select("_id", F.explode(selected).alias("_x")).select("_id", F.col("_x.p").alias("_p"), F.col("_x.f").alias("_f"))
    several = materialize(fingerprints.groupBy("_f").agg(F.count("*").alias("_n")).where("_n > 1").select("_f"), "fingerprints")
    # positions of fingerprints that occur again, each with the windows that selected it: its lines to either side
    around = lines.select("_id", F.explode("_windows").alias("_w")).select("_id", F.col("_w.f").alias("_f"), F.col("_w.s").alias("_s"), F.col("_w.r").alias("_r"), F.col("_w.a").alias("_a"), F.col("_w.b").alias("_b"))
    met = materialize(join_checked(around, several, "_f", "left_semi").select("_id", "_s", "_r", "_a", "_b"), "met")
    first = met.groupBy("_a", "_b").agg(F.min(F.struct("_id", "_s")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = materialize(first.select(F.col("_a").alias("_c"), F.col("_b").alias("_d"), "_first"), "first")
    later = join_checked(met, first, (F.col("_a") == F.col("_c")) & (F.col("_b") == F.col("_d")), "inner")
    later = later.where(F.struct("_id", "_s") > F.col("_first")).select("_id", F.explode(F.sequence(F.col("_s"), F.col("_s") + F.col("_r") - 1)).alias("_at"))
    gone = materialize(later.distinct().groupBy("_id").agg(F.collect_list("_at").alias("_at")), "later")
    places = lines.select("_id", "_places").dropDuplicates(["_id"])
    return join_checked(places, gone, "_id", "inner").select(F.col("_id").alias(id_col), F.transform("_at", lambda i: F.element_at("_places", i + 1)).alias("_gone"))


def drop_repeated_lines(docs: DataFrame, run: int = RUN, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the repeated lines taken out of their texts; other rows and columns stay as they are.

    Rows with a null id take no part; rows that repeat an id are at the same place in the order, so neither repeats the
    other. A null text stays null. A document may be left with an empty text. An empty table gives no rows; texts of any
    length are done whole, in time that grows with their lines.
    """
    gone, id_, lines, stay = (unused(docs, c) for c in ("_gone", "_of", "_every", "_stay"))
    places = materialize(repeated_lines(docs, run, words, id_col, text_col).select(F.col(id_col).alias(id_), F.col("_gone").alias(gone)), "gone")
    joined = join_checked(docs, places, F.col(id_col) == F.col(id_), "left")
    # the split text is a column of its own, read more than once, so that it is split once a row and not once a line
    joined = joined.withColumn(lines, F.when(F.col(gone).isNotNull(), F.split(F.col(text_col), "\n", -1)))
    joined = joined.withColumn(stay, F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)))
    text = F.when(F.col(gone).isNotNull(), F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")).otherwise(F.col(text_col))
    return joined.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
