"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from ..plans.lineage import materialize

#: Lengths of the n-grams and number of buckets they are hashed to.
ORDERS, BUCKETS = (1, 2, 3), 1 << 14
#: Characters hashed together.
BLOCK = 400_000
UNKNOWN = "und"
#: Quantile of the learned rows' mean log-probability per n-gram; a text that lies further below it than SLACK times its own
#: distance from the median is in none of the learned languages.
LOW, SLACK = 0.005, 3

_FACTORS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def held_out(key: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id as text leaves 2 modulo 4, or the id is null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, start of each text's n-grams). Each text stands between spaces."""
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter((len(p) for p in padded), np.int64, len(padded))
    ends = np.cumsum(lengths)
    out = np.empty((len(codes), len(ORDERS)), np.int32)
    mixed = np.zeros(len(codes), np.uint32)
    for k, order in enumerate(ORDERS):
        # an n-gram that would run over its text's end is that of the shorter rest, as a space and zeros follow
        ahead = np.zeros(len(codes), np.uint32)
        ahead[: len(codes) - (order - 1)] = codes[order - 1:]
        for back in range(order - 1):
            ahead[ends - 1 - back] = 0
        mixed = (mixed ^ (ahead * _FACTORS[order - 1])) * np.uint32(0x85EBCA6B)
        out[:, k] = (mixed ^ (mixed >> np.uint32(15))) % np.uint32(BUCKETS)
    return out.reshape(-1), (ends - lengths) * len(ORDERS)


def _blocks(texts: list[str]):
    """Runs of texts (from, to) with BLOCK characters or a single longer text."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield first, k
            first, size = k, 0
        size += len(t) + 2
    if first < len(texts):
        yield first, len(texts)


class Model:
    """Log-probabilities (buckets x languages), log-priors and the smoothed counts behind them."""

    def __init__(self, languages: list[str], log_p: np.ndarray, prior: np.ndarray, counts: np.ndarray):
        self.languages, self.log_p, self.prior, self.counts = languages, log_p, prior, counts

    def typical(self, texts: list[str], languages: list[str]) -> np.ndarray:
        """Mean log-probability per n-gram of each text in its language."""
        out = np.empty(len(texts))
        column = np.searchsorted(self.languages, languages)
        for a, b in _blocks(texts):
            grams, starts = _grams(texts[a:b])
            sizes = np.diff(np.r_[starts, len(grams)])
            out[a:b] = np.add.reduceat(self.log_p[grams, np.repeat(column[a:b], sizes)], starts) / sizes
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        for a, b in _blocks(texts):
            grams, starts = _grams(texts[a:b])
            joint = np.add.reduceat(self.log_p[grams], starts, axis=0) + self.prior
            p = np.exp(joint - joint.max(axis=1, keepdims=True))
            best, score = joint.argmax(axis=1), 1.0 / p.sum(axis=1)
            out += [(self.languages[k], float(s)) if any(map(str.isalpha, t)) else (UNKNOWN, 0.0) for t, k, s in zip(texts[a:b], best, score)]
        return out


def _learned(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """`_text`, `_lang` of the rows that the classifier is fitted on: all that have both and are not held out."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    return labelled.select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))


def floors(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """For each language the mean log-probability per n-gram below which a text is in none of the learned languages.

    Each learned row is measured without its own n-grams, so that rows the model has not seen are as likely.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            texts, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
            found, langs, means = m.predict(texts), [], []
            for t, lang, (best, _) in zip(texts, labels, found):
                if best != lang:
                    continue
                at, own = np.unique(_grams([t])[0], return_counts=True)
                k = m.languages.index(lang)
                n, total = own.sum(), m.counts[:, k].sum()
                langs.append(lang)
                means.append(float((own * np.log((m.counts[at, k] - own) / (total - n))).sum() / n))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(means, pa.float64())], names=["lang", "mean"])

    # a language may hold most of the rows: their means are written and the quantiles found without one task holding them all
    means = materialize(_learned(docs, id_col, text_col, lang_col).mapInArrow(run, "lang string, mean double"), "means")
    return {r["lang"]: r["low"] - SLACK * (r["mid"] - r["low"]) for r in exact_quantiles(means, ["lang"], "mean", {"low": LOW, "mid": 0.5}).collect()}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts n-grams per language on executors; what comes to the driver is a row per language and bucket at most."""
    learned = _learned(docs, id_col, text_col, lang_col)

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            texts, languages = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), object)
            for lang in set(languages):
                own = [texts[i] for i in np.flatnonzero(languages == lang)]
                total = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                total[BUCKETS] += len(own)  # the last place counts texts
                for x, y in _blocks(own):
                    total[:BUCKETS] += np.bincount(_grams(own[x:y])[0], minlength=BUCKETS)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(total[at])], names=["lang", "bucket", "n"])

    counted = learned.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    table = np.zeros((BUCKETS + 1, len(languages)))
    table[counted["bucket"].to_numpy(int), np.searchsorted(languages, counted["lang"].to_numpy(str)) if languages else []] = counted["n"].to_numpy(float)
    smooth = table[:BUCKETS] + 0.5
    return Model(languages, np.log(smooth / smooth.sum(axis=0)), np.log(table[BUCKETS] / max(table[BUCKETS].sum(), 1)) if languages else np.zeros(0), smooth)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of `docs`: id, `held_out`, `lang_pred`, `score` (posterior probability).

    A null text and one without letters get `und` and 0, as does every text if nothing is labelled. Of equally likely
    languages the first by name is taken. Rows with null `lang_col` or null id are not learned from. Repeated rows get
    the same answer; other columns are not read. Whole texts are scored, whatever their length.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col))

    def run(batches):
        for b in batches:
            found = model.value.predict([t or "" for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("_held_out"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", open_set: bool = False) -> DataFrame:
    """The rows of `docs`, with all their columns, whose language is found with a score of at least `least`.

    The score compares the learned languages with each other only. With `open_set` a text also has to be as likely in its
    language as the learned rows are (`floors`), so texts in other languages and noise go.
    """
    model = fit(docs, id_col, text_col, lang_col)
    low = floors(docs, model, id_col, text_col, lang_col) if open_set and model.languages else {}
    model = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            found = model.value.predict(texts)
            keep = np.array([lang != UNKNOWN and score >= least for lang, score in found], bool)
            if low and keep.any():
                some = np.flatnonzero(keep)
                languages = [found[k][0] for k in some]
                keep[some] = model.value.typical([texts[k] for k in some], languages) >= [low.get(lang, -np.inf) for lang in languages]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
