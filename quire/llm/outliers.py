"""Operator 11: quality rules by robust multivariate outliers.

Every text gets counts (words, symbols, repeated lines and word windows and others), made into a vector of shares whose
spread hardly depends on a text's length. For each language and source the minimum covariance determinant is sought by
concentration steps over all rows that pass the base rules: distances under the present estimate, the COVER nearest rows
of each group, their mean and covariance, again. Texts whose Mahalanobis distance is beyond the chi-squared bound of
`tail` are rejected.

A step is one aggregation. Rows are summed by group and by the binary logarithm of their distance in eighths, so the
nearest rows are told from a few hundred sums for each group, and neither a group nor a sample of it comes together
anywhere; a bin is taken whole. A group of few rows is drawn towards its language, and that towards the whole, by
SHRINK rows; SPREAD is added to every deviation, since most texts have no symbols or repeated lines at all and would
leave a singular matrix. Steps begin at each language's medians and quartiles.

Null and empty texts have no words and fail the base rules. A null language or source counts as ''. Equal texts of one
group, repeated rows too, get equal verdicts; each row counts. Lines and words are compared by 64-bit hashes. Columns
of the input other than the four named are not read. An empty table gives no rows.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .text import CHUNK_BYTES, mix, spans_hash, stored, text_chunks, utf8

#: Base rules: least words, words of a repeated window, and the share (of 100) of words in such windows at most.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: Share of a group's rows that are nearest, concentration steps, rows by which groups are drawn to what is above them.
COVER, STEPS, SHRINK = 0.75, 6, 50
#: Chance of a text of the normal model to be rejected.
TAIL = 1e-4
#: Words that are taken as ordinary besides a text's own, so that few words make no extreme shares.
PRIOR = 20
#: The least standard deviation of each statistic, in the order of `vector`.
SPREAD = [0.08, 0.03, 0.05, 0.05, 0.12, 0.16, 0.03]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_stops"]
_U64 = np.uint64


def _marks(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SPACE, _SYMBOL, _STOP = _marks(" \t\n\x0b\x0c\r"), _marks("#*$%&|<>"), _marks(".,;:!?\"")
_UPPER = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _hashed(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """spans_hash over stretches, so that a very long text doesn't fill a worker."""
    out, a = [np.zeros(0, _U64)], 0
    while a < len(begins):
        b = max(a + 1, int(np.searchsorted(ends, begins[a] + CHUNK_BYTES, "right")))
        out.append(spans_hash(buf[begins[a] : ends[b - 1]], begins[a:b] - begins[a], ends[a:b] - begins[a]))
        a = b
    return np.concatenate(out)


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each text has."""
    _, first = np.unique(keys ^ mix(doc.astype(_U64)), return_index=True)
    return np.bincount(doc[first], minlength=n)


def counts(col: pa.Array) -> np.ndarray:
    """COUNTS of each text, one column for each."""
    n = len(col)
    buf, off = utf8(col)
    out = np.zeros((len(COUNTS), n), np.int64)
    if not len(buf):
        return out.T
    space = _SPACE[buf]
    texts = np.repeat(np.arange(n), np.diff(off))
    edge = np.zeros(len(buf) + 1, bool)  # where a text begins
    edge[off] = True
    first = ~space & (np.concatenate([[True], space[:-1]]) | edge[:-1])
    last = ~space & (np.concatenate([space[1:], [True]]) | edge[1:])
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc, words = texts[begins], _hashed(buf, begins, ends)
    out[0] = np.bincount(doc, minlength=n)
    point = (buf & 0xC0) != 0x80
    capital = _UPPER[buf]
    capital[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    for k, held in ((1, point & ~space), (2, _SYMBOL[buf]), (7, capital), (8, _STOP[buf])):
        out[k] = np.bincount(texts[held], minlength=n)
    # lines that have a word; edges and breaks end them
    begin = np.flatnonzero(edge[:-1] | np.concatenate([[False], buf[:-1] == 10]))
    end = np.concatenate([begin[1:], [len(buf)]])
    end = end - (buf[end - 1] == 10)
    held = np.searchsorted(begins, begin) < np.searchsorted(begins, end)
    begin, end = begin[held], end[held]
    out[5] = np.bincount(texts[begin], minlength=n)
    out[3] = out[5] - _distinct(_hashed(buf, begin, end), texts[begin], n)
    out[6] = _distinct(words, doc, n)
    if len(words) >= WINDOW:
        size = len(words) - WINDOW + 1
        window = np.zeros(size, _U64)
        for k in range(WINDOW):
            window = window * _U64(0x9E3779B97F4A7C15) + words[k : k + size]
        at = np.flatnonzero(doc[:size] == doc[WINDOW - 1 :])
        _, kind, often = np.unique(mix(window[at]) ^ mix(doc[at].astype(_U64)), return_inverse=True, return_counts=True)
        covered, again = np.zeros(len(words) + 1, np.int64), at[often[kind] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + WINDOW, -1)
        out[4] = np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=n)
    return out.T


def with_counts(df: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    """key, lang, source and COUNTS."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = [counts(part) for _, part in text_chunks(batch.column(3))]
            made = np.concatenate(made) if made else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(np.ascontiguousarray(c)) for c in made.T]], ["key", "lang", "source", *COUNTS])

    asked = df.select(F.col(key).alias("key"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    return asked.mapInArrow(run, f"key {kind}, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def vector() -> list[Column]:
    """From COUNTS: length of words, shares of symbols, capitals, stops, repeated lines and repeated words, and how
    different words are."""
    letters, words = F.col("word_chars") + 5 * PRIOR, F.col("n_words") + PRIOR
    shares = [F.sqrt(F.col(c) / size) for c, size in (("n_symbols", letters), ("n_capitals", letters), ("n_stops", letters), ("n_dup_lines", F.col("n_lines") + PRIOR / 2), ("n_repeat_words", words))]
    return [F.log(letters / words), *shares, F.log(F.col("n_distinct") + 1) / F.log(F.col("n_words") + 2)]


P = len(SPREAD)
_UP = [(i, j) for i in range(P) for j in range(i, P)]
_X = [f"x{i}" for i in range(P)]
GROUP = ["lang", "source"]


def chi2(q: float, p: int = P) -> float:
    """Quantile of the chi-squared distribution, by the cube of a normal one (within a hundredth from p = 3 on)."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * (2 / (9 * p)) ** 0.5) ** 3


def _estimate(sums: np.ndarray, mean: np.ndarray | None = None, cov: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances from rows of sums (rows, values, products), drawn to those above by SHRINK rows."""
    n = sums[:, :1]
    own = sums[:, 1 : P + 1] / np.maximum(n, 1)
    square = np.zeros((len(sums), P, P))
    for k, (i, j) in enumerate(_UP):
        square[:, i, j] = square[:, j, i] = sums[:, P + 1 + k] / np.maximum(n[:, 0], 1)
    square -= own[:, :, None] * own[:, None, :]
    if mean is None:
        return own, square
    part = n / (n + SHRINK)
    return part * own + (1 - part) * mean, part[:, :, None] * square + (1 - part[:, :, None]) * cov


def _inverse(cov: np.ndarray) -> np.ndarray:
    """Upper triangles of the inverses, off the diagonal twice, so that distances are sums of products."""
    inv = np.linalg.inv(cov + np.diag(np.square(SPREAD)))
    return np.stack([inv[:, i, j] * (1 if i == j else 2) for i, j in _UP], 1)


def _models(found: DataFrame) -> DataFrame:
    """found: GROUP, cut, sums (of its nearest rows). GROUP, scale, mean, inverse."""
    each = [F.sum(F.get("sums", F.lit(k))) for k in range(1 + P + len(_UP))]
    total = np.array(found.agg(*[x.alias(f"s{k}") for k, x in enumerate(each)]).first(), float)[None]  # one row
    by_lang = found.groupBy("lang").agg(F.array(*each).alias("above"))

    def run(frames):
        top = _estimate(total)
        for f in frames:
            if len(f):
                mean, cov = _estimate(np.stack(f["sums"].to_list()), *_estimate(np.stack(f["above"].to_list()), *top))
                yield pd.DataFrame({"lang": f["lang"], "source": f["source"], "scale": np.maximum(1.0, f["cut"] / chi2(COVER)), "mean": list(mean), "inverse": list(_inverse(cov))})

    return found.join(by_lang, "lang").mapInPandas(run, "lang string, source string, scale double, mean array<double>, inverse array<double>")


def _begin(rows: DataFrame) -> DataFrame:
    """GROUP, scale, mean, inverse from medians and quartiles of each language, statistic by statistic."""
    parts = rows.groupBy("lang").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in _X])

    def run(frames):
        for f in frames:
            if len(f):
                q = np.stack([np.stack(f[x].to_list()) for x in _X], 1)
                cov = np.zeros((len(f), P, P))
                cov[:, range(P), range(P)] = np.square((q[:, :, 2] - q[:, :, 0]) / 1.349)
                yield pd.DataFrame({"lang": f["lang"], "mean": list(q[:, :, 1]), "inverse": list(_inverse(cov))})

    known = parts.mapInPandas(run, "lang string, mean array<double>, inverse array<double>")
    return rows.select(*GROUP).distinct().join(known, "lang").select(*GROUP, F.lit(1.0).alias("scale"), "mean", "inverse")


def _far(rows: DataFrame, models: DataFrame) -> DataFrame:
    """rows with d2, the squared distance under the model of their group. Models are as many as groups; Spark sends
    them to all tasks if their measured size allows, and else splits groups that are too large for one."""
    both = rows.join(models, GROUP, "left")
    d = [F.col(x) - F.get("mean", F.lit(i)) for i, x in enumerate(_X)]
    return both.withColumn("d2", sum((d[i] * d[j] * F.get("inverse", F.lit(k)) for k, (i, j) in enumerate(_UP)), F.lit(0.0)))


def _nearest(rows: DataFrame, models: DataFrame) -> DataFrame:
    """GROUP, cut, sums: of the rows of each group that are nearest under its model."""
    bins = _far(rows, models).withColumn("bin", F.floor(8 * F.log2(F.greatest("d2", F.lit(1e-9)))).cast("int"))
    values = [F.lit(1.0), *map(F.col, _X), *[F.col(_X[i]) * F.col(_X[j]) for i, j in _UP]]
    made = bins.groupBy(*GROUP, "bin").agg(*[F.sum(v).alias(f"s{k}") for k, v in enumerate(values)])
    w = W.partitionBy(*GROUP).orderBy("bin")  # a few hundred bins for each group
    made = made.withColumns({"before": F.sum("s0").over(w) - F.col("s0"), "all": F.sum("s0").over(W.partitionBy(*GROUP))}).where(F.col("before") < COVER * F.col("all"))
    sums = made.groupBy(*GROUP).agg(F.max("bin").alias("bin"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(len(values))])
    return stored(sums.select(*GROUP, F.pow(F.lit(2.0), (F.col("bin") + 1) / 8).alias("cut"), F.array(*[f"s{k}" for k in range(len(values))]).alias("sums")), "nearest")


def verdicts(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", tail: float = TAIL, steps: int = STEPS) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and distance (squared; null
    where no row of its language and source passes the base rules)."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = stored(with_counts(df, key, text, lang, source), "counts").withColumn("base_failed", failed)
    rows = rows.withColumns(dict(zip(_X, vector(), strict=True)))
    taught = rows.where(~F.col("base_failed")).select(*GROUP, *_X)
    models = stored(_begin(taught), "models")
    for _ in range(steps):
        found = _nearest(taught, models)
        if found.isEmpty():
            break
        models = stored(_models(found), "models")
    distance = F.col("d2") / F.col("scale")
    return _far(rows, models).select(F.col("key").alias(key), *COUNTS[:5], "base_failed", (~F.col("base_failed") & F.coalesce(distance <= chi2(1 - tail), F.lit(False))).alias("kept"), distance.alias("distance"))
