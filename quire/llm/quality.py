"""Operator 2: quality classifier, a sparse rule ensemble.

Boosted small trees over text statistics give root-to-node paths; each path is a conjunctive rule. Lasso logistic
regression keeps few of them with weights, and the kept rules are compiled into one Spark column expression. The
statistics are column expressions too, so scoring runs in the JVM in one pass, without a shuffle.

Null and empty texts have all statistics 0 and get a score like any other row; very long texts are read whole; equal
texts get equal scores. Labels that are null or not 0/1 do not teach; of repeated labels for one id the highest counts.
Without both classes, or where no statistic tells them apart, every score is the share of 1. Columns of the input named
score or predicted are replaced, others left alone. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fresh

#: Labelled rows that the rules are learned from, at most: those of lowest xxhash64(doc_id).
SAMPLE_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.split(F.trim(t), r"\s+")
    n = F.when(F.length(F.trim(t)) == 0, 0).otherwise(F.size(words)).cast("double")

    def share(chars: str) -> Column:
        return F.regexp_count(t, F.lit(f"[{chars}]")) / size

    return {
        "chars": F.length(t).cast("double"),
        "words": n,
        "word_size": F.length(t) / F.greatest(n, F.lit(1.0)),
        "distinct": F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1.0)),
        "upper": F.regexp_count(t, F.lit(r"\p{Lu}")) / size,
        "symbols": share(r"#$%&*@~^_=+<>\\/{}\[\]"),
        "shouts": share("!?"),
        "bars": share("|"),
        "digits": share("0123456789"),
        "stops": share(".,;:"),
        "breaks": (F.size(F.split(t, "\n")) - 1) / size,
        "repeats": F.regexp_count(t, F.lit(r"(?<!\S)(\S+)\s\1(?!\S)")) / F.greatest(n, F.lit(1.0)),
    }


@dataclass
class Rules:
    """Conjunctions of (statistic, at most or above, bound) with weights; score = sigmoid(bias + sum of weights that hold)."""

    bias: float
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]]

    def column(self, of: dict[str, Column]) -> Column:
        total = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, at_most, bound in conditions:
                holds = holds & ((of[name] <= float(bound)) if at_most else (of[name] > float(bound)))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, f: np.ndarray, rate: float) -> None:
    """One regression tree on gradients; appends paths to out and adds leaf values to f."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, -1, 0)
    if depth and len(rows) >= 40:
        for j, c in enumerate(cuts):
            if len(c):
                sg = np.cumsum(np.bincount(bins[rows, j], g[rows], len(c) + 1))[:-1]
                sh = np.cumsum(np.bincount(bins[rows, j], h[rows], len(c) + 1))[:-1]
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                k = int(np.argmax(np.where((sh > 1) & (total_h - sh > 1), gain, -1)))
                if gain[k] > best[0] and sh[k] > 1 and total_h - sh[k] > 1:
                    best = (float(gain[k]), j, k)
    if best[1] < 0:
        f[rows] -= rate * total_g / (total_h + 1)
        return
    _, j, k = best
    low = bins[rows, j] <= k
    for at_most, part in ((True, rows[low]), (False, rows[~low])):
        own = (*path, (j, at_most, float(cuts[j][k])))
        out.append(own)
        _grow(x, cuts, bins, g, h, part, depth - 1, own, out, f, rate)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, penalty: float = 1e-3, steps: int = 400) -> Rules:
    p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    bias_of_all = math.log(p / (1 - p))
    if not len(y) or y.min() == y.max():
        return Rules(bias_of_all, [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64))) for j in range(x.shape[1])]
    cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    f, paths = np.full(len(y), math.log(p / (1 - p))), []
    rng = np.random.default_rng(7)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        rows = np.sort(rng.choice(len(y), max(1, int(len(y) * 0.7)), replace=False))
        _grow(x, cuts, bins, q - y, q * (1 - q) + 1e-9, rows, depth, (), paths, f, 0.2)
    paths = list(dict.fromkeys(tuple(sorted(set(p))) for p in paths))
    if not paths:  # too few labels, or statistics that tell nothing apart
        return Rules(bias_of_all, [])
    holds = np.ones((len(paths), len(y)), bool)
    for i, path in enumerate(paths):
        for j, at_most, bound in path:
            holds[i] &= (x[:, j] <= bound) == at_most
    # the same rows hold for rules that differ in words only: keep the shortest
    kept: dict[bytes, int] = {}
    for i in sorted(range(len(paths)), key=lambda i: (len(paths[i]), i)):
        kept.setdefault(np.packbits(holds[i]).tobytes(), i)
    paths, holds = [paths[i] for i in sorted(kept.values())], holds[sorted(kept.values())].astype(np.float32)
    # rules are standardized without a second matrix: z = (holds - mean) / spread
    mean = holds.mean(1, dtype=float)
    spread = np.sqrt(mean * (1 - mean)) + 1e-6
    w, bias = np.zeros(len(paths)), math.log(p / (1 - p))
    v, vb, t = w.copy(), bias, 1.0
    both = (holds @ holds.T / len(y) - np.outer(mean, mean)) / np.outer(spread, spread)
    pace = 4 / (np.linalg.eigvalsh(both)[-1] + 1)
    for _ in range(steps):  # accelerated proximal gradient
        u = v / spread
        r = 1 / (1 + np.exp(-((u.astype(np.float32) @ holds).astype(float) - u @ mean + vb))) - y
        grad = ((holds @ r.astype(np.float32)).astype(float) - mean * r.sum()) / spread
        new = v - pace * grad / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - pace * penalty, 0)
        new_b = vb - pace * r.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - bias)
        w, bias, t = new, new_b, t2
    weights = w / spread
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return Rules(float(bias - (weights * mean).sum()), [(tuple((names[j], a, b) for j, a, b in paths[i]), float(weights[i])) for i in used])


def learn(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Rules:
    """labels: the rows to learn from (key, label). At most sample_rows of them reach the driver, as statistics."""
    taught = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("double").alias("_y"))
    taught = taught.orderBy(F.xxhash64("_key"), "_key").limit(sample_rows)
    of = statistics(F.col(text))
    rows = df.select(F.col(key).alias("_key"), text).join(F.broadcast(taught), "_key").select("_y", *[c.alias(n) for n, c in of.items()])
    got = rows.orderBy(F.xxhash64("_y", *of)).limit(2 * sample_rows).toPandas()
    return fit(got[list(of)].to_numpy(float), got["_y"].to_numpy(float), list(of))


def with_quality(df: DataFrame, rules: Rules, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds score double (0 to 1) and predicted int (1 if score >= threshold); columns of these names are replaced.

    Statistics are made as one struct behind a generator, which no later filter is pushed through: a filter on the
    score reads the struct and doesn't work out each statistic again for each rule.
    """
    of = statistics(F.col(text))
    kept = [c for c in df.columns if c.lower() not in ("score", "predicted")]
    own = fresh(df, "stats")
    out = df.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(F.struct(*[c.alias(n) for n, c in of.items()]))).alias(own))
    out = out.withColumn("score", rules.column({n: F.col(own)[n] for n in of})).drop(own)
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
