"""Operator 3: language-model scoring with an interpolated modified Kneser-Ney bigram model.

Counting: tasks count hashed words and then pairs of word numbers in numpy, Spark shuffles the partial counts by
shard and tasks add them up. A frequent first word's pairs are spread over all shards, so no shard holds one word's
pairs alone. The model is a set of sorted arrays in the shared folder: word hashes with counts, pair keys with
counts, and by word the numbers that discounts and back-off weights need. Scoring memory-maps them and looks up each
distinct pair of a batch once, in key order.

Null texts count as empty: one end token. Repeated rows count each time. Without training rows every token has
probability 1. Tokens: words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, then one end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Arrays, find, summed
from .bpe import _with
from .text import mix, shared_dir, small_batches, text_chunks, word_hashes

_END = np.uint64(0x5851F42D4C957F2D)  # the end token's hash
_START = np.uint64(0xFFFFFFFF)  # the number of what stands before the first word
_FLUSH = 2_000_000  # tokens that a task counts before it sends counts on
_SHARD_BYTES = 8 << 20  # text for each shard of the model


def _tokens(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts, an end after each, and each text's bounds."""
    h, bounds = word_hashes(part)
    out_bounds = bounds + np.arange(len(bounds))
    out = np.full(out_bounds[-1], _END, np.uint64)
    if len(h):
        out[np.arange(len(h)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = h
    return out, out_bounds


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Of values seen once, twice and more often, from how many are seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5
    return tuple(float(min(max(x, 0.05), k - 0.05)) for k, x in enumerate(d, 1))


def _tally(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


@dataclass
class Model:
    arrays: Arrays
    bits: int  # 2**bits shards
    bases: list[int]  # number of the first word of each shard of words, and of all
    tokens: int
    pair_types: int
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    start: tuple[int, int, int, int]  # texts, and pairs seen once, twice, more often after the start
    word_left: float = 0.0  # what discounts take from the counts of words' left neighbours

    @property
    def types(self) -> int:
        return self.bases[-1]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Numbers of distinct ascending hashes; -1 for unknown words."""
        out = np.full(len(h), -1, np.int64)
        for s, a, b in _by_shard(h >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(h), np.uint64)):
            at, there = find(self.arrays.read(f"w{s}.key", np.uint64), h[a:b])
            out[a:b] = np.where(there, at + self.bases[s], -1)
        return out

    def of_words(self, kind: str, ids: np.ndarray) -> np.ndarray:
        """A value by word number; ascending numbers; 0 for unknown words."""
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(np.asarray(self.bases[1:]), ids, "right")
        for s, a, b in _by_shard(np.where(ids < 0, -1, shard)):
            if s >= 0:
                out[a:b] = self.arrays.read(f"w{s}.{kind}", np.int64)[ids[a:b] - self.bases[s]]
        return out

    def shard_of(self, keys: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """By the first word, or by the pair where the first word is frequent."""
        return mix(np.where(frequent, keys, keys >> np.uint64(32))) & np.uint64((1 << self.bits) - 1)

    def is_frequent(self, counts: np.ndarray) -> np.ndarray:
        return counts > self.tokens // (4 << self.bits)

    def pairs(self, keys: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """Counts of distinct ascending pair keys."""
        out, shards = np.zeros(len(keys), np.int64), self.shard_of(keys, frequent)
        order = np.argsort(shards, kind="stable")
        for s, a, b in _by_shard(shards[order]):
            own = order[a:b]
            at, there = find(self.arrays.read(f"p{s}.key", np.uint64), keys[own])
            if there.any():
                out[own[there]] = self.arrays.read(f"p{s}.cnt", np.int64)[at[there]]
        return out

    def score(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: known tokens, base score and model score (log10)."""
        n = len(bounds) - 1
        text = np.repeat(np.arange(n), np.diff(bounds))
        u, at = np.unique(h, return_inverse=True)
        known = self.lookup(u)
        order = np.argsort(known, kind="stable")
        count, types, n1, n2, n3 = (np.zeros(len(u), np.int64) for _ in range(5))
        for kind, values in (("cnt", count), ("typ", types), ("n1", n1), ("n2", n2), ("n3", n3)):
            values[order] = self.of_words(kind, known[order])
        base = np.log10((count + 1) / (self.tokens + self.types + 1))[at]
        d, dw = self.discounts, self.word_discounts
        total = max(self.pair_types, 1)
        taken = np.array([0.0, *dw])[np.minimum(types, 3)]
        left = self.word_left / total if self.pair_types else 1.0
        p_word = ((types - taken) / total + left / (self.types + 1))[at]
        ids = known[at]
        before = np.empty(len(h), np.int64)
        before[1:], first = ids[:-1], bounds[:-1]
        before[first] = _START
        ctx = np.empty((4, len(h)))
        for k, values in enumerate((count, n1, n2, n3)):
            ctx[k, 1:] = values[at][:-1]
            ctx[k, first] = self.start[k]
        seen, some = ctx[0], ctx[0] > 0
        back = np.where(some, (d[0] * ctx[1] + d[1] * ctx[2] + d[2] * ctx[3]) / np.maximum(seen, 1), 1.0)
        asked = some & (ids >= 0) & (before >= 0)
        keys = (before[asked].astype(np.uint64) << np.uint64(32)) | ids[asked].astype(np.uint64)
        uk, one, inv = np.unique(keys, return_index=True, return_inverse=True)
        c = np.zeros(len(h), np.int64)
        c[asked] = self.pairs(uk, self.is_frequent(seen[asked][one]))[inv]
        p = np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0) / np.maximum(seen, 1) + back * p_word
        return (np.bincount(text, count[at] > 0, n).astype(np.int64), np.bincount(text, base, n), np.bincount(text, np.log10(np.maximum(p, 1e-300)), n))


def _by_shard(shards: np.ndarray):
    """(shard, begin, end) of runs."""
    if len(shards):
        cut = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1], [True]]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield int(shards[a]), a, b


def _sent(shards: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each shard: its number and its part of each column as bytes."""
    order = np.argsort(shards, kind="stable")
    rows = [(s, *(x[order[a:b]].tobytes() for x in columns)) for s, a, b in _by_shard(shards[order])]
    kinds = [pa.int32(), *[pa.binary()] * len(columns)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["shard", *(f"c{i}" for i in range(len(columns)))])


def _joined(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in table[name].to_pylist()] or [np.zeros(0, dtype)])


def _counted(batches, text: str, keys_of):
    """Distinct keys with counts of a task's rows, each _FLUSH tokens; keys_of: tokens and bounds to keys."""
    kept, size = [], 0
    for batch in batches:
        for _, part in text_chunks(batch.column(batch.schema.get_field_index(text))):
            kept.append(keys_of(*_tokens(part)))
            size += len(kept[-1])
            if size >= _FLUSH:
                yield np.unique(np.concatenate(kept), return_counts=True)
                kept, size = [], 0
    if size:
        yield np.unique(np.concatenate(kept), return_counts=True)


def learn(df: DataFrame, text: str = "text") -> Model:
    """Count a model over all rows of df. What reaches the driver is a few numbers for each shard."""
    spark = df.sparkSession
    small_batches(spark)
    df = df.select(text)
    size, texts = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)), F.count(F.lit(1))).first()
    bits = int(np.clip(np.ceil(np.log2(size / _SHARD_BYTES + 1)), 3, 20))
    arrays = Arrays(shared_dir(spark, "lm"))

    def count_words(batches):
        for keys, counts in _counted(batches, text, lambda h, _: h):
            yield _sent(keys >> np.uint64(64 - bits), keys, counts)

    def add_words(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        keys, counts = summed(_joined(table, "c0", np.uint64), _joined(table, "c1", np.int64))
        arrays.write(f"w{s}.key", keys)
        arrays.write(f"w{s}.cnt", counts)
        return pa.table({"shard": pa.array([s], pa.int32()), "types": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    parts = df.mapInArrow(count_words, "shard int, c0 binary, c1 binary")
    got = {r[0]: r for r in parts.groupBy("shard").applyInArrow(add_words, "shard int, types bigint, tokens bigint").collect()}
    types = [got[s][1] if s in got else 0 for s in range(1 << bits)]
    for s in set(range(1 << bits)) - set(got):  # shards that no word falls into
        arrays.write(f"w{s}.key", np.zeros(0, np.uint64))
    model = Model(arrays, bits, [0, *np.cumsum(types).tolist()], sum(r[2] for r in got.values()), 0, (0, 0, 0), (0, 0, 0), (texts, 0, 0, 0))
    if model.types >= int(_START):
        raise ValueError("more than 2**32 - 1 distinct words")

    def pair_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        u, at = np.unique(h, return_inverse=True)
        ids = model.lookup(u)[at].astype(np.uint64)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[bounds[:-1]] = _START
        return (before << np.uint64(32)) | ids

    def frequent(keys: np.ndarray) -> np.ndarray:
        ctx = (keys >> np.uint64(32)).astype(np.int64)
        out = np.full(len(keys), model.is_frequent(np.array([texts]))[0])
        words = ctx < int(_START)
        out[words] = model.is_frequent(model.of_words("cnt", ctx[words]))
        return out

    def count_pairs(batches):
        for keys, counts in _counted(batches, text, pair_keys):
            yield _sent(model.shard_of(keys, frequent(keys)), keys, counts.astype(np.uint32))

    def add_pairs(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        keys, counts = summed(_joined(table, "c0", np.uint64), _joined(table, "c1", np.uint32).astype(np.int64))
        arrays.write(f"p{s}.key", keys)
        arrays.write(f"p{s}.cnt", counts)
        ctx = keys >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
        seen = [np.add.reduceat(x.astype(np.int64), first).astype(np.uint32) for x in (counts == 1, counts == 2, counts > 2)]
        words, types = np.unique(keys & _START, return_counts=True)
        ids = np.concatenate([ctx[first], words])
        zero = np.zeros(len(words), np.uint32)
        columns = [np.concatenate([x, zero]) for x in seen] + [np.concatenate([np.zeros(len(first), np.uint32), types.astype(np.uint32)])]
        home = np.where(ids == _START, -1, np.searchsorted(np.asarray(model.bases[1:]), ids.astype(np.int64), "right"))
        sent = _sent(home, ids.astype(np.uint32), *columns)
        tally = np.zeros((len(sent), 5), np.int64)
        tally[0] = [*_tally(counts), len(keys)]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([*sent.columns, pa.array(list(map(bytes, tally)), pa.binary())], [*sent.schema.names, "tally"])])

    def add_stats(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        ids = _joined(table, "c0", np.uint32).astype(np.int64)
        size = 1 if s < 0 else model.bases[s + 1] - model.bases[s]
        ids = np.zeros_like(ids) if s < 0 else ids - model.bases[s]
        values = [np.bincount(ids, _joined(table, f"c{k}", np.uint32), size).astype(np.int64) for k in (1, 2, 3, 4)]
        if s >= 0:
            for kind, x in zip(("n1", "n2", "n3", "typ"), values, strict=True):
                arrays.write(f"w{s}.{kind}", x)
        pairs = _joined(table, "tally", np.int64).reshape(-1, 5).sum(0).tolist()
        own = [*_tally(values[3]), int((values[3] > 2).sum())] if s >= 0 else [0] * 5
        start = [int(x[0]) for x in values[:3]] if s < 0 else [0] * 3
        return pa.table({"v": pa.array([[*pairs, *own, *start]], pa.list_(pa.int64()))})

    parts = df.mapInArrow(count_pairs, "shard int, c0 binary, c1 binary")
    stats = parts.groupBy("shard").applyInArrow(add_pairs, "shard int, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary, tally binary")
    sums = np.sum([r[0] for r in stats.groupBy("shard").applyInArrow(add_stats, "v array<bigint>").collect()] or [[0] * 13], axis=0).tolist()
    there = arrays.names()
    for name in {f"p{s}.key" for s in range(1 << bits)} - there:  # shards that no pair falls into
        arrays.write(name, np.zeros(0, np.uint64))
    model.pair_types, model.discounts = sums[4], _discounts(sums[:4])
    model.word_discounts, model.start = _discounts(sums[5:9]), (texts, *sums[10:13])
    model.word_left = float(np.dot(model.word_discounts, [sums[5], sums[6], sums[9]]))
    return model


def with_lm_score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score (log10 probability) and perplexity."""
    small_batches(df.sparkSession)
    kept, schema = _with(df, "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")

    def run(batches):
        for batch in batches:
            own: list[list[np.ndarray]] = [[], [], [], []]
            for _, part in text_chunks(batch.column(batch.schema.get_field_index(text)), 4 << 20):
                h, bounds = _tokens(part)
                for x, y in zip(own, (np.diff(bounds), *model.score(h, bounds)), strict=True):
                    x.append(y)
            n, known, base, score = (np.concatenate(x) if x else np.zeros(0) for x in own)
            made = [pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(-score / np.maximum(n, 1), 300.0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return kept.mapInArrow(run, schema)
