"""Operator 4: exact n-gram Jaccard join by token-combination prefixes, and its components.

A text's set holds its distinct word n-grams. Texts of equal sets are one class. Tokens seen in one task's batch of
classes and counted in Spark fall into frequency classes: unique, rare (at most RARE sets) and frequent. Prefixes put
rare tokens first:

* a text with fewer tokens that are not unique than a link needs cannot link and is not indexed;
* single rare tokens of the standard prefix are indexed; unique ones cannot match and are left out;
* a pair that shares no rare token differs in all its rare ones, so only texts with few of them need more. Their
  prefix is extended by one token, after which a linked pair shares two tokens of it, and each pair of its frequent
  tokens is indexed as one key;
* pairs of tokens grow with the square of the prefix. Where it can be longer than COMBINED, it is extended to the whole
  set instead and split by hash into more parts than a linked pair can differ in tokens. At least one part is then
  equal in both, so each part's combination of frequent tokens is one key. Which form is used depends on size bands; a
  text is in two bands, so linked pairs share one.

Candidates of a key are not all pairs of its texts: each is tested against the key's hub, links are joined to
components, and only keys that still hold several components are tried again: their texts outside the key's largest
component against those of other components, a growing number at a time. A pair that is never tested is in one
component already or ruled out, so no component misses a link. Before a test, parity sketches of the two sets (512
bits, each token flips one) rule out pairs that differ in more bits than linked sets can differ in tokens; where many
texts of a key are tried, the join on keys does so itself. Tests compare whole sets of 64-bit hashes. Joins on keys meet
tables that are stored before, so that Spark can split a key that holds very many texts.

Null and empty texts, and texts without words, have an empty set and link with nothing; so do rows of null id, whose
component is null. Equal texts link; very long texts are taken whole; rows of equal id share what each of them links
with. Other columns of the input are left alone. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Arrays, find, summed
from .text import mix, shared_dir, small_batches, stored, text_chunks, word_hashes

RARE = 16
#: Tokens of the longest extended prefix whose pairs are indexed.
COMBINED = 8
#: Distinct sets that a task remembers; a set met again later is counted again, which only makes its tokens look
#: more frequent, and indexed again.
MET = 200_000
#: Keys of a text, those of most texts first, that tell whether a pair meets at an earlier key.
FIRST = 12
_FLUSH = 2_000_000
_SHARD_BYTES = 8 << 20  # text for each shard of the token classes
_U = np.uint64


def shingle_sets(part: pa.Array, words: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within it, and each text's bounds."""
    h, bounds = word_hashes(part)
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(bounds[1:], sizes) - np.arange(len(h))  # words from here to the text's end
    first = np.arange(len(h)) == np.repeat(bounds[:-1], sizes)
    own = (left >= words) | first
    out = np.zeros(len(h), _U)
    for k in range(words):
        ok = left > k
        out[ok] = mix(out[ok] * _U(0x9E3779B97F4A7C15) + h[np.flatnonzero(ok) + k])
    out, text = out[own], text[own]
    order = np.argsort(out, kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    out, text = out[order], text[order]
    if len(out):
        keep = np.concatenate([[True], (out[1:] != out[:-1]) | (text[1:] != text[:-1])])
        out, text = out[keep], text[keep]
    return out, np.searchsorted(text, np.arange(len(sizes) + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of each stretch."""
    total = np.concatenate([np.zeros(1, _U), np.cumsum(values, dtype=_U)])
    return total[bounds[1:]] - total[bounds[:-1]]


def set_hashes(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _sums(mix(tokens), bounds).view(np.int64), _sums(mix(tokens ^ _U(0xA5A5A5A5A5A5A5A5)), bounds).view(np.int64)


def _placed(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and 48-bit key of ascending tokens; both ascend. From 16 bits of shards on they tell all tokens apart."""
    return (tokens >> _U(64 - bits)).astype(np.int64), (tokens >> _U(max(16 - bits, 0))) & _U((1 << 48) - 1)


class Classes:
    """Frequency classes of tokens: sorted arrays of those in two sets or more, and which of them are frequent."""

    def __init__(self, arrays: Arrays, bits: int):
        self.arrays, self.bits = arrays, bits

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """0 unique, 1 rare, 2 frequent."""
        u, at = np.unique(tokens, return_inverse=True)
        out = np.zeros(len(u), np.int8)
        shard, keys = _placed(u, self.bits)
        cut = np.searchsorted(shard, np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero(np.diff(cut)):
            a, b = cut[s], cut[s + 1]
            where, there = find(self.arrays.read(f"t{s}.key", np.uint64), keys[a:b])
            if there.any():
                out[a:b][there] = 1 + self.arrays.read(f"t{s}.frequent", np.int8)[where[there]]
        return out[at]


def _bytes6(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from6(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _distinct_sets(batches, text: str, words: int, also: list[str] = ()):
    """Of each chunk: values of `also`, tokens, bounds, set hashes, and which sets are new: those that the task has not
    met among the last MET distinct ones, of rows whose first value of `also` isn't null."""
    met: set[tuple[int, int]] = set()
    for batch in batches:
        for first, part in text_chunks(batch.column(batch.schema.get_field_index(text))):
            tokens, bounds = shingle_sets(part, words)
            a, b = set_hashes(tokens, bounds)
            new = np.zeros(len(part), bool)
            own = [batch.column(batch.schema.get_field_index(c)).slice(first, len(part)) for c in also]
            valid = own[0].is_valid().to_pylist() if own else [True] * len(part)
            for i, key in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                if valid[i] and key not in met:
                    if len(met) >= MET:
                        met.clear()
                    met.add(key)
                    new[i] = True
            yield own, tokens, bounds, a, b, new


def token_classes(df: DataFrame, text: str, words: int) -> Classes:
    spark = df.sparkSession
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    bits = int(np.clip(np.ceil(np.log2(size / _SHARD_BYTES + 1)), 3, 20))
    arrays = Arrays(shared_dir(spark, "classes"))

    def send(tokens: list[np.ndarray]):
        keys, counts = np.unique(np.concatenate(tokens), return_counts=True)
        rows = []
        shard, keys = _placed(keys, bits)
        cut = np.searchsorted(shard, np.arange((1 << bits) + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            k, c = keys[cut[s] : cut[s + 1]], counts[cut[s] : cut[s + 1]]
            rows.append((s, _bytes6(k[c == 1]), _bytes6(k[c > 1]), np.minimum(c[c > 1], 1 << 30).astype(np.int32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32(), pa.binary(), pa.binary(), pa.binary()], strict=True)], ["shard", "ones", "more", "counts"])

    def count(batches):
        kept, n = [], 0
        for _, tokens, bounds, _, _, new in _distinct_sets(batches, text, words):
            kept.append(tokens[np.repeat(new, np.diff(bounds))])
            n += len(kept[-1])
            if n >= _FLUSH:
                yield send(kept)
                kept, n = [], 0
        if n:
            yield send(kept)

    def add(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        ones, more = (np.concatenate([_from6(x) for x in table[c].to_pylist()]) for c in ("ones", "more"))
        counts = np.concatenate([np.frombuffer(x, np.int32) for x in table["counts"].to_pylist()])
        keys, counts = summed(np.concatenate([ones, more]), np.concatenate([np.ones(len(ones), np.int64), counts.astype(np.int64)]))
        arrays.write(f"t{s}.key", keys[counts > 1])
        arrays.write(f"t{s}.frequent", (counts[counts > 1] > RARE).astype(np.int8))
        return pa.table({"shard": pa.array([s], pa.int32()), "frequent": pa.array([int((counts > RARE).sum())], pa.int64())})

    got = df.select(text).mapInArrow(count, "shard int, ones binary, more binary, counts binary").groupBy("shard").applyInArrow(add, "shard int, frequent bigint").collect()
    for s in set(range(1 << bits)) - {r[0] for r in got}:
        arrays.write(f"t{s}.key", np.zeros(0, _U))
    return Classes(arrays, bits)


def parity(tokens: np.ndarray) -> np.ndarray:
    """512 bits as 8 longs; a token flips one. Two sets differ in at least as many tokens as their sketches in bits."""
    flips = np.bincount((mix(tokens ^ _U(0x77777777)) >> _U(55)).astype(np.int64), minlength=512)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def prefix_keys(tokens: np.ndarray, kinds: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index keys of one set (ascending tokens): rare single tokens, and combinations where those are few."""
    n = len(tokens)
    least = -(-num * n // den)
    if (kinds > 0).sum() < least:  # a linked text shares this many, and nobody shares unique ones
        return np.zeros(0, _U)
    rare = tokens[kinds < 2]
    single = mix(tokens[kinds == 1][: n - least + 1]) if len(rare) == n else mix(rare[: n - least + 1][kinds[kinds < 2][: n - least + 1] == 1])
    # the most tokens that a linked text of any size can differ in: n * (1 - t) / t
    if len(rare) > n * (den - num) // num:
        return single
    often, out = tokens[kinds == 2], [single]
    width = 1.02 * den / num  # of a size band: linked sizes are in one band or in neighbours
    at = int(np.log(n) / np.log(width))
    for band in (at, at + 1):
        largest = int(width ** (band + 1)) + 1
        if largest + 2 - num * largest // den <= COMBINED:
            own = tokens[np.argsort(kinds == 2, kind="stable")[: n - least + 2]]  # rare ones first, each by hash
            own = np.sort(own[np.isin(own, often)])
            a, b = np.triu_indices(len(own), 1)
            out.append(mix(mix(own[a]) + _U(3) * mix(own[b]) + mix(_U(band) + _U(1 << 61))))
            continue
        differ = 2 * largest * (den - num) // (den + num)
        parts = differ + 1 + differ // 6
        part = (mix(often ^ _U(0x1234567)) % _U(parts)).astype(np.int64)
        sums = np.zeros(parts, _U)
        np.add.at(sums, part, mix(often))
        keys = mix(sums + mix(np.arange(parts, dtype=_U) + _U(band << 32) + _U(1 << 60)))
        full = np.bincount(part, minlength=parts) > 0
        # parts - differ of them are equal at least; empty ones need a key only if those could all be empty
        out.append(keys if parts - differ <= (~full).sum() else keys[full])
    return np.concatenate(out)


def index(df: DataFrame, classes: Classes, key: str, text: str, words: int, num: int, den: int) -> DataFrame:
    """Per row: id, n, set hashes s1 and s2; of one row of each set and task also keys, parity and tokens."""

    def run(batches):
        for (ids,), tokens, bounds, a, b, new in _distinct_sets(batches, text, words, [key]):
            kinds = classes.of(tokens) if len(tokens) else np.zeros(0, np.int8)
            keys: list = [None] * len(a)
            sets: list = [None] * len(a)
            bits: list = [None] * len(a)
            for i in np.flatnonzero(new & (np.diff(bounds) > 0)).tolist():
                own = slice(bounds[i], bounds[i + 1])
                found = prefix_keys(tokens[own], kinds[own], num, den)
                if len(found):
                    keys[i], sets[i], bits[i] = np.unique(found).view(np.int64), tokens[own].tobytes(), parity(tokens[own])
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(a), pa.array(b), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["id", "n", "s1", "s2", "keys", "bits", "tokens"])

    return df.select(key, text).mapInArrow(run, "id bigint, n bigint, s1 bigint, s2 bigint, keys array<bigint>, bits array<bigint>, tokens binary")


def tested(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs: a, b. Adds linked: den * intersection >= num * union, over whole sets (id, tokens)."""

    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    rows = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, linked boolean")


def sizes_allow(n: str, m: str, num: int, den: int):
    return (F.col(n) * den >= F.col(m) * num) & (F.col(m) * den >= F.col(n) * num)


def sketches_allow(x: str, y: str, n, num: int, den: int):
    """Whether parity sketches x and y of two sets, whose sizes add up to n, allow a link."""
    differ = sum(F.bit_count(F.get(x, i).bitwiseXOR(F.get(y, i))) for i in range(8))
    return differ * (den + num) <= n * (den - num)


def met(work: DataFrame, sketches: DataFrame | None = None, num: int = 90, den: int = 100) -> DataFrame:
    """Texts of a key that a round tries, as hub and hub_n, with its texts of other components.

    work: key, id, n, comp, c (texts of the key), tries. A pair that shares several keys is met at the first of them, in
    one order for all keys, as far as each text's FIRST tell it: it either is tried there or stays open there. With
    sketches (id, bits) the join itself leaves out pairs that cannot link, so its rows are about the pairs to be tested
    and not the square of a key's texts.
    """
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("few"), "key"))), 1, FIRST)["key"]
    own = work.groupBy("id").agg(first.alias("first"))
    own = own.withColumn("bits", F.lit(None).cast("array<bigint>")) if sketches is None else own.join(sketches.select("id", "bits"), "id")
    rows = work.select("key", "id", "n", "comp", "tries").join(own, "id")
    hubs = rows.where("tries").select("key", F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"), F.col("first").alias("hub_first"), F.col("bits").alias("hub_bits"))
    here = F.coalesce(F.get(F.array_intersect("first", "hub_first"), 0), F.col("key")) == F.col("key")
    both = rows.join(hubs, "key").where(F.col("comp") != F.col("hub_comp"))
    if sketches is not None:
        both = both.where(sizes_allow("n", "hub_n", num, den) & sketches_allow("bits", "hub_bits", F.col("n") + F.col("hub_n"), num, den))
    return both.where(here).select("key", "id", "n", "hub", "hub_n")


def components(links: DataFrame) -> DataFrame:
    """links: a, b. The smallest id reachable from each id that has a link: id, comp."""
    edges = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    labels = stored(edges.groupBy(F.col("u").alias("id")).agg(F.least("id", F.min("v")).alias("comp")), "labels")
    while True:
        best = edges.join(labels, edges["v"] == labels["id"]).groupBy("u").agg(F.min("comp").alias("near"))
        new = labels.join(best, labels["id"] == best["u"]).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("beyond"))
        new = stored(new.join(jump, "comp", "left").select("id", "old", F.coalesce("beyond", "comp").alias("comp")), "labels")
        labels = new.select("id", "comp")
        if new.where("comp <> old").isEmpty():
            return labels


def linked_groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per row of df: key as doc_id, n_shingles and component_id, the smallest id reachable by links (its own included).

    Two rows link when den * intersection >= num * union of their shingle sets.
    """
    if not 0 < num < den:
        raise ValueError("the threshold num / den must be between 0 and 1")
    spark = df.sparkSession
    small_batches(spark)
    rows = stored(index(df, token_classes(df, text, words), key, text, words, num, den), "index")
    # classes of equal sets; `id` is the row that holds the class's keys and tokens
    held = F.when(F.col("keys").isNotNull(), F.col("id"))
    classes = stored(rows.where("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min(held).alias("id")), "sets")
    sets = rows.where("keys is not null").select("id", "keys", "bits", "tokens")
    members = classes.where("id is not null").select("id", "n", "copies")
    entries = sets.select("id", "keys").join(members, "id").select(F.explode("keys").alias("key"), "id", "n", "copies")

    def ordered(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    def alike(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs a, b with the sum n of their sizes, those whose parity sketches allow a link."""
        x, y = (sets.select(F.col("id").alias(c), F.col("bits").alias(f"{c}_bits")) for c in ("a", "b"))
        return pairs.join(x, "a").join(y, "b").where(sketches_allow("a_bits", "b_bits", F.col("n"), num, den)).select("a", "b")

    def same_texts(rows: DataFrame, *of: str) -> DataFrame:
        """One key of those whose c texts are the same, told by two 64-bit hashes x and y: they lead to the same pairs."""
        return rows.groupBy("c", "x", "y").agg(F.min("key").alias("key"), *[F.min(c).alias(c) for c in of]).drop("x", "y")

    hashes = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(c) for i, c in enumerate("xy")]
    least = F.min(F.struct((-F.col("copies")).alias("few"), "id", "n")).alias("h")
    hubs = same_texts(entries.groupBy("key").agg(F.count(F.lit(1)).alias("c"), least, *hashes).where("c > 1"), "h")
    hubs = stored(hubs.select("key", F.col("h.id").alias("hub"), F.col("h.n").alias("hub_n")), "hubs")
    work = stored(entries.select("key", "id", "n").join(hubs, "key").where(F.col("id") != F.col("hub")), "work")
    pairs = alike(work.where(sizes_allow("n", "hub_n", num, den)).select(*ordered("hub", "id"), (F.col("n") + F.col("hub_n")).alias("n")).distinct())
    tests = stored(tested(pairs, sets, num, den), "tests")
    done = [tests]
    comp = components(tests.where("linked").select("a", "b"))
    left = work.select("key", "id", "n")
    most = RARE
    while True:
        # a key is open while its texts are in several components; its texts outside the largest are tried against all
        left = left.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        sizes = left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"), *hashes)
        sizes = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("big"), F.sum("m").alias("c"), *[F.bit_xor(c).alias(c) for c in "xy"]).where("big.m < c")
        sizes = stored(same_texts(sizes, "big"), "open")
        work = left.join(sizes.select("key", "c", (F.col("c") - F.col("big.m")).alias("rest"), F.col("big.comp").alias("big")), "key")
        tried = F.pmod(F.xxhash64("id", F.lit(most)), F.ceil(F.col("rest") / most)) == 0
        work = stored(work.withColumn("tries", (F.col("comp") != F.col("big")) & tried), "work")
        if work.isEmpty():
            break
        # stored, since Spark would take the tested pairs out before it makes the pairs distinct
        pairs = stored(met(work, sets, num, den).select(*ordered("hub", "id")).distinct(), "pairs")
        for x in done:
            pairs = pairs.join(x.select("a", "b"), ["a", "b"], "left_anti")
        tests = stored(tested(pairs, sets, num, den), "tests")
        done.append(tests)
        if not tests.where("linked").isEmpty():
            every = done[0]
            for x in done[1:]:
                every = every.unionByName(x)
            comp = components(every.where("linked").select("a", "b"))
        left = work.where(~F.col("tries") & (F.col("rest") > most)).select("key", "id", "n")
        most *= 8
    # a component's id is the smallest id of all rows of its classes
    named = classes.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id", "rep"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "comp").select("s1", "s2", F.col("n").alias("n_set"), "component_id")
    out = rows.select("id", "n", "s1", "s2")
    some = out.where("n > 0 and id is not null").join(named, ["s1", "s2"]).where("n = n_set").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(out.where("n = 0 or id is null").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
