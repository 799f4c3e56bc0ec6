"""Operator 9: document fingerprints, a homomorphic multiset hash in DataFrame functions only.

A text's paragraphs (lines, cut again after sentence ends and after each eight words) are a multiset; white space
around them does not count. In scripts without spaces a code point is a word, and longer words count as one for each
24 code points, so texts without any space are cut too. Each is hashed into a wide vector, and
vectors are summed lane by lane modulo a power of two: 8 wide lanes of 32 bits that tell multisets apart, and 128
narrow lanes of 32 bits that count hash bits, packed two to a long. Sums do not depend on order, and adding or
subtracting a paragraph's vector inserts or deletes it. Narrow lanes, read as signs, are a random projection of the
multiset, so their cosine tells how alike two texts are; equal fingerprints have likeness 1.

Null texts count as empty; an empty text has the zero fingerprint, which is like itself only. Equal texts, repeated
rows too, have equal fingerprints. Other columns of the input are left alone. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .text import fresh

WIDE, PACKS = 4, 64
#: One bit in each of a long's two narrow lanes. A lane counts paragraphs of one text, which are fewer than 2**30: a text
#: has less than 2**31 bytes, and a paragraph and what parts it from the next two at least. So no lane runs over.
_ONE, _LANE = 0x0000000100000001, 32
_LOW = 0xFFFFFFFF


#: A word: at most 24 code points of it at a time. From U+0E00 on, where the scripts without spaces are, each code
#: point counts as one. No part of the pattern gives back what it has taken, so a scan is linear.
_WORD = r"(?:[\x21-\u0DFF]{1,24}+|\S)"


def paragraphs(text: Column) -> Column:
    """Runs of at most eight words of one line and sentence, in the text's order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{_WORD}(?:(?<![.!?。！？])[^\S\n]*+{_WORD}){{0,7}}+"), 0)


def hashes(text: Column) -> Column:
    """Two 64-bit hashes of each paragraph. Give it a column of its own before lanes() reads it many times."""
    return F.transform(paragraphs(text), lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit("b"), p).alias("b")))


def lanes(hashed: Column) -> Column:
    """The fingerprint as array<bigint>: wide lanes, number of paragraphs, packs of narrow lanes."""

    def total(f) -> Column:
        return F.aggregate(hashed, F.lit(0).cast("bigint"), lambda acc, h: acc + f(h))

    def wide(k: int):
        return lambda h: h["a"] if k == 0 else h["b"] if k == 1 else F.xxhash64(F.lit(k), h["a"], h["b"])

    low = [total(lambda h, k=k: wide(k)(h).bitwiseAND(F.lit(_LOW))).bitwiseAND(F.lit(_LOW)) for k in range(WIDE)]
    high = [total(lambda h, k=k: F.shiftrightunsigned(wide(k)(h), 32)).bitwiseAND(F.lit(_LOW)) for k in range(WIDE)]
    packs = [total(lambda h, j=j: F.shiftrightunsigned(h["a"] if j < _LANE else h["b"], j % _LANE).bitwiseAND(F.lit(_ONE))) for j in range(PACKS)]
    return F.array(*low, *high, F.size(hashed).cast("bigint"), *packs)


def _lane(pack: Column, k: int) -> Column:
    return F.shiftrightunsigned(pack, _LANE * k).bitwiseAND(F.lit(_LOW))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union of two multisets (sign 1), or of a without b (sign -1), lane by lane."""
    wide = [F.pmod(F.get(a, i) + sign * F.get(b, i), F.lit(1 << 32)) for i in range(2 * WIDE)]
    packs = []
    for j in range(PACKS):
        x, y = F.get(a, 2 * WIDE + 1 + j), F.get(b, 2 * WIDE + 1 + j)
        parts = [F.shiftleft(F.pmod(_lane(x, k) + sign * _lane(y, k), F.lit(1 << _LANE)), _LANE * k) for k in range(2)]
        packs.append(parts[0].bitwiseOR(parts[1]))
    return F.array(*wide, F.get(a, 2 * WIDE) + sign * F.get(b, 2 * WIDE), *packs)


def hexed(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.lower(F.hex(x))), ".")


def signs(v: Column) -> Column:
    """Narrow lanes as sums of signs: twice the count less the number of paragraphs."""
    n = F.get(v, 2 * WIDE)

    def sign(pack: Column, k: int) -> Column:
        return (2 * _lane(pack, k) - n).cast("double")

    return F.flatten(F.transform(F.slice(v, 2 * WIDE + 2, PACKS), lambda p: F.array(*[sign(p, k) for k in range(2)])))


def likeness(a: Column, b: Column, x: Column | None = None, y: Column | None = None) -> Column:
    """Cosine of signs(a) and signs(b) (x and y, where they are columns already), 0 to 1; 1 for equal fingerprints."""
    x, y = signs(a) if x is None else x, signs(b) if y is None else y

    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, s: acc + s)

    norm = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)))


#: Rows without a key are dealt by their text into so many blocks.
NULL_BLOCKS = 1 << 16


def with_next_text(df: DataFrame, key: str, text: str, carry: list[str], block_bits: int = 6) -> DataFrame:
    """Adds next_<c> for text and each carried column, of the row that follows by key (after the last: the first).

    The table is shuffled once, by blocks of key values; a window finds what follows within a block. Only the last
    row of each block meets the first row of the next one, in a join of one row for each block, read from the same
    shuffle. Which block is next is found from keys alone. Rows of equal key follow one another, ordered by text and
    in one block; rows of null key come last, in an order of their own by text.
    """
    at, block = fresh(df, "at"), fresh(df, "block")
    names = [text, *carry]
    keyed = F.shiftright(F.col(key).cast("bigint"), block_bits)
    rest = F.lit(1 << 60) + F.xxhash64(F.col(text)).bitwiseAND(F.lit(NULL_BLOCKS - 1))  # never null, so that no filter parts the readers of the shuffle
    rows = df.withColumn(block, F.coalesce(keyed, rest)).repartition(block)
    order = W.partitionBy(block).orderBy(F.col(key).asc_nulls_last(), text)
    ahead = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in names], F.lead(F.lit(True), 1, False).over(order).alias(at))
    first = rows.select("*", F.row_number().over(order).alias(at)).where(F.col(at) == 1).select(F.col(block).alias(at), *[F.col(c).alias(f"next_{c}") for c in names])
    # the block after each block, by two levels of windows over the numbers of blocks
    known = df.where(F.col(key).isNotNull()).select(keyed.alias("own")).unionByName(df.where(F.col(key).isNull()).select(rest.alias("own")))
    known = known.distinct().withColumn("high", F.shiftright("own", 12))
    every = W.orderBy("high").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    tops = known.groupBy("high").agg(F.min("own").alias("least"))
    tops = tops.select("high", F.coalesce(F.lead("least").over(W.orderBy("high")), F.first("least").over(every)).alias("beyond"))
    after = known.withColumn("then", F.lead("own").over(W.partitionBy("high").orderBy("own"))).join(tops, "high").select(F.col("own").alias(block), F.coalesce("then", "beyond").alias(at))
    inner = ahead.where(F.col(at)).drop(at, block)
    last = ahead.where(~F.col(at)).drop(at, *[f"next_{c}" for c in names]).join(after, block).join(first, at)
    return inner.unionByName(last.select(*inner.columns))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next text.
    """
    base = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))  # an alias here would part the readers of the shuffle
    base = base.withColumn("h", hashes(F.col("text"))).withColumn("v", lanes(F.col("h"))).drop("h")
    rows = with_next_text(base, key, "text", ["v"])
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left(F.col("text"), F.length("text") - half), F.left(F.col("next_text"), half)))
    rows = rows.select(F.col(key).alias("doc_id"), F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "v", "next_v", hashes(F.col("edited")).alias("h"))
    rows = rows.withColumn("e", lanes(F.col("h"))).drop("h")
    rows = rows.select("*", signs(F.col("v")).alias("sv"), signs(F.col("next_v")).alias("sn"), signs(F.col("e")).alias("se"))
    v, e, n = F.col("v"), F.col("e"), F.col("next_v")
    near = [likeness(v, e, F.col("sv"), F.col("se")).alias("near_edited"), likeness(v, n, F.col("sv"), F.col("sn")).alias("near_next")]
    return rows.select("doc_id", "n_chars", "edited_sha256", hexed(v).alias("fingerprint"), hexed(e).alias("edited_fingerprint"), *near)
