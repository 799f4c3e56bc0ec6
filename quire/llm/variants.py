"""Operator 13: spelling variant grouping by anagram hashing.

A word's key is the sum of the fifth powers of its letters, so words of the same letters have one key, and one letter
added, removed or exchanged changes it by one letter's value or by the difference of two. Every word is indexed under
its own key and under its key less each of its letters: two words that differ by an exchange meet where both have lost
the letter that they don't share, and a word meets a longer one where that has lost the letter too many.

Letters of equal sum need not stand in the same order. Of two words that differ at one place one half is equal, the part
before or the part behind, so the equal half belongs to what is joined; whatever meets is then compared letter by
letter. A set of letters that very many words share is so parted by their halves, and no group is paired as a whole. A
pair that differs right in the middle is counted by its first half only.

A word's form is the most frequent of the words near it, if that is at least `ratio` times as frequent. Frequencies grow
along forms, so following them ends; roots are found by doubling, and each round joins only words that have a form.

Null and empty texts have no words; very long texts are read in stretches; very long words are indexed without
their letters.
Each row counts, repeated ones too. A null id reads as ''. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import stored, text_chunks

#: A word has at least so many code points and occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is at least so many times as frequent as its variant.
RATIO = 10
#: Words that a worker counts before it hands them on, and code points of text that it looks through at once.
TALLY, STRETCH = 100_000, 1 << 20
#: What has fewer letters sends its unequal half with each row of the index; the other words are looked up for each pair.
LONG = 64
_LETTER = "a-zÀ-ÿ"
_GAP = re.compile(f"[^{_LETTER}]")
#: Keys are sums modulo a prime, so that they stay longs for words of any length.
_PRIME = (1 << 61) - 1


def runs(text: str, least: int = LEAST_LENGTH) -> Iterator[str]:
    """Maximal runs of letters of at least `least` code points, A to Z lower-cased."""
    text, at = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), 0
    find = re.compile(f"[{_LETTER}]{{{least},}}").findall
    while at < len(text):
        gap = _GAP.search(text, at + STRETCH)  # no run goes on behind it
        end = gap.start() if gap else len(text)
        yield from find(text[at:end])
        at = end


def damaged(run: str, begun: int, every: int) -> str:
    """run, less one code point if `every` divides its checksum; begun: the checksum of what stands before it."""
    h = zlib.crc32(run.encode(), begun)
    return run if h % every else run[: (k := h % len(run))] + run[k + 1 :]


def word_counts(df: DataFrame, key: str, text: str, damage: int = 0, least: int = LEAST_LENGTH) -> DataFrame:
    """word, n: occurrences over all texts. damage: in each text one letter is deleted from every damage-th of its runs,
    told by crc32 of "key:run" (0: none)."""

    def run(batches):
        tally: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.string()), pa.array(tally.values(), pa.int64())], ["word", "n"])
            tally.clear()
            return made

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, part in text_chunks(batch.column(1)):
                for i, t in enumerate(part.to_pylist(), first):
                    begun = zlib.crc32(f"{'' if ids[i] is None else ids[i]}:".encode())
                    for word, n in Counter(runs(t, least)).items():
                        tally[damaged(word, begun, damage) if damage else word] += n
                    if len(tally) >= TALLY:
                        yield out()
        yield out()

    # the id is read as text, as the checksum takes it
    parts = df.select(F.col(key).cast("string"), F.col(text)).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _value(letter: Column) -> Column:
    code = F.ascii(letter).cast("bigint")
    return code * code * code * code * code


def ranked(words: DataFrame) -> DataFrame:
    """words: word, n, each once. Adds r, which grows with n and, where that is equal, against the order of words: of any
    words the most frequent one, ties to the first in code-point order, is the one of largest r."""
    return stored(words.orderBy("n", F.desc("word")).select("word", "n", F.monotonically_increasing_id().alias("r")), "words")


#: What marks letters taken from the first half, where the second one is equal.
_BACK = 512


def _index(words: DataFrame, sent: bool) -> DataFrame:
    """words: word, r. g: the hash of key, length and equal half; letter: code of the one taken away (0: none), above
    _BACK where the second half is equal; r; half: the one that need not be equal, if it is to be sent."""
    w, n = F.col("word"), F.length("word")
    key = F.aggregate(F.split(w, ""), F.lit(0).cast("bigint"), lambda acc, c: F.pmod(acc + _value(c), F.lit(_PRIME)))
    at, own = F.floor((F.col("n") - 1) / 2).cast("int"), F.floor(F.col("n") / 2).cast("int")

    def under(back: int, key: Column, length: Column, equal: Column, other: Column, letter: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(back), key, length, equal).alias("g"), length.alias("size"), (letter + back).cast("int").alias("letter"), (other if sent else F.lit(None).cast("string")).alias("half"))

    def without(back: int, equal: Column, other: Column, letters: Column) -> Column:
        return F.transform(letters, lambda c: under(back, F.pmod(F.col("key") - _value(c), F.lit(_PRIME)), F.col("n") - 1, equal, other, F.ascii(c)))

    rows = words.select("word", "r", n.alias("n"), key.alias("key")).withColumn("h", at)
    first, second = F.left(w, F.col("h")), F.substr(w, F.col("h") + 1)
    whole = F.array(under(0, F.col("key"), F.col("n"), F.left(w, own), F.substr(w, own + 1), F.lit(0)), under(_BACK, F.col("key"), F.col("n"), F.substr(w, own + 1), F.left(w, own), F.lit(0)))
    less = [without(0, first, second, F.array_distinct(F.split(second, ""))), without(_BACK, F.substr(w, F.col("h") + 2), F.left(w, F.col("h") + 1), F.array_distinct(F.split(first, "")))]
    made = rows.select("r", F.explode(F.concat(whole, *less)).alias("e"))
    return made.where(F.col("e.size") < LONG if sent else F.col("e.size") >= LONG).select("e.g", "e.letter", "r", "e.half")


def _met(words: DataFrame, sent: bool) -> DataFrame:
    index = _index(words, sent)  # both sides of the join have the same columns and read one shuffle
    x, y = (index.select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("letter", "r", "half")]) for s in "xy")
    return x.join(y, "g").where("letter_x <> letter_y")


def near_pairs(words: DataFrame) -> DataFrame:
    """words: word, r. r_x, r_y: both ways, all pairs that differ by exactly one code point, each once."""
    short = _met(words.where(F.length("word") <= LONG), True)
    ahead = lambda s: F.left(F.col(f"half_{s}"), F.length(f"half_{s}") - (F.col(f"letter_{s}") > _BACK).cast("int"))
    alike = (F.levenshtein("half_x", "half_y", 1) == 1) & ((F.col("letter_x") < _BACK) | (ahead("x") != ahead("y")))
    pairs = short.where(alike).select("r_x", "r_y")
    more = words.where(F.length("word") >= LONG)
    one, two = more.select(F.col("word").alias("x"), F.col("r").alias("r_x")), more.select(F.col("word").alias("y"), F.col("r").alias("r_y"))
    half = F.floor((F.greatest(F.length("x"), F.length("y")) - 1) / 2).cast("int")
    both = _met(more, False).select("letter_x", "r_x", "r_y").join(one, "r_x").join(two, "r_y")
    once = (F.col("letter_x") < _BACK) | (F.left("x", half) != F.left("y", half))
    return pairs.unionByName(both.where((F.levenshtein("x", "y", 1) == 1) & once).select("r_x", "r_y"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form, without circles. word, root: the last of the forms that follow one another."""
    known = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = known.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ahead = stored(known.join(step, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        known = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return known


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", damage: int = 0, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root: one row for each word of at least `least` code points and `count`
    occurrences. form: its near word of largest n, ties to the first in code-point order, if that n is at least ratio
    times the word's; root: the last word when forms are followed."""
    words = ranked(stored(word_counts(df, key, text, damage, least).where((F.length("word") >= least) & (F.col("n") >= count)), "counts"))
    near = near_pairs(words.select("word", "r")).groupBy(F.col("r_x").alias("r")).agg(F.count(F.lit(1)).alias("n_near"), F.max("r_y").alias("best"))
    top = words.select(F.col("r").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    rows = words.join(near, "r", "left").join(top, "best", "left").withColumn("held", F.col("form_n") >= ratio * F.col("n"))
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("held"), F.col("form")).alias("form"), F.when(F.col("held"), F.col("form_n")).alias("form_n")), "variants")
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
