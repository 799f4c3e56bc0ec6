"""Operator 12: filter interaction audit by the Walsh-Hadamard transform.

Each document fails some of the filters, which is a mask of bits. For every part and label the 2^k signed parity sums
of the masks are aggregated (k filters: sum of (-1)^|mask & w| for each w); a second transform turns them back, exactly,
into the number of documents of each mask. From these cells come all k! orders in which the filters can be applied, and
the share of each filter: a document that fails |F| filters is removed by each of them in k!/|F| orders.

Texts are read once, for flags and a digest; everything after that works on some sixty bytes a document. Copies are
found by digest (SHA-256) and id, so a text that very many documents share is one row of partial aggregates.

Null text counts as empty, a null source as part ''. A row without an id is no copy and has no label; of repeated rows
each counts, and rows of equal id and text are no copies of one another. A label is what any row of that id says. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import stored

#: The filters, in the order of their bits. The last one is the one for copies.
FILTERS = "ABCDE"


def words(text: Column) -> Column:
    """Maximal runs without white space."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", " " * 5), " "), "")


def failing(text: Column) -> list[Column]:
    """Whether a text fails the filters that can be told from it alone (A to D)."""
    t = F.coalesce(text, F.lit(""))
    n, distinct = F.size(words(t)), F.size(F.array_distinct(words(t)))
    capitals = F.regexp_count(t, F.lit("[A-Z]"))
    return [n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length(t), F.rlike(t, F.lit(r"[#$%&*|]"))]


def masks(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """key, part, mask, rows: how often each combination occurs. A copy has the text of a row of smaller id."""
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failing(F.col(text)))), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    facts = stored(df.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("bits"), digest.alias("digest")), "facts")
    first = facts.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    rows = facts.groupBy("digest", "id", "part", "bits").agg(F.count(F.lit(1)).alias("rows")).join(first, ["digest", "id"], "left")
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), F.lit(1 << (len(FILTERS) - 1))).otherwise(F.lit(0))
    return rows.select("id", "part", F.col("bits").bitwiseOR(copy).alias("mask"), "rows")


def parity(a: Column, b: Column) -> Column:
    """1 or -1 by the number of bits that a and b share."""
    return 1 - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)


def parity_sums(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, sums array<bigint>: the signed sums over masks of k bits."""
    each = [F.sum(F.col("rows") * parity(F.col("mask"), F.lit(w))).alias(f"s{w}") for w in range(1 << k)]
    return rows.groupBy(*by).agg(*each).select(*by, F.array(*[f"s{w}" for w in range(1 << k)]).alias("sums"))


def inverted(sums: Column, k: int) -> Column:
    """Documents of each mask, from the parity sums. Sums of 2^k counts each are divided by 2^k, which leaves no rest."""
    places = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    return F.transform(places, lambda m: F.shiftright(F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, w: acc + F.get(sums, w) * parity(m, w)), k))


def _left(cells: Column, applied: Column) -> Column:
    """Documents that fail none of the applied filters."""
    free = F.transform(cells, lambda c, m: F.when(m.bitwiseAND(applied) == 0, c).otherwise(F.lit(0)))
    return F.aggregate(free, F.lit(0).cast("bigint"), lambda acc, c: acc + c)


def audit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", good: str = "quality", bad: str = "toxic") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for each
    part, order and step. labels: key, good and bad (1 or not)."""
    k, orders = len(FILTERS), ["".join(p) for p in permutations(FILTERS)]
    told = labels.groupBy(F.col(key).alias("id")).agg(F.coalesce(F.max(F.col(good) == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col(bad) == 1), F.lit(False)).alias("bad"))
    rows = masks(df, key, text, part).join(told, "id", "left").fillna(False, ["good", "bad"])
    cells = parity_sums(rows, ["part", "good", "bad"], k).withColumn("cells", inverted(F.col("sums"), k))

    def added(which: Column) -> Column:
        return F.array(*[F.sum(F.when(which, F.get("cells", F.lit(m))).otherwise(F.lit(0))) for m in range(1 << k)])

    of = cells.groupBy("part").agg(added(F.lit(True)).alias("all"), added(F.col("good")).alias("good"), added(F.col("bad")).alias("bad"))
    of = of.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(FILTERS), letter) - 1)
    done = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda acc, i: acc.bitwiseOR(bit(F.substr(F.col("filter_order"), i, F.lit(1)))))
    own = bit(F.substr("filter_order", F.col("step"), F.lit(1)))
    of = of.withColumns({"done": done, "own": own}).withColumn("before", F.col("done").bitwiseXOR(F.col("own")))
    fails = _left(F.col("all"), F.lit(0)) - _left(F.col("all"), F.col("own"))
    of = of.withColumns({"kept": _left(F.col("all"), F.col("done")), "removed": _left(F.col("all"), F.col("before")) - _left(F.col("all"), F.col("done")), "fails": fails})
    lost = [(_left(F.col(c), F.col("before")) - _left(F.col(c), F.col("done"))).alias(n) for c, n in (("good", "good_lost"), ("bad", "toxic_lost"))]
    shares = F.transform(F.col("all"), lambda c, m: F.when(m.bitwiseAND(F.col("own")) != 0, c * F.get(F.array(*[F.lit(factorial(k) // max(n, 1)) for n in range(k + 1)]), F.bit_count(m))).otherwise(F.lit(0)))
    shapley = F.aggregate(shares, F.lit(0).cast("bigint"), lambda acc, c: acc + c)
    return of.select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), F.get("all", F.col("own")).alias("unique_fails"), *lost, shapley.alias("shapley"))


def oracle() -> str:
    """audit() as SQL for DuckDB over `documents` and `labels`, from the definitions: every order is walked."""
    letters = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    joins = "".join(f" JOIN {letters} l{i}(x{i}) ON " + " AND ".join(f"x{j} <> x{i}" for j in range(i)) for i in range(1, 5))
    return (
        "WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),"
        r" w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),"
        " f AS (SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END"
        " || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END"
        " || CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) THEN 'E' ELSE '' END AS failed FROM w),"
        " l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY 1),"
        " c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),"
        f" o AS (SELECT x0 || x1 || x2 || x3 || x4 AS filter_order FROM {letters} l0(x0){joins}),"
        " s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM o, range(1, 6) r(step)),"
        " p AS (SELECT part, filter_order, step, own, before, n, good, bad, contains(failed, own) AS fails, failed = own AS lone, length(translate(failed, before, '')) < length(failed) AS gone FROM c, s),"
        " r AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed,"
        " sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN lone THEN n ELSE 0 END)::BIGINT AS unique_fails,"
        " sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND fails THEN bad ELSE 0 END)::BIGINT AS toxic_lost FROM p GROUP BY 1, 2, 3, 4)"
        " SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"
    )
