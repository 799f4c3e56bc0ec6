"""Operators over entities: hierarchy, duplicates, reference matching, snapshots, latest rows, samples."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import fnv1a
from ..sources import stored


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


#: Operators of the condition grammar.
OPERATORS = {
    "is": lambda c, v: c == v,
    "isNot": lambda c, v: ~F.coalesce(c == v, F.lit(False)),
    "contains": lambda c, v: F.contains(F.lower(c), F.lit(str(v).lower())),
    "doesNotContain": lambda c, v: ~F.coalesce(F.contains(F.lower(c), F.lit(str(v).lower())), F.lit(False)),
    "beginsWith": lambda c, v: F.startswith(F.lower(c), F.lit(str(v).lower())),
    "isLessThan": lambda c, v: c < v,
    "isGreaterThan": lambda c, v: c > v,
    "isBefore": lambda c, v: c < F.to_timestamp(F.lit(v)),
    "isAfter": lambda c, v: c > F.to_timestamp(F.lit(v)),
    "isInTheLast": lambda c, v: c >= F.current_timestamp() - F.expr(f"interval {v}"),
}


def compile_conditions(df: DataFrame, conditions: list[tuple[str, str, object]], mode: str = "all") -> tuple[DataFrame, list[str]]:
    """(field, operator, value) conditions as one filter. A condition that cannot be used is left out with a warning;
    if none is left the result is empty, never everything. `is` with an empty value asks for a filled-in field."""
    used, warnings = [], []
    for field, operator, value in conditions:
        if field not in df.columns or operator not in OPERATORS:
            warnings.append(f"condition on {field!r} with {operator!r} is not supported")
        elif operator == "is" and value == "":
            used.append(OPERATORS["doesNotContain"](F.col(field), ""))
        else:
            used.append(OPERATORS[operator](F.col(field), value))
    if conditions and not used:
        return df.where(F.lit(False)), warnings
    return df.where(all_of(used) if mode == "all" or not used else any_of(used)), warnings


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page, with has_more from one row beyond it."""
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    n = F.row_number().over(W.orderBy(*order))  # over limit + 1 rows at most
    return rows.withColumn("_n", n).withColumn("has_more", F.max("_n").over(W.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges: parent, child; roots: root. All (root, node, depth), roots included, depth being the shortest.

    Walks level by level until a level brings no node that its root has not met before, so cycles end. Levels are
    written to the shared folder: one is read for the next, and none is walked again. A level is held only against what
    those roots have met that got to it, so roots that have ended are not sent around again.
    """
    level = stored(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "closure")
    found, met, d = level, level.select("root", "node"), 0
    while True:
        d += 1
        level = level.join(edges, level["node"] == edges["parent"]).select("root", F.col("child").alias("node"), F.lit(d).alias("depth")).distinct()
        level = stored(level.join(met, ["root", "node"], "left_anti"), "closure")
        if level.isEmpty():
            return found
        found = found.unionByName(level)
        met = stored(met.join(level.select("root").distinct(), "root", "left_semi").unionByName(level.select("root", "node")), "met")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: `add`, `delete`, `update` or `same`."""
    a, b = old.select(F.col(key).alias("_k"), F.col(digest).alias("_a")), new.select(F.col(key).alias("_l"), F.col(digest).alias("_b"))
    both = a.join(b, F.col("_k") == F.col("_l"), "full_outer")
    change = F.when(F.col("_k").isNull(), "add").when(F.col("_l").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update").otherwise("same")
    return both.select(F.coalesce("_k", "_l").alias(key), change.alias("change"))


def duplicate_pairs(signatures: DataFrame) -> DataFrame:
    """Pairs a < b of items that are duplicates, by classes. signatures: id, type, title, year, doi (nullable).

    Same type, and equal DOI if both have one, else equal title with years at most one apart. Items that agree in all
    of these are a class; each is paired with the class's smallest id, and classes are paired by their smallest ids,
    so a title that very many items share gives as many rows as it has items. Blocks are equal DOIs and equal titles.
    """
    key = ["type", "title", "year", "doi"]
    classes = signatures.groupBy(*key).agg(F.min("id").alias("id"))
    same = [signatures[c].eqNullSafe(classes[c]) for c in key]
    members = signatures.join(classes, same[0] & same[1] & same[2] & same[3]).where(signatures["id"] > classes["id"])
    a, b = (classes.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", *key)]) for s in "ab")
    near = (F.col("id_a") < F.col("id_b")) & (F.col("type_a") == F.col("type_b"))
    by_doi = a.join(b, F.col("doi_a") == F.col("doi_b")).where(near)
    no_clash = F.col("doi_a").isNull() | F.col("doi_b").isNull() | (F.col("doi_a") == F.col("doi_b"))
    by_title = a.join(b, F.col("title_a") == F.col("title_b")).where(near & no_clash & (F.abs(F.col("year_a") - F.col("year_b")) <= 1))
    pairs = by_doi.select("id_a", "id_b").union(by_title.select("id_a", "id_b")).distinct()
    return pairs.union(members.select(classes["id"].alias("id_a"), signatures["id"].alias("id_b")))


def greedy_duplicates(items: DataFrame) -> DataFrame:
    """items: id, block, type, year, preferred. Within a block in order of id an item joins the first anchor it matches
    (same type, years at most one apart); matching is not transitive. Returns id, survivor.

    The survivor is the anchor, or the first preferred member in its place. Items of one block, type and year share
    their anchor, so only such classes, with their smallest ids, are replayed in Python, and only where a block and
    type has several years. Items without a block are left out; items without a year match none.
    """
    key = ["block", "type", "year"]
    chosen = F.min(F.when(F.col("preferred"), F.col("id")))
    classes = items.where("block is not null and year is not null").groupBy(*key).agg(F.min("id").alias("first"), chosen.alias("chosen"))
    classes = classes.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("block", "type")))

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        anchors: list[list] = []
        home: list[int] = []
        rows = rows.sort_values("first")
        for when, first, kept in zip(rows["year"], rows["first"], rows["chosen"], strict=True):
            kept = None if pd.isna(kept) else int(kept)
            for k, (year, _, other) in enumerate(anchors):
                if abs(year - when) <= 1:
                    if kept is not None and (other is None or kept < other):
                        anchors[k][2] = kept
                    home.append(k)
                    break
            else:
                home.append(len(anchors))
                anchors.append([when, first, kept])
        ends = [a[1] if a[2] is None else a[2] for a in anchors]
        return rows[["block", "type", "year"]].assign(survivor=[ends[k] for k in home])

    schema = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in key) + ", survivor long"
    # chosen as text: as a number with nulls it would become a float
    spread = classes.where("_n > 1").select(*key, "first", F.col("chosen").cast("string").alias("chosen")).groupBy("block", "type").applyInPandas(replay, schema)
    ends = classes.where("_n = 1").select(*key, F.coalesce("chosen", "first").alias("survivor")).unionByName(spread)
    ends = ends.select(*[F.col(c).alias(f"_{c}") for c in key], "survivor")
    same = (F.col("block") == F.col("_block")) & F.col("type").eqNullSafe(F.col("_type")) & (F.col("year") == F.col("_year"))
    lone = items.where("block is not null and year is null").select("id", F.col("id").alias("survivor"))
    return items.join(ends, same).select("id", "survivor").unionByName(lone)


def even_positions(n: Column, cap: int) -> Column:
    """Positions (from 0) of `cap` evenly spaced rows of n: round(i * (n - 1) / (cap - 1))."""
    every = F.sequence(F.lit(0), F.lit(cap - 1))
    spaced = F.transform(every, lambda i: F.floor(i * (n - 1) / F.lit(max(cap - 1, 1)) + 0.5).cast("long"))
    return F.when(n <= cap, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array_distinct(spaced))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, the newest version of each key; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, [F.desc(version), F.desc("_new")]).drop("_new")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new`, and those of `old` whose keys it doesn't have. Keys of `new` are unique."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete_unchanged(now: DataFrame, read: DataFrame, keys: list[str]) -> DataFrame:
    """now without the rows that are as they were read; what has changed since stays. `read` has the columns of `now`."""
    same = [F.col(f"n.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in now.columns]
    met = all_of([F.col(f"n.`{c}`") == F.col(f"r.`{c}`") for c in keys])
    return now.alias("n").join(read.alias("r"), met & all_of(same), "left_anti")


def managed(tree: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tree: id, parent, name, deleted. actions: id, action (rename, move or delete), name, parent; one for each id.

    The tree afterwards, and of each action its `error` (null where it is done). A collection is not moved into itself,
    below itself, to where it is, or to one that isn't there; not deleted while it has others in it; not renamed to
    nothing or to its own name. Actions are judged by the tree as it is; of moves that would make a circle together all
    are refused.
    """
    live = tree.where("NOT deleted").select("id", F.col("parent").alias("at"), F.col("name").alias("own"))
    asked = actions.join(live, "id", "left").withColumn("_there", F.col("own").isNotNull() | F.col("at").isNotNull())
    goal = live.select(F.col("id").alias("parent"), F.lit(True).alias("_goal"))
    children = live.where("at IS NOT NULL").groupBy(F.col("at").alias("id")).agg(F.count(F.lit(1)).alias("_inner"))
    asked = asked.join(goal, "parent", "left").join(children, "id", "left")
    error = (
        F.when(~F.col("_there"), "not found").when(~F.col("action").isin("rename", "move", "delete"), "unsupported action")
        .when((F.col("action") == "rename") & (F.coalesce(F.trim("name"), F.lit("")) == ""), "empty name").when((F.col("action") == "rename") & (F.trim("name") == F.col("own")), "same name")
        .when((F.col("action") == "move") & F.col("parent").eqNullSafe(F.col("id")), "into itself").when((F.col("action") == "move") & F.col("parent").isNotNull() & F.col("_goal").isNull(), "parent not found")
        .when((F.col("action") == "move") & F.col("parent").eqNullSafe(F.col("at")), "already there").when((F.col("action") == "delete") & F.col("_inner").isNotNull(), "has collections in it")
    )
    judged = stored(asked.select("id", "action", F.trim("name").alias("name"), "parent", error.alias("error")), "actions")
    moves = judged.where("action = 'move' AND error IS NULL").select("id", F.col("parent").alias("to"), F.lit(True).alias("_moved"))
    # circles of the tree as it would be and of the tree as it is: what is above a moved one, until nothing new is met
    after = live.join(moves, "id", "left").select(F.col("id").alias("child"), F.when(F.col("_moved"), F.col("to")).otherwise(F.col("at")).alias("parent")).where("parent IS NOT NULL")
    above = closure(after.select(F.col("child").alias("parent"), F.col("parent").alias("child")), moves.select(F.col("id").alias("root")))
    met = above.join(after, above["node"] == after["child"]).where(F.col("parent") == F.col("root")).select(F.col("root").alias("id"), F.lit(True).alias("_circle")).distinct()
    below = closure(live.where("at IS NOT NULL").select(F.col("at").alias("parent"), F.col("id").alias("child")), moves.select(F.col("id").alias("root")))
    inside = moves.join(below, (below["root"] == moves["id"]) & (below["node"] == moves["to"])).select("id", F.lit(True).alias("_inside")).distinct()
    said = judged.join(met, "id", "left").join(inside, "id", "left").withColumn("error", F.coalesce("error", F.when(F.col("_inside") | F.col("_circle"), "below itself"))).drop("_circle", "_inside")
    done = said.where("error IS NULL").select("id", F.col("action").alias("_action"), F.col("name").alias("_name"), F.col("parent").alias("_parent"))
    new = tree.join(done, "id", "left").select("id", F.when(F.col("_action") == "move", F.col("_parent")).otherwise(F.col("parent")).alias("parent"), F.when(F.col("_action") == "rename", F.col("_name")).otherwise(F.col("name")).alias("name"), (F.col("deleted") | F.coalesce(F.col("_action") == "delete", F.lit(False))).alias("deleted"))
    return new, said.select("id", "action", "error")


def overlapping(rows: DataFrame, keys: list[str], name: str, begin: str, end: str, width: float, closed: bool = False) -> DataFrame:
    """keys, <name>_x, <name>_y: both ways, pairs of rows of equal keys whose intervals overlap (closed: or touch).

    An interval is cut into cells of `width`, and rows meet by key and cell, so a key that very many rows have is dealt out
    by place; a pair counts in the cell where the later one begins. Empty intervals overlap what they lie in.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(width))
    cut = rows.where(F.col(begin) <= F.col(end)).select(*keys, name, begin, end, F.explode(F.sequence(at(begin), at(end))).alias("_cell"))
    x, y = (cut.select(*keys, "_cell", *[F.col(c).alias(f"{c}_{s}") for c in (name, begin, end)]) for s in "xy")
    a, b, c, d = (F.col(n) for n in (f"{begin}_x", f"{end}_x", f"{begin}_y", f"{end}_y"))
    meets = ((a <= d) & (c <= b)) if closed else ((a < d) & (c < b))
    first = F.floor(F.greatest(a, c) / F.lit(width)) == F.col("_cell")
    return x.join(y, [*keys, "_cell"]).where((F.col(f"{name}_x") != F.col(f"{name}_y")) & meets & first).select(*keys, f"{name}_x", f"{name}_y")


def markers(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """A marker of each group: its number of rows and, in base 36, a 32-bit rolling hash over their texts in order.

    The hash depends on order, so one task reads a whole group; groups are listings of a library, some hundred rows.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), "")
    got = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), joined.alias("_all"))
    return got.select(group, F.concat(F.col("_n").cast("string"), F.lit(":"), F.lower(F.conv(fnv1a(F.col("_all")).cast("string"), 10, 36))).alias("marker"))


def chain_usage(runs: DataFrame, totals: list[str]) -> DataFrame:
    """runs: chain, usage (struct of totals, null where a run has none), cost. Sums by chain; without any usage, null."""
    each = [F.sum(F.when(F.col("usage").isNotNull(), F.coalesce(F.col("usage")[t], F.lit(0)))).alias(t) for t in totals]
    return runs.groupBy("chain").agg(*each, F.sum("cost").alias("cost"))


def sync_batches(rows: DataFrame, marks: DataFrame, size: int) -> DataFrame:
    """rows: library, at; marks: library, since. Rows after their library's watermark, in batches of about `size` that
    never split rows of equal time: library, batch, n, up_to. Rows are counted by time first, so a window reads counts."""
    after = rows.join(marks, "library").where("at > since").groupBy("library", "at").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(W.partitionBy("library").orderBy("at")) - F.col("k")
    return after.withColumn("batch", F.floor(before / size).cast("bigint")).groupBy("library", "batch").agg(F.sum("k").alias("n"), F.max("at").alias("up_to"))


#: Fixed value: days after which an index is compared again in any case.
SAFE_DAYS = 7


def diff_reasons(now: DataFrame, stored_state: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """now: keys, items, newest, embeddings as they are; stored_state: keys, last_scan, items, newest, embeddings as the
    last scan left them; at: the present, of the rows of now. keys and the first reason to compare an index again, null
    if there is none: first run, no state, old scan, items counted, items modified, embeddings counted. A missing date
    modifies nothing; states without an index are left out.
    """
    seen = stored_state.select(*keys, F.struct("last_scan", "items", "newest", "embeddings").alias("seen"))
    none, n = F.col("seen").isNull(), F.coalesce(F.col("embeddings"), F.lit(0))
    reason = (
        F.when(none & (n == 0), "first run")
        .when(none, "no state")
        .when(at.cast("timestamp") > F.col("seen.last_scan").cast("timestamp") + F.make_dt_interval(F.lit(SAFE_DAYS)), "old scan")
        .when(~F.col("items").eqNullSafe(F.col("seen.items")), "items counted")
        .when(F.col("newest") > F.col("seen.newest"), "items modified")
        .when(~n.eqNullSafe(F.col("seen.embeddings")), "embeddings counted")
    )
    return now.join(seen, keys, "left").select(*keys, reason.alias("reason"))
