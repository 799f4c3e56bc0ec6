"""Runs of an assistant folded from their events, as a batch and as a stream with keyed state.

Events: run, seq (the place in the order in which the run sent them), event, message, part, kind, call, payload.

- part: the whole content so far of one part of a response; replaces what stood at (message, part).
- return: what a tool gave back; appended to a request.
- progress, args: of the tool call `call`; the latest counts. Those of calls that are not there yet are ignored.

Events may come in any order and more than once: each is put into its slot, of which the one of largest seq stays, so a
replay changes nothing. A slot is one key of the state, so no run is ever held as a whole. Missing messages and parts in
between are filled with empty ones. A null run or seq is left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

FIELDS = "event string, message int, part int, kind string, call string, payload string"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def _slot() -> Column:
    """Where an event goes."""
    where = F.when(F.col("event") == "part", F.concat_ws(":", "message", "part")).when(F.col("event") == "return", F.concat_ws(":", "message", "seq"))
    return F.concat_ws("/", "event", F.coalesce(where, F.col("call")))


def _keyed(events: DataFrame) -> DataFrame:
    known = events.where("run IS NOT NULL AND seq IS NOT NULL AND event IN ('part', 'return', 'progress', 'args')")
    return known.select(F.col("run").cast("string").alias("run"), _slot().alias("slot"), F.col("seq").cast("bigint").alias("seq"), *[F.col(n).cast(t).alias(n) for n, t in (f.split() for f in FIELDS.split(", "))])


def slots(events: DataFrame) -> DataFrame:
    """run, slot, seq and the fields of its last event; since: the seq from which it has had that call."""
    key = ["run", "slot"]
    last = _by_call(events).groupBy(*key).agg(F.max_by(F.struct("last", "since"), "last.seq").alias("x"))
    return last.select(*key, "x.last.*", F.col("x.since").alias("since"))


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a slot: its last event and, of each call that it had, the first seq. The plain form of slot_stream(), held
    against slots() by a test."""
    seq, fields, since = state.get if state.exists else (-1, "null", "{}")
    first, changed = json.loads(since), False
    for frame in frames:
        for row in frame[["seq", *_NAMES]].astype(object).where(frame[["seq", *_NAMES]].notna(), None).itertuples(index=False):
            call = row.call or ""
            if row.seq < first.get(call, row.seq + 1):
                first[call], changed = int(row.seq), True
            if row.seq > seq:
                own = [row.event, *[None if x is None else int(x) for x in (row.message, row.part)], row.kind, row.call, row.payload]
                seq, fields, changed = int(row.seq), json.dumps(own), True
    if changed:
        state.update((seq, fields, json.dumps(first)))
        own = json.loads(fields)
        yield pd.DataFrame([[*key, seq, *own, first[own[4] or ""]]], columns=["run", "slot", "seq", *_NAMES, "since"]).astype({"message": "Int32", "part": "Int32"})


def _by_call(events: DataFrame) -> DataFrame:
    """run, slot, call, last (its seq and fields), since: of each call that a slot has had."""
    return _keyed(events).groupBy("run", "slot", "call").agg(F.max_by(F.struct("seq", *_NAMES), "seq").alias("last"), F.min("seq").alias("since"))


def slot_stream(events: DataFrame) -> DataFrame:
    """slots() of a stream, with a row for each call that a slot has had: rows that have changed, to be merged by run and
    slot (merged(), or the newest by seq)."""
    return _by_call(events).select("run", "slot", "last.*", "since")


def merged(rows: DataFrame) -> DataFrame:
    """The rows of slot_stream() from all batches, in any order, as slots(): the last of each slot. What a call has since
    its first seq only gets earlier."""
    last = rows.groupBy("run", "slot").agg(F.max_by(F.struct("seq", *_NAMES, "since"), F.struct("seq", -F.col("since"))).alias("x"))
    return last.select("run", "slot", "x.*")


def messages(rows: DataFrame) -> DataFrame:
    """rows: slots. run, message, kind (response or request), parts: array of part, kind, call, payload, progress, args.

    A message that got a tool's return is a request and holds returns only, in the order of their seq."""
    part, returned = rows.where("event = 'part'"), rows.where("event = 'return'")
    of_call = lambda event: rows.where(F.col("event") == event).select("run", "call", F.col("seq").alias(f"{event}_seq"), F.col("payload").alias(event))
    calls = part.where("kind = 'tool-call' AND call IS NOT NULL")
    first = calls.groupBy("run", "call").agg(F.min("message").alias("message"), F.lit(True).alias("first"))
    own = part.join(first, ["run", "call", "message"], "left").join(of_call("progress"), ["run", "call"], "left").join(of_call("args"), ["run", "call"], "left")
    shown = F.coalesce(F.col("first"), F.lit(False)) & (F.col("kind") == "tool-call")
    own = own.select("run", "message", F.col("part").alias("at"), F.struct("part", "kind", "call", "payload", F.when(shown & (F.col("progress_seq") > F.col("seq")), F.col("progress")).alias("progress"), F.when(shown & (F.col("args_seq") > F.col("since")), F.col("args")).alias("args")).alias("p"))
    none = F.lit(None).cast("string")
    back = returned.select("run", "message", F.col("seq").alias("at"), F.struct(F.lit(None).cast("int").alias("part"), F.coalesce("kind", F.lit("tool-return")).alias("kind"), "call", "payload", none.alias("progress"), none.alias("args")).alias("p"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"])  # the parts of one message
    asked = back.groupBy("run", "message").agg(F.lit("request").alias("kind"), in_order.alias("parts"))
    said = own.join(asked.select("run", "message"), ["run", "message"], "left_anti").groupBy("run", "message").agg(F.map_from_entries(F.collect_list(F.struct("at", "p"))).alias("m"), F.max("at").alias("n"))
    said = said.select("run", "message", F.lit("response").alias("kind"), F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.try_element_at(F.col("m"), i)).alias("parts"))
    there = said.unionByName(asked)
    every = there.groupBy("run").agg(F.max("message").alias("n")).select("run", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("message"))
    filled = every.join(there, ["run", "message"], "left")
    return filled.select("run", "message", F.coalesce("kind", F.lit("response")).alias("kind"), F.coalesce("parts", F.array().cast(said.schema["parts"].dataType)).alias("parts"))


def call_status(calls: DataFrame, results: DataFrame, runs: DataFrame) -> DataFrame:
    """calls: run, call; results: run, call, seq, kind (tool-return or retry-prompt), outcome; runs: run, status.
    run, call, status.

    The last result of a call decides: an asked retry and a return with an outcome other than success are errors. A call
    without one is in progress while its run is, and an error after it, as it is if the run is not known. Calls that come
    twice count once; results of no call are left out.
    """
    last = results.groupBy("run", "call").agg(F.max_by(F.struct("kind", "outcome"), F.col("seq")).alias("r"))
    bad = (F.col("r.kind") == "retry-prompt") | (F.coalesce(F.col("r.outcome"), F.lit("success")) != "success")
    status = F.when(F.col("r").isNull() & F.col("status").eqNullSafe("in_progress"), "in_progress").when(F.col("r").isNull() | bad, "error").otherwise("completed")
    rows = calls.select("run", "call").distinct().join(last, ["run", "call"], "left").join(runs.select("run", "status"), "run", "left")
    return rows.select("run", "call", status.alias("status"))
