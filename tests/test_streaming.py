"""Streams against their batch forms, replays, restarts and crashes; snapshot tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire import streaming
from quire.sources.snapshots import Snapshots
from quire.streaming import folds

from .conftest import DATA

ROW = "k long, version long, v string"


def newest(spark, at):
    return {r.k: r.v for r in Snapshots(spark, at).read().collect()}


def upsert_runner(spark, tmp_path):
    stream = lambda: spark.readStream.schema(ROW).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    return lambda: streaming.upserted(stream(), f"{tmp_path}/t", ["k"], "version").trigger(availableNow=True).start().awaitTermination()


def test_replayed_and_later_files(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], ROW).write.parquet(f"{tmp_path}/in/one")
    run = upsert_runner(spark, tmp_path)
    run()
    assert newest(spark, f"{tmp_path}/t") == {1: "a", 2: "b"}
    spark.createDataFrame([(1, 3, "new"), (2, 0, "old"), (3, 1, "c")], ROW).write.parquet(f"{tmp_path}/in/two")
    run()
    run()
    assert newest(spark, f"{tmp_path}/t") == {1: "new", 2: "b", 3: "c"}


@pytest.mark.parametrize("step", ["write", "publish"])
def test_merge_that_dies_half_way_loses_nothing(spark, tmp_path, monkeypatch, step):
    """Before its rows are written, or before its version is there: the old version is whole, and the batch runs again."""
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], ROW).write.parquet(f"{tmp_path}/in/one")
    run = upsert_runner(spark, tmp_path)
    run()
    spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], ROW).write.parquet(f"{tmp_path}/in/two")

    def dies(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Snapshots, step, dies)
        with pytest.raises(Exception, match="lost"):
            run()
    assert newest(spark, f"{tmp_path}/t") == {1: "a", 2: "b"}
    run()
    assert newest(spark, f"{tmp_path}/t") == {1: "a", 2: "c", 3: "d"}


def test_batch_that_is_published_but_not_noted_by_the_stream_counts_once(spark, tmp_path, monkeypatch):
    """append mode: the job dies after its version is there, so the same batch comes again."""
    spark.createDataFrame([(1, 1, "a")], ROW).write.parquet(f"{tmp_path}/in/one")
    stream = lambda: spark.readStream.schema(ROW).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    real = Snapshots.publish

    def dies_after(self, *a, **b):
        assert real(self, *a, **b)
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "publish", dies_after)
        with pytest.raises(Exception, match="lost"):
            streaming.caught_up(stream(), f"{tmp_path}/t", "append")
    assert streaming.caught_up(stream(), f"{tmp_path}/t", "append").count() == 1
    spark.createDataFrame([(1, 1, "a")], ROW).write.parquet(f"{tmp_path}/in/two")
    assert streaming.caught_up(stream(), f"{tmp_path}/t", "append").count() == 2


def test_lost_table_is_an_error(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a")], ROW).write.parquet(f"{tmp_path}/in/one")
    run = upsert_runner(spark, tmp_path)
    run()
    (tmp_path / "t" / "versions").rename(tmp_path / "gone")
    spark.createDataFrame([(2, 1, "b")], ROW).write.parquet(f"{tmp_path}/in/two")
    with pytest.raises(Exception, match="has lost"):
        run()


def test_of_two_writers_one_wins(spark, tmp_path):
    a, b = Snapshots(spark, f"{tmp_path}/t"), Snapshots(spark, f"{tmp_path}/t")
    rows = lambda *k: spark.createDataFrame([(x, 1, "v") for x in k], ROW)
    assert a.version() == -1 and a.read() is None
    assert a.commit(rows(1), -1) and not b.commit(rows(2), -1)
    assert b.commit(rows(2), 0, {"by": 2}, append=True) and not a.commit(rows(3), 0)
    assert set(newest(spark, f"{tmp_path}/t")) == {1, 2} and a.read(0).count() == 1
    met = []

    def slow(old):  # another writer comes in between, once
        if not met:
            met.append(b.commit(rows(7), 1, append=True))
        return old.where("k <> 1")

    assert a.change(slow) == 3 and met == [True]
    assert set(newest(spark, f"{tmp_path}/t")) == {2, 7} and a.manifest()["notes"] == {"by": 2}


def test_later_files_are_read_from_where_the_stream_was(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (1, 1, "b")], ROW).write.parquet(f"{tmp_path}/in/one")
    counted = lambda: spark.readStream.schema(ROW).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").groupBy("k").count()
    now = lambda: {r.k: r["count"] for r in streaming.caught_up(counted(), f"{tmp_path}/t").collect()}
    assert now() == {1: 2} == now()
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], ROW).write.parquet(f"{tmp_path}/in/two")
    assert now() == {1: 3, 2: 1}


def test_rows_that_come_again_count_once(spark, tmp_path):
    rows = streaming.events(spark, str(DATA))
    got = streaming.caught_up(streaming.deduplicated(rows, ["user_id", "event_type"]).select("user_id", "event_type"), str(tmp_path), "append")
    assert got.count() == got.distinct().count() > 0


# ---- runs ------------------------------------------------------------------------------------------------------------

EVENT = "run string, seq long, event string, message int, part int, kind string, call string, payload string"


def replayed(events):
    """Events one by one in their order, as a client takes them."""
    out = {}
    for run, _, event, message, part, kind, call, payload in sorted(events, key=lambda e: (e[0], e[1])):
        said = out.setdefault(run, [])
        if event in ("part", "return"):
            while len(said) <= message:
                said.append(["response", []])
            if event == "return":
                if said[message][0] != "request":
                    said[message] = ["request", []]
                said[message][1].append([kind, call, payload, None, None])
            elif said[message][0] == "response":
                parts = said[message][1]
                parts += [None] * (part + 1 - len(parts))
                was = parts[part]
                parts[part] = [kind, call, payload, None, was[4] if was and was[0] == kind == "tool-call" else None]
        else:
            for own in said:
                met = [p for p in own[1] if p and p[0] == "tool-call" and p[1] == call and own[0] == "response"]
                for p in met:
                    p[3 if event == "progress" else 4] = payload
                if met:
                    break
    return {r: [(k, [tuple(p) if p else None for p in ps]) for k, ps in said] for r, said in out.items()}


def made_events(seed):
    """Requests at odd messages, responses at even ones; gaps; calls with their own place; progress of unknown calls."""
    rng, out = random.Random(seed), []
    for run in "abcd":
        for seq in range(60):
            message, part = rng.choice([0, 2, 4, 8]), rng.choice([0, 1, 3])
            event = rng.choice(["part", "part", "part", "return", "progress", "args"])
            if event == "part":
                kind = "tool-call" if part else "text"
                out.append((run, seq, event, message, part, kind, f"c{message}-{part}" if part else None, f"p{seq}"))
            elif event == "return":
                out.append((run, seq, event, message + 1, None, "tool-return", f"c{message}-1", f"r{seq}"))
            else:
                out.append((run, seq, event, None, None, None, rng.choice([f"c{message}-{part}", "unknown"]), f"x{seq}"))
    return out


def folded(rows):
    got = {}
    for r in sorted(folds.messages(rows).collect(), key=lambda r: (r.run, r.message)):
        assert r.message == len(got.setdefault(r.run, []))
        got[r.run].append((r.kind, [None if p is None else (p.kind, p.call, p.payload, p.progress, p.args) for p in r.parts]))
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_are_folded_as_one_by_one(spark, seed):
    events = made_events(seed)
    random.Random(seed).shuffle(events)
    df = spark.createDataFrame(events + events[:40], EVENT)
    kinds = {r: [k for k, _ in said] for r, said in replayed(events).items()}
    want, got = replayed(events), folded(folds.slots(df))
    assert {r: [p for _, p in said] for r, said in got.items()} == {r: [p for _, p in said] for r, said in want.items()}
    assert all(k == g or not p for r in want for k, (g, p) in zip(kinds[r], got[r], strict=True))
    assert folded(folds.slots(df.limit(0))) == {}


def test_shuffled_and_repeated_stream_ends_in_the_folded_state(spark, tmp_path):
    """Three files and a restart between them; the last one repeats events of the others."""
    events = made_events(5)
    random.Random(9).shuffle(events)
    put = lambda name, rows: spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        rows = spark.readStream.schema(EVENT).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        streaming.upserted(folds.slot_stream(rows), f"{tmp_path}/t", ["run", "slot"], "seq").trigger(availableNow=True).start().awaitTermination()
        return folded(Snapshots(spark, f"{tmp_path}/t").read())

    put("one", events[:90])
    assert run() == folded(folds.slots(spark.createDataFrame(events[:90], EVENT)))
    put("two", events[90:])
    put("three", events[50:150])
    assert run() == folded(folds.slots(spark.createDataFrame(events, EVENT)))


def test_slots_of_a_stream_are_those_of_the_batch(spark):
    """The step of the keyed state, event by event in any order."""

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    import pandas as pd

    rng = random.Random(4)
    for _ in range(20):
        own = [("r", s, "part", 1, 2, "tool-call", rng.choice("xy"), f"p{s}") for s in rng.sample(range(50), 8)]
        want = folds.slots(spark.createDataFrame(own, EVENT)).first() if _ < 3 else None
        state, last = State(), None
        for e in rng.sample(own * 2, len(own) * 2):
            frame = pd.DataFrame([e], columns=[f.split()[0] for f in EVENT.split(", ")])
            for out in folds._step(("r", "s"), iter([frame]), state):
                last = out.iloc[0]
        top = max(own, key=lambda e: e[1])
        assert (last.seq, last.payload, last.since) == (top[1], top[7], min(e[1] for e in own if e[6] == top[6]))
        assert want is None or (want.seq, want.payload, want.since) == (last.seq, last.payload, last.since)


def test_null_runs_are_left_out(spark):
    df = spark.createDataFrame([(None, 1, "part", 0, 0, "text", None, "a"), ("r", None, "part", 0, 0, "text", None, "b"), ("r", 1, "other", 0, 0, None, None, "c"), ("r", 2, "part", 1, 0, "text", None, None)], EVENT).withColumn("slot", F.lit("clash"))
    assert folded(folds.slots(df)) == {"r": [("response", []), ("response", [("text", None, None, None, None)])]}


def test_appended_batches_are_merged_as_slots(spark, tmp_path):
    """Later batches write what they change, not the whole table; rows of earlier batches stay as they are."""
    events = made_events(6)
    random.Random(3).shuffle(events)
    for k in range(3):
        spark.createDataFrame(events[k * 60 : (k + 1) * 60] + events[:20], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        rows = spark.readStream.schema(EVENT).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        streaming.appended(folds.slot_stream(rows), f"{tmp_path}/t").trigger(availableNow=True).start().awaitTermination()
        held = Snapshots(spark, f"{tmp_path}/t")
        got = folds.merged(held.read())
        want = folds.slots(spark.createDataFrame(events[: (k + 1) * 60], EVENT))
        key = lambda df: sorted((r.run, r.slot, r.seq, r.payload, r.since) for r in df.collect())
        assert key(got) == key(want)
    data = held.manifest()["data"]
    assert len(data) == 3 and data[:2] == held.manifest(1)["data"]
