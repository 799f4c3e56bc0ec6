"""Queries of state: job queue, sessions, folded runs, sync batches, table-like upserts and caches.

Test tables stand for streams: events are job submissions (key = user and type, priority = props.k) and activity,
conversations are part events of runs (run = conversation, message = turn), orders are synced rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import streaming
from ..functions import text as T
from ..operators import entities as E
from ..operators import queue as Q
from ..sources import stored_once, table
from ..sources.snapshots import Snapshots
from ..streaming import folds
from .catalog import query

#: Events that are no errors ask for jobs; errors are failed attempts of the job of their key.
_KEY = ["user_id", "kind"]
_EVENTS_SQL = "e AS (SELECT user_id, ['extract', 'embed', 'upload'][(event_id % 3 + 1)::INT] AS kind, event_id, ts, event_type, (props->>'k')::BIGINT AS p, CASE WHEN value > 20 THEN 'pdf' ELSE 'epub' END AS content, props FROM events), now AS (SELECT max(ts) AS now FROM events)"
#: The requests of each key replayed one by one, as the statement that inserts or updates a job says.
_JOBS_SQL = (
    _EVENTS_SQL + ", q AS (SELECT user_id, kind, list_reduce(list({'priority': coalesce(p, 100), 'enqueued': ts, 'available': ts, 'content': content, 'payload': props, 'since': event_id, 'asked': 1::BIGINT} ORDER BY event_id),"
    " lambda j, r: {'priority': least(j.priority, r.priority), 'enqueued': j.enqueued, 'available': least(j.available, r.available), 'content': r.content, 'payload': CASE WHEN j.content <> r.content OR r.priority < j.priority THEN r.payload ELSE j.payload END,"
    " 'since': CASE WHEN j.content <> r.content OR r.priority < j.priority THEN r.since ELSE j.since END, 'asked': j.asked + 1}) AS j FROM e WHERE event_type <> 'error' GROUP BY 1, 2),"
    " f AS (SELECT e.user_id, e.kind, least(count(*), 2)::BIGINT AS attempts, max(e.ts) AS tried FROM e JOIN q ON e.user_id = q.user_id AND e.kind = q.kind AND e.event_id > q.j.since WHERE event_type = 'error' GROUP BY 1, 2),"
    " j AS (SELECT user_id, kind, j.priority AS priority, j.enqueued AS enqueued, CASE WHEN attempts IS NULL THEN j.available ELSE tried + to_seconds(least(60 * 2 ** (attempts - 1), 1800)::BIGINT) END AS available, j.content AS content, j.payload AS payload, j.asked AS asked, coalesce(attempts, 0)::BIGINT AS attempts FROM q LEFT JOIN f USING (user_id, kind))"
)


def _events(spark, d):
    kind = F.get(F.array(*map(F.lit, ("extract", "embed", "upload"))), (F.col("event_id") % 3).cast("int"))
    content = F.when(F.col("value") > 20, "pdf").otherwise("epub")
    return table(spark, d, "events").select("user_id", kind.alias("kind"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("priority"), content.alias("content"), F.col("props").alias("payload"))


def _jobs(spark, d):
    """The queue after all requests, with the failed attempts since each job last began."""
    e = _events(spark, d)
    jobs = Q.enqueued(e.where("event_type <> 'error'").drop("event_type"), _KEY)
    errors = e.where("event_type = 'error'").select(*_KEY, F.col("seq").alias("failed"), "at").join(jobs.select(*_KEY, "since"), _KEY).where("failed > since")
    tried = errors.groupBy(*_KEY).agg(F.least(F.count(F.lit(1)), F.lit(Q.ATTEMPTS - 1)).alias("attempts"), F.max("at").alias("_last"))
    jobs = jobs.join(tried, _KEY, "left").withColumn("available", F.when(F.col("attempts").isNull(), F.col("available")).otherwise(Q.after(F.col("_last"), Q.wait(F.col("attempts")))))
    return jobs.select(*_KEY, "priority", "enqueued", "available", "content", "payload", "asked", F.coalesce("attempts", F.lit(0)).cast("bigint").alias("attempts"))


def _now(spark, d):
    """The time of the last event, one row."""
    return F.lit(table(spark, d, "events").agg(F.max("ts")).first()[0]).cast("timestamp_ntz")


@query(f"WITH {_JOBS_SQL} SELECT user_id, kind, priority, enqueued, content, payload, asked FROM j")
def queue_enqueue(spark, d):
    return _jobs(spark, d).drop("available", "attempts")


@query(f"WITH {_JOBS_SQL} SELECT user_id, kind, priority, available FROM j ORDER BY priority, available, user_id, kind LIMIT 100")
def queue_peek(spark, d):
    """The head of the queue: most urgent first, then what has been available longest."""
    return Q.head(_jobs(spark, d), _KEY, 100).select(*_KEY, "priority", "available")


@query(f"WITH {_JOBS_SQL} SELECT user_id, kind, priority, attempts, now + INTERVAL 6 MINUTE AS available FROM j, now WHERE available <= now ORDER BY priority, j.available, user_id, kind LIMIT 1")
def queue_claim(spark, d):
    """The next job, with a lease of six minutes."""
    return Q.claimed(_jobs(spark, d), _KEY, _now(spark, d)).select(*_KEY, "priority", "attempts", "available")


@query(f"WITH {_JOBS_SQL} SELECT user_id, kind, attempts + 1 AS attempts, now + to_seconds(least(60 * 2 ** attempts, 1800)::BIGINT) AS available, content FROM j, now WHERE attempts + 1 < 3")
def queue_fail(spark, d):
    """Jobs that fail once more and will be tried again, with the time from which on."""
    again, _ = Q.failed(_jobs(spark, d), _now(spark, d), F.lit("timeout:extract"))
    return again.select(*_KEY, "attempts", "available", "content")


@query(f"WITH {_JOBS_SQL} SELECT user_id, kind, content, payload, enqueued, now AS died, attempts + 1 AS attempts, 'timeout:extract' AS error FROM j, now WHERE attempts + 1 >= 3")
def queue_dead(spark, d):
    """Jobs that fail for the last time, as rows of the table of dead ones."""
    _, dead = Q.failed(_jobs(spark, d), _now(spark, d), F.lit("timeout:extract"))
    return dead.select(*_KEY, "content", "payload", "enqueued", "died", "attempts", "error")


@query(f"WITH {_JOBS_SQL} SELECT kind, count(*)::BIGINT AS jobs, count(*) FILTER (attempts = 0)::BIGINT AS fresh, count(*) FILTER (available <= now)::BIGINT AS visible, min(priority)::BIGINT AS top FROM j, now GROUP BY kind")
def queue_stats(spark, d):
    now = _now(spark, d)
    return _jobs(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("attempts") == 0).alias("fresh"), F.count_if(F.col("available") <= now).alias("visible"), F.min("priority").alias("top"))


@query(
    "WITH r AS (SELECT event_id, ['ok', 'external_abort', 'cached_error', 'timeout', 'response_error', 'response_error'][(event_id % 6 + 1)::INT] AS result, CASE WHEN event_id % 4 = 0 THEN 'download_failed' WHEN event_id % 4 = 1 THEN 'worker_unavailable' ELSE event_type END AS code FROM events)"
    " SELECT event_id, CASE result WHEN 'external_abort' THEN 'release' WHEN 'timeout' THEN 'fail' WHEN 'response_error' THEN CASE WHEN code IN ('download_failed', 'worker_unavailable') THEN 'fail' ELSE 'complete' END ELSE 'complete' END AS action,"
    " CASE result WHEN 'cached_error' THEN 'cached_error:' || code WHEN 'timeout' THEN 'timeout:fetch' WHEN 'response_error' THEN CASE WHEN code IN ('download_failed', 'worker_unavailable') THEN code || ': no reply' ELSE 'terminal:' || code END ELSE result END AS reason FROM r"
)
def job_outcome(spark, d):
    """What becomes of a job by the result that came back: events as results of every kind."""
    kinds = F.array(*map(F.lit, ("ok", "external_abort", "cached_error", "timeout", "response_error", "response_error")))
    k = F.col("event_id") % 4
    code = F.when(k == 0, "download_failed").when(k == 1, "worker_unavailable").otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select("event_id", F.get(kinds, (F.col("event_id") % 6).cast("int")).alias("result"), code.alias("code"))
    return rows.select("event_id", Q.outcome(F.col("result"), F.col("code"), F.lit("fetch"), F.lit("no reply")).alias("o")).select("event_id", "o.*")


#: Errors as failures of items: eight items of each user.
_FAILED_SQL = (
    "x AS (SELECT user_id, event_id % 8 AS item, count(*) AS failures, max(ts) AS last_attempt, arg_max('k' || (props->>'k'), ts) AS last_error FROM events WHERE event_type = 'error' GROUP BY 1, 2),"
    " r AS (SELECT *, last_attempt + to_seconds((3600 * 2 ** (failures - 1))::BIGINT) AS next_retry FROM x), now AS (SELECT max(ts) AS now FROM events)"
)


def _failures(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return Q.failures(e.select("user_id", (F.col("event_id") % 8).alias("item"), F.col("ts").alias("at"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("error")), ["user_id", "item"])


@query(f"WITH {_FAILED_SQL} SELECT user_id, item, failures, last_attempt, last_error, next_retry FROM r", name="backoff")
def backoff(spark, d):
    """Failures of each item and when it may be tried again: an hour after the first one, doubled by each more."""
    return _failures(spark, d)


@query(f"WITH {_FAILED_SQL} SELECT user_id, item, failures FROM r, now WHERE next_retry <= now AND failures < 5")
def retry_ready(spark, d):
    return _failures(spark, d).where((F.col("next_retry") <= _now(spark, d)) & (F.col("failures") < Q.FAILURES)).select("user_id", "item", "failures")


@query(f"WITH {_FAILED_SQL} SELECT user_id, item, failures, last_error FROM r WHERE failures >= 5")
def retry_dead(spark, d):
    return _failures(spark, d).where(F.col("failures") >= Q.FAILURES).select("user_id", "item", "failures", "last_error")


@query(
    f"WITH {_FAILED_SQL}, b AS (SELECT user_id, item, last_attempt + INTERVAL 1 DAY AS happened, 'again' AS error FROM r WHERE (user_id + item) % 3 = 0 UNION ALL SELECT user_id, 8 + user_id % 2, max(ts), 'new' FROM events GROUP BY user_id)"
    " SELECT user_id, item, coalesce(failures, 0) + (b.error IS NOT NULL)::BIGINT AS failures, coalesce(b.happened, last_attempt) AS last_attempt, coalesce(b.error, last_error) AS last_error,"
    " CASE WHEN b.error IS NULL THEN next_retry ELSE b.happened + to_seconds((3600 * 2 ** coalesce(failures, 0))::BIGINT) END AS next_retry FROM r FULL JOIN b USING (user_id, item)"
)
def failure_batch(spark, d):
    """A batch of failures taken into what is known: some of known items, some of new ones."""
    known = _failures(spark, d)
    again = known.where("(user_id + item) % 3 = 0").select("user_id", "item", (F.col("last_attempt") + F.expr("interval 1 day")).alias("at"), F.lit("again").alias("error"))
    new = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("at")).select("user_id", (8 + F.col("user_id") % 2).alias("item"), "at", F.lit("new").alias("error"))
    return Q.refreshed(known, again.unionByName(new), ["user_id", "item"])


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*)::BIGINT AS n FROM s GROUP BY user_id, k")
def session_gap(spark, d):
    """Sessions of a user end after 30 quiet minutes."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"), "ts")
    s = e.groupBy("user_id", F.session_window("t", "30 minutes")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return s.select("user_id", "first_ts", "last_ts", "n")


@query("SELECT conv_id, turn, arg_max(role, (len(text), text)) AS role, max(len(text))::BIGINT AS size FROM conversations GROUP BY 1, 2")
def fold_parts(spark, d):
    """Parts of one message: the last value wins, whatever order or how often they arrive."""
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id", "turn").agg(F.max_by("role", F.struct(F.length("text"), "text")).alias("role"), F.max(F.length("text")).cast("bigint").alias("size"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) GROUP BY 1")
def fold_returns(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["role"]), ",").alias("roles"))


@query("SELECT conv_id, max(turn)::BIGINT AS last_turn, arg_max(role, turn) = 'assistant' AS complete FROM conversations GROUP BY 1")
def run_complete(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), (F.max_by("role", "turn") == "assistant").alias("complete"))


@query("WITH r AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders), b AS (SELECT o_orderdate, min((n - 1) // 50) AS batch FROM r GROUP BY 1) SELECT batch::BIGINT AS batch, count(*)::BIGINT AS n, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM r JOIN b USING (o_orderdate) GROUP BY 1")
def date_batches(spark, d):
    """Batches of about 50 rows by date that never split equal dates: counts by date first, then a running sum of few rows."""
    days = table(spark, d, "orders").groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(W.orderBy("o_orderdate").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return days.withColumn("batch", F.floor(before / 50).cast("bigint")).groupBy("batch").agg(F.sum("k").alias("n"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def upsert_replace(spark, d):
    """Old and new rows of each key by version: the newest stays."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("v", F.struct("o_orderdate", "o_orderkey"))
    return E.upsert(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"), ["o_custkey"], "v").drop("v")


@query(
    "WITH n AS (SELECT o_custkey, max(o_orderdate) AS last_scan, count(*)::BIGINT AS items FROM orders GROUP BY 1), o AS (SELECT o_custkey, max(o_orderdate) AS last_scan, count(*)::BIGINT AS items FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)"
    " SELECT o_custkey, last_scan, items FROM n WHERE o_custkey % 3 <> 0 UNION ALL SELECT o_custkey, last_scan, items FROM o WHERE o_custkey % 3 = 0"
)
def upsert_state(spark, d):
    """The state of each index, where a new scan of two thirds of them replaces or adds rows."""
    orders = table(spark, d, "orders")
    state = lambda rows: rows.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_scan"), F.count(F.lit(1)).alias("items"))
    return E.replaced(state(orders.where("o_orderkey % 2 = 0")), state(orders).where("o_custkey % 3 <> 0"), ["o_custkey"])


#: Indexes as they are and as the last scan of two thirds of them left them: part of these saw half of the orders, an
#: older date, or an embedding less.
_INDEX_SQL = (
    "n AS (SELECT o_custkey, count(*) AS items, max(o_orderdate) AS newest, count(*) FILTER (o_orderstatus <> 'P') AS embeddings FROM orders GROUP BY 1),"
    " s AS (SELECT o_custkey, count(*) AS items, max(o_orderdate) AS top, count(*) FILTER (o_orderstatus <> 'P') - (o_custkey % 7 = 0)::INT AS embeddings FROM orders WHERE o_custkey % 3 <> 0 AND (o_custkey % 2 = 0 OR o_orderkey % 2 = 0) GROUP BY 1)"
)


@query(
    f"WITH {_INDEX_SQL} SELECT o_custkey, CASE WHEN s.items IS NULL AND n.embeddings = 0 THEN 'first run' WHEN s.items IS NULL THEN 'no state' WHEN n.newest + INTERVAL 8 DAY > s.top + INTERVAL 7 DAY + to_days((o_custkey % 10)::INT) THEN 'old scan' WHEN n.items <> s.items THEN 'items counted'"
    " WHEN n.newest > s.top - to_days((o_custkey % 4 = 0)::INT) THEN 'items modified' WHEN n.embeddings <> s.embeddings THEN 'embeddings counted' END AS reason FROM n LEFT JOIN s USING (o_custkey)"
)
def diff_needed(spark, d):
    """Why an index must be compared again, first reason first, eight days after its last order."""
    o, k = table(spark, d, "orders"), F.col("o_custkey")
    state = lambda rows: rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("items"), F.max("o_orderdate").alias("newest"), F.count_if(F.col("o_orderstatus") != "P").alias("embeddings"))
    days = lambda n: F.make_dt_interval(n.cast("int"))
    seen = state(o.where((k % 3 != 0) & ((k % 2 == 0) | (F.col("o_orderkey") % 2 == 0)))).withColumn("newest", F.col("newest").cast("timestamp_ntz"))
    seen = seen.select("o_custkey", (F.col("newest") + days(k % 10)).alias("last_scan"), "items", (F.col("newest") - days(k % 4 == 0)).alias("newest"), (F.col("embeddings") - (k % 7 == 0).cast("int")).alias("embeddings"))
    now = state(o).withColumn("newest", F.col("newest").cast("timestamp_ntz"))
    return E.diff_reasons(now, seen, ["o_custkey"], F.col("newest") + days(F.lit(8)))


@query(
    "WITH c AS (SELECT conv_id AS run, turn AS call FROM conversations WHERE role = 'assistant'), r AS (SELECT conv_id AS run, turn - 1 AS call, length(coalesce(text, '')) % 4 AS f FROM conversations WHERE role = 'user'), s AS (SELECT conv_id AS run, arg_max(role, turn) = 'assistant' AS open FROM conversations GROUP BY 1)"
    " SELECT run, call, CASE WHEN f IS NULL AND open THEN 'in_progress' WHEN f IS NULL OR f < 2 THEN 'error' ELSE 'completed' END AS status FROM c LEFT JOIN r USING (run, call) JOIN s USING (run)"
)
def tool_status(spark, d):
    """Turns of an assistant as calls, the user's next turns as their results, some of which fail or ask for a retry; runs
    that end in a call go on."""
    c, form = table(spark, d, "conversations").withColumnRenamed("conv_id", "run"), F.length(F.coalesce("text", F.lit(""))) % 4
    calls = c.where("role = 'assistant'").select("run", F.col("turn").alias("call"))
    results = c.where("role = 'user'").select("run", (F.col("turn") - 1).alias("call"), F.lit(0).alias("seq"), F.when(form == 0, "retry-prompt").otherwise("tool-return").alias("kind"), F.when(form == 1, "failed").when(form == 2, "success").alias("outcome"))
    runs = c.groupBy("run").agg(F.when(F.max_by("role", "turn") == "assistant", "in_progress").otherwise("completed").alias("status"))
    return folds.call_status(calls, results, runs)


@query("SELECT doc_id, length(text) AS size, lang FROM documents WHERE NOT (doc_id % 2 = 0 AND doc_id % 6 <> 0) OR doc_id IS NULL")
def delete_unchanged(spark, d):
    """Cache entries of even ids were read to be deleted; each third of these has changed since, and stays."""
    now = table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("size"), "lang")
    read = now.where("doc_id % 2 = 0").withColumn("size", F.when(F.col("doc_id") % 6 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return E.delete_unchanged(now, read, ["doc_id"])


@query("SELECT o_custkey, n AS failures, (3600 * pow(2, n - 1))::BIGINT AS wait_s FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) WHERE n < 5")
def backoff_filter(spark, d):
    n = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("failures")).where("failures < 5")
    return n.select("o_custkey", "failures", (F.lit(3600) * F.pow(F.lit(2), F.col("failures") - 1)).cast("bigint").alias("wait_s"))


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1")
def added_today(spark, d):
    e = table(spark, d, "events")
    since = e.agg(F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("since"))
    return e.join(F.broadcast(since), F.col("ts") >= F.col("since")).groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def cache_gc(spark, d):
    """Entries that nothing refers to."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT event_type, CASE event_type WHEN 'purchase' THEN 'orders' WHEN 'view' THEN 'activity' ELSE 'other' END AS route, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def route_events(spark, d):
    t = F.col("event_type")
    return table(spark, d, "events").groupBy("event_type", F.when(t == "purchase", "orders").when(t == "view", "activity").otherwise("other").alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, (epoch_us(ts) // 1000)::BIGINT AS ms FROM events")
def ts_to_ms(spark, d):
    return table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@query(
    "WITH n AS (SELECT max(ts)::DATE AS today FROM events) SELECT event_id, CASE WHEN ts::DATE = today THEN 'Today' WHEN ts::DATE = today - 1 THEN 'Yesterday' WHEN ts::DATE - dayofweek(ts::DATE)::INT = today - dayofweek(today)::INT THEN 'This Week'"
    " WHEN date_trunc('month', ts) = date_trunc('month', today) THEN 'This Month' ELSE 'Older' END AS date_group FROM events, n"
)
def date_group(spark, d):
    """Events by how long ago they were, seen from the last one."""
    return table(spark, d, "events").select("event_id", T.date_group(F.col("ts"), _now(spark, d)).alias("date_group"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, props IS NOT NULL AND json_valid(props) AS valid FROM events")
def json_parse(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.coalesce(F.get_json_object("props", "$").isNotNull(), F.lit(False)).alias("valid"))


@query()
def sanitize_error(spark, d):
    """Messages of failed pages without paths."""
    return table(spark, d, "pages").select("page_id", T.sanitize_error(F.concat(F.lit("cannot open /var/data/"), "url")).alias("message"))


# ---- streams -------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type AS kind, min(coalesce((props->>'k')::BIGINT, 100)) AS priority, min(ts) AS queued, count(*)::BIGINT AS asked FROM events GROUP BY 1, 2")
def queue_stream(spark, d):
    """Requests coalesced as a stream over the events that are there."""
    jobs = streaming.caught_up(streaming.queued(streaming.events(spark, d), Q.PRIORITY), streaming.own_folder(spark, "queue", d))
    return jobs.withColumn("queued", F.col("queued").cast("timestamp_ntz"))


@query(
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),"
    " s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS begin, count(*)::BIGINT AS n FROM s GROUP BY user_id, k"
)
def session_stream(spark, d):
    """Sessions by session windows over the stream of events."""
    rows = streaming.caught_up(streaming.sessions(streaming.events(spark, d)), streaming.own_folder(spark, "sessions", d))
    return rows.withColumn("begin", F.col("begin").cast("timestamp_ntz"))


#: What the events of _run_events come to. Parts of assistants: the text, and a call whose second sending is longer, with
#: progress of after it and arguments of before it; all others are returns.
_RUN_SQL = (
    "WITH c AS (SELECT conv_id AS run, turn AS message, role, text FROM conversations), s AS (SELECT run, unnest(range(0, max(message) + 1)) AS message FROM c GROUP BY run)"
    " SELECT run, message::INT AS message, CASE WHEN role <> 'assistant' THEN 'request' ELSE 'response' END AS kind, CASE WHEN role = 'assistant' THEN 'text:' || text || '||;;tool-call:' || substr(text, 1, 20) || '|done|' || substr(text, 1, 5) WHEN role IS NOT NULL THEN 'tool-return:' || text || '||' ELSE '' END AS parts FROM s LEFT JOIN c USING (run, message)"
)


def _run_events(spark, d):
    """Turns as the events of a run: an assistant sends its text in two parts, a tool call, arguments, the call again,
    progress twice, and progress of a call that is not there."""
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("run"), F.col("turn").cast("int").alias("message"), "role", F.col("text").alias("t"))
    call, seq, t = F.concat(F.lit("c"), F.col("message").cast("string")), F.col("message") * 10, F.col("t")

    def one(k: int, event: str, part: int | None, kind: str | None, payload, of=None):
        return F.struct((seq + k).cast("bigint").alias("seq"), F.lit(event).alias("event"), F.lit(part).cast("int").alias("part"), F.lit(kind).cast("string").alias("kind"), (F.lit(None).cast("string") if of is None else of).alias("call"), payload.alias("payload"))

    tool = F.substr(t, F.lit(1), F.lit(10)), F.substr(t, F.lit(1), F.lit(20))
    own = F.array(
        one(0, "part", 0, "text", F.left(t, F.lit(7))), one(1, "part", 0, "text", t), one(2, "part", 2, "tool-call", tool[0], call), one(3, "args", None, None, F.left(t, F.lit(5)), call),
        one(4, "part", 2, "tool-call", tool[1], call), one(5, "progress", None, None, F.lit("half"), call), one(6, "progress", None, None, F.lit("done"), call), one(7, "progress", None, None, F.lit("lost"), F.lit("none")),
    )
    said = F.when(F.col("role") == "assistant", own).otherwise(F.array(one(0, "return", None, None, t)))
    return c.select("run", "message", F.explode(said).alias("e")).select("run", "message", "e.*")


def _told(messages):
    part = lambda p: F.concat(F.coalesce(p["kind"], F.lit("")), F.when(p.isNotNull(), F.lit(":")).otherwise(""), F.concat_ws("|", *[F.coalesce(p[x], F.lit("")) for x in ("payload", "progress", "args")]))
    parts = F.transform("parts", lambda p: F.when(p.isNull(), F.lit("")).otherwise(part(p)))
    return messages.select(F.col("run").cast("bigint").alias("run"), "message", "kind", F.array_join(parts, ";").alias("parts"))


@query(_RUN_SQL)
def fold_run(spark, d):
    """Messages of each run from all of its events, with empty ones where nothing came."""
    return _told(folds.messages(folds.slots(_run_events(spark, d))))


@query(_RUN_SQL)
def fold_stream(spark, d):
    """fold_run from a stream of the conversations' files, by keyed state of one row for each call of a slot."""
    at = streaming.own_folder(spark, "folds", d)
    files = stored_once(_run_events(spark, d), f"{at}/events")
    rows = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/events")
    streaming.appended(folds.slot_stream(rows), f"{at}/table").trigger(availableNow=True).start().awaitTermination()
    return _told(folds.messages(folds.merged(Snapshots(spark, f"{at}/table").read())))
