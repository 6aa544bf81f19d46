"""Task states, watchdogs, quotas, queues and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinegraph.operators import store as S
from cinegraph.operators import tasks as K
from cinegraph.operators.ranking import classify_error
from cinegraph.plans.catalog import event, query, t
from cinegraph.streaming import consumers as Q
from cinegraph.streaming import sessions as W

c = F.col
#: The sweep's time; what came later is not known to it.
NOW = "2024-01-30 12:00:00"
_NOW = f"TIMESTAMP '{NOW}'"
ACTIONS = list(K.TRANSITIONS)


def _null(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


def _fold_sql() -> str:
    """The guarded transitions as a recursive query over each user's actions in order."""
    ok = []
    for name, (before, _) in K.TRANSITIONS.items():
        here = "state IS NULL" if before == (None,) else f"state IN ({', '.join(map(_null, before))})"
        budget = {"analyze_retry": f" AND ar < {K.MAX_RETRY}", "commit_retry": f" AND cr < {K.MAX_RETRY}"}.get(name, "")
        ok.append(f"(action = '{name}' AND {here}{budget})")
    to = " ".join(f"WHEN '{name}' THEN '{after}'" for name, (_, after) in K.TRANSITIONS.items())
    return f"""act AS (SELECT user_id, ts, ({ACTIONS})[1 + (k % {len(ACTIONS)})::INT] AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM event WHERE ts < {_NOW}),
    fold AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::VARCHAR AS state, 0 AS aa, 0 AS ar, 0 AS ca, 0 AS cr, 0 AS rejected, NULL::TIMESTAMP AS since FROM act
    UNION ALL SELECT user_id, i, CASE WHEN ok THEN CASE action {to} END ELSE state END, aa + (ok AND action IN ('create', 'analyze_queue', 'analyze_retry'))::INT, CASE WHEN ok AND action = 'manual_analyze' THEN 0 ELSE ar + (ok AND action = 'analyze_retry')::INT END,
      ca + (ok AND action IN ('analyzed', 'commit_queue', 'commit_retry'))::INT, CASE WHEN ok AND action = 'manual_commit' THEN 0 ELSE cr + (ok AND action = 'commit_retry')::INT END, rejected + (NOT ok)::INT, CASE WHEN ok THEN ts ELSE since END
      FROM (SELECT f.*, a.action, a.ts, coalesce({' OR '.join(ok)}, false) AS ok FROM (SELECT user_id, i + 1 AS i, state, aa, ar, ca, cr, rejected, since FROM fold) f JOIN act a USING (user_id, i))),
    task AS (SELECT user_id, arg_max(ROW(state, aa, ar, ca, cr, rejected, since), i) AS s FROM fold GROUP BY user_id),
    tasks AS (SELECT user_id, s[1] AS state, s[2] AS analyze_attempt, s[3] AS analyze_retry, s[4] AS commit_attempt, s[5] AS commit_retry, s[6] AS rejected, s[7] AS updated_at FROM task)"""


_TASKS = "[event] WITH RECURSIVE " + _fold_sql()
_BEATS = f"beats AS (SELECT user_id, max(ts) AS beat_at, arg_max(k % 4 - 1, (ts, event_id)) AS beat_attempt FROM event WHERE event_type = 'click' AND ts < {_NOW} GROUP BY user_id)"
_DEAD = "(b.beat_at IS NULL OR coalesce({0} > 0 AND b.beat_attempt <> -1 AND b.beat_attempt <> {0}, false) OR " + _NOW + " - b.beat_at > INTERVAL 30 MINUTE)"


def _known(spark: SparkSession, d: str) -> DataFrame:
    return event(spark, d).where(c("ts") < F.lit(NOW).cast("timestamp"))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (1 + c("k") % len(ACTIONS)).cast("int"))
    return K.run_states(_known(spark, d).select("user_id", "ts", "event_id", action.alias("action")), "user_id", ["ts", "event_id"], "action")


def _ms(x: F.Column) -> F.Column:
    return F.unix_millis(x.cast("timestamp"))


def _now_ms() -> F.Column:
    return _ms(F.lit(NOW).cast("timestamp"))


def _beats(spark: SparkSession, d: str) -> DataFrame:
    b = _known(spark, d).where("event_type = 'click'").groupBy("user_id").agg(F.max("ts").alias("at"), F.max_by(c("k") % 4 - 1, F.struct("ts", "event_id")).alias("beat_attempt"))
    return b.select("user_id", _ms(c("at")).alias("beat_ms"), "beat_attempt")


@query(_TASKS + " SELECT user_id, state, rejected FROM tasks")
def task_state_machine(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each task after its actions in order, and how many were not allowed."""
    return _tasks(spark, d).select("user_id", "state", "rejected")


@query(_TASKS + " SELECT user_id, state, rejected FROM tasks")
def task_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same machine as a stream with state; a source of one file is one batch."""
    schema = t(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    k = F.get_json_object("props", "$.k").cast("int")
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (1 + k % len(ACTIONS)).cast("int"))
    source = source.where(c("ts") < F.lit(NOW).cast("timestamp")).select("user_id", "ts", "event_id", action.alias("action"))
    return W.drain(W.task_states(source, None), "update").select("user_id", "state", "rejected")


@query(_TASKS + " SELECT user_id, analyze_attempt, analyze_retry, commit_attempt, commit_retry FROM tasks")
def fencing_and_budget(spark: SparkSession, d: str) -> DataFrame:
    """Every dispatch raises an attempt, which fences off older executors; only failures use up the budget."""
    return _tasks(spark, d).select("user_id", "analyze_attempt", "analyze_retry", "commit_attempt", "commit_retry")


@query(_TASKS + " SELECT user_id, CASE state WHEN 'ANALYZE_FAILED' THEN 'QUEUED' WHEN 'COMMIT_FAILED' THEN 'ANALYZED' ELSE state END AS state, CASE WHEN state = 'ANALYZE_FAILED' THEN 0 ELSE analyze_retry END AS analyze_retry, CASE WHEN state = 'COMMIT_FAILED' THEN 0 ELSE commit_retry END AS commit_retry, coalesce(state IN ('ANALYZE_FAILED', 'COMMIT_FAILED'), false) AS retried FROM tasks")
def manual_retry(spark: SparkSession, d: str) -> DataFrame:
    return K.manual_retry(_tasks(spark, d)).withColumn("retried", F.coalesce("retried", F.lit(False)))


def _redo(retry: str, go: str) -> str:
    return f"CASE WHEN {retry} < {K.MAX_RETRY} THEN '{go}' ELSE 'exhausted' END"


@query(_TASKS + f""", {_BEATS} SELECT user_id, state, CASE
 WHEN state = 'QUEUED' AND {_NOW} - updated_at > INTERVAL 5 MINUTE THEN CASE WHEN analyze_attempt - analyze_retry >= {K.MAX_QUEUE} THEN 'queue_capped' ELSE 'redispatch_analyze' END
 WHEN state = 'ANALYZED' AND {_NOW} - updated_at > INTERVAL 5 MINUTE THEN CASE WHEN commit_attempt - commit_retry >= {K.MAX_QUEUE} THEN 'queue_capped' ELSE 'redispatch_commit' END
 WHEN state = 'ANALYZING' AND {_DEAD.format('analyze_attempt')} THEN {_redo('analyze_retry', 'fail_redispatch_analyze')}
 WHEN state = 'COMMITTING' AND {_DEAD.format('commit_attempt')} THEN {_redo('commit_retry', 'fail_redispatch_commit')}
 WHEN state = 'ANALYZE_FAILED' AND {_NOW} - updated_at > INTERVAL 15 SECOND * (2 ** least(analyze_retry, 6))::INT THEN {_redo('analyze_retry', 'redispatch_analyze')}
 WHEN state = 'COMMIT_FAILED' AND {_NOW} - updated_at > INTERVAL 15 SECOND * (2 ** least(commit_retry, 6))::INT THEN {_redo('commit_retry', 'redispatch_commit')}
 ELSE 'none' END AS action FROM tasks LEFT JOIN beats b USING (user_id)""")
def watchdog(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that nothing moves are dispatched again: by age without an executor, by heartbeat or attempt with one, after a back-off when failed."""
    return K.watchdog(_tasks(spark, d).withColumn("updated_ms", _ms(c("updated_at"))), _beats(spark, d), _now_ms())


@query(_TASKS + f", {_BEATS} SELECT count(*) AS running, count(*) >= 3 AND count(b.user_id) = 0 AS skip FROM tasks LEFT JOIN beats b USING (user_id) WHERE state IN ('ANALYZING', 'COMMITTING')")
def mass_heartbeat_guard(spark: SparkSession, d: str) -> DataFrame:
    """Where three or more run and none has a heartbeat, the store is at fault and the sweep is skipped."""
    r = _tasks(spark, d).where("state in ('ANALYZING', 'COMMITTING')").join(_beats(spark, d), "user_id", "left")
    return r.agg(F.count("*").alias("running"), ((F.count("*") >= 3) & (F.count("beat_ms") == 0)).alias("skip"))


@query("[event] WITH o AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN k % 5 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stored FROM event) SELECT event_id, stored IS NULL OR stored = k % 5 AS accepted FROM o WHERE event_type = 'click'")
def heartbeat_owner_write(spark: SparkSession, d: str) -> DataFrame:
    """A heartbeat (click) is written if no attempt is stored or its own is; a dispatch (view) stores a new one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    o = event(spark, d).withColumn("stored", F.last(F.when(c("event_type") == "view", c("k") % 5), ignorenulls=True).over(w))
    return o.where("event_type = 'click'").select("event_id", (c("stored").isNull() | (c("stored") == c("k") % 5)).alias("accepted"))


@query(_TASKS + f", {_BEATS} SELECT user_id, coalesce(state = 'ANALYZING' AND {_NOW} - b.beat_at < INTERVAL 12 HOUR AND (b.beat_attempt = -1 OR b.beat_attempt = analyze_attempt), false) AS fresh FROM tasks LEFT JOIN beats b USING (user_id)")
def fresh_running_precheck(spark: SparkSession, d: str) -> DataFrame:
    """Whether a live executor of the same attempt runs already (its heartbeat may be 12 hours old on these sparse events)."""
    x = _tasks(spark, d).join(_beats(spark, d), "user_id", "left")
    fresh = (c("state") == "ANALYZING") & (_now_ms() - c("beat_ms") < 12 * 3_600_000) & ((c("beat_attempt") == -1) | (c("beat_attempt") == c("analyze_attempt")))
    return x.select("user_id", F.coalesce(fresh, F.lit(False)).alias("fresh"))


@query(_TASKS + f", n AS (SELECT least(count(*), {K.ANALYZE_SLOTS}) AS n FROM tasks WHERE state = 'ANALYZING'), w AS (SELECT user_id, row_number() OVER (ORDER BY updated_at, user_id) AS r FROM tasks WHERE state = 'QUEUED') SELECT user_id, CASE WHEN r <= {K.ANALYZE_SLOTS} - n THEN 'ACCEPT' ELSE 'BUSY' END AS admission FROM w, n UNION ALL SELECT user_id, 'DUPLICATE' FROM tasks WHERE state = 'ANALYZING'")
def slot_admission(spark: SparkSession, d: str) -> DataFrame:
    return K.admit(_tasks(spark, d).withColumn("updated_ms", _ms(c("updated_at"))), "QUEUED", "ANALYZING", K.ANALYZE_SLOTS)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b(user_id, i, event_id, s, granted, wait_s, left_) AS (SELECT user_id, i, event_id, s, true, 0::DOUBLE, 1::DOUBLE FROM e WHERE i = 1
UNION ALL SELECT user_id, i, event_id, s, have >= 1, CASE WHEN have >= 1 THEN 0 ELSE (1 - have) * 43200 END, have - (have >= 1)::INT FROM (SELECT e.*, least(2, b.left_ + (e.s - b.s) / 43200) AS have FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1))
SELECT user_id, event_id, granted, round(wait_s, 2) AS wait_s FROM b""")
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return K.token_bucket(t(spark, d, "events"), "user_id", 2, 1 / 43_200).withColumn("wait_s", F.round("wait_s", 2))


@query("WITH r AS (SELECT event_id, user_id, epoch_ms(ts) AS s, epoch_ms(ts) + (value * 3600000)::BIGINT AS e FROM events), u AS (SELECT user_id, s AS moment, 1 AS k, event_id FROM r UNION ALL SELECT user_id, e, -1, NULL FROM r), x AS (SELECT *, sum(k) OVER (PARTITION BY user_id ORDER BY moment, k, event_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running FROM u) SELECT event_id, running, running > 2 AS waits FROM x WHERE k = 1")
def inflight_semaphore(spark: SparkSession, d: str) -> DataFrame:
    """Requests that run as long as their value in hours; two of a user may run at once."""
    r = t(spark, d, "events").select("event_id", "user_id", _ms(c("ts")).alias("start_ms"), (_ms(c("ts")) + F.round(c("value") * 3_600_000).cast("long")).alias("end_ms"))
    return K.in_flight(r, "user_id", 2)


@query("WITH a AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 1) SELECT event_id FROM a QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) <= 10")
def rate_quota_fixed(spark: SparkSession, d: str) -> DataFrame:
    """One for each user and ten for all in an hour."""
    return K.quota(t(spark, d, "events"), "user_id", 1, n_all=10).select("event_id")


@query("[event] SELECT event_id, round(least(2 ** (k % 7) * 2, 30) + ('0x' || left(md5(event_id::VARCHAR), 3))::INT / 4096, 6) AS wait_s, NOT (400 + k BETWEEN 400 AND 499 AND 400 + k <> 429) AS retried FROM event")
def backoff_retry(spark: SparkSession, d: str) -> DataFrame:
    """Doubling waits up to 30 seconds with up to a second on top, which is fixed for each event, so a repeated run waits alike."""
    s = 400 + c("k")
    jitter = F.conv(F.left(F.md5(c("event_id").cast("string")), F.lit(3)), 16, 10).cast("double") / 4096
    return event(spark, d).select("event_id", F.round(F.least(F.pow(F.lit(2), c("k") % 7) * 2, F.lit(30)) + jitter, 6).alias("wait_s"), (~(s.between(400, 499) & (s != 429))).alias("retried"))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id) = 1")
def dedupe_ttl(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    return S.latest(e, ["user_id", "event_type", "day"], ["ts", "event_id"]).select("event_id")


@query("SELECT source, md5(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY ALL HAVING count(*) > 1")
def content_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").groupBy("source", F.md5("text").alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("[event] SELECT event_id, k % 3 <> 0 AS ledger, k % 2 <> 0 AS dead_letter, k % 3 <> 0 OR k % 2 <> 0 AS acknowledged FROM event WHERE user_id % 5 = 0 AND event_type = 'error' OR value < 5")
def poison_message(spark: SparkSession, d: str) -> DataFrame:
    """Malformed messages go to the ledger and to the dead letters; one of the two must take them, or they are delivered again."""
    e = event(spark, d)
    return Q.poison(e, ((c("user_id") % 5 == 0) & (c("event_type") == "error")) | (c("value") < 5), c("k") % 3 != 0, c("k") % 2 != 0)


_TEXTS = ["read timed out", "401 unauthorized", "file not found", "odd value"]


@query(f"[event] WITH m AS (SELECT *, ({_TEXTS})[1 + (k % 4)::INT] AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM event WHERE event_type = 'error') SELECT event_id, attempt, CASE WHEN attempt < 3 AND m IN ('read timed out', 'odd value') THEN 'retry' ELSE 'dead' END AS decision FROM m")
def delivery_retry(spark: SparkSession, d: str) -> DataFrame:
    """A failed delivery is tried three times, but not where the error lasts."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    text = F.element_at(F.array(*[F.lit(x) for x in _TEXTS]), (1 + c("k") % 4).cast("int"))
    e = event(spark, d).where("event_type = 'error'").select("event_id", F.row_number().over(w).alias("attempt"), classify_error(text, F.lit("RuntimeError")).alias("e"))
    return e.select("event_id", "attempt", F.when((c("attempt") < 3) & c("e.retryable"), "retry").otherwise("dead").alias("decision"))


@query("[event] WITH e AS (SELECT user_id || ':' || (k % 3) AS channel, ts, event_id, event_type FROM event), f AS (SELECT channel, min((ts, event_id)) FILTER (event_type IN ('purchase', 'error')) AS last FROM e GROUP BY channel) SELECT channel, count(*) AS delivered, max(event_id) AS last_id, bool_or(event_type IN ('purchase', 'error')) AS closed FROM e JOIN f USING (channel) WHERE last IS NULL OR (ts, event_id) <= last GROUP BY channel")
def event_fanout(spark: SparkSession, d: str) -> DataFrame:
    """What the subscribers of each channel get: everything up to the first event that ends it."""
    e = event(spark, d).select(F.concat_ws(":", "user_id", c("k") % 3).alias("channel"), F.struct("ts", "event_id").alias("at"), "event_id", c("event_type").isin("purchase", "error").alias("ends"))
    last = e.where("ends").groupBy("channel").agg(F.min("at").alias("last"))
    seen = e.join(last, "channel", "left").where("last is null or at <= last")
    return seen.groupBy("channel").agg(F.count("*").alias("delivered"), F.max("event_id").alias("last_id"), F.bool_or("ends").alias("closed"))


@query("""WITH RECURSIVE q AS (SELECT o_orderkey AS request, o_orderdate::DATE AS day, list_sort(list(DISTINCT l_suppkey % 20)) AS ks FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY request) AS i FROM q),
r AS (SELECT day, i, request, ks, true AS granted, ks AS held FROM n WHERE i = 1 UNION ALL SELECT n.day, n.i, n.request, n.ks, NOT list_has_any(r.held, n.ks), CASE WHEN list_has_any(r.held, n.ks) THEN r.held ELSE list_concat(r.held, n.ks) END FROM r JOIN n ON n.day = r.day AND n.i = r.i + 1)
SELECT request, array_to_string(ks, ',') AS keys, granted FROM r""")
def multi_lock_order(spark: SparkSession, d: str) -> DataFrame:
    """Write sets of a day's orders (suppliers in twenty shards) take all of their locks or none, in order."""
    lines = t(spark, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), (c("l_suppkey") % 20).alias("k"))
    o = t(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")).join(lines, "o_orderkey")
    q = o.groupBy(c("o_orderkey").alias("request"), "day").agg(F.array_sort(F.collect_set("k")).alias("keys"))
    return K.locks(q, "day", "request", "keys")


@query(f"SELECT event_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-28 00:00:00'")
def orphan_upload_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").where((c("event_type") == "signup") & (c("ts") < F.lit("2024-01-28 00:00:00").cast("timestamp"))).select("event_id")


@query(_TASKS + f", {_BEATS} SELECT user_id, CASE WHEN state IN ('QUEUED', 'ANALYZING', 'ANALYZED', 'COMMITTING') THEN CASE WHEN b.beat_at IS NULL OR {_NOW} - b.beat_at > INTERVAL 30 MINUTE THEN 'table' ELSE 'cache' END ELSE 'table' END AS source, CASE WHEN state IS NULL THEN 'NONE' WHEN state IN ('ANALYZE_FAILED', 'COMMIT_FAILED', 'CANCELLED') THEN 'FAILED' WHEN state = 'SUCCESS' THEN 'DONE' ELSE 'RUNNING' END AS status FROM tasks LEFT JOIN beats b USING (user_id)")
def status_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """An active task whose cached state is stale is read from the table; both are mapped to what users see."""
    x = _tasks(spark, d).join(_beats(spark, d), "user_id", "left")
    s = c("state")
    stale = c("beat_ms").isNull() | (_now_ms() - c("beat_ms") > K.HEARTBEAT_MS)
    source = F.when(s.isin("QUEUED", "ANALYZING", "ANALYZED", "COMMITTING") & ~stale, "cache").otherwise("table")
    status = F.when(s.isNull(), "NONE").when(s.isin("ANALYZE_FAILED", "COMMIT_FAILED", "CANCELLED"), "FAILED").when(s == "SUCCESS", "DONE").otherwise("RUNNING")
    return x.select("user_id", source.alias("source"), status.alias("status"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_cache(spark: SparkSession, d: str) -> DataFrame:
    done = t(spark, d, "labels").where("quality = 1").select("doc_id")
    return t(spark, d, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query(f"[event] WITH m AS (SELECT *, ({_TEXTS})[1 + (k % 4)::INT] AS m FROM event) SELECT event_id, 'topic-' || event_type AS topic, CASE WHEN value < 2 THEN 'dead' WHEN value >= 10 THEN 'done' WHEN k % 5 + 1 < 3 AND m IN ('read timed out', 'odd value') THEN 'retry' ELSE 'dead' END AS outcome FROM m")
def mq_consumers(spark: SparkSession, d: str) -> DataFrame:
    """Queue topics as a stream: malformed messages and lasting faults end among the dead letters, others are retried."""
    schema = t(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.element_at(F.array(*[F.lit(x) for x in _TEXTS]), (1 + k % 4).cast("int"))
    messages = source.select("event_id", F.concat(F.lit("topic-"), "event_type").alias("topic"), (c("value") >= 2).alias("well_formed"), F.when(c("value") < 10, text).alias("error"), (k % 5 + 1).alias("attempt"))
    return W.drain(Q.consume(messages))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return W.tumbling(t(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("SELECT h + INTERVAL (i * 30) MINUTE AS start, event_type, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE AS h, unnest([0, 1]) AS i FROM events) GROUP BY ALL")
def window_sliding(spark: SparkSession, d: str) -> DataFrame:
    return W.sliding(t(spark, d, "events"), "1 hour", "30 minutes")


@query("WITH g AS (SELECT *, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR)::INT AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def window_session(spark: SparkSession, d: str) -> DataFrame:
    return W.session(t(spark, d, "events"), "6 hours")


def _deliveries(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """A stream that gets its parts one after the other, a batch each."""
    import time
    import uuid

    from cinegraph.plans.shared import shared_dir

    path = f"{shared_dir(spark)}/source-{uuid.uuid4().hex}"
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{path}/part={i}")
        time.sleep(0.05)  # the source goes by the time of a file
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


@query("SELECT event_id, user_id, event_type FROM events")
def dedupe_stream(spark: SparkSession, d: str) -> DataFrame:
    """Messages that are delivered twice in different batches come out once."""
    e = t(spark, d, "events").select("event_id", c("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    parts = [e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1 or event_id % 3 = 0"), e.where("event_id % 5 = 0")]
    return W.drain(W.dedupe(_deliveries(spark, parts), ["event_id"], "60 days")).select("event_id", "user_id", "event_type")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY ALL")
def late_rows_stream(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of a stream whose first ten days come last: the watermark has passed them, so they are dropped."""
    e = t(spark, d, "events").select("event_id", c("ts").cast("timestamp").alias("ts"), "event_type", "value")
    day = lambda x: F.lit(f"2024-01-{x} 00:00:00").cast("timestamp")
    parts = [e.where((c("ts") >= day(10)) & (c("ts") < day(20))), e.where(c("ts") >= day(20)), e.where(c("ts") < day(10))]
    updates = W.drain(W.tumbling(_deliveries(spark, parts), "1 hour"), "update")
    return updates.groupBy("start", "event_type").agg(F.max("n").alias("n"))
