"""Task states: guarded transitions with fencing and budgets, the watchdog, admission, quotas, locks and uploads.

A task's events are folded in order inside the JVM; tasks are many and each has few events.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States from which each action may start (None: no task yet), and the state it leads to.
TRANSITIONS: dict[str, tuple[tuple[str | None, ...], str]] = {
    "create": ((None,), "QUEUED"),
    "analyze": (("QUEUED",), "ANALYZING"),
    "analyzed": (("ANALYZING",), "ANALYZED"),
    "commit": (("ANALYZED",), "COMMITTING"),
    "committed": (("COMMITTING",), "SUCCESS"),
    "analyze_error": (("QUEUED", "ANALYZING"), "ANALYZE_FAILED"),
    "commit_error": (("ANALYZED", "COMMITTING"), "COMMIT_FAILED"),
    "analyze_queue": (("QUEUED",), "QUEUED"),
    "commit_queue": (("ANALYZED",), "ANALYZED"),
    "analyze_retry": (("QUEUED", "ANALYZE_FAILED"), "QUEUED"),
    "commit_retry": (("ANALYZED", "COMMIT_FAILED"), "ANALYZED"),
    "manual_analyze": (("ANALYZE_FAILED",), "QUEUED"),
    "manual_commit": (("COMMIT_FAILED",), "ANALYZED"),
    "cancel": (("QUEUED", "ANALYZING", "ANALYZED", "COMMITTING", "ANALYZE_FAILED", "COMMIT_FAILED"), "CANCELLED"),
}
#: Fixed values of the watchdog: failures that may be retried, queue dispatches, milliseconds without a sign of life.
MAX_RETRY, MAX_QUEUE = 2, 10
NO_EXECUTOR_MS, HEARTBEAT_MS, BACKOFF_MS = 300_000, 1_800_000, 15_000
ANALYZE_SLOTS, COMMIT_SLOTS = 3, 2


def step(now: tuple[str | None, int, int, int, int, int], action: str) -> tuple[str | None, int, int, int, int, int]:
    """The fold in Python: state, both attempts (fencing, every dispatch) and retries (budget, failures only), rejected."""
    state, aa, ar, ca, cr, rejected = now
    before, after = TRANSITIONS.get(action, ((), None))
    if state not in before or (action == "analyze_retry" and ar >= MAX_RETRY) or (action == "commit_retry" and cr >= MAX_RETRY):
        return (state, aa, ar, ca, cr, rejected + 1)
    aa += action in ("create", "analyze_queue", "analyze_retry")
    ca += action in ("analyzed", "commit_queue", "commit_retry")
    ar = 0 if action == "manual_analyze" else ar + (action == "analyze_retry")
    cr = 0 if action == "manual_commit" else cr + (action == "commit_retry")
    return (after, aa, ar, ca, cr, rejected)


def _allowed(state: Column, action: Column, a_retry: Column, c_retry: Column) -> Column:
    ok = F.lit(False)
    for name, (before, _) in TRANSITIONS.items():
        here = state.isNull() if before == (None,) else state.isin(*before)
        if name.endswith("_retry"):
            here &= (a_retry if name == "analyze_retry" else c_retry) < MAX_RETRY
        ok |= (action == name) & F.coalesce(here, F.lit(False))
    return ok


def run_states(events: DataFrame, key: str, order: list[str], action: str) -> DataFrame:
    """The last state of each key with its fencing counters, budgets and rejected actions, and the last accepted action's place."""
    to = F.create_map(*[F.lit(x) for name, (_, after) in TRANSITIONS.items() for x in (name, after)])
    start = F.struct(F.lit(None).cast("string").alias("state"), *(F.lit(0).alias(n) for n in ("aa", "ar", "ca", "cr", "rejected")), F.lit(None).cast(dict(events.dtypes)[order[0]]).alias("at"))

    def fold(acc: Column, e: Column) -> Column:
        x = e["x"]
        ok = _allowed(acc["state"], x, acc["ar"], acc["cr"])
        one = lambda *names: (ok & x.isin(*names)).cast("int")
        return F.struct(
            F.when(ok, to[x]).otherwise(acc["state"]).alias("state"),
            (acc["aa"] + one("create", "analyze_queue", "analyze_retry")).alias("aa"),
            F.when(ok & (x == "manual_analyze"), 0).otherwise(acc["ar"] + one("analyze_retry")).alias("ar"),
            (acc["ca"] + one("analyzed", "commit_queue", "commit_retry")).alias("ca"),
            F.when(ok & (x == "manual_commit"), 0).otherwise(acc["cr"] + one("commit_retry")).alias("cr"),
            (acc["rejected"] + (~ok).cast("int")).alias("rejected"),
            F.when(ok, e[order[0]]).otherwise(acc["at"]).alias("at"),
        )

    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(action).alias("x")))).alias("e"))
    out = rows.select(key, F.aggregate("e", start, fold).alias("s"))
    return out.select(key, "s.state", F.col("s.aa").alias("analyze_attempt"), F.col("s.ar").alias("analyze_retry"), F.col("s.ca").alias("commit_attempt"), F.col("s.cr").alias("commit_retry"), "s.rejected", F.col("s.at").alias("updated_at"))


def manual_retry(tasks: DataFrame) -> DataFrame:
    """Failed tasks go back to where they are dispatched from, with a new budget."""
    a, b = F.col("state") == "ANALYZE_FAILED", F.col("state") == "COMMIT_FAILED"
    return tasks.select(
        "user_id",
        F.when(a, "QUEUED").when(b, "ANALYZED").otherwise(F.col("state")).alias("state"),
        F.when(a, 0).otherwise(F.col("analyze_retry")).alias("analyze_retry"),
        F.when(b, 0).otherwise(F.col("commit_retry")).alias("commit_retry"),
        (a | b).alias("retried"),
    )


def heartbeat_dead(attempt: Column, beat_attempt: Column, beat_at: Column, now: Column, stale_ms: int = HEARTBEAT_MS) -> Column:
    """No heartbeat, one of another attempt, or one that is too old."""
    other = (attempt > 0) & (beat_attempt != -1) & (beat_attempt != attempt)
    return beat_at.isNull() | F.coalesce(other, F.lit(False)) | ((now - beat_at) > stale_ms)


def watchdog(tasks: DataFrame, beats: DataFrame, now_ms: Column) -> DataFrame:
    """What the sweep does with each task: redispatch, fail and redispatch, give up, or nothing. Times are milliseconds."""
    x = tasks.join(beats, "user_id", "left")
    c = F.col
    age = now_ms - c("updated_ms")
    waited = lambda retry: age > BACKOFF_MS * F.pow(F.lit(2), F.least(c(retry), F.lit(6))).cast("long")
    dead = lambda attempt: heartbeat_dead(c(attempt), c("beat_attempt"), c("beat_ms"), now_ms)
    budget = lambda retry, go: F.when(c(retry) < MAX_RETRY, go).otherwise("exhausted")
    queue = lambda a, r, go: F.when(c(a) - c(r) >= MAX_QUEUE, "queue_capped").otherwise(go)
    s = c("state")
    action = (
        F.when((s == "QUEUED") & (age > NO_EXECUTOR_MS), queue("analyze_attempt", "analyze_retry", "redispatch_analyze"))
        .when((s == "ANALYZED") & (age > NO_EXECUTOR_MS), queue("commit_attempt", "commit_retry", "redispatch_commit"))
        .when((s == "ANALYZING") & dead("analyze_attempt"), budget("analyze_retry", "fail_redispatch_analyze"))
        .when((s == "COMMITTING") & dead("commit_attempt"), budget("commit_retry", "fail_redispatch_commit"))
        .when((s == "ANALYZE_FAILED") & waited("analyze_retry"), budget("analyze_retry", "redispatch_analyze"))
        .when((s == "COMMIT_FAILED") & waited("commit_retry"), budget("commit_retry", "redispatch_commit"))
        .otherwise("none")
    )
    return x.select("user_id", "state", action.alias("action"))


def admit(tasks: DataFrame, waiting: str, running: str, slots: int) -> DataFrame:
    """Requests of a stage: DUPLICATE where it runs already, ACCEPT for as many of the longest waiting as slots are free, else BUSY."""
    busy = tasks.where(F.col("state") == running).select("user_id")
    free = max(0, slots - busy.limit(slots).count())
    wait = tasks.where(F.col("state") == waiting).select("user_id", "updated_ms")
    first = wait.orderBy("updated_ms", "user_id").limit(free).select("user_id", F.lit(True).alias("_in"))
    out = wait.join(F.broadcast(first), "user_id", "left").select("user_id", F.when(F.col("_in"), "ACCEPT").otherwise("BUSY").alias("admission"))
    return out.unionByName(busy.select("user_id", F.lit("DUPLICATE").alias("admission")))


def token_bucket(events: DataFrame, key: str, capacity: float, rate: float) -> DataFrame:
    """Grants each event a token if the bucket holds one, or says how many seconds are missing; it fills at `rate` a second."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ts", "event_id"])
        tokens, last, out, wait = capacity, None, [], []
        for ts in part["ts"]:
            s = ts.timestamp()
            tokens = min(capacity, tokens + (0 if last is None else (s - last) * rate))
            last = s
            ok = tokens >= 1
            out.append(ok)
            wait.append(0.0 if ok else (1 - tokens) / rate)
            tokens -= ok
        return pd.DataFrame({key: part[key], "event_id": part["event_id"], "granted": out, "wait_s": wait})

    return events.select(key, "event_id", "ts").groupBy(key).applyInPandas(fold, f"{key} long, event_id long, granted boolean, wait_s double")


def in_flight(requests: DataFrame, key: str, limit: int) -> DataFrame:
    """For each request (start_ms, end_ms) how many of its key run when it starts, itself included, and whether it is over the limit."""
    change = lambda at, k, i: requests.select(key, F.col(at).alias("at"), F.lit(k).alias("k"), i.alias("event_id"))
    both = change("end_ms", -1, F.lit(None).cast("long")).unionByName(change("start_ms", 1, F.col("event_id")))
    w = Window.partitionBy(key).orderBy("at", "k", F.col("event_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("running", F.sum("k").over(w)).where("k = 1")
    return out.select("event_id", "running", (F.col("running") > limit).alias("waits"))


def quota(events: DataFrame, key: str, n: int, width: str = "1 hour", n_all: int | None = None) -> DataFrame:
    """The first n events of each key and window, and of these the first n_all of each window."""
    w = Window.partitionBy(key, F.window("ts", width)).orderBy("ts", "event_id")
    out = events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    if n_all is not None:
        w = Window.partitionBy(F.window("ts", width)).orderBy("ts", "event_id")
        out = out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_all).drop("_r")
    return out


def locks(requests: DataFrame, batch: str, request: str, keys: str) -> DataFrame:
    """Each request of a batch, in order, gets all of its keys (sorted, distinct) or none, where an earlier one holds some."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        held: set[int] = set()
        out = []
        for r in part.sort_values(request).itertuples(index=False):
            own = set(getattr(r, keys))
            ok = not held & own
            held |= own if ok else set()
            out.append((getattr(r, request), ",".join(map(str, sorted(own))), ok))
        return pd.DataFrame(out, columns=[request, "keys", "granted"])

    kind = dict(requests.dtypes)[request]
    return requests.groupBy(batch).applyInPandas(fold, f"{request} {kind}, keys string, granted boolean")


def upload_decision(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """INSTANT if the same source holds an earlier equal document, else by the unfinished task's chunks."""
    first = docs.groupBy("source", "hash").agg(F.min("doc_id").alias("first"))
    out = docs.join(first, ["source", "hash"]).join(tasks, "doc_id", "left")
    decision = F.when(F.col("first") < F.col("doc_id"), "INSTANT").when(F.col("task_chunks").isNull(), "NEW").when(F.col("task_chunks") == F.col("chunks"), "RESUME").otherwise("CONFLICT")
    return out.select("doc_id", decision.alias("decision"))
