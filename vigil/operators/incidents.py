"""Incident lifecycle: sessionisation of candidates into incidents, recovery,
state-transition audit, and the read-side views (list, get, in-flight, status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vigil.config import Params
from vigil.functions import ids
from vigil.operators.detect import severity_name
from vigil.operators.windows import epoch_seconds, running_sum

# Incident states and the allowed transitions between them.
STATES = ["Candidate", "Triaging", "Investigating", "Reported", "Ignored", "Inconclusive", "Failed", "Recovered"]
IN_FLIGHT = ["Candidate", "Triaging", "Investigating", "Failed"]
TERMINAL = ["Reported", "Ignored", "Inconclusive", "Recovered"]
ALLOWED_TRANSITIONS = [
    ("Candidate", "Triaging"),
    ("Candidate", "Recovered"),
    ("Candidate", "Failed"),
    ("Triaging", "Investigating"),
    ("Triaging", "Ignored"),
    ("Triaging", "Recovered"),
    ("Triaging", "Failed"),
    ("Investigating", "Reported"),
    ("Investigating", "Inconclusive"),
    ("Investigating", "Recovered"),
    ("Investigating", "Failed"),
    ("Failed", "Triaging"),
    ("Failed", "Investigating"),
    ("Failed", "Recovered"),
    ("Reported", "Recovered"),
    ("Inconclusive", "Recovered"),
    ("Ignored", "Recovered"),
]


def recovery_pass(detected_at, params: Params) -> Column:
    """First pass more than ``recovery`` after a detection: where an incident without a newer one recovers."""
    step = params.slide_seconds
    return F.timestamp_seconds((F.floor((epoch_seconds(detected_at) + params.recovery_seconds) / step) + 1) * step)


def sessions(candidates: DataFrame, params: Params, closed: DataFrame | None = None) -> DataFrame:
    """Assign each candidate to an incident of its fingerprint.

    A candidate joins the newest incident if that one is open or its last
    detection is at most the cooldown ago; else it opens a new one. An
    incident stays closed once it is.

    Without a state log (``gap`` mode) passes run every ``slide``, so an
    incident is closed from the first pass after ``recovery`` without a
    detection. With one (``closed``: fingerprint, closed_at, the moves into a
    final state) only the log closes incidents, so one that no pass could
    close stays open however long the gap.
    """
    w = Window.partitionBy("fingerprint").orderBy("detected_at", "queue_rank")
    before = F.lag("detected_at").over(w)
    late = before.isNull() | (epoch_seconds("detected_at") - epoch_seconds(before) > params.cooldown_seconds)
    if closed is None:
        recovered = before.isNull() | (recovery_pass(before, params) < F.col("detected_at"))
        c = candidates.withColumn("__new", (late & recovered).cast("int"))
    else:
        # Between two candidates farther apart than the cooldown lies the only
        # place where an incident can end: it does if it was closed since the
        # run of candidates before that gap began (an earlier closing would
        # have ended it at an earlier gap).
        log = closed.select("fingerprint", F.col("closed_at").alias("detected_at"), F.lit(-1).alias("queue_rank"),
                            F.col("closed_at").alias("__closed"))
        both = candidates.unionByName(log, allowMissingColumns=True)
        real = F.col("__closed").isNull()
        up_to = w.rowsBetween(Window.unboundedPreceding, -1)
        prev = F.max(F.when(real, F.col("detected_at"))).over(up_to)
        both = both.withColumn("__prev", prev).withColumn("__last_closed", F.max("__closed").over(up_to))
        c = both.filter(real).withColumn("__late", F.col("__prev").isNull() | (
            epoch_seconds("detected_at") - epoch_seconds("__prev") > params.cooldown_seconds))
        run = F.last(F.when(F.col("__late"), F.col("detected_at")), ignorenulls=True).over(up_to)  # where the run before began
        c = c.withColumn("__new", (F.col("__late") & (run.isNull() | F.coalesce(F.col("__last_closed") >= run, F.lit(False)))).cast("int"))
        c = c.drop("__closed", "__prev", "__last_closed", "__late")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("session_no", F.sum("__new").over(running)).drop("__new")


def incidents(candidates: DataFrame, params: Params, replay_end: str = "replay_end", closed: DataFrame | None = None) -> DataFrame:
    """Candidates -> incidents with recovery (``closed``: see ``sessions``).

    ``replay_end`` names a column holding the last pass instant of the replay
    (attach it with ``with_replay_end``: a one-row broadcast, not a global
    window).

    Title, category, signals and workloads come from the first candidate;
    severity is the maximum seen (it only rises while open); ``state`` is
    Recovered once a pass ran more than ``recovery`` after a detection with no
    detection in between (later detections within the cooldown still count
    against the same, now recovered, incident).
    """
    s = sessions(candidates, params, closed)
    ws = Window.partitionBy("fingerprint", "session_no").orderBy("detected_at", "queue_rank")
    s = s.withColumn("__next", F.lead("detected_at").over(ws))
    s = s.withColumn("__rp", recovery_pass("detected_at", params))
    s = s.withColumn("__end", F.col(replay_end))
    recovers = (F.col("__next").isNotNull() & (F.col("__rp") < F.col("__next"))) | (
        F.col("__next").isNull() & (F.col("__rp") <= F.col("__end"))
    )
    first = F.struct("detected_at", "queue_rank")
    agg = s.groupBy("fingerprint", "session_no").agg(
        F.min_by(F.struct("namespace", "category", "title", "affected_workloads", "signals", "detection_rule"), first).alias("f"),
        F.max("severity_rank").alias("severity_rank"),
        F.min("detected_at").alias("first_detected_at"),
        F.max("detected_at").alias("last_detected_at"),
        F.count(F.lit(1)).alias("detection_count"),
        F.min(F.when(recovers, F.col("__rp"))).alias("recovered_at"),
    )
    return agg.select(
        ids.deterministic_id("fingerprint", epoch_seconds("first_detected_at")).alias("incident_id"),
        "fingerprint",
        F.col("f.namespace").alias("namespace"),
        F.col("f.category").alias("category"),
        severity_name("severity_rank").alias("severity"),
        "severity_rank",
        F.col("f.title").alias("title"),
        F.col("f.detection_rule").alias("detection_rule"),
        F.col("f.affected_workloads").alias("affected_workloads"),
        F.col("f.signals").alias("signals"),
        "first_detected_at",
        "last_detected_at",
        "detection_count",
        (epoch_seconds("last_detected_at") - epoch_seconds("first_detected_at")).alias("duration_seconds"),
        F.when(F.col("recovered_at").isNotNull(), "Recovered").otherwise("Candidate").alias("state"),
        "recovered_at",
    )


def with_replay_end(candidates: DataFrame, passes_end: DataFrame) -> DataFrame:
    """Attach the last pass instant of the replay (a one-row aggregate,
    broadcast; a join keeps the plan reusable as a whole, which a scalar
    subquery would not)."""
    return candidates.crossJoin(F.broadcast(passes_end.select(F.col("replay_end"))))


def transition_audit(log: DataFrame) -> DataFrame:
    """Classify each logged move: noop (same state), allowed, or refused."""
    spark = log.sparkSession
    allowed = spark.createDataFrame(ALLOWED_TRANSITIONS, "from_state string, to_state string").withColumn("__ok", F.lit(True))
    j = log.join(F.broadcast(allowed), ["from_state", "to_state"], "left")
    verdict = F.when(F.col("from_state") == F.col("to_state"), "noop").when(F.col("__ok"), "allowed").otherwise("refused")
    return j.withColumn("verdict", verdict).drop("__ok")


def terminal_flags(df: DataFrame, state: str = "state") -> DataFrame:
    return df.withColumn("is_terminal", F.col(state).isin(*TERMINAL)).withColumn("in_flight", F.col(state).isin(*IN_FLIGHT))


def clamp(n: int | None, lo: int, hi: int) -> int:
    if n is None or n < lo:
        return hi if n is None or n <= 0 else lo
    return min(n, hi)


def incident_list(inc: DataFrame, state: str | None = None, limit: int | None = 50) -> DataFrame:
    d = inc if state is None else inc.filter(F.col("state") == state)
    n = clamp(limit, 1, 200)
    return d.orderBy(F.col("last_detected_at").desc(), F.col("incident_id")).limit(n)


def in_flight(inc: DataFrame) -> DataFrame:
    return inc.filter(F.col("state").isin(*IN_FLIGHT)).orderBy("first_detected_at", "incident_id")


def cluster_status(inc: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: number of open incidents, the open ones by state, and the work
    queue's depth by state (``queue``: state, n), both as ``state=n`` text."""
    def text(rows: DataFrame, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.concat("state", F.lit("="), F.col("n").cast("string"))))  # one per state
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"), F.array_join(pairs, ";").alias(name))

    by_state = text(inc.filter(F.col("state").isin(*IN_FLIGHT)).groupBy("state").agg(F.count(F.lit(1)).alias("n")), "incidents_by_state")
    depth = text(queue, "work_queue").drop("total")
    return by_state.withColumnRenamed("total", "open_incidents").crossJoin(depth)  # one row each


def open_at(inc: DataFrame, moments: DataFrame, at: str = "moment_ts") -> DataFrame:
    """``moments`` (namespace, ``at``, ...) with ``open_incidents``: those of the namespace detected by then and not recovered.

    A sweep over time: +1 at a detection, -1 at a recovery, summed up to each
    moment in two levels (hours, then within the hour), so incidents and
    moments never meet as pairs and no task holds a whole namespace.
    """
    def steps(ts: str, delta: int) -> DataFrame:
        return inc.filter(F.col(ts).isNotNull()).select("namespace", F.col(ts).cast("timestamp").alias("__at"), F.lit(delta).alias("__delta"))

    asked = moments.select("namespace", F.col(at).cast("timestamp").alias("__at"), F.lit(0).alias("__delta"), F.struct(*moments.columns).alias("__moment"))
    both = steps("first_detected_at", 1).unionByName(steps("recovered_at", -1)).unionByName(asked, allowMissingColumns=True)
    both = both.withColumn("__asked", F.col("__moment").isNotNull())  # a moment comes after the steps of its instant
    swept = running_sum(both, ["namespace"], ["__at", "__asked"], "__delta", "open_incidents", ts="__at")
    return swept.filter("__asked").select("__moment.*", F.col("open_incidents").cast("bigint").alias("open_incidents"))


def open_digest(inc: DataFrame, top: int = 10) -> DataFrame:
    """The first ``top`` of the open incidents, oldest first."""
    line = F.format_string("[%s] %s: %s", F.col("severity"), F.col("category"), F.col("title"))
    return in_flight(inc).limit(top).select("incident_id", line.alias("line"))
