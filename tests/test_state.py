"""Stored memory and restart counts: what an upsert keeps, overwrites and leaves alone."""

import os
import uuid
from datetime import datetime, timedelta

from vigil.session import ensure_checkpoint_dir
from vigil.sources import state as ST
from vigil.sources import store

T0 = datetime(2024, 1, 1)
MEMORY = "id string, kind string, source_ref string, incident_id string, content string, version long, created_at timestamp, updated_at timestamp"


def new_path(spark):
    return os.path.join(ensure_checkpoint_dir(spark), "tests", uuid.uuid4().hex)


def test_memory_keeps_identity_and_takes_the_newest_content(spark):
    path = new_path(spark)

    def write(*rows):
        at = [T0 + timedelta(hours=r[-1]) for r in rows]
        return ST.upsert_memory(path, spark.createDataFrame([(*r, t, t) for r, t in zip(rows, at)], MEMORY))

    write(("a", "runbook", "r1", None, "one", 1), ("b", "incident", "r1", "i1", "uno", 1), ("c", "runbook", "r2", None, "x", 1))
    write(("z", "runbook", "r1", "i9", None, 5), ("y", "runbook", "r1", "i8", "two", 4), ("n", "runbook", "r3", None, "new", 4))
    write(("late", "runbook", "r1", None, "older than what is stored", 2))
    got = {(r.kind, r.source_ref): r for r in store.read(spark, path, spark.createDataFrame([], MEMORY).schema).collect()}
    assert len(got) == 4
    r = got[("runbook", "r1")]
    assert (r.id, r.incident_id, r.content, r.version) == ("a", None, None, 5)  # a NULL in the newest write is a value
    assert r.created_at == T0 + timedelta(hours=1) and r.updated_at == T0 + timedelta(hours=5)
    assert got[("incident", "r1")].content == "uno" and got[("runbook", "r3")].id == "n"


def test_restart_counts_of_an_empty_pass_stay(spark):
    path = new_path(spark)

    def save(*rows):
        return ST.save_restart_counts(path, spark.createDataFrame([(ns, p, n, T0 + timedelta(minutes=m)) for ns, p, n, m in rows], ST.RESTARTS))

    save(("a", "p1", 1, 0), ("a", "p2", 5, 0), ("b", "q1", 2, 0))
    save(("a", "p1", 3, 1), ("a", "p1", 4, 2), ("a", "p3", 0, 2))  # p2 is gone; b was not reached
    assert save() == 0
    got = {(r.namespace, r.pod): r.restart_count for r in ST.restart_counts(spark, path).collect()}
    assert got == {("a", "p1"): 4, ("a", "p3"): 0, ("b", "q1"): 2}
    save(("a", "p1", 9, 1))  # an older pass that comes late changes nothing
    assert {(r.namespace, r.pod): r.restart_count for r in ST.restart_counts(spark, path).collect()} == got
