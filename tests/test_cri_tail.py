"""The CRI data source: any cut into blocks gives each logical line once; tailing across triggers, restarts, rotation."""

import os
import random
import re
import uuid

import pytest
from pyspark.sql import Observation

from vigil.session import ensure_checkpoint_dir
from vigil.sources import cri
from vigil.sources import json_api as J


def brute(data: bytes, ended: bool = True):
    """(stream, begin, stamp, log, complete, rejected) by one pass over the file."""
    out, open_, at = [], {}, 0
    parts = data.split(b"\n")
    rest = parts.pop()
    lines = [*parts, rest] if ended and rest else parts
    for raw in lines:
        line = raw.decode(errors="replace").removesuffix("\r")
        m = re.match(r"^(\S+) (stdout|stderr) ([PF]) ?(.*)$", line, re.S)
        if m:
            first = open_.setdefault(m[2], [at, m[1], ""])
            first[2] += m[4]
            if m[3] == "F":
                out.append((m[2], *open_.pop(m[2]), 1, False))
        elif line.strip():
            out.append((None, at, None, line, 1, True))
        at += len(raw) + 1
    if ended:
        out += [(s, *v, 0, False) for s, v in open_.items()]
    return sorted(out, key=repr)


def content(rng, n, open_end=True):
    rows = []
    for i in range(n):
        stream = rng.choice(["stdout"] * 9 + ["stderr"])
        kind = rng.random()
        text = rng.choice(["x", "", "é日本", "a  b ", "w" * rng.randint(0, 90)]) + str(i)
        if kind < 0.06:
            rows.append(rng.choice(["no cri line", "", "   ", "2024 stdout X y", "yesterday stdout F bad stamp"]))
        elif kind < 0.1:
            rows.append(f"2024-01-01T00:00:{i % 60:02d}Z {stream} F {text}\r")
        else:
            rows.append(f"2024-01-01T00:00:{i % 60:02d}Z {stream} {'P' if rng.random() < 0.3 else 'F'} {text}")
    if not open_end:
        rows += ["2024-01-01T00:01:00Z stdout F", "2024-01-01T00:01:00Z stderr F"]
    data = "\n".join(rows).encode() + b"\n"
    return data.replace(b"w9", b"\xff\xfe") + (b"2024-01-01T00:09:00Z stdout P cut o" if open_end else b"")


def rows_of(df):
    return sorted(((r.stream, r.line_no, r.stamp, r.log, r.complete, r.rejected) for r in df.collect()), key=repr)


def folder(spark):
    base = os.path.join(ensure_checkpoint_dir(spark), "tests", uuid.uuid4().hex)
    os.makedirs(base)
    return base


def write(path, data, mode="wb"):
    with open(path, mode) as f:
        f.write(data)


@pytest.mark.parametrize("block", [1, 7, 64, 1000, 10**6])
def test_any_cut_into_blocks(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(cri, "LOOK_BACK", 16)
    for seed in range(4):
        data = content(random.Random(seed), 60, open_end=seed % 2 == 0)
        path = str(tmp_path / f"{seed}.log")
        write(path, data)
        files = cri._Files({"path": path, "block_bytes": str(block)})
        (identity, f), = files.listing().items()
        got = [r for b in files.blocks(f["path"], identity, 0, f["bytes"], last=True) for batch in files.read(b) for r in batch.to_pylist()]
        assert sorted(((r["stream"], r["line_no"], r["stamp"], r["log"], r["complete"], r["rejected"]) for r in got), key=repr) == brute(data)


def test_one_file_over_several_tasks(spark):
    base = folder(spark)
    data = content(random.Random(9), 3000)
    write(os.path.join(base, "a.log"), data)
    write(os.path.join(base, "fluent-own.log"), b"2024-01-01T00:00:00Z stdout F own\n")
    write(os.path.join(base, "empty.log"), b"")
    rows = cri.cri_lines(spark, base, "fluent", block_bytes=4096)
    assert rows.rdd.getNumPartitions() > 10
    assert rows_of(rows) == brute(data)
    seen = Observation("lines")
    lines = J.read_cri(spark, base, "fluent", rejects=seen).count()
    assert seen.get == {"lines": len(brute(data)), "rejected": sum(r[5] for r in brute(data))} and lines == sum(not r[5] for r in brute(data))


def run(spark, base, name, **options):
    out, mark = os.path.join(base, "..", f"{name}-out"), os.path.join(base, "..", f"{name}-mark")
    q = cri.cri_lines(spark, base, stream=True, **options).writeStream.format("parquet").option("checkpointLocation", mark).trigger(
        availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(cri.SCHEMA).parquet(out)


def test_tail_gives_each_line_once(spark):
    base, name = folder(spark), uuid.uuid4().hex
    data = content(random.Random(3), 400, open_end=False)
    rng, at, path = random.Random(4), 0, os.path.join(base, "a.log")
    for step in range(4):  # each trigger is a restart from the checkpoint; parts end anywhere in a line
        end = len(data) if step == 3 else rng.randint(at, at + len(data) // 3)
        write(path, data[at:end], "ab")
        at = end
        got = run(spark, base, name, block_bytes=512)
        assert rows_of(got) == brute(data[:at], ended=False)
    assert rows_of(run(spark, base, name, block_bytes=512)) == brute(data, ended=False)  # nothing new: nothing again


def test_tail_follows_rotation_and_truncation(spark):
    base, name = folder(spark), uuid.uuid4().hex
    path = os.path.join(base, "a.log")
    line = "2024-01-01T00:00:00Z stdout F {}\n".format
    write(path, line("one").encode() + b"2024-01-01T00:00:00Z stdout P tw")
    assert [r.log for r in run(spark, base, name).collect()] == ["one"]
    write(path, b"o, \n2024-01-01T00:00:00Z stdout F three\n", "ab")
    os.rename(path, path + ".1")
    write(path, line("four").encode())
    assert sorted(r.log for r in run(spark, base, name).collect()) == ["four", "one", "two, three"]
    write(path, line("5").encode())  # shorter: starts anew
    assert sorted(r.log for r in run(spark, base, name).collect()) == ["5", "four", "one", "two, three"]


def test_lost_bytes_fail_or_are_left_out(spark, tmp_path):
    path = str(tmp_path / "a.log")
    write(path, b"2024-01-01T00:00:00Z stdout F one\n")
    files = cri._Files({"path": str(tmp_path)})
    (identity, f), = files.listing().items()
    block = files.blocks(f["path"], identity, 0, f["bytes"])[0]
    os.remove(path)
    with pytest.raises(FileNotFoundError):
        list(files.read(block))
    assert list(cri._Files({"path": str(tmp_path), "failondataloss": "false"}).read(block)) == []


def test_a_new_stream_from_the_end(spark):
    base, name = folder(spark), uuid.uuid4().hex
    path = os.path.join(base, "a.log")
    write(path, b"2024-01-01T00:00:00Z stdout F old\n")
    options = {"from": "end"}
    assert run(spark, base, name, **options).count() == 0
    write(path, b"2024-01-01T00:00:00Z stdout F new\n", "ab")
    assert [r.log for r in run(spark, base, name, **options).collect()] == ["new"]


def test_the_number_of_files_follows_the_lines(spark, monkeypatch):
    """No task writes more than about ``LINES_OF_FILE`` lines."""
    from vigil.plans import q_cluster

    made, real = [], q_cluster._grow_files
    monkeypatch.setattr(q_cluster, "LINES_OF_FILE", 50)
    monkeypatch.setattr(q_cluster, "_grow_files", lambda lines, path, upto, files=8: made.append(files) or real(lines, path, upto, files))
    lines = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert q_cluster.q_ingest_tail_logs(spark, "/root/testdata/sf0.001").count() == lines
    assert set(made) == {-(-lines // 50)} and made[0] > 8
