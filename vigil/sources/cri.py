"""Container runtime (CRI) log files as a Spark data source, read or tailed.

Lines are ``<rfc3339 ts> <stream> <P|F> <text>``; P marks a partial chunk that
continues in the next line of the same file and stream, F the last chunk of a
logical line. The source cuts files into byte ranges of ``block_bytes``, one
task each, so a large file is read by many tasks:

* a line belongs to the range that holds its line break, and a logical line to
  the range that holds its last chunk. A task looks back from its range for
  what it needs of earlier ranges: to the previous line break, and, for each
  stream it meets, to that stream's previous line;
* so a line is read once whatever the ranges are, and a stream's offset is just
  the number of bytes of each file, kept in the stream's checkpoint. What has
  no line break yet, or no last chunk, is read when that arrives.

On a mounted file system a file is known by its inode: a rotated (renamed) file
goes on at its offset under the new name. One that got shorter starts anew.
Elsewhere (object stores) it is known by its path. A file that is gone before its
bytes were read fails the query, or with ``failOnDataLoss`` = false
is left out. The offset has an entry per file that exists, so its size follows
the number of files, not their bytes.

Rows: file, stream, line_no (the byte at which the logical line begins in
its file), stamp (of its first chunk, as written), log, complete (0: a batch
read met the end of the file before the last chunk), rejected (the line has
another shape: log holds it, stream and stamp are null). Blank lines are left
out. Bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import fnmatch
import os
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "vigil_cri"
SCHEMA = "file string, stream string, line_no long, stamp string, log string, complete int, rejected boolean"
BLOCK_BYTES = 32 << 20
LOOK_BACK = 64 << 10  # bytes read at a time when looking back

LINE = re.compile(rb"^(\S+) (stdout|stderr) ([PF]) ?(.*)$", re.S)
#: The same for whole columns; a line break in the middle cannot occur.
COLUMN_LINE = r"^(?P<stamp>[^ \t\r\n\f\v]+) (?P<stream>stdout|stderr) (?P<tag>[PF]) ?(?P<log>(?s:.*))$"


@dataclass
class Block(InputPartition):
    """Bytes ``start`` to ``end`` of a file; ``last``: a batch read's last block, whose end also ends its lines."""

    path: str
    identity: str
    start: int
    end: int
    last: bool = False


class _Files:
    """The files under a root: listing and opening by pyarrow's file systems."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.exclude = [p for p in options.get("exclude", "").split(",") if p]
        self.block_bytes = int(options.get("block_bytes", BLOCK_BYTES))
        self.keep_going = options.get("failondataloss", "true").lower() == "false"
        self.store, self.base = pafs.FileSystem.from_uri(self.root)
        self.local = isinstance(self.store, pafs.LocalFileSystem)

    def listing(self) -> dict[str, dict]:
        """identity -> path and size of every file that exists."""
        info = self.store.get_file_info(self.base)
        if info.type == pafs.FileType.Directory:
            found = self.store.get_file_info(pafs.FileSelector(self.base, recursive=True))
        else:
            found = [info] if info.type == pafs.FileType.File else []
        out = {}
        for f in found:
            name = posixpath.basename(f.path)
            if f.type != pafs.FileType.File or name[:1] in "._" or any(fnmatch.fnmatch(name, p) for p in self.exclude):
                continue
            identity = self._identity(f.path)
            if identity is not None:
                out[identity] = {"path": f.path, "bytes": int(f.size)}
        return out

    def _identity(self, path: str) -> str | None:
        if not self.local:
            return path
        try:
            found = os.stat(path)
        except FileNotFoundError:  # gone since the listing
            return None
        return f"{found.st_dev}:{found.st_ino}"

    def blocks(self, path: str, identity: str, start: int, end: int, last: bool = False) -> list[Block]:
        cuts = [*range(start, end, self.block_bytes), end]
        return [Block(path, identity, a, b, last and b == end) for a, b in zip(cuts, cuts[1:])]

    def open(self, block: Block) -> pa.NativeFile | None:
        """The block's file, also if it was renamed meanwhile."""
        path = block.path
        if self._identity(path) != block.identity:
            names = {v["path"] for k, v in self.listing().items() if k == block.identity}
            path = min(names, default=None)
        if path is not None:
            f = self.store.open_input_file(path)
            if f.size() >= block.end:
                return f
        if self.keep_going:
            return None
        raise FileNotFoundError(f"{block.path}: bytes {block.start} to {block.end} are gone (failOnDataLoss)")

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        f = self.open(block)
        if f is not None:
            with f:
                yield from _logical_lines(f, block)


def _range(f: pa.NativeFile, start: int, end: int) -> bytes:
    f.seek(start)
    return f.read(end - start)


def _lines_before(f: pa.NativeFile, end: int) -> Iterator[tuple[int, bytes]]:
    """(begin, line) of the lines whose breaks end at ``end`` and before, last first. ``end`` follows a line break or is 0."""
    low, held = end, b""  # held: the bytes from low to the line last given
    while low > 0 or held:
        cut = held.rfind(b"\n", 0, len(held) - 1)
        if cut < 0 and low > 0:
            step = max(LOOK_BACK, len(held))  # a long line is read in growing steps
            low, held = max(0, low - step), _range(f, max(0, low - step), low) + held
            continue
        yield low + cut + 1, held[cut + 1:-1]
        held = held[:cut + 1]


def _begin(f: pa.NativeFile, at: int) -> int:
    """Where the line that goes on at ``at`` begins."""
    low, step = at, LOOK_BACK
    while low > 0:
        low, high = max(0, low - step), low
        cut = _range(f, low, high).rfind(b"\n")
        if cut >= 0:
            return low + cut + 1
    return 0


def _pending(f: pa.NativeFile, begin: int, stream: bytes) -> list[tuple[int, str, str]]:
    """(begin, stamp, text) of the chunks of ``stream`` before ``begin`` that wait for a last one, in order."""
    found = []
    for at, line in _lines_before(f, begin):
        m = LINE.match(line)
        if m and m[2] == stream:
            if m[3] == b"F":
                break
            found.append((at, m[1].decode(errors="replace"), m[4].decode(errors="replace")))
    return found[::-1]


def _logical_lines(f: pa.NativeFile, block: Block) -> Iterator[pa.RecordBatch]:
    begin = _begin(f, block.start)
    data = _range(f, begin, block.end)
    if not data.endswith(b"\n"):  # the rest belongs to the range with its break, but at the end of a batch read
        data = data + b"\n" if block.last else data[:data.rfind(b"\n") + 1]
    if not data:
        return
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    begins = begin + np.append(0, ends[:-1] + 1)
    lines = pa.array(data.decode(errors="replace").split("\n")[:-1], pa.large_string())
    lines = pc.if_else(pc.ends_with(lines, "\r"), pc.utf8_slice_codeunits(lines, 0, -1), lines) if b"\r" in data else lines
    parts = pc.extract_regex(lines, COLUMN_LINE)
    good = parts.is_valid().to_numpy(zero_copy_only=False)

    bad = np.flatnonzero(~good & pc.not_equal(pc.utf8_trim_whitespace(lines), "").to_numpy(zero_copy_only=False))
    if len(bad):
        yield _batch(block.path, pa.nulls(len(bad), pa.string()), begins[bad], pa.nulls(len(bad), pa.string()), lines.take(pa.array(bad)), 1, True)
    for stream in ("stdout", "stderr"):
        mine = np.flatnonzero(good & pc.fill_null(pc.equal(parts.field("stream"), stream), False).to_numpy(zero_copy_only=False))
        if not len(mine):
            continue
        at, rows = begins[mine], parts.take(pa.array(mine))
        stamps, texts = rows.field("stamp"), rows.field("log")
        full = pc.equal(rows.field("tag"), "F").to_numpy(zero_copy_only=False)
        waiting = _pending(f, begin, stream.encode()) if begin > 0 else []
        if full.all() and not waiting:
            yield _batch(block.path, stream, at, stamps, texts, 1, False)
            continue
        # chunks of one logical line are neighbours within the stream
        line = np.cumsum(np.append(0, full[:-1]))
        first = np.flatnonzero(np.append(True, full[:-1]))
        counts = np.bincount(line)
        at, stamps = at[first].copy(), stamps.take(pa.array(first)).to_pylist()
        logs = texts.take(pa.array(first)).to_pylist()
        for i in np.flatnonzero(counts > 1):
            logs[i] = "".join(texts.slice(first[i], counts[i]).to_pylist())
        if waiting:
            at[0], stamps[0], logs[0] = waiting[0][0], waiting[0][1], "".join(w[2] for w in waiting) + logs[0]
        whole = len(first) if full[-1] else len(first) - 1  # an open end waits for its last chunk
        yield _batch(block.path, stream, at[:whole], stamps[:whole], logs[:whole], 1, False)
        if block.last and not full[-1]:
            yield _batch(block.path, stream, at[whole:], stamps[whole:], logs[whole:], 0, False)
    if block.last:
        yield from _unmet(f, block, begin, {s for s in ("stdout", "stderr") if not pc.any(pc.equal(parts.field("stream"), s)).as_py()})


def _unmet(f: pa.NativeFile, block: Block, begin: int, streams: set[str]) -> Iterator[pa.RecordBatch]:
    """Chunks left open by earlier blocks in streams that the last block does not hold."""
    for stream in sorted(streams) if begin > 0 else ():
        waiting = _pending(f, begin, stream.encode())
        if waiting:
            yield _batch(block.path, stream, [waiting[0][0]], [waiting[0][1]], ["".join(w[2] for w in waiting)], 0, False)


def _batch(path: str, stream, at, stamps, logs, complete: int, rejected: bool) -> pa.RecordBatch:
    def text(values):
        return values.cast(pa.string()) if isinstance(values, pa.Array | pa.ChunkedArray) else pa.array(values, pa.string())

    n = len(at)
    return pa.record_batch({
        "file": pa.array([path] * n, pa.string()), "stream": pa.array([stream] * n, pa.string()) if isinstance(stream, str) else stream,
        "line_no": pa.array(np.asarray(at), pa.int64()), "stamp": text(stamps), "log": text(logs),
        "complete": pa.array([complete] * n, pa.int32()), "rejected": pa.array([rejected] * n, pa.bool_())})


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Block]:
        files = _Files(self.options)
        return [b for identity, f in files.listing().items() for b in files.blocks(f["path"], identity, 0, f["bytes"], last=True)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return _Files(self.options).read(partition)


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return _Files(self.options).listing() if self.options.get("from", "start") == "end" else {}

    def latestOffset(self) -> dict:
        return _Files(self.options).listing()

    def partitions(self, start: dict, end: dict) -> list[Block]:
        files, out = _Files(self.options), []
        for identity, f in end.items():
            done = start.get(identity, {}).get("bytes", 0)
            out += files.blocks(f["path"], identity, done if done <= f["bytes"] else 0, f["bytes"])
        return out

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return _Files(self.options).read(partition)


class CriLogs(DataSource):
    """``spark.read`` / ``spark.readStream`` ``.format("vigil_cri")``; options: path, exclude (file name patterns,
    comma-separated), block_bytes, failOnDataLoss, from (``start``, or ``end``: a new stream begins with what comes)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailReader(dict(self.options))


def cri_lines(spark: SparkSession, path: str, exclude_prefix: str | None = None, stream: bool = False, **options) -> DataFrame:
    """The rows of the source, rejected lines included; ``stream``: tail the files."""
    spark.dataSource.register(CriLogs)
    reader = (spark.readStream if stream else spark.read).format(NAME).options(**options)
    if exclude_prefix:
        reader = reader.option("exclude", f"{exclude_prefix}*")
    return reader.load(path)


def logical_lines(rows: DataFrame) -> DataFrame:
    """Without the rejected lines, and with ``ts``: the stamp as a timestamp (null if it is none)."""
    return rows.filter(~F.col("rejected")).withColumn("ts", F.try_to_timestamp("stamp")).select(
        "file", "stream", "line_no", "stamp", "ts", "log", "complete")


def tail_cri(spark: SparkSession, path: str, exclude_prefix: str | None = None, **options) -> DataFrame:
    """A stream of logical lines of files that grow: each once, also after a restart."""
    return logical_lines(cri_lines(spark, path, exclude_prefix, stream=True, **options))
