"""WARC archives: writing pages with revisits, and a sequential reader.

Archives are byte strings of bounded size, each a run of gzip members with one
record per member. They travel as rows (archive, content), so Spark's own
readers and writers move them to and from any store; files ``*.warc.gz`` are
read the same way (``read_files``).

The reader goes through an archive once: it inflates a bounded piece at a
time, takes the header block up to the empty line, frames the content by
Content-Length, checks that the record ends where its gzip member ends, and
verifies the digests. What is wrong with a record is told in ``problem``; the
reader goes on at the next member.

Equal payloads of at least ``min_revisit_bytes`` are written once, as the
response with the smallest id; the others become revisits that name it.

Defined results: a null or empty html is a record with an empty payload; a
null url is an empty target; rows that repeat the smallest id of their payload
are all responses; a null id is written and read as null and is never referred
to; an empty table gives no archives; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import stored

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-record:"
END = b"\r\n\r\n"

PIECE = 1 << 16  # bytes inflated at a time
MOST_HEADER = 1 << 20


# --- writing ----------------------------------------------------------------------

def _name(value) -> str:
    return f"<{URN}{'' if value is None else quote(str(value), safe='')}>"


def _id(name: str | None) -> str | None:
    inner = (name or "").strip("<>").removeprefix(URN)
    return unquote(inner) if inner else None


def record(key, url: str | None, payload: bytes, digest: str, refers_to, date: str, level: int) -> bytes:
    """One record as one gzip member; a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(key)),
              ("WARC-Date", date), ("WARC-Target-URI", quote(url or "", safe="%/:?#[]@!$&'()*+,;=~")),
              ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    head = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields)]).encode() + END
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head) + pack.compress(block) + pack.compress(END) + pack.flush()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_revisit_bytes: int = 100, archive_bytes: int = 4 << 20, date: str = "1970-01-01T00:00:00Z",
                   level: int = 6) -> DataFrame:
    """Write a record per row to the shared folder: (archive, records, content)."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("html"),
                        F.sha2(payload.cast("binary"), 256).alias("digest"))
    first = rows.filter(F.octet_length("html") >= min_revisit_bytes).groupBy("digest").agg(
        F.min("id").alias("first"), F.count("*").alias("copies"))
    first = stored(first.filter("copies > 1").select("digest", "first"), "payloads")
    planned = rows.join(first, "digest", "left").select(
        "id", "url", "html", "digest",
        F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        number, size, members = 0, 0, []

        def archive():
            return pa.RecordBatch.from_arrays(
                [pa.array([part + number], pa.int64()), pa.array([len(members)], pa.int64()), pa.array([b"".join(members)], pa.binary())],
                names=["archive", "records", "content"])

        for batch in batches:
            for key, url, html, digest, refers_to in zip(*(batch.column(i) for i in range(5))):
                members.append(record(key.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), refers_to.as_py(), date, level))
                size += len(members[-1])
                if size >= archive_bytes:
                    yield archive()
                    number, size, members = number + 1, 0, []
        if members:
            yield archive()

    return stored(planned.mapInArrow(run, "archive long, records long, content binary"), "warc")


# --- reading ----------------------------------------------------------------------

class Member:
    """Inflates one gzip member of an archive piece by piece."""

    def __init__(self, data: memoryview, start: int):
        self.data, self.at = data, start
        self.engine = zlib.decompressobj(31)
        self.ready = b""

    def _more(self) -> bool:
        """Inflate some more; False once the member has ended or the archive is cut off."""
        if self.engine.eof:
            return False
        given = self.engine.unconsumed_tail
        if not given:
            given = self.data[self.at:self.at + PIECE]
            self.at += len(given)
        out = self.engine.decompress(given, PIECE)
        self.ready += out
        return bool(out or given or self.engine.unconsumed_tail)

    def until(self, mark: bytes, most: int) -> bytes:
        while (i := self.ready.find(mark)) < 0:
            if len(self.ready) > most or not self._more():
                raise ValueError("no end of the header")
        found, self.ready = self.ready[:i], self.ready[i + len(mark):]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in bounded pieces."""
        while n > 0:
            if not self.ready and not self._more():
                raise ValueError("content is shorter than Content-Length")
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            yield part

    def finish(self) -> int:
        """Position after the member, whose text must be used up."""
        while not self.ready and self._more():
            pass
        if self.ready:
            raise ValueError("content after the record in its member")
        if not self.engine.eof:
            raise ValueError("member is cut off")
        return self.at - len(self.engine.unused_data)


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_member(member: Member, with_payload: bool) -> dict:
    """The record in a member, digests verified; ValueError tells what is wrong."""
    first, *lines = member.until(END, MOST_HEADER).split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC version line")
    head = _fields(lines)
    length = head.get("content-length", "")
    if not length.isdecimal():
        raise ValueError("no Content-Length")
    kind = head.get("warc-type", "")
    out = {"record_id": _id(head.get("warc-record-id")), "record_type": kind, "target_uri": head.get("warc-target-uri"),
           "refers_to": _id(head.get("warc-refers-to"))}
    block, body = hashlib.sha256(), hashlib.sha256()
    is_http = head.get("content-type", "").startswith("application/http")
    http, seen, pieces = b"", not is_http, []
    payload_bytes = 0
    for part in member.take(int(length)):
        block.update(part)
        if not seen:  # still in the HTTP header
            http += part
            i = http.find(END)
            if i < 0:
                if len(http) > MOST_HEADER:
                    raise ValueError("no end of the HTTP header")
                continue
            http, part, seen = http[:i], http[i + len(END):], True
        body.update(part)
        payload_bytes += len(part)
        if with_payload:
            pieces.append(part)
    if b"".join(member.take(len(END))) != END:
        raise ValueError("no empty lines after the content")
    told = head.get("warc-payload-digest", "").removeprefix("sha256:")
    if head.get("warc-block-digest", "sha256:" + block.hexdigest()) != "sha256:" + block.hexdigest():
        raise ValueError("block digest differs")
    if kind == "revisit":  # the payload itself stands in the record it refers to
        full = _fields(http.split(b"\r\n")[1:]).get("content-length", "")
        return out | {"payload_bytes": int(full) if full.isdecimal() else None, "payload_digest": told, "payload": None}
    if told and told != body.hexdigest():
        raise ValueError("payload digest differs")
    return out | {"payload_bytes": payload_bytes, "payload_digest": body.hexdigest(), "payload": b"".join(pieces) if with_payload else None}


def records(content: bytes, with_payload: bool = False) -> Iterator[dict]:
    """The records of an archive in order; ``problem`` is null for a sound one."""
    data, at = memoryview(content), 0
    while at < len(data):
        member = Member(data, at)
        try:
            found = read_member(member, with_payload)
            after = member.finish()
            yield found | {"problem": None}
        except (ValueError, zlib.error) as error:
            yield {"problem": f"at byte {at}: {error}"}
            after = content.find(b"\x1f\x8b\x08", at + 1)
            while after >= 0 and not _starts(data, after):
                after = content.find(b"\x1f\x8b\x08", after + 1)
            if after < 0:
                return
        at = after


def _starts(data: memoryview, at: int) -> bool:
    """Whether a member that holds a record starts here."""
    try:
        return zlib.decompressobj(31).decompress(data[at:at + PIECE], 5) == b"WARC/"
    except zlib.error:
        return False


_READ = [("archive", pa.string()), ("position", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
         ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("payload", pa.binary()), ("problem", pa.string())]
_READ_SCHEMA = ("archive string, position long, record_id string, record_type string, target_uri string, refers_to string, "
                "payload_bytes long, payload_digest string, payload binary, problem string")


def read_archives(archives: DataFrame, name_col: str = "archive", content_col: str = "content", with_payload: bool = False) -> DataFrame:
    """One row per record of each archive; ``position`` counts the records of an archive from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for position, found in enumerate(records(content.as_py() or b"", with_payload)):
                    rows.append(found | {"archive": name.as_py(), "position": position})
                    if len(rows) == (64 if with_payload else 4096):
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(_READ))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(_READ))

    return archives.select(F.col(name_col).cast("string"), content_col).mapInArrow(run, _READ_SCHEMA)


def read_files(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of the ``*.warc.gz`` files under a path, from any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return read_archives(files, "path", "content", with_payload)


def oracle_sql(least_bytes: int = 100) -> str:
    """What must come back of every page, without archives (DuckDB)."""
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= {least_bytes} THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, NULL::VARCHAR AS problem FROM f"""
