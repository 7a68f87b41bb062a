"""Secret scans through a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams that every
match must contain. For a block of documents the postings of the trigrams in
use are read off the text bytes in one vectorised pass; the queries intersect
and unite postings, and only documents that satisfy a rule's query are matched
with its regex. A rule without mandatory trigrams scans every document.

The index of a block lives with the block: nothing is shuffled, and memory is
bounded by one Arrow batch.

Defined results: a null or empty text has no spans; rows are scanned one by
one, so repeated rows and ids give repeated results; a null id stays null; an
empty table gives an empty table; columns other than id and text are not
looked at. Spans are code points, end exclusive.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as regex_parser
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds and patterns of the secrets looked for.
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # greedy, so the same spans as one or more, kept from 32 characters
GITHUB = r"gh[opsu]_[A-Za-z0-9]{36,}"
SLACK = r"xox[abprs]-[A-Za-z0-9-]{10,}"
GOOGLE = r"AIza[A-Za-z0-9_-]{35}"
STRIPE = r"[rs]k_live_[A-Za-z0-9]{16,}"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"


@dataclass(frozen=True)
class Rule:
    """A match counts where ``group`` has at least ``min_length`` characters."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE_RULES = (
    Rule("assign", ASSIGN, group=2, min_length=8, any_case=True),
    Rule("access", ACCESS, min_length=16),
    Rule("hex", HEX),
)
MORE_RULES = (Rule("github", GITHUB), Rule("slack", SLACK), Rule("google", GOOGLE), Rule("stripe", STRIPE),
              Rule("jwt", JWT), Rule("pem", PEM))
RULES = BASE_RULES + MORE_RULES

MAX_LITERALS = 64  # exact strings kept for one part of a pattern before it is closed


# --- Boolean trigram queries -------------------------------------------------
# A query is True (no condition), a trigram (bytes), ("and", parts) or ("or", parts).

def _all(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_literals(strings: set[str]):
    """Query satisfied by every text that contains one of the strings."""
    queries = []
    for s in strings:
        b = s.encode()
        queries.append(_all([b[i:i + 3] for i in range(len(b) - 2)]))
    return _any(queries)


def _members(items) -> set[str] | None:
    """Characters of a class in lower case, or None if it is large or negated."""
    chars: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            chars.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < 8:
            chars.update(chr(x).lower() for x in range(value[0], value[1] + 1))
        else:
            return None
    return chars if len(chars) <= 8 else None


def _walk(tokens) -> tuple[set[str] | None, object]:
    """(the exact lower-case strings it matches or None, a query for it otherwise)."""
    literal: set[str] = {""}
    closed = []
    exact = True

    def close():
        nonlocal literal
        closed.append(_of_literals(literal))
        literal = {""}

    for op, value in tokens:
        if op is C.LITERAL:
            part, query = {chr(value).lower()}, True
        elif op is C.IN:
            part, query = _members(value), True
        elif op is C.SUBPATTERN:
            part, query = _walk(value[3])
        elif op is C.BRANCH:
            found = [_walk(x) for x in value[1]]
            part = set().union(*(p for p, _ in found)) if all(p is not None for p, _ in found) else None
            query = _any([_of_literals(p) if p is not None else q for p, q in found])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = value
            part, query = _walk(inner)
            if (low, high) == (0, 1) and part is not None:
                part = part | {""}
            elif low == high and low <= 4 and part is not None:
                part = {"".join(x) for x in product(part, repeat=low)} if len(part) ** low <= MAX_LITERALS else None
                query = True
            else:  # at least ``low`` times: one occurrence is certain if low > 0
                query = (_of_literals(part) if part is not None else query) if low else True
                part = None
        elif op is C.AT:
            continue
        else:
            part, query = None, True
        if part is not None and len(part) * len(literal) <= MAX_LITERALS:
            literal = {a + b for a in literal for b in part}
        else:
            close()
            closed.append(_of_literals(part) if part is not None else query)
            exact = False
    if exact:
        return literal, True
    close()
    return None, _all(closed)


def trigram_query(pattern: str):
    """Condition on the ASCII-lower-cased text that holds wherever the pattern matches."""
    if not pattern.isascii():
        return True
    strings, query = _walk(regex_parser.parse(pattern))
    return _of_literals(strings) if strings is not None else query


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams_of(p) for p in query[1]))


# --- the index of a block ----------------------------------------------------

@dataclass
class Index:
    """Postings (document numbers) of the trigrams in use over one block of texts."""

    n_docs: int
    postings: dict[bytes, np.ndarray] = field(default_factory=dict)

    def select(self, query) -> np.ndarray:
        """A Boolean per document: whether it satisfies the query."""
        if query is True:
            return np.ones(self.n_docs, bool)
        if isinstance(query, bytes):
            hit = np.zeros(self.n_docs, bool)
            hit[self.postings[query]] = True
            return hit
        kind, parts = query
        hit = self.select(parts[0])
        for p in parts[1:]:
            hit = hit & self.select(p) if kind == "and" else hit | self.select(p)
        return hit


class Scanner:
    """Rules with their queries; one per task."""

    SLICE = 1 << 22  # bytes of text indexed at a time

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.names = sorted(set().union(*(trigrams_of(q) for _, _, q in self.rules)))
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[65:91] += 32
        self.number = np.zeros(1 << 24, np.uint8 if len(self.names) < 255 else np.uint16)
        for i, t in enumerate(self.names, 1):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = i

    def index(self, texts: pa.Array) -> Index:
        column = texts.cast(pa.large_binary())
        if len(column) == 0 or not self.names:
            return Index(len(column), {t: np.zeros(0, np.int64) for t in self.names})
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = column.buffers()[2]
        chars = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        found_at, found = [], []
        for start in range(int(offsets[0]), int(offsets[-1]), self.SLICE):
            low = self.lower[chars[start:min(int(offsets[-1]), start + self.SLICE + 2)]]
            which = self.number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]] if len(low) > 2 else low[:0]
            at = np.flatnonzero(which)
            found_at.append(at + start)
            found.append(which[at])
        at, which = np.concatenate(found_at or [offsets[:0]]), np.concatenate(found or [offsets[:0]])
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 2 < offsets[doc + 1]  # not across two texts
        doc, which = doc[inside], which[inside]
        return Index(len(column), {t: np.unique(doc[which == i]) for i, t in enumerate(self.names, 1)})

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Per document the spans (start, rule number, end), by start and then by rule."""
        index = self.index(texts)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        decoded: dict[int, str] = {}
        for number, (rule, pattern, query) in enumerate(self.rules):
            for doc in np.flatnonzero(index.select(query)).tolist():
                text = decoded.get(doc)
                if text is None:
                    text = texts[doc].as_py() or ""
                    if query is not True:
                        decoded[doc] = text
                for m in pattern.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.min_length:
                        spans[doc].append((m.start(), number, m.end()))
        for s in spans:
            s.sort()
        return spans


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its id and ``spans``, an array of (kind, start, end) by start, then in the order of ``rules``."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in scanner.scan(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW_SPANS)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(id_col, id_type), T.StructField("spans", SPANS)]))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, SHA-256 of the base spans and all spans as text."""
    base = [r.kind for r in BASE_RULES]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    return found.select(
        id_col, *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))
