"""Text operators as Column expressions: normalise, signature hash, redaction,
control-character stripping, truncation, correlation-id sanitising.

Regex dialect
-------------
Patterns are written once as templates and rendered for two engines: the JVM
(``java.util.regex``, used by Spark) and RE2 (used by the DuckDB oracle). The
meaning is pinned to ASCII: ``\\d`` is ``[0-9]``, whitespace is the ASCII set,
and a word boundary next to a word character is an ASCII word boundary. Java
17 treats ``\\b`` as Unicode-aware, so on the JVM side boundaries are written
as explicit look-arounds; RE2 keeps ``\\b`` (ASCII there).

No Python UDF is involved: every operator is a chain of built-in
``regexp_replace`` / ``regexp_count`` / ``sha2`` calls that stays inside
whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS_CHARS = r" \t\n\x0B\f\r"

_JAVA = {"WBL": r"(?<![A-Za-z0-9_])", "WBR": r"(?![A-Za-z0-9_])", "WS": f"[{_WS_CHARS}]", "WSC": _WS_CHARS}
_RE2 = {"WBL": r"\b", "WBR": r"\b", "WS": f"[{_WS_CHARS}]", "WSC": _WS_CHARS}


def _render(template: str, dialect: dict) -> str:
    out = template
    for k, v in dialect.items():
        out = out.replace("{" + k + "}", v)
    return out


# ---------------------------------------------------------------------------
# Fixed values that must equal the detection service's behaviour.
# The patterns below are the service's patterns with three spellings made
# engine-neutral: {WBL}/{WBR} stand for an ASCII word boundary before/after a
# word character (\b), {WS} for one ASCII whitespace character (\s) and {WSC}
# for the same set inside a character class. Java 17 and RE2 disagree on \b,
# so each engine gets its own rendering (see _JAVA / _RE2 above).
# Log-message normalisation: ordered (pattern, replacement) pairs, applied in
# this order, then whitespace runs collapse to one space and the result is cut
# to 300 characters.
#   guid        -> <guid>
#   timestamp   -> <timestamp>
#   ip[:port]   -> <ip>
#   duration    -> <duration>   (units ms, s, sec, secs, seconds, milliseconds; any case)
#   'quoted'    -> '<str>'      (up to 200 characters between single quotes)
#   prefix_id   -> <id>         (2-12 lowercase letters, underscore, 4+ alphanumerics)
#   long hex    -> <hex>        (12+ hex digits)
#   number      -> <n>
NORMALISE_RULES = [
    (r"{WBL}[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}{WBR}", "<guid>"),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z?", "<timestamp>"),
    (r"{WBL}[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?{WBR}", "<ip>"),
    (r"(?i){WBL}[0-9]+(?:\.[0-9]+)?{WS}*(?:ms|s|sec|secs|seconds|milliseconds){WBR}", "<duration>"),
    (r"'[^']{0,200}'", "'<str>'"),
    (r"{WBL}[a-z]{2,12}_[A-Za-z0-9]{4,}{WBR}", "<id>"),
    (r"{WBL}[0-9a-fA-F]{12,}{WBR}", "<hex>"),
    (r"{WBL}[0-9]+(?:\.[0-9]+)?{WBR}", "<n>"),
]
NORMALISED_MAX = 300

# Secret redaction: ordered patterns. Group 1 is the context kept before the
# secret, the secret group is replaced by [REDACTED], and for the private-key
# block group 3 (the END line) is kept as well. Every match counts once, and
# the patterns run one after another on the already-redacted text.
#   connection-string password / user id
#   bearer token (16+ chars)
#   JSON web token (three dot-separated base64url segments, header starts eyJ)
#   authorization / x-api-key / proxy-authorization header (8+ chars)
#   api key / secret / token / access key / client secret assignment (12+ chars)
#   PEM private key block body
#   AWS access key id (AKIA + 16)
REDACTED = "[REDACTED]"
REDACT_RULES = [
    (r"(?i)({WBL}(?:password|pwd|user{WS}*id|uid){WS}*={WS}*)([^;{WSC}\"']{1,200})", 1),
    (r"(?i)({WBL}bearer{WS}+)([A-Za-z0-9\-._~+/]{16,}=*)", 1),
    (r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 0),
    (r"(?i)({WBL}(?:authorization|x-api-key|proxy-authorization){WS}*[:=]{WS}*)([^{WSC},;\"']{8,})", 1),
    (r"(?i)({WBL}(?:api[_-]?key|secret|token|access[_-]?key|client[_-]?secret){WS}*[:=]{WS}*[\"']?)([A-Za-z0-9\-._~+/]{12,})", 1),
    (r"(-----BEGIN[^-]{0,40}PRIVATE KEY-----)([\s\S]*?)(-----END[^-]{0,40}PRIVATE KEY-----)", 2),
    (r"{WBL}(AKIA[0-9A-Z]{16}){WBR}", 0),
]
# What a text must hold, one of each tuple, for the pattern of the same place to match at all (empty: no plain sign tells).
REDACT_SIGNS = [("=",), (), ("eyJ",), (":", "="), (":", "="), ("-----BEGIN",), ("AKIA",)]
# Control characters (Unicode category Cc) except tab, line feed, carriage return.
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
# ---------------------------------------------------------------------------


def _java(template: str) -> str:
    return _render(template, _JAVA)


def re2(template: str) -> str:
    """The RE2 (DuckDB) rendering of a pattern template."""
    return _render(template, _RE2)


def _replacement(kind: int, dialect: str) -> str:
    ref = "$" if dialect == "java" else "\\"
    if kind == 0:
        return REDACTED
    if kind == 1:
        return f"{ref}1{REDACTED}"
    return f"{ref}1{REDACTED}{ref}3"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trim_ws(col) -> Column:
    """Strip leading/trailing ASCII whitespace (Spark ``trim`` only strips spaces)."""
    ws = _JAVA["WS"]
    return F.regexp_replace(_c(col), f"^{ws}+|{ws}+$", "")


def normalise(col) -> Column:
    """Log-message normalisation; NULL or blank becomes ''."""
    c = _c(col)
    working = trim_ws(c)
    for pattern, repl in NORMALISE_RULES:
        working = F.regexp_replace(working, _java(pattern), repl)
    working = trim_ws(F.regexp_replace(working, _JAVA["WS"] + "+", " "))
    working = F.substring(working, 1, NORMALISED_MAX)
    return F.when(c.isNull() | (trim_ws(c) == F.lit("")), F.lit("")).otherwise(working)


def signature_hash(normalised_col) -> Column:
    """First 16 hex characters of SHA-256 over an already normalised message."""
    return F.substring(F.sha2(_c(normalised_col), 256), 1, 16)


def log_signature(col) -> Column:
    return signature_hash(normalise(col))


def strip_control(col) -> Column:
    return F.regexp_replace(_c(col), CONTROL_CHARS, "")


def with_redaction(df, text_col: str, out_text: str = "redacted_text", out_count: str = "redaction_count"):
    """Append redacted text and redaction count columns.

    Each stage counts its matches on the text produced by the previous stage,
    then replaces them; stages are separate projections so that every
    intermediate text is computed once (Catalyst does not collapse projections
    that would repeat a non-trivial expression).
    """
    src = F.col(text_col)
    work = "__redact_w"
    cnt = "__redact_n"
    df = df.withColumn(work, F.coalesce(src, F.lit(""))).withColumn(cnt, F.lit(0))
    step = "__redact_k"
    for (pattern, kind), signs in zip(REDACT_RULES, REDACT_SIGNS, strict=True):
        p = _java(pattern)
        # count first, and only where a sign is there; the replace pass only runs
        # on texts that matched (secrets are rare, so most texts skip both)
        count = F.regexp_count(F.col(work), F.lit(p))
        if signs:
            count = F.when(reduce(Column.__or__, (F.contains(F.col(work), F.lit(x)) for x in signs)), count).otherwise(0)
        df = df.withColumn(step, count)
        df = df.withColumns(
            {
                cnt: F.col(cnt) + F.col(step),
                work: F.when(F.col(step) > 0, F.regexp_replace(F.col(work), p, _replacement(kind, "java"))).otherwise(F.col(work)),
            }
        ).drop(step)
    return (
        df.withColumn(out_text, strip_control(F.col(work)))
        .withColumn(out_count, F.col(cnt).cast("int"))
        .drop(work, cnt)
    )


def truncate(col, n: int, suffix: str = "...") -> Column:
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def correlation_sanitise(col, fallback_key) -> Column:
    """Keep [A-Za-z0-9_-], first 64; empty -> deterministic id from a row key."""
    cleaned = F.substring(F.regexp_replace(F.coalesce(_c(col), F.lit("")), "[^A-Za-z0-9_-]", ""), 1, 64)
    fresh = F.substring(F.sha2(_c(fallback_key).cast("string"), 256), 1, 16)
    return F.when(cleaned == F.lit(""), fresh).otherwise(cleaned)


# --- SQL (DuckDB) renderings used by oracle queries -------------------------

def sql_trim_ws(expr: str) -> str:
    ws = _RE2["WS"]
    return f"regexp_replace({expr}, '^{ws}+|{ws}+$', '', 'g')"


def _q(s: str) -> str:
    return s.replace("'", "''")


def sql_normalise(expr: str) -> str:
    work = sql_trim_ws(expr)
    for pattern, repl in NORMALISE_RULES:
        work = f"regexp_replace({work}, '{_q(re2(pattern))}', '{_q(repl)}', 'g')"
    work = sql_trim_ws(f"regexp_replace({work}, '{_RE2['WS']}+', ' ', 'g')")
    work = f"substr({work}, 1, {NORMALISED_MAX})"
    return f"(CASE WHEN {expr} IS NULL OR {sql_trim_ws(expr)} = '' THEN '' ELSE {work} END)"


def sql_signature_hash(normalised_expr: str) -> str:
    return f"left(sha256({normalised_expr}), 16)"


def sql_redaction_ctes(source: str, id_cols: str, text_col: str, prefix: str = "r") -> str:
    """CTE chain r0..r7 computing (text, count) stage by stage in DuckDB."""
    parts = [f"{prefix}0 AS (SELECT {id_cols}, coalesce({text_col}, '') AS w, 0 AS n FROM {source})"]
    for i, (pattern, kind) in enumerate(REDACT_RULES, start=1):
        p = _q(re2(pattern))
        repl = _q(_replacement(kind, "re2"))
        parts.append(
            f"{prefix}{i} AS (SELECT {id_cols}, regexp_replace(w, '{p}', '{repl}', 'g') AS w, "
            f"n + len(regexp_extract_all(w, '{p}')) AS n FROM {prefix}{i - 1})"
        )
    return ",\n".join(parts)


def sql_strip_control(expr: str) -> str:
    return f"regexp_replace({expr}, '{CONTROL_CHARS}', '', 'g')"
