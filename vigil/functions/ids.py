"""Deterministic identifiers: incident fingerprints and evidence ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.text import trim_ws

# Evidence kind names and their id prefixes.
#   LogSample -> log, LogSignature -> sig, Metric -> met,
#   KubernetesState -> k8s, KubernetesEvent -> evt,
#   HistoricalIncident -> hist, Runbook -> book
EVIDENCE_PREFIX = {
    "LogSample": "log",
    "LogSignature": "sig",
    "Metric": "met",
    "KubernetesState": "k8s",
    "KubernetesEvent": "evt",
    "HistoricalIncident": "hist",
    "Runbook": "book",
}
# Evidence source names (part of the hashed id text).
SOURCE_LOGS = "loki"
SOURCE_METRICS = "prometheus"
SOURCE_K8S = "kubernetes"
SOURCE_MEMORY = "memory"
# Kind priority used when an evidence bundle must be trimmed.
KIND_PRIORITY = ["KubernetesState", "KubernetesEvent", "Metric", "LogSignature", "HistoricalIncident", "Runbook", "LogSample"]

FINGERPRINT_HEX = 20
EVIDENCE_HEX = 12


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_workloads(workloads) -> Column:
    """Non-blank, trimmed, distinct, binary-sorted workload list."""
    kept = F.filter(_c(workloads), lambda w: w.isNotNull() & (trim_ws(w) != F.lit("")))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda w: trim_ws(w))))


def fingerprint(category, namespace, workloads, signature=None) -> Column:
    """20 hex of SHA-256 over ``category|namespace|w1,w2[|signature]``."""
    base = F.concat_ws(
        "|", _c(category), _c(namespace), F.array_join(clean_workloads(workloads), ",")
    )
    if signature is not None:
        sig = _c(signature)
        has_sig = sig.isNotNull() & (trim_ws(sig) != F.lit(""))
        base = F.when(has_sig, F.concat(base, F.lit("|"), sig)).otherwise(base)
    return F.substring(F.sha2(base, 256), 1, FINGERPRINT_HEX)


def evidence_id(kind: str, source, *parts) -> Column:
    """``<prefix>_`` + 12 hex of SHA-256 over ``Kind|source|part|...``.

    NULL parts contribute an empty string (``concat_ws`` would drop them and
    shift the layout, so each part is coalesced explicitly).
    """
    pieces = [F.lit(kind), _c(source) if not isinstance(source, str) else F.lit(source)]
    pieces += [F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts]
    digest = F.substring(F.sha2(F.concat_ws("|", *pieces), 256), 1, EVIDENCE_HEX)
    return F.concat(F.lit(EVIDENCE_PREFIX.get(kind, "ev") + "_"), digest)


def deterministic_id(*cols) -> Column:
    """Stable 32-hex id (replay is idempotent: same inputs give the same id)."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols]), 256), 1, 32)


# --- SQL renderings ---------------------------------------------------------

def sql_fingerprint(category: str, namespace: str, workloads_list: str, signature: str | None = None) -> str:
    base = f"concat_ws('|', {category}, {namespace}, array_to_string({workloads_list}, ','))"
    if signature is not None:
        base = f"(CASE WHEN {signature} IS NOT NULL AND trim({signature}) <> '' THEN {base} || '|' || {signature} ELSE {base} END)"
    return f"left(sha256({base}), {FINGERPRINT_HEX})"


def sql_evidence_id(kind: str, source: str, *parts: str) -> str:
    pieces = [f"'{kind}'", f"'{source}'"] + [f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts]
    return f"('{EVIDENCE_PREFIX.get(kind, 'ev')}_' || left(sha256(concat_ws('|', {', '.join(pieces)})), {EVIDENCE_HEX}))"
