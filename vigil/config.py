"""Engine parameters with the cross-field checks of the detection service.

The defaults are the service defaults (5 minute window evaluated every 60 s,
15 minute cooldown, 10 minute recovery). Tests over the synthetic tables use
wider windows because the events there are minutes apart.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

_NAMESPACE_RE = re.compile(r"^[a-z0-9]([-a-z0-9]{0,61}[a-z0-9])?$")


@dataclass(frozen=True)
class Thresholds:
    http_error_rate: float = 0.10
    min_request_sample: int = 20
    latency_p95_seconds: float = 1.5
    pod_restart_increase: int = 2
    unready_pod_count: int = 1
    repeated_signature_count: int = 10
    dependency_failure_count: int = 5


@dataclass(frozen=True)
class Params:
    window_seconds: int = 300
    slide_seconds: int = 60
    cooldown_seconds: int = 900
    recovery_seconds: int = 600
    thresholds: Thresholds = field(default_factory=Thresholds)
    max_log_lines: int = 500
    max_range_minutes: int = 120
    max_items: int = 200
    max_evidence_items: int = 60
    retry_max_attempts: int = 3
    retry_base_delay_seconds: int = 30
    retry_max_delay_seconds: int = 900
    lease_seconds: int = 2400
    top_k: int = 5
    max_distance: float = 0.65
    embedding_dim: int = 768
    default_namespace: str = "default"
    allowed_namespaces: tuple[str, ...] = ("default",)
    max_signatures: int = 25        # listed per pass as evidence; rules see all
    max_log_samples: int = 50       # newest error lines per incident
    ann_cells: int = 0              # of the approximate search; 0: from the table's size
    ann_probes: int = 0             # cells a query looks into; 0: as the sample's neighbours need

    def __post_init__(self) -> None:
        self.validate()

    def validate(self) -> None:
        problems = []
        if self.window_seconds <= 0 or self.slide_seconds <= 0:
            problems.append("window and slide must be positive")
        if self.window_seconds % self.slide_seconds:
            problems.append("window must be a whole number of slides")
        if self.window_seconds > self.max_range_minutes * 60:
            problems.append("window may not exceed the maximum query range")
        if self.recovery_seconds < self.window_seconds:
            problems.append("recovery must be at least one window")
        if self.cooldown_seconds < self.window_seconds:
            problems.append("cooldown must be at least one window")
        if self.default_namespace not in self.allowed_namespaces:
            problems.append("default namespace must be in the allow-list")
        for ns in self.allowed_namespaces:
            if not _NAMESPACE_RE.match(ns):
                problems.append(f"invalid namespace name {ns!r}")
        if not 0 < self.max_distance <= 2:
            problems.append("max_distance must be in (0, 2]")
        if self.top_k < 1:
            problems.append("top_k must be positive")
        if problems:
            raise ValueError("; ".join(problems))

    @property
    def window_minutes(self) -> int:
        """The window as texts name it: whole minutes, one at least."""
        return max(1, self.window_seconds // 60)

    @property
    def slides_per_window(self) -> int:
        return self.window_seconds // self.slide_seconds

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


def replay_params(**kw) -> Params:
    """Parameters sized for the synthetic tables (events minutes apart)."""
    base = dict(
        window_seconds=86400,
        slide_seconds=21600,
        cooldown_seconds=129600,
        recovery_seconds=86400,
        max_range_minutes=7 * 24 * 60,
        allowed_namespaces=("default", "prod", "staging"),
    )
    base.update(kw)
    return Params(**base)
