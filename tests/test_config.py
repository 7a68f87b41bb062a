"""Parameter cross-field checks (window vs range, recovery, cooldown, namespaces)."""

import pytest

from vigil.config import Params, replay_params


def test_defaults_are_valid():
    p = Params()
    assert (p.window_seconds, p.slide_seconds, p.cooldown_seconds, p.recovery_seconds) == (300, 60, 900, 600)
    assert p.slides_per_window == 5 and p.thresholds.min_request_sample == 20


@pytest.mark.parametrize("kw", [
    dict(window_seconds=3 * 3600),                     # window longer than the 120 min query range
    dict(recovery_seconds=120),                        # recovery shorter than the window
    dict(cooldown_seconds=120),                        # cooldown shorter than the window
    dict(default_namespace="other"),                   # default not allow-listed
    dict(allowed_namespaces=("default", "Bad_Name")),  # not a Kubernetes name
    dict(window_seconds=310),                          # not a whole number of slides
    dict(max_distance=0.0),
    dict(top_k=0),
])
def test_invalid(kw):
    with pytest.raises(ValueError):
        Params(**kw)


def test_replay_params_and_with():
    p = replay_params()
    assert p.window_seconds == 86400 and p.slides_per_window == 4
    q = p.with_(top_k=3)
    assert q.top_k == 3 and hash(q) != hash(p)
