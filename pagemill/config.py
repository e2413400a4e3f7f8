"""Settings: defaults, then the environment, then overrides; nested ones are merged, lists replaced."""

from __future__ import annotations

import os
from collections.abc import Mapping
from typing import Any

DEFAULTS: dict[str, Any] = {
    "strategies": ["static", "browser"],
    "concurrency": 3,
    "timeouts": {"page": 30_000, "autonomous": 45_000, "quick": 30_000},
    "retry": {"max": 2, "delay_ms": 1_000},
    "circuit": {"threshold": 5, "reset_ms": 300_000, "half_open": 2},
    "block_resources": True,
}
PREFIX = "PAGEMILL_"


def merged(base: Mapping[str, Any], *over: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with the others' values over it, from left to right; None leaves what is there."""
    out = dict(base)
    for o in over:
        for k, v in o.items():
            if v is not None:
                out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def _read(text: str, like: Any) -> Any:
    """A text as a value of the default's type; None if it is no such value."""
    if isinstance(like, bool):
        return {"true": True, "1": True, "false": False, "0": False}.get(text.strip().lower())
    if isinstance(like, int):
        return int(text) if text.strip().lstrip("-").isdigit() else None
    if isinstance(like, list):
        return [x.strip() for x in text.split(",") if x.strip()] or None
    return text


def from_environment(env: Mapping[str, str], defaults: Mapping[str, Any] = DEFAULTS, prefix: str = PREFIX) -> dict[str, Any]:
    """Settings that the environment names: PREFIX, then the path in capitals with underscores."""
    out: dict[str, Any] = {}
    for k, like in defaults.items():
        name = prefix + k.upper()
        if isinstance(like, Mapping):
            out[k] = from_environment(env, like, name + "_")
        elif name in env:
            out[k] = _read(env[name], like)
    return out


def load(overrides: Mapping[str, Any] | None = None, env: Mapping[str, str] | None = None) -> dict[str, Any]:
    return merged(DEFAULTS, from_environment(os.environ if env is None else env), overrides or {})
