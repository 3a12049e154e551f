"""Settings from a JSON file, the environment and the command line, in rising precedence."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Mapping

DEFAULTS = {"provider": "mock", "model": "", "timeout": 60.0, "retries": 1, "mode": "conservative", "verbose": False}
PREFIX = "INKSPAN_"
_SECRET = re.compile(r"api_?key|secret|token|password|credential", re.I)


def _typed(name: str, value):
    kind = type(DEFAULTS[name])
    if kind is bool and isinstance(value, str):
        return value.lower() in ("1", "true", "yes")
    try:
        return kind(value)
    except (TypeError, ValueError) as e:
        raise ValueError(f"{name} must be of type {kind.__name__}") from e


def _known(values: Mapping, source: str) -> dict:
    for name in values:
        if _SECRET.search(name):
            raise ValueError(f"{source}: secrets don't belong into settings: {name}")
        if name not in DEFAULTS:
            raise ValueError(f"{source}: unknown setting {name}")
    return {k: _typed(k, v) for k, v in values.items() if v is not None}


def load_config(path: str | None = None, environment: Mapping[str, str] | None = None, command: Mapping | None = None) -> dict:
    """Defaults, then the file, then INKSPAN_* of the environment, then the command line."""
    merged = dict(DEFAULTS)
    if path:
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        if not isinstance(content, dict):
            raise ValueError("the settings file must hold a JSON object")
        merged |= _known(content, path)
    merged |= _known({k[len(PREFIX) :].lower(): v for k, v in (environment or {}).items() if k.startswith(PREFIX)}, "environment")
    return merged | _known(command or {}, "command line")


def logger(verbose: bool = False) -> logging.Logger:
    """A logger for counts and states; texts are never logged."""
    out = logging.getLogger("inkspan")
    out.setLevel(logging.INFO if verbose else logging.WARNING)
    return out
