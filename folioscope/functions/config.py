"""Settings from the environment."""

from __future__ import annotations

import os


def env_text(name: str, default: str | None = None) -> str | None:
    """A variable's value; blank counts as unset."""
    return os.environ.get(name, "").strip() or default


def env_number(name: str, default: int | None = None) -> int | None:
    value = env_text(name)
    if value is None:
        return default
    try:
        return int(value)
    except ValueError:
        raise ValueError(f"{name} must be a whole number, not {value!r}") from None


def library_root() -> str:
    return env_text("FOLIOSCOPE_LIBRARY", "data/library")


def incoming_root() -> str:
    return env_text("FOLIOSCOPE_INCOMING", "data/incoming")
