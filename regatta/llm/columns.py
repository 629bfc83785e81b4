"""Names of columns that operators add."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no column has it (in any case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name
