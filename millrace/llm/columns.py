"""Names of helper columns."""

from __future__ import annotations

from collections.abc import Iterable


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it; Spark ignores case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name
