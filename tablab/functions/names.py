"""Private column names: whatever columns a table has, an operator's own helper columns never meet them."""

from __future__ import annotations

from collections.abc import Iterable


def private(taken: Iterable[str], *stems: str) -> list[str]:
    """One name per stem that no name in ``taken`` equals, in either case (Spark's names are case-insensitive)."""
    used = {c.lower() for c in taken}
    out = []
    for stem in stems:
        name, i = f"__{stem}", 0
        while name.lower() in used:
            i += 1
            name = f"__{stem}_{i}"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"
