"""Names for columns that an operator adds beside those of its input."""

from __future__ import annotations


def free(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores added as it takes to differ from all ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out
