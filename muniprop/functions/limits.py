"""Row limits of the bounded operators."""

from __future__ import annotations

MAX_RESULT_ROWS = 2000  # largest number of rows a bounded operator returns


def bounded_limit(asked: int, most: int = MAX_RESULT_ROWS) -> int:
    """``asked`` as an int, refused unless 1 <= asked <= most."""
    rows = int(asked)
    if not 0 < rows <= most:
        raise ValueError(f"a row limit of {rows} is outside 1..{most}")
    return rows
