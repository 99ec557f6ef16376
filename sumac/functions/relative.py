"""Signed durations such as -1h or +8d2h10m, against a fixed clock."""

from __future__ import annotations

from itertools import groupby

#: The units in milliseconds, and the furthest instant from 1970 in milliseconds.
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
FURTHEST = 8_640_000_000_000_000


def offset_ms(text: str) -> int | None:
    """Milliseconds of a duration; None for what isn't one or reaches too far."""
    sign, turns = text[:1], ["".join(run) for _, run in groupby(text[1:], "0123456789".__contains__)]
    numbers, units = turns[::2], turns[1::2]
    if sign not in ("+", "-") or not numbers or len(numbers) != len(units) or not numbers[0].isdecimal() or not UNITS.keys() >= set(units):
        return None
    reach = sum(int(n) * UNITS[u] for n, u in zip(numbers, units, strict=True))
    return None if reach > FURTHEST else int(f"{sign}1") * reach
