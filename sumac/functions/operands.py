"""Operands: what the text of a predicate's value says, by the kind of its field."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from sumac.errors import QueryError
from sumac.functions.relative import offset_ms

#: The words for true and false, and the form of a decimal number.
TRUE, FALSE = ("true", "1", "t"), ("false", "0", "f")
DECIMAL = re.compile(r"[ \t\n\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r]*", re.ASCII)
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def number(raw: str, now: datetime | None = None) -> float | None:
    """A finite decimal number."""
    got = float(raw) if DECIMAL.fullmatch(raw) else math.inf
    return got if math.isfinite(got) else None


def truth(raw: str, now: datetime | None = None) -> bool | None:
    return {w: w in TRUE for w in (*TRUE, *FALSE)}.get(raw.lower())


def moment(raw: str, now: datetime) -> datetime | None:
    """A signed duration from now, or an ISO date or timestamp (without an offset: UTC)."""
    ahead = offset_ms(raw)
    try:
        at = now + timedelta(milliseconds=ahead) if ahead is not None else datetime.fromisoformat(raw)
    except (ValueError, OverflowError):
        return None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


#: How each kind is read, and what is said of text that can't be; other kinds take the text as it is.
READ: dict[str, tuple[Callable, str]] = {"number": (number, "a decimal number"), "bool": (truth, "true or false"), "datetime": (moment, "an instant or a signed duration")}


def operand(kind: str, raw: str, now: datetime, name: str = "value"):
    read, wanted = READ.get(kind, (lambda text, _: text, ""))
    got = read(raw, now)
    if got is None:
        raise QueryError("invalid_value", f"{name} takes {wanted}, and {raw!r} isn't one")
    return got


def instant(raw: str, now: datetime, name: str = "value") -> datetime:
    return operand("datetime", raw, now, name)


def millis(at: datetime) -> int:
    return (at - EPOCH) // timedelta(milliseconds=1)


def at_millis(ms: int) -> datetime:
    return EPOCH + timedelta(milliseconds=ms)


#: Of each comparison with a number: the first whole number that satisfies it and the first beyond that doesn't (None: no such bound).
_WHOLE: dict[str, tuple[Callable | None, Callable | None]] = {
    "=": (math.ceil, lambda x: math.floor(x) + 1),
    ">": (lambda x: math.floor(x) + 1, None),
    ">=": (math.ceil, None),
    "<": (None, math.ceil),
    "<=": (None, lambda x: math.floor(x) + 1),
}


def whole_span(op: str, x: float) -> tuple[int | None, int | None] | None:
    """[low, high) of the whole numbers n with ``n op x``; None for an operator that isn't an ordering."""
    if op not in _WHOLE:
        return None
    return tuple(f and f(x) for f in _WHOLE[op])  # type: ignore[return-value]


def meet(a: tuple[int | None, int | None], b: tuple[int | None, int | None]) -> tuple[int | None, int | None]:
    """The intersection of two spans."""
    lows, highs = ([x for x in side if x is not None] for side in zip(a, b, strict=True))
    return max(lows, default=None), min(highs, default=None)
