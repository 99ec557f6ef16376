"""Calendar buckets and cycles in a time zone, as columns and, for filling gaps, as Python functions.

A bucket is named by the instant at which it starts. Buckets of ``every`` intervals have fixed anchors: hours at local
multiples of every in each day (so every divides 24), days from 1970-01-01, weeks from Monday 1969-12-29, months and years
from 1970. A start that the clock repeats is its earlier occurrence; one that the clock skips is the transition. Single
hours are elapsed hours: a repeated hour is two buckets, and an offset change inside an hour begins another.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from itertools import pairwise
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumac.errors import QueryError

INTERVALS = ("hour", "day", "week", "month", "year")
CYCLES = {"hourOfDay": range(24), "dayOfWeek": range(1, 8)}
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_HOUR, _DAY = 3_600_000, 86_400_000
#: Of intervals of one length, how far before 1970-01-01 one of them began, and that length.
_ANCHORS = {"hour": (0, _HOUR), "day": (0, _DAY), "week": (3 * _DAY, 7 * _DAY)}


def check(interval: str, every: int = 1) -> None:
    if interval in CYCLES:
        if every != 1:
            raise QueryError("invalid_every", "cycles are of single hours or days")
    elif interval not in INTERVALS or not 1 <= every <= 1000 or (interval == "hour" and 24 % every):
        raise QueryError("invalid_every", f"{every} {interval}")


@functools.lru_cache(maxsize=256)
def _clock(zone: str, first: int = 1900, last: int = 2100) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(the instants from which each offset of the zone holds, the offsets), in milliseconds; the first holds from ever on."""
    tz = ZoneInfo(zone)
    offset = lambda s: (_EPOCH + timedelta(seconds=s)).astimezone(tz).utcoffset() // timedelta(milliseconds=1)
    weeks = range(round(datetime(first, 1, 1, tzinfo=UTC).timestamp()), round(datetime(last, 1, 1, tzinfo=UTC).timestamp()), 7 * 86_400)
    since, offsets = [-(2**62)], [offset(weeks[0])]
    for a, b in pairwise(weeks):
        while offset(b) != offsets[-1]:
            a += bisect_left(range(a, b), True, key=lambda s: offset(s) != offsets[-1])
            since.append(a * 1000)
            offsets.append(offset(a))
    return tuple(since), tuple(offsets)


def transitions(zone: str) -> tuple[int, ...]:
    """Epoch milliseconds at which the zone's offset changes."""
    return _clock(zone)[0][1:]


@functools.lru_cache(maxsize=256)
def _midnights_stand(zone: str) -> bool:
    """Whether no clock change leaps from before midnight to after it: then a local date always begins at its midnight, or at the
    change that skips just that."""
    since, offsets = _clock(zone)
    leaps = [(t + a, t + b) for t, a, b in zip(since[1:], offsets[:-1], offsets[1:], strict=True)]
    inside = lambda before, after: before // _DAY < after // _DAY and before % _DAY and after % _DAY
    return not any(inside(before, after) for before, after in leaps)


def _let(value: Column, make) -> Column:
    """make(value) with the value computed once."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _local(ms: Column, zone: str) -> Column:
    """The wall clock's reading, as milliseconds."""
    return ms if zone == "UTC" else F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), zone))


def _last_change(ms: Column, zone: str) -> Column:
    known = F.array(*[F.lit(t) for t in transitions(zone)]).cast("array<bigint>")
    return F.array_max(F.filter(known, lambda t: t <= ms))


def _instant(wall: Column, zone: str) -> Column:
    if zone == "UTC":
        return wall
    later = lambda w: F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(w), zone))
    return _let(wall, lambda w: _let(later(w), lambda t: F.when(_local(t, zone) == w, t).otherwise(_last_change(t, zone))))


def _number(local: Column, interval: str, every: int) -> Column:
    """The number of the period that holds a wall clock's reading, counted from the anchor."""
    days = F.floor(local / _DAY)
    if interval in ("hour", "day", "week"):
        shift, length = _ANCHORS[interval]
        return F.floor((local + shift) / (length * every))
    date = F.date_from_unix_date(days.cast("int"))
    years = F.year(date) - 1970
    return F.floor((years if interval == "year" else years * 12 + F.month(date) - 1) / every)


def _reading(number: Column, interval: str, every: int) -> Column:
    """The wall clock's reading at which the period of that number begins."""
    if interval in ("hour", "day", "week"):
        shift, length = _ANCHORS[interval]
        return number * (length * every) - shift
    months = number * (every if interval == "month" else 12 * every)
    return F.unix_date(F.add_months(F.lit("1970-01-01").cast("date"), months.cast("int"))).cast("long") * _DAY


def _furthest(ms: Column, zone: str) -> Column:
    """The furthest reading of the wall clock so far: that before the last change, where the clock was put back by then."""
    if zone == "UTC":
        return ms
    return _let(_last_change(ms, zone), lambda t: F.greatest(_local(ms, zone), _local(t - 1, zone)))


def bucket(ts: Column, interval: str, zone: str = "UTC", every: int = 1) -> Column:
    """The start (timestamp) of the bucket that holds ts; of a cycle its slot (double). Null for null."""
    check(interval, every)
    if interval in CYCLES:
        local = ts if zone == "UTC" else F.from_utc_timestamp(ts, zone)
        return (F.hour(local) if interval == "hourOfDay" else F.weekday(local) + 1).cast("double")
    if zone == "UTC" and every == 1:
        return F.date_trunc(interval, ts)
    ms = F.unix_millis(ts)
    if interval == "hour" and every == 1:
        offset = lambda t: _local(t, zone) - t
        start = F.floor(_local(ms, zone) / 3_600_000) * 3_600_000 - offset(ms)
        return F.when(ts.isNotNull(), F.timestamp_millis(F.when(offset(start) == offset(ms), start).otherwise(_last_change(ms, zone))))
    if interval != "hour" and every == 1 and _midnights_stand(zone):
        return F.to_utc_timestamp(F.date_trunc(interval, F.from_utc_timestamp(ts, zone)), zone)
    # hours follow the clock as far as it has come: where it was put back, the later of two buckets holds on
    reading = _furthest if interval == "hour" else _local
    begin = lambda t: _instant(_let(reading(t, zone), lambda w: _reading(_number(w, interval, every), interval, every)), zone)
    return F.when(ts.isNotNull(), F.timestamp_millis(_let(ms, begin)))


def following(start: Column, interval: str, zone: str = "UTC", every: int = 1) -> Column:
    """The start of the bucket after the one that starts at ``start``."""
    check(interval, every)
    ms = F.unix_millis(start)
    if interval == "hour" and every == 1:
        end = ms + 3_600_000
        if zone != "UTC":
            change = lambda e: F.coalesce(_last_change(e - 1, zone), F.lit(-(2**62)))
            hour = F.floor(_local(ms, zone) / 3_600_000) * 3_600_000 + 3_600_000 - _local(ms, zone) + ms
            end = _let(hour, lambda e: F.when(change(e) > ms, change(e)).otherwise(e))
        return F.timestamp_millis(end)
    after = lambda w: _reading(_number(w, interval, every) + 1, interval, every)
    return F.timestamp_millis(_let(_local(ms, zone), lambda w: _instant(after(w), zone)))


# the same in Python, for lists of buckets: readings and instants are milliseconds


def _stretch(ms: int, zone: str) -> tuple[int, int, int]:
    """(from, until, offset) of the stretch of time with one offset that holds ms."""
    since, offsets = _clock(zone)
    k = bisect_right(since, ms) - 1
    return since[k], since[k + 1] if k + 1 < len(since) else 2**62, offsets[k]


@functools.lru_cache(maxsize=256)
def _turned(zone: str) -> tuple[int, ...]:
    """The readings that the clock shows when each of its stretches is over."""
    since, offsets = _clock(zone)
    return tuple(t + o for t, o in zip(since[1:], offsets[:-1], strict=True))


def _earliest(reading: int, zone: str) -> int:
    """The first instant at which the clock shows the reading, or is put ahead of it."""
    since, offsets = _clock(zone)
    k = bisect_right(_turned(zone), reading)
    return max(since[k], reading - offsets[k])


def _py_number(reading: int, interval: str, every: int) -> int:
    if interval in _ANCHORS:
        shift, length = _ANCHORS[interval]
        return (reading + shift) // (length * every)
    date = _EPOCH + timedelta(days=reading // _DAY)
    return ((date.year - 1970) * 12 + date.month - 1) // (every if interval == "month" else 12 * every)


def _py_reading(number: int, interval: str, every: int) -> int:
    if interval in _ANCHORS:
        shift, length = _ANCHORS[interval]
        return number * length * every - shift
    years, month = divmod(number * (every if interval == "month" else 12 * every), 12)
    return (datetime(1970 + years, month + 1, 1, tzinfo=UTC) - _EPOCH).days * _DAY


def start_of(ms: int, interval: str, zone: str = "UTC", every: int = 1) -> int:
    check(interval, every)
    since, _, offset = _stretch(ms, zone)
    if interval == "hour" and every == 1:
        return max(since, (ms + offset) // _HOUR * _HOUR - offset)
    reading = ms + offset
    if interval == "hour" and (k := bisect_right(transitions(zone), ms)):
        reading = max(reading, _turned(zone)[k - 1] - 1)  # as _furthest()
    return _earliest(_py_reading(_py_number(reading, interval, every), interval, every), zone)


def next_of(start: int, interval: str, zone: str = "UTC", every: int = 1) -> int:
    _, until, offset = _stretch(start, zone)
    if interval == "hour" and every == 1:
        return min(until, (start + offset) // _HOUR * _HOUR + _HOUR - offset)
    return _earliest(_py_reading(_py_number(start + offset, interval, every) + 1, interval, every), zone)


def starts(first: int, last: int, interval: str, zone: str = "UTC", every: int = 1, most: int = 10_000) -> Iterator[int]:
    """The starts of the buckets from the one that holds ``first`` to the one that holds ``last``."""
    at = start_of(first, interval, zone, every)
    for _ in range(most + 1):
        if at > last:
            return
        yield at
        at = next_of(at, interval, zone, every)
    raise QueryError("resource_limit", f"more than {most} buckets")
