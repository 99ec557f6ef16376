"""Row expressions that carry their errors: a Cell is a value column and, where it can fail, a column of error codes.

Nulls propagate except through the functions that look at them; an error propagates until if_, coalesce_, iferror and the
logical operators leave the failing branch out. Values are null where the error isn't. Nothing raises at run time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumac.functions.relative import FURTHEST

#: Fixed value: the characters that count as white space in trimming and word counts.
WHITE = "\t\n\x0b\x0c\r   " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
SAFE = float(2**53 - 1)


@dataclass(frozen=True)
class Cell:
    value: Column
    error: Column | None = None

    def __add__(self, other):
        return _number(lambda a, b: a + b, self, other)

    def __radd__(self, other):
        return _number(lambda a, b: a + b, other, self)

    def __sub__(self, other):
        return _number(lambda a, b: a - b, self, other)

    def __rsub__(self, other):
        return _number(lambda a, b: a - b, other, self)

    def __mul__(self, other):
        return _number(lambda a, b: a * b, self, other)

    def __rmul__(self, other):
        return _number(lambda a, b: a * b, other, self)

    def __truediv__(self, other):
        return _number(F.try_divide, self, other, fails=[("divide_by_zero", lambda a, b: b == 0)])

    def __rtruediv__(self, other):
        return cell(other) / self

    def __mod__(self, other):
        return _number(F.try_mod, self, other, fails=[("divide_by_zero", lambda a, b: b == 0)])

    def __neg__(self):
        return _number(lambda a: -a, self)

    def __eq__(self, other):  # type: ignore[override]
        return strict(lambda a, b: a == b, self, other)

    def __ne__(self, other):  # type: ignore[override]
        return strict(lambda a, b: a != b, self, other)

    def __lt__(self, other):
        return strict(lambda a, b: a < b, self, other)

    def __le__(self, other):
        return strict(lambda a, b: a <= b, self, other)

    def __gt__(self, other):
        return strict(lambda a, b: a > b, self, other)

    def __ge__(self, other):
        return strict(lambda a, b: a >= b, self, other)

    def __and__(self, other):
        return _logic(self, cell(other), False)

    def __or__(self, other):
        return _logic(self, cell(other), True)

    def __invert__(self):
        return strict(lambda a: ~a, self)

    __hash__ = None  # type: ignore[assignment]


def cell(x) -> Cell:
    """A Cell of a Cell, a Column or a constant; whole numbers become doubles."""
    if isinstance(x, Cell):
        return x
    if isinstance(x, Column):
        return Cell(x)
    return Cell(F.lit(float(x)) if isinstance(x, int) and not isinstance(x, bool) else F.lit(x))


def col(name: str) -> Cell:
    return Cell(F.col(f"`{name}`"))


def _first(errors: list[Column | None]) -> Column | None:
    there = [e for e in errors if e is not None]
    return None if not there else there[0] if len(there) == 1 else F.coalesce(*there)


def _of(value: Column, error: Column | None) -> Cell:
    return Cell(value if error is None else F.when(error.isNull(), value), error)


def strict(make: Callable[..., Column], *args, fails: list[tuple[str, Callable[..., Column]]] = ()) -> Cell:
    """make() of the values; the first argument's error, or the code of the first condition in ``fails`` that holds."""
    cells = [cell(a) for a in args]
    values = [c.value for c in cells]
    own = [F.when(test(*values), F.lit(code)) for code, test in fails]
    return _of(make(*values), _first([*[c.error for c in cells], *own]))


def _number(make: Callable[..., Column], *args, fails=()) -> Cell:
    """A numeric result must be in range."""
    got = strict(make, *args, fails=list(fails))
    return ranged(got.value, got.error)


def ranged(value: Column, error: Column | None) -> Cell:
    """A number must be finite, and a whole one within 2^53 - 1."""
    bad = F.isnan(value) | (F.abs(value) == float("inf")) | ((F.abs(value) > SAFE) & (F.floor(value).cast("double") == value))
    return _of(value, _first([error, F.when(bad, F.lit("number_range"))]))


def _logic(a: Cell, b: Cell, decisive: bool) -> Cell:
    """Three-valued AND (decisive: False) or OR (True); a side that decides on its own hides the other's error."""
    value = (a.value | b.value) if decisive else (a.value & b.value)
    if a.error is None and b.error is None:
        return Cell(value)
    settled = (F.coalesce(a.value == decisive, F.lit(False)) if a.error is None else (a.error.isNull() & F.coalesce(a.value == decisive, F.lit(False)))) | F.coalesce(
        (b.value == decisive) if b.error is None else (b.error.isNull() & (b.value == decisive)), F.lit(False)
    )
    error = F.when(~settled, _first([a.error, b.error]))
    return Cell(F.when(settled, F.lit(decisive)).when(error.isNull(), value), error)


def if_(condition, then, otherwise=None) -> Cell:
    """A null condition takes the other branch; only the branch taken can fail."""
    c, a, b = cell(condition), cell(then), cell(otherwise)
    value = F.when(c.value, a.value).otherwise(b.value)
    if c.error is None and a.error is None and b.error is None:
        return Cell(value)
    none = F.lit(None).cast("string")
    branch = F.when(c.value, none if a.error is None else a.error).otherwise(none if b.error is None else b.error)
    return _of(value, branch if c.error is None else F.coalesce(c.error, branch))


def ifs(*pairs, otherwise=None) -> Cell:
    """ifs((condition, value), ...): the first condition that holds."""
    return reduce(lambda rest, p: if_(p[0], p[1], rest), reversed(pairs), cell(otherwise))


def switch(on, *pairs, otherwise=None) -> Cell:
    """switch(x, (match, value), ...); null matches null."""
    return ifs(*[(strict(lambda a, b: a.eqNullSafe(b), on, m), v) for m, v in pairs], otherwise=otherwise)


def coalesce_(*args) -> Cell:
    """The first value that isn't null; later ones don't count, whatever their errors."""
    return reduce(lambda rest, c: if_(Cell(c.value.isNotNull() if c.error is None else (c.value.isNotNull() | c.error.isNotNull())), c, rest), [cell(a) for a in reversed(args[:-1])], cell(args[-1]))


def nullif(a, b) -> Cell:
    return strict(F.nullif, a, b)


def is_null(a) -> Cell:
    return strict(F.isnull, a)


def is_empty(a) -> Cell:
    """Of text: null or ''."""
    return strict(lambda x: x.isNull() | (x == ""), a)


def array_is_empty(a) -> Cell:
    return strict(lambda x: x.isNull() | (F.size(x) == 0), a)


def iferror(a, instead) -> Cell:
    a, b = cell(a), cell(instead)
    if a.error is None:
        return a
    return _of(F.when(a.error.isNull(), a.value).otherwise(b.value), None if b.error is None else F.when(a.error.isNotNull(), b.error))


def in_(a, *values) -> Cell:
    return reduce(lambda x, y: x | y, [cell(a) == v for v in values])


def between(a, low, high) -> Cell:
    return strict(lambda x, y, z: (x >= y) & (x <= z), a, low, high)


# conversions


def to_text(a) -> Cell:
    """Of a number: its shortest digits, whole ones without a fraction; without an exponent from 1e-6 on."""
    plain = lambda x, scale: F.regexp_replace(x.cast("string").cast(f"decimal(38,{scale})").cast("string"), r"\.?0+$", "")

    def said(x: Column) -> Column:
        size, short = F.abs(x), x.cast("string")
        tiny = F.replace(F.replace(short, F.lit(".0E"), F.lit("E")), F.lit("E"), F.lit("e"))
        broken = F.when(size >= 1e7, plain(x, 18)).when(size >= 1e-3, short).when(size >= 1e-6, plain(x, 30)).otherwise(tiny)
        return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(broken)

    return strict(lambda x: said(x.cast("double")), a)


def bool_to_text(a) -> Cell:
    return strict(lambda x: x.cast("string"), a)


def datetime_to_text(a) -> Cell:
    """ISO 8601 in UTC with milliseconds."""
    return strict(lambda x: F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")), a)


def to_number(a) -> Cell:
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    bare = lambda x: F.btrim(x, F.lit(WHITE))
    return _number(lambda x: F.when(bare(x).rlike(number), bare(x).try_cast("double")), a, fails=[("invalid_number", lambda x: ~bare(x).rlike(number))])


def to_boolean(a) -> Cell:
    low = lambda x: F.lower(F.btrim(x, F.lit(WHITE)))
    return strict(lambda x: F.when(low(x).isin("true", "1"), True).when(low(x).isin("false", "0"), False), a, fails=[("invalid_boolean", lambda x: ~low(x).isin("true", "1", "false", "0"))])


def to_datetime(a, zone: str = "UTC") -> Cell:
    """An ISO date (its midnight in the zone) or a timestamp with an offset."""
    date, time = r"\d{4}-\d{2}-\d{2}", r"[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})"
    midnight = lambda x: F.to_utc_timestamp(x.try_cast("timestamp_ntz"), zone)
    got = lambda x: F.date_trunc("millisecond", F.when(x.rlike(f"^{date}$"), midnight(x)).when(x.rlike(f"^{date}{time}$"), x.try_cast("timestamp")))
    return strict(got, a, fails=[("invalid_datetime", lambda x: x.isNotNull() & got(x).isNull())])


# text; positions and lengths are in code points, positions from 1


def _int(n: Column) -> Column:
    """A number as an int; beyond the ints' range the nearest of them."""
    return F.least(F.lit(2.0**31 - 1), F.greatest(F.lit(-(2.0**31)), n)).cast("int")


def _count(n: Column) -> Column:
    return F.greatest(F.lit(0), _int(n))


def left(a, n) -> Cell:
    return strict(lambda x, k: F.substring(x, F.lit(1), _count(k)), a, n)


def right(a, n) -> Cell:
    return strict(lambda x, k: F.substring(x, F.greatest(F.lit(1), F.length(x) - _count(k) + 1), _count(k)), a, n)


def substring(a, start, n=None) -> Cell:
    fails = [("invalid_position", lambda x, s, *k: s < 1)]
    if n is None:
        return strict(lambda x, s: F.substring(x, _int(s), F.length(x)), a, start, fails=fails)
    return strict(lambda x, s, k: F.substring(x, _int(s), _count(k)), a, start, n, fails=fails)


def length(a) -> Cell:
    return strict(lambda x: F.length(x).cast("double"), a)


def word_count(a) -> Cell:
    return strict(lambda x: F.size(F.regexp_extract_all(x, F.lit(f"[^{WHITE}]+"), F.lit(0))).cast("double"), a)


def url_encode(a) -> Cell:
    """Percent-encoding of all but unreserved characters."""
    return strict(lambda x: F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), a)


def lower(a) -> Cell:
    return strict(F.lower, a)


def upper(a) -> Cell:
    return strict(F.upper, a)


def trim(a) -> Cell:
    return strict(lambda x: F.btrim(x, F.lit(WHITE)), a)


def ltrim(a) -> Cell:
    return strict(lambda x: F.ltrim(x, F.lit(WHITE)), a)


def rtrim(a) -> Cell:
    return strict(lambda x: F.rtrim(x, F.lit(WHITE)), a)


def replace(a, what, by) -> Cell:
    return strict(F.replace, a, what, by, fails=[("empty_search", lambda x, w, b: w == "")])


#: Fixed value: the longest text that padding makes.
PADDED = 1_000_000
_PADDING = [("empty_pad", lambda x, k, p: p == ""), ("invalid_length", lambda x, k, p: k > PADDED)]


def lpad(a, n, pad=" ") -> Cell:
    return strict(lambda x, k, p: F.when(F.length(x) >= k, x).otherwise(F.lpad(x, _int(F.when(k <= PADDED, k)), p)), a, n, pad, fails=_PADDING)


def rpad(a, n, pad=" ") -> Cell:
    return strict(lambda x, k, p: F.when(F.length(x) >= k, x).otherwise(F.rpad(x, _int(F.when(k <= PADDED, k)), p)), a, n, pad, fails=_PADDING)


def _quoted(separator: str) -> str:
    return "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split(a, separator: str) -> Cell:
    """By a literal separator; trailing empty parts stay."""
    return strict(lambda x: F.split(x, _quoted(separator)), a)


def split_part(a, separator: str, n) -> Cell:
    """The n-th part; null where there are fewer."""
    return strict(lambda x, k: F.get(F.split(x, _quoted(separator)), _int(k) - 1), a, n, fails=[("invalid_position", lambda x, k: k < 1)])


def concat(*args) -> Cell:
    return strict(F.concat, *args)


def concat_ws(separator: str, *args) -> Cell:
    """Nulls are left out."""
    return strict(lambda *x: F.concat_ws(separator, *x), *args)


def _folded(make: Callable[[Column, Column], Column], a, b, ignore_case) -> Cell:
    if ignore_case is False or ignore_case is True:
        return strict(lambda x, y: make(F.lower(x), F.lower(y)) if ignore_case else make(x, y), a, b)
    return strict(lambda x, y, i: F.when(i, make(F.lower(x), F.lower(y))).when(~i, make(x, y)), a, b, ignore_case)


def contains(a, b, ignore_case=False) -> Cell:
    return _folded(F.contains, a, b, ignore_case)


def starts_with(a, b, ignore_case=False) -> Cell:
    return _folded(F.startswith, a, b, ignore_case)


def ends_with(a, b, ignore_case=False) -> Cell:
    return _folded(F.endswith, a, b, ignore_case)


def _flags(flags: str) -> str:
    return f"(?{flags})" if flags else ""


def regex_test(a, pattern: str, flags: str = "") -> Cell:
    return strict(lambda x: x.rlike(_flags(flags) + pattern), a)


def regex_extract(a, pattern: str, group: int = 0, flags: str = "") -> Cell:
    """Null where nothing matches."""
    whole = _flags(flags) + pattern
    return strict(lambda x: F.when(x.rlike(whole), F.regexp_extract(x, whole, group)), a)


def regex_replace(a, pattern: str, by: str, flags: str = "") -> Cell:
    """All matches; in ``by`` $& is the match, $n a group and $$ a dollar."""
    java, k = "", 0
    while k < len(by):
        two = by[k : k + 2]
        if two in ("$$", "$&"):
            java, k = java + ("\\$" if two == "$$" else "$0"), k + 2
        else:
            java += "\\\\" if by[k] == "\\" else by[k] if by[k] != "$" or by[k + 1 : k + 2].isdigit() else "\\$"
            k += 1
    return strict(lambda x: F.regexp_replace(x, _flags(flags) + pattern, java), a)


# numbers


def abs_(a) -> Cell:
    return _number(F.abs, a)


def floor(a) -> Cell:
    return _number(lambda x: F.floor(x).cast("double"), a)


def ceil(a) -> Cell:
    return _number(lambda x: F.ceil(x).cast("double"), a)


def trunc(a) -> Cell:
    return _number(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"), a)


def sqrt(a) -> Cell:
    return _number(lambda x: F.when(x >= 0, F.sqrt(x)), a, fails=[("invalid_argument", lambda x: x < 0)])


def round_(a, digits: int = 0) -> Cell:
    """Ties go up. A number too large to have a digit there stays as it is."""
    scale = 10.0**digits
    return _number(lambda x: F.when(F.abs(x * scale) < SAFE, F.floor(x * scale + 0.5).cast("double") / scale).otherwise(x), a)


def power(a, b) -> Cell:
    return _number(F.pow, a, b)


def clamp(a, low, high) -> Cell:
    return _number(lambda x, lo, hi: F.when(x.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.greatest(lo, F.least(hi, x))), a, low, high, fails=[("invalid_range", lambda x, lo, hi: lo > hi)])


def least(*args) -> Cell:
    """Null if any is null."""
    return strict(lambda *x: F.when(reduce(lambda p, q: p & q, [y.isNotNull() for y in x]), F.least(*x)), *args)


def greatest(*args) -> Cell:
    return strict(lambda *x: F.when(reduce(lambda p, q: p & q, [y.isNotNull() for y in x]), F.greatest(*x)), *args)


# arrays of text


def join(a, separator: str) -> Cell:
    return strict(lambda x: F.array_join(x, separator), a)


def array_length(a) -> Cell:
    return strict(lambda x: F.when(x.isNotNull(), F.size(x)).cast("double"), a)


def array_contains(a, b) -> Cell:
    return strict(lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.coalesce(F.array_contains(x, y), F.lit(False))), a, b)


def array_get(a, n) -> Cell:
    """From 1; null beyond the end."""
    return strict(lambda x, k: F.get(x, _int(k) - 1), a, n, fails=[("invalid_position", lambda x, k: k < 1)])


def array_unique(a) -> Cell:
    return strict(F.array_distinct, a)


def array_sort(a) -> Cell:
    return strict(F.array_sort, a)


# dates, in UTC


def year(a) -> Cell:
    return strict(lambda x: F.year(x).cast("double"), a)


def month(a) -> Cell:
    return strict(lambda x: F.month(x).cast("double"), a)


def day(a) -> Cell:
    return strict(lambda x: F.dayofmonth(x).cast("double"), a)


def hour(a) -> Cell:
    return strict(lambda x: F.hour(x).cast("double"), a)


def weekday(a) -> Cell:
    """Monday is 1."""
    return strict(lambda x: (F.weekday(x) + 1).cast("double"), a)


_MILLIS = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1_000, "millisecond": 1}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def date_trunc(unit: str, a) -> Cell:
    return strict(lambda x: F.date_trunc(unit, x), a)


def date_add(unit: str, n, a) -> Cell:
    """Months and years keep to the last day of shorter months."""
    far = [("datetime_range", lambda k, x: F.abs(k * (_MILLIS.get(unit) or _MONTHS[unit] * 31 * _MILLIS["day"]) + F.unix_millis(x)) > FURTHEST)]
    if unit in _MILLIS:
        return strict(lambda k, x: F.timestamp_millis(F.unix_millis(x) + F.when(~far[0][1](k, x), k * _MILLIS[unit]).cast("long")), n, a, fails=far)
    return strict(lambda k, x: x + F.make_ym_interval(F.lit(0), F.when(~far[0][1](k, x), k * _MONTHS[unit]).cast("int")), n, a, fails=far)


def date_diff(unit: str, a, b) -> Cell:
    """Whole units that elapsed from a to b."""
    return trunc(strict(lambda x, y: (F.unix_millis(y) - F.unix_millis(x)) / F.lit(float(_MILLIS[unit])), a, b))


def format_date(a, pattern: str) -> Cell:
    """YYYY MM DD HH mm ss are filled in; all else stands."""
    parts = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss"}
    java, other, k = "", "", 0
    quoted = lambda t: "'" + t.replace("'", "''") + "'" if t else ""
    while k < len(pattern):
        token = next((t for t in parts if pattern.startswith(t, k)), None)
        if token:
            java, other = java + quoted(other) + parts[token], ""
        else:
            other += pattern[k]
        k += len(token) if token else 1
    java += quoted(other)
    return strict(lambda x: F.date_format(x, java), a)
