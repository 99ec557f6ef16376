import math

from pyspark.sql import functions as F

from sumac.functions import scalar as S
from sumac.functions.scalar import Cell, cell, col

def num(x):
    return Cell(F.lit(x).cast("double"))


def text(x):
    return Cell(F.lit(x).cast("string"))


def cases():
    t = Cell(F.lit("2024-01-31 23:05:09.123456").cast("timestamp"))
    return [
        (num(1) / num(0), None, "divide_by_zero"),
        (S.to_text(num(12345678.5)), "12345678.5", None),
        (S.to_text(num(0.0001)), "0.0001", None),
        (S.to_text(num(-1.5e-6)), "-0.0000015", None),
        (S.to_text(num(2.5e-7)), "2.5e-7", None),
        (S.to_text(num(1e-7)), "1e-7", None),
        (S.to_text(num(-0.5)), "-0.5", None),
        (S.round_(num(1e14), 6), 1e14, None),
        (S.round_(num(2.345), 2), 2.35, None),
        (S.left(text("abc"), num(1e10)), "abc", None),
        (S.right(text("abc"), num(1e10)), "abc", None),
        (S.substring(text("abc"), num(1e10)), "", None),
        (S.split_part(text("a,b"), ",", num(1e10)), None, None),
        (S.array_get(S.split(text("a,b"), ","), num(1e10)), None, None),
        (S.lpad(text("a"), num(1e10)), None, "invalid_length"),
        (S.year(S.date_add("day", num(1e10), t)), None, "datetime_range"),
        (S.year(S.date_add("year", num(1e10), t)), None, "datetime_range"),
        (S.year(S.date_add("year", num(2), t)), 2026.0, None),
        (num(1) / num(None), None, None),
        (num(-7) % num(3), -1.0, None),
        (num(2**53) + num(1), None, "number_range"),
        (num(1e308) * num(10), None, "number_range"),
        (S.if_(num(None) > 1, num(1) / 0, 5), 5.0, None),
        (S.if_(num(2) > 1, num(1) / 0, 5), None, "divide_by_zero"),
        (S.coalesce_(num(None), 3, num(1) / 0), 3.0, None),
        (S.coalesce_(num(1) / 0, 3), None, "divide_by_zero"),
        (S.iferror(num(1) / 0, 9), 9.0, None),
        (cell(False) & (num(1) / 0 > 1), False, None),
        (cell(True) & (num(1) / 0 > 1), None, "divide_by_zero"),
        (cell(True) | (num(1) / 0 > 1), True, None),
        (S.switch(text(None), (text(None), "none"), otherwise="x"), "none", None),
        (S.ifs((num(1) > 2, "a"), (num(3) > 2, "b")), "b", None),
        (S.nullif(num(0), 0), None, None),
        (S.in_(num(3), 1, 3), True, None),
        (S.between(num(3), 1, 2), False, None),
        (S.is_empty(text("")), True, None),
        (S.to_text(num(12)), "12", None),
        (S.to_text(num(0.5)), "0.5", None),
        (S.to_number(text("  -1.5e2 ")), -150.0, None),
        (S.to_number(text("1 2")), None, "invalid_number"),
        (S.to_boolean(text("y")), None, "invalid_boolean"),
        (S.to_boolean(text("1")), True, None),
        (S.to_datetime(text("2024-02-30")), None, "invalid_datetime"),
        (S.datetime_to_text(S.to_datetime(text("2024-07-01"), "America/New_York")), "2024-07-01T04:00:00.000Z", None),
        (S.datetime_to_text(S.to_datetime(text("2024-07-01"))), "2024-07-01T00:00:00.000Z", None),
        (S.datetime_to_text(S.to_datetime(text("2024-02-29T01:00:00+02:00"))), "2024-02-28T23:00:00.000Z", None),
        (S.left(text("a😀bc"), 2), "a😀", None),
        (S.right(text("a😀bc"), 3), "😀bc", None),
        (S.right(text("ab"), 9), "ab", None),
        (S.substring(text("abcdef"), 2, 3), "bcd", None),
        (S.substring(text("abc"), 0), None, "invalid_position"),
        (S.length(text("a😀")), 2.0, None),
        (S.word_count(text(" a b　c ")), 3.0, None),
        (S.trim(text("  x﻿")), "x", None),
        (S.url_encode(text("a b*~é/")), "a%20b%2A~%C3%A9%2F", None),
        (S.replace(text("aXbX"), "X", "-"), "a-b-", None),
        (S.replace(text("a"), "", "-"), None, "empty_search"),
        (S.lpad(text("7"), 3, "0"), "007", None),
        (S.lpad(text("long"), 2, "0"), "long", None),
        (S.rpad(text("7"), 3, ""), None, "empty_pad"),
        (S.split_part(text("a.b.c"), ".", 2), "b", None),
        (S.split_part(text("a.b.c"), ".", 4), None, None),
        (S.concat(text("a"), text(None)), None, None),
        (S.concat_ws("-", text("a"), text(None), text("b")), "a-b", None),
        (S.contains(text("ABC"), "bc", True), True, None),
        (S.starts_with(text("ABC"), "ab"), False, None),
        (S.regex_extract(text("x12y"), "([0-9])([0-9])", 2), "2", None),
        (S.regex_extract(text("xy"), "[0-9]"), None, None),
        (S.regex_replace(text("a1"), "([a-z])", "<$&$1$$>"), "<aa$>1", None),
        (S.round_(num(-2.5)), -2.0, None),
        (S.round_(num(1.25), 1), 1.3, None),
        (S.trunc(num(-1.7)), -1.0, None),
        (S.sqrt(num(-1)), None, "invalid_argument"),
        (S.power(num(2), 10), 1024.0, None),
        (S.clamp(num(5), 1, 3), 3.0, None),
        (S.clamp(num(5), 3, 1), None, "invalid_range"),
        (S.least(num(1), num(None)), None, None),
        (S.greatest(num(1), num(2)), 2.0, None),
        (S.array_length(S.split(text("a,,"), ",")), 3.0, None),
        (S.array_get(S.split(text("a,b"), ","), 3), None, None),
        (S.join(S.array_unique(S.split(text("b,a,b"), ",")), "+"), "b+a", None),
        (S.join(S.array_sort(S.split(text("b,a"), ",")), "+"), "a+b", None),
        (S.array_contains(S.split(text("b,a"), ","), "A"), False, None),
        (S.weekday(t), 3.0, None),
        (S.datetime_to_text(S.date_add("month", 1, t)), "2024-02-29T23:05:09.123Z", None),
        (S.datetime_to_text(S.date_add("hour", -1, t)), "2024-01-31T22:05:09.123Z", None),
        (S.date_diff("day", t, S.to_datetime("2024-01-29")), -2.0, None),
        (S.format_date(t, "DD.MM.YYYY 'at' HH:mm"), "31.01.2024 'at' 23:05", None),
        (-S.abs_(num(-3)), -3.0, None),
        (S.floor(num(-0.5)) + S.ceil(num(0.5)), 0.0, None),
    ]


def test_all(spark):
    """All in one plan; none raises."""
    made = cases()
    none = F.lit(None).cast("string")
    row = spark.range(1).select(*[F.struct(c.value.alias("v"), (none if c.error is None else c.error).alias("e")).alias(f"c{k}") for k, (c, _, _) in enumerate(made)]).collect()[0]
    for k, (_, value, error) in enumerate(made):
        got = row[k]
        assert got["e"] == error, (k, got)
        assert got["v"] == value or (isinstance(value, float) and math.isclose(got["v"], value)), (k, got, value)


def test_errors_follow_rows(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 0.0)], "a double, b double")
    ratio = col("a") / col("b")
    assert [tuple(r) for r in frame.select(ratio.value, ratio.error).collect()] == [(0.5, None), (None, "divide_by_zero"), (None, "divide_by_zero")]
