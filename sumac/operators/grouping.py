"""Row-producing groups: keys, summaries, a representative row and an identity, as rows that can be filtered, ordered and
grouped again (HAVING is a filter on them)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumac.errors import QueryError
from sumac.functions import calendar
from sumac.functions.aggregates import Part
from sumac.functions.scalar import Cell
from sumac.operators.rows import Order
from sumac.schema import REDUCTIONS, FieldSchema

#: The most keys and summaries, and the name of the groups' identity.
MOST_KEYS, MOST_SUMMARIES, IDENTITY = 20, 64, "__group_id"


@dataclass(frozen=True)
class Calendar:
    """A key that is the calendar bucket (or cycle) of a datetime field."""

    field: str
    interval: str
    zone: str = "UTC"
    every: int = 1


Key = str | Calendar


def key_column(schema: FieldSchema, key: Key) -> Column:
    name = key if isinstance(key, str) else key.field
    f = schema.field(name)
    c = F.col(f"`{f.name}`")
    if isinstance(key, str):
        if not f.may_group:
            raise QueryError("not_groupable", f.name)
        return c
    if f.kind != "datetime":
        raise QueryError("not_a_datetime", f.name)
    return calendar.bucket(c, key.interval, key.zone, key.every)


def reduction(schema: FieldSchema, op: str, field: str | None) -> Part:
    """The part of a plain summary; the field's kind must allow it."""
    if field is None:
        if op != "count":
            raise QueryError("missing_field", op)
        return Part("count")
    f = schema.field(field)
    if op not in REDUCTIONS[f.kind]:
        raise QueryError("aggregate_not_allowed", f"{op} on {f.name}")
    return Part(op, Cell(F.col(f"`{f.name}`")))


@dataclass(frozen=True)
class Summary:
    """A named column of the groups: a reduction, a formula over parts, or (``row``) a field of the representative row."""

    name: str
    part: Part | None = None
    parts: dict[str, Part] | None = None
    formula: Callable[[dict[str, Cell]], Cell] | None = None
    row: str | None = None


def groups(frame: DataFrame, schema: FieldSchema, keys: list[Key], summaries: list[Summary], representative: list[Order] | None = None) -> DataFrame:
    """One row for each tuple of keys (null, '' and 0 are keys of their own; without keys one row): the identity, the keys by
    their field names, the summaries, and for those that can fail a column ``<name>__error``.

    All summaries and the representative row come from one aggregation. The representative is the first row under the given
    order, ties going to the greater identity.
    """
    if len(keys) > MOST_KEYS or len(summaries) > MOST_SUMMARIES:
        raise QueryError("too_many_keys", f"{len(keys)} keys, {len(summaries)} summaries")
    names = [k if isinstance(k, str) else k.field for k in keys]
    if len({*names, *[s.name for s in summaries]}) != len(keys) + len(summaries):
        raise QueryError("duplicate_field", "keys and summaries need different names")
    aggs: list[Column] = []
    for s in summaries:
        for n, part in (s.parts or ({"": s.part} if s.part else {})).items():
            aggs += part.columns(f"__{s.name}_{n}")
    wanted = [s for s in summaries if s.row is not None]
    if wanted:
        if not representative and representative != []:
            raise QueryError("missing_representative", "row summaries need an order")
        aggs.append(F.min_by(F.struct(*[F.col(f"`{schema.field(s.row).name}`").alias(s.name) for s in wanted]), _first_key(schema, representative)).alias("__row"))
    made = [key_column(schema, k).alias(f"__key{i}") for i, k in enumerate(keys)]
    if made:
        grouped = frame.select("*", *made).groupBy(*[f"__key{i}" for i in range(len(keys))])
        got = grouped.agg(*aggs) if aggs else grouped.agg(F.count("*").alias("__n"))
    else:
        got = frame.agg(*(aggs or [F.count("*").alias("__n")]))
    out = [identity(names).alias(IDENTITY), *[F.col(f"__key{i}").alias(n) for i, n in enumerate(names)]]
    for s in summaries:
        if s.row is not None:
            out.append(F.col("__row")[s.name].alias(s.name))
            continue
        cells = {n: part.cell(f"__{s.name}_{n}") for n, part in (s.parts or {"": s.part}).items()}
        result = s.formula(cells) if s.formula else cells[""]
        out.append(result.value.alias(s.name))
        if result.error is not None:
            out.append(result.error.alias(f"{s.name}__error"))
    return got.select(*out)


def identity(names: list[str]) -> Column:
    """[[name, value], ...] in the order of the names, as JSON; instants in ISO form."""
    each = [F.concat(F.lit(f'["{n}",'), _json(F.col(f"__key{i}")), F.lit("]")) for i, n in sorted(enumerate(names), key=lambda x: x[1])]
    return F.concat(F.lit("["), F.concat_ws(",", *each), F.lit("]")) if each else F.lit("[]")


def _json(c: Column) -> Column:
    """One value as JSON."""
    whole = F.to_json(F.struct(c.alias("v")))  # {"v":...}, and {} for null
    return F.when(c.isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def _first_key(schema: FieldSchema, orders: list[Order]) -> Column:
    """A struct whose least value is the first row: for each term whether it is null (by placement) and the value, turned for
    descending terms; then the identity, descending."""
    out = []
    terms = [*orders, *([] if any(schema.field(o.field).name == schema.identity for o in orders) else [Order(schema.identity, descending=True)])]
    for k, o in enumerate(terms):
        f = schema.field(o.field)
        c = F.col(f"`{f.name}`")
        out.append((c.isNull() != F.lit(o.nulls_first)).alias(f"n{k}"))
        out.append((_turned(c, f.kind) if o.descending else c).alias(f"v{k}"))
    return F.struct(*out)


def _turned(c: Column, kind: str) -> Column:
    """A value that sorts the other way round."""
    if kind == "number":
        return -c
    if kind == "datetime":
        return -F.unix_micros(c)
    if kind == "bool":
        return ~c
    # bytes' complements, ended by the greatest of all: a prefix then comes after what it begins
    flip = F.translate(F.hex(c.cast("string").cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210")
    return F.concat(flip, F.lit("G"))
