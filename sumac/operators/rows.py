"""Row queries: order, pages with totals, lookup by identity, field statistics, distinct values and previews."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumac.errors import QueryError
from sumac.operators.filters import of_dataset
from sumac.schema import Dataset, FieldSchema

#: The most order terms and the furthest offset.
MOST_ORDERS, FURTHEST = 20, 1_000_000


@dataclass(frozen=True)
class Order:
    """One order term; ``extract`` sorts by a regular expression's first group (or its match; null where it has none)."""

    field: str
    descending: bool = False
    nulls_first: bool = False
    extract: str | None = None

    def column(self, c: Column) -> Column:
        if self.extract is not None:
            group = 1 if _groups(self.extract) else 0
            c = F.when(c.rlike(self.extract), F.regexp_extract(c, self.extract, group))
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def order_by(schema: FieldSchema, orders: list[Order]) -> list[Column]:
    """The columns to sort by: the terms (or the schema's default order), then the identity, ascending."""
    if len(orders) > MOST_ORDERS:
        raise QueryError("too_many_orders", str(len(orders)))
    terms = orders or [Order(*t) for t in schema.default_order]
    out, seen = [], set()
    for t in terms:
        f = schema.field(t.field)
        if not f.sortable:
            raise QueryError("not_sortable", f.name)
        name = f.sort_as or f.name
        seen.add(name if t.extract is None else None)
        out.append(t.column(F.col(f"`{name}`")))
    if schema.identity not in seen:
        out.append(F.col(f"`{schema.identity}`").asc_nulls_last())
    return out


def page(frame: DataFrame, schema: FieldSchema, select: list[str], orders: list[Order], limit: int, offset: int = 0) -> DataFrame:
    """The page's rows in order: the selected fields and the identity. Spark keeps only offset + limit rows of each task."""
    if not 0 <= offset <= FURTHEST or limit < 0:
        raise QueryError("invalid_page", f"{offset}, {limit}")
    names = list(dict.fromkeys([schema.field(s).name for s in select] + [schema.identity]))
    return frame.orderBy(*order_by(schema, orders)).offset(offset).limit(limit).select(*[F.col(f"`{n}`") for n in names])


def total(frame: DataFrame) -> DataFrame:
    return frame.agg(F.count("*").alias("total"))


def lookup(data: Dataset, value: str | int, now: datetime | None = None) -> DataFrame:
    """The row of that identity; two rows show that it isn't unique. The relation is asked for it in its own type."""
    return of_dataset(data, [{"field": data.schema.identity, "op": "=", "value": str(value)}], now or datetime.now(UTC)).limit(2)


def field_stats(frame: DataFrame, schema: FieldSchema, fields: list[str]) -> DataFrame:
    """(field, distinct_values, least, greatest, nulls) of each field, in one pass; least and greatest as text."""
    known = [schema.field(f) for f in fields]
    aggs = []
    for k, f in enumerate(known):
        c = F.col(f"`{f.name}`")
        ordered = f.kind in ("number", "datetime", "text", "enum")
        aggs += [F.count_distinct(c).alias(f"d{k}"), F.count_if(c.isNull()).alias(f"n{k}")]
        aggs += [(F.min(c) if ordered else F.lit(None)).cast("string").alias(f"l{k}"), (F.max(c) if ordered else F.lit(None)).cast("string").alias(f"g{k}")]
    one = frame.agg(*aggs)
    each = [F.struct(F.lit(f.name).alias("field"), F.col(f"d{k}").alias("distinct_values"), F.col(f"l{k}").alias("least"), F.col(f"g{k}").alias("greatest"), F.col(f"n{k}").alias("nulls")) for k, f in enumerate(known)]
    return one.select(F.explode(F.array(*each)).alias("s")).select("s.*")


def distinct_values(frame: DataFrame, schema: FieldSchema, field: str, search: str = "", limit: int = 50) -> DataFrame:
    """(value, rows) of the commonest values that contain the text in any case, then by value; an array counts by its members.

    Values are grouped before they are searched, so that each distinct one is compared once.
    """
    f = schema.field(field)
    c = F.col(f"`{f.name}`")
    values = frame.select((F.explode(c) if f.kind == "textarray" else c).alias("value")).where(F.col("value").isNotNull())
    counted = values.groupBy("value").agg(F.count("*").alias("rows"))
    if search:
        counted = counted.where(F.lower(F.col("value").cast("string")).contains(search.lower()))
    return counted.orderBy(F.desc("rows"), F.asc("value")).limit(limit)


def has_more(frame: DataFrame, schema: FieldSchema, field: str, search: str = "", limit: int = 50) -> DataFrame:
    """One row: whether distinct_values() under these terms leaves values out. No more than limit + 1 of them are gathered."""
    return distinct_values(frame, schema, field, search, limit + 1).agg((F.count("*") > limit).alias("has_more"))


def has_null(frame: DataFrame, schema: FieldSchema, field: str) -> DataFrame:
    """One row: whether any row has no value there, whatever is searched for."""
    f = schema.field(field)
    c = F.col(f"`{f.name}`")
    none = c.isNull() | (F.size(c) == 0) if f.kind == "textarray" else c.isNull()
    return frame.agg(F.coalesce(F.bool_or(none), F.lit(False)).alias("has_null"))


def preview(data: Dataset, inputs: list[str], computed: str, most: int | None = None) -> DataFrame:
    """(inputs, value, error, rows): how often a computed field takes which value, the commonest first. ``most``: of no more rows than that."""
    names = [data.schema.field(i).name for i in inputs]
    rows = data.rows if most is None else data.rows.limit(most)
    got = rows.groupBy(*[F.col(f"`{n}`") for n in names], F.col(f"`{computed}`").alias("value"), F.col(f"`{computed}__error`").alias("error"))
    return got.agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), *[F.asc(F.col(f"`{n}`")) for n in names])


def preview_facts(shown: DataFrame) -> DataFrame:
    """One row of a preview: how many rows it counts, and for how many the value is null or an error."""
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("rows"))), F.lit(0))
    failed = F.col("error").isNotNull()
    return shown.agg(of(F.lit(True)).alias("processed"), of(~failed & F.col("value").isNull()).alias("nulls"), of(failed).alias("errors"))
