"""Declared schemas over one DataFrame: which fields there are, what they read, and what may be done with them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumac.errors import QueryError

#: The six kinds of field, as Spark types, with the filters and reductions that each allows.
SPARK_TYPE = {"text": "string", "enum": "string", "number": "double", "datetime": "timestamp", "bool": "boolean", "textarray": "array<string>"}
NULLITY = ("is_null", "is_not_null")
FILTERS = {
    "text": ("=", "!=", "contains", "starts_with", "ends_with", "matches_regex", "not_matches_regex", "length_gt", "length_lt", "length_eq", *NULLITY),
    "enum": ("=", "!=", *NULLITY),
    "number": ("=", "!=", ">", ">=", "<", "<=", *NULLITY),
    "datetime": ("=", "!=", ">", ">=", "<", "<=", *NULLITY),
    "bool": ("=", "!=", *NULLITY),
    "textarray": ("includes", *NULLITY),
}
REDUCTIONS = {
    "number": ("count", "count_distinct", "sum", "avg", "min", "max"),
    "datetime": ("count", "count_distinct", "min", "max"),
    "enum": ("count", "count_distinct", "min", "max"),
    "text": ("count", "count_distinct", "min", "max"),
    "bool": ("count", "count_distinct"),
    "textarray": ("count",),
}
GROUPABLE = ("enum", "text", "bool")


@dataclass(frozen=True)
class Field:
    """One field. ``source`` is a Spark SQL expression over the relation (default: the column of that name; struct paths are
    written ``a.b``); it is trusted configuration, never text of a request."""

    name: str
    kind: str
    source: str | None = None
    aliases: tuple[str, ...] = ()
    filters: tuple[str, ...] | None = None
    groupable: bool | None = None
    sortable: bool = True
    sort_as: str | None = None
    case_sensitive: bool = False

    def __post_init__(self) -> None:
        if self.kind not in SPARK_TYPE:
            raise QueryError("unknown_type", f"{self.name} has kind {self.kind}")

    @property
    def allowed(self) -> tuple[str, ...]:
        return self.filters or FILTERS[self.kind]

    @property
    def may_group(self) -> bool:
        return self.kind in GROUPABLE if self.groupable is None else self.groupable

    def column(self, whole: bool = False) -> Column:
        """The field over the relation, in its Spark type; numbers that aren't finite are null (``whole``: all are), timestamps are
        whole milliseconds."""
        raw = F.expr(self.source if self.source is not None else f"`{self.name}`")
        value = raw.cast(SPARK_TYPE[self.kind])
        if self.kind == "number" and not whole:
            value = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
        if self.kind == "datetime":
            value = F.date_trunc("millisecond", value)
        return value.alias(self.name)


@dataclass(frozen=True)
class FieldSchema:
    """The fields of a dataset; ``identity`` names the one that is unique and never null."""

    fields: tuple[Field, ...]
    identity: str
    default_order: tuple[tuple, ...] = ()

    @cached_property
    def _by_name(self) -> dict[str, Field]:
        return {f.name: f for f in self.fields}

    def field(self, token: str) -> Field:
        """By exact name, then by name in any case, then by alias."""
        if token in self._by_name:
            return self._by_name[token]
        low = token.lower()
        for match in (lambda f: f.name.lower() == low, lambda f: low in [a.lower() for a in f.aliases]):
            for f in self.fields:
                if match(f):
                    return f
        raise QueryError("unknown_field", token)


@dataclass(frozen=True)
class Dataset:
    """A schema bound to any DataFrame, joins and all; ``rows`` is lazy and only reads the columns that a query uses."""

    schema: FieldSchema
    source: DataFrame
    #: Computed fields, as (Field, Cell) in an order in which each uses earlier ones only.
    computed: tuple = ()

    @cached_property
    def rows(self) -> DataFrame:
        made = {f.name for f, _ in self.computed}
        frame = self.source.select(*[f.column(self.source_type(f) in ("tinyint", "smallint", "int", "bigint")) for f in self.schema.fields if f.name not in made])
        for f, cell in self.computed:
            error = F.lit(None).cast("string") if cell.error is None else cell.error
            frame = frame.withColumns({f.name: cell.value.cast(SPARK_TYPE[f.kind]), f"{f.name}__error": error})
        return frame

    def source_type(self, f: Field) -> str | None:
        """The type of the relation's column that the field is, if it is one."""
        return None if f.source is not None else dict(self.source.dtypes).get(f.name)

    def over(self, source: DataFrame) -> Dataset:
        return Dataset(self.schema, source, self.computed)

    def with_computed(self, name: str, kind: str, cell, groupable: bool = True) -> Dataset:
        """A dataset with one more field, whose cell may use all earlier ones."""
        f = Field(name, kind, groupable=groupable)
        if any(g.name == name for g in self.schema.fields):
            raise QueryError("duplicate_field", name)
        return Dataset(FieldSchema((*self.schema.fields, f), self.schema.identity, self.schema.default_order), self.source, (*self.computed, (f, cell)))

    def hold_to(self, most: int) -> Dataset:
        """This dataset, if it has at most so many rows; no more than that and one are counted."""
        if self.source.limit(most + 1).count() > most:
            raise QueryError("resource_limit", f"more than {most} rows")
        return self

    def identity_is_sound(self) -> DataFrame:
        """One row: rows, ids, and whether every id is there and unique."""
        key = F.col(f"`{self.schema.identity}`")
        got = self.rows.groupBy(key.alias("id")).count().agg(F.sum("count").alias("rows"), F.count("id").alias("ids"), F.coalesce(F.max(F.when(F.col("id").isNull(), 0).otherwise(F.col("count"))) <= 1, F.lit(True)).alias("one"))
        return got.select(F.coalesce("rows", F.lit(0)).alias("rows"), "ids", (F.col("one") & (F.coalesce("rows", F.lit(0)) == F.col("ids"))).alias("sound"))
