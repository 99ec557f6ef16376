"""Whole requests as plain dictionaries: rows, groups, metrics and distinct values of one dataset, with the names that a JSON
body would have. Formulas are the host's functions of parts, by name; a request never carries code."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumac.errors import QueryError
from sumac.functions.aggregates import Part
from sumac.functions.calendar import CYCLES
from sumac.functions.scalar import col
from sumac.operators import distributions, filters, grouping, rows, series
from sumac.operators.grouping import IDENTITY, Calendar, Summary, reduction
from sumac.operators.metrics import Fill, Interval, Metric, Result, Sort, Trailing, evaluate, population
from sumac.operators.rows import Order
from sumac.schema import Dataset, Field, FieldSchema

_ALLOWED = {"source", "result", "grouping", "metrics", "distinct", "rows", "now"}
#: The most metrics of a request, and a page's size where it names none.
MOST_METRICS, PAGE = 20, 25


@dataclass(frozen=True)
class Answer:
    """Lazy frames: the page and its total, a result or an error code for each metric, distinct values."""

    page: DataFrame | None = None
    total: DataFrame | None = None
    metrics: dict[str, Result | DataFrame | QueryError] = field(default_factory=dict)
    distinct: DataFrame | None = None
    has_more: DataFrame | None = None
    has_null: DataFrame | None = None


def run(data: Dataset, request: dict, formulas: dict[str, tuple[dict[str, Part], object]] | None = None) -> Answer:
    """The request's answer. A metric that is refused holds its QueryError; the others are not affected."""
    if unknown := set(request) - _ALLOWED:
        raise QueryError("unknown_key", ", ".join(sorted(unknown)))
    now = datetime.fromtimestamp(request["now"] / 1000, UTC) if "now" in request else datetime.now(UTC)
    source, formulas = request.get("source", {}), formulas or {}
    frame, schema = filters.of_dataset(data, source.get("where", []), now), data.schema
    if d := request.get("distinct"):
        terms = (frame, schema, d["field"], d.get("search", ""), d.get("limit", 50))
        return Answer(distinct=rows.distinct_values(*terms), has_more=rows.has_more(*terms), has_null=rows.has_null(*terms[:3]))
    view = source
    if g := request.get("grouping"):
        frame, schema = _grouped(frame, schema, g, formulas)
        view = request.get("result", {})
        frame = filters.where(frame, schema, view.get("where", []), now)
    orders = [_order(o) for o in view.get("orderBy", [])]
    select = view.get("select") or [f.name for f in schema.fields]
    page = rows.page(frame, schema, [f.name for f in schema.fields], orders, view.get("limit", PAGE), view.get("offset", 0))
    out: dict = {}
    specs = request.get("metrics", [])
    if len(specs) > MOST_METRICS:
        raise QueryError("too_many_metrics", str(len(specs)))
    for spec in specs:
        try:
            out[spec["id"]] = _metric(page if spec.get("scope") == "shownRows" else frame, schema, spec, formulas, view.get("where", []), now)
        except QueryError as e:
            out[spec["id"]] = e
    names = list(dict.fromkeys([*[schema.field(s).name for s in select], schema.identity]))
    wanted = request.get("rows", True)
    return Answer(page.select(*[f"`{n}`" for n in names]) if wanted else None, rows.total(frame) if wanted else None, out)


def _order(o: dict) -> Order:
    return Order(o["field"], o.get("dir") == "desc", o.get("nulls") == "first", (o.get("extract") or {}).get("regex"))


def _key(k) -> str | Calendar:
    return k if isinstance(k, str) else Calendar(k["field"], k["interval"], k.get("timeZone", "UTC"), k.get("every", 1))


def _grouped(frame: DataFrame, schema: FieldSchema, g: dict, formulas: dict) -> tuple[DataFrame, FieldSchema]:
    keys, made, fields = [_key(k) for k in g.get("keys", [])], [], [Field(IDENTITY, "text", groupable=False)]
    for k in keys:
        f = schema.field(k if isinstance(k, str) else k.field)
        fields.append(Field(f.name, f.kind, groupable=True))
    for s in g.get("summaries", []):
        if s["op"] == "row":
            made.append(Summary(s["id"], row=schema.field(s["field"]).name))
            fields.append(Field(s["id"], schema.field(s["field"]).kind))
        elif s["op"] == "formula":
            parts, formula = _formula(formulas, s["expression"])
            made.append(Summary(s["id"], parts=parts, formula=formula))
            fields.append(Field(s["id"], "number"))
        else:
            made.append(Summary(s["id"], reduction(schema, s["op"], s.get("field"))))
            fields.append(Field(s["id"], schema.field(s["field"]).kind if s["op"] in ("min", "max") else "number"))
    first = [_order(o) for o in (g.get("representative") or {}).get("orderBy", [])] if g.get("representative") else None
    return grouping.groups(frame, schema, keys, made, first), FieldSchema(tuple(fields), IDENTITY)


def _formula(formulas: dict, name: str) -> tuple[dict[str, Part], object]:
    if name not in formulas:
        raise QueryError("unknown_formula", name)
    return formulas[name]


def _fill(schema: FieldSchema, dates: dict, terms: list[dict], now: datetime) -> Fill:
    """The range of empty buckets: as observed, custom, or what the filters bound (both ends must be)."""
    if dates["interval"] in CYCLES or dates.get("range", "query") == "observed":
        return Fill()
    if dates.get("range") == "custom":
        ends = tuple(filters.instant(dates[k], now) if dates.get(k) else None for k in ("start", "end"))
    else:
        ends = filters.date_bounds(schema, terms, dates["field"], now)
    if None in ends:
        raise QueryError("unbounded_range", dates["field"])
    return Fill(*ends)


def _metric(frame: DataFrame, schema: FieldSchema, spec: dict, formulas: dict, terms: list[dict], now: datetime) -> Result | DataFrame:
    keys = [_key(k) for k in spec.get("groupBy", [])]
    dates, fill = spec.get("dateGrouping"), None
    if dates:
        keys[0] = _key(dates)
        if dates.get("includeEmpty"):
            fill = _fill(schema, dates, [*terms, *spec.get("where", [])], now)
    where = tuple(spec.get("where", []))
    occurring = bool(dates and dates.get("occurrence"))
    whole = occurring or bool(dates and dates.get("partialIntervals") == "exclude")
    d = spec.get("distribution")
    if d and not (occurring and d["kind"] == "box"):
        if whole:
            raise QueryError("invalid_range", "whole intervals of a distribution")
        return _distribution(frame, schema, d, tuple(keys), where, now)
    if occurring and spec.get("window"):
        raise QueryError("invalid_occurrence", "occurrences have no window")
    y = None
    if "expression" in spec:
        parts, value = _formula(formulas, spec["expression"])
        if "expressionY" in spec:
            more, y = _formula(formulas, spec["expressionY"])
            parts = parts | more
    else:
        parts, value = {"m": reduction(schema, spec["op"], spec.get("field"))}, None
    least = spec.get("minCount")
    if isinstance(least, dict):
        kind = "distinct" if "distinct" in least else "sum"
        least = (kind, least[kind], least["min"])
    sort = tuple(Sort(s["key"], s.get("dir") == "desc", s.get("nulls") == "first") for s in spec.get("sort", []))
    i = spec.get("interval")
    interval = Interval(i["kind"], i["numerator"], i["denominator"], i.get("level", 0.95), i.get("scale", 1.0)) if i else None
    w = spec.get("window")
    trailing = Trailing(None if w["periods"] == "all" else w["periods"], w.get("reduce", "total"), w.get("partial") == "include") if w else None
    m = Metric(parts, value, y, tuple(keys), where, least, sort, spec.get("groupLimit"), bool(spec.get("other")), fill, interval, trailing, spec.get("share"))
    if fill is not None and fill.start is not None and dates.get("range") == "custom":
        _covered(frame, schema, m, now)
    if not whole:
        return evaluate(frame, schema, m, now)
    ends = filters.date_bounds(schema, [*terms, *where], dates["field"], now)
    if None in ends:
        raise QueryError("unbounded_range", dates["field"])
    if occurring:
        every = series.bounded(replace(m, group_by=(series.unit_of(keys[0]), *keys[1:])), *ends, now)
        m = replace(every, group_by=m.group_by, fill=every.fill if dates["occurrence"].get("includeEmpty") else None)
        if d:
            return series.occurrence_box(frame, schema, m, distributions.Box(d.get("whiskers", "minmax"), tuple(d.get("whiskerProbabilities", (0.1, 0.9)))), now)
        return series.occurrences(frame, schema, m, now=now)
    made = series.bounded(m, *ends, now)
    return evaluate(frame, schema, made if fill is not None else replace(made, fill=None), now)


def _distribution(frame: DataFrame, schema: FieldSchema, d: dict, keys: tuple, where: tuple[dict, ...], now: datetime) -> DataFrame:
    x = col(schema.field(d["input"]).name)
    if d["kind"] == "box":
        return distributions.box(frame, schema, x, keys, distributions.Box(d.get("whiskers", "minmax"), tuple(d.get("whiskerProbabilities", (0.1, 0.9)))), where, now)
    if d["kind"] == "histogram":
        return distributions.histogram(frame, schema, x, keys, d.get("bins", 10), where, now)
    return distributions.quantiles(frame, schema, x, d["probabilities"], keys, where, now)


def _covered(frame: DataFrame, schema: FieldSchema, m: Metric, now: datetime) -> None:
    """A custom range must hold every observed bucket; this looks for one row outside."""
    f = schema.field(m.group_by[0].field).name
    at = F.col(f"`{f}`")
    outside = population(frame, schema, m.where, now).where((at < F.lit(m.fill.start)) | (at >= F.lit(m.fill.end)))
    if not outside.isEmpty():
        raise QueryError("invalid_range", f"rows of {f} lie outside the custom range")
