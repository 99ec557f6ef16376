"""Filters: an AND of terms, each a predicate or an ``any`` of predicates or of ``all`` conjunctions, as one column.

A predicate is {"field", "op", "value", "negated"}; its value is text and is read by the field's kind. Null matches neither
a predicate nor its negation (except is_null); an empty operand means no filter but for = and != on text.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumac.errors import QueryError
from sumac.functions.operands import at_millis, instant, meet, millis, number, operand, whole_span
from sumac.schema import NULLITY, Dataset, Field, FieldSchema

#: The most predicates of one filter, and the pairs of operators that say the opposite of each other.
MOST = 100
OPPOSITES = (("=", "!="), (">", "<="), ("<", ">="), ("is_null", "is_not_null"), ("matches_regex", "not_matches_regex"))
_OPPOSITE = {x: y for pair in OPPOSITES for x, y in (pair, pair[::-1])}
#: How a column compares with a value.
COMPARED = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "contains": F.contains,
    "starts_with": F.startswith,
    "ends_with": F.endswith,
    "matches_regex": F.rlike,
    "not_matches_regex": lambda c, v: ~F.rlike(c, v),
    "length_gt": lambda c, v: F.length(c) > v,
    "length_lt": lambda c, v: F.length(c) < v,
    "length_eq": lambda c, v: F.length(c) == v,
}
_FOLDED = ("contains", "starts_with", "ends_with")


def _there(field: Field, c: Column) -> Column:
    """Not null; of text not '' either, and of arrays not empty."""
    if field.kind in ("text", "enum"):
        return c.isNotNull() & (c != "")
    return c.isNotNull() & (F.size(c) > 0) if field.kind == "textarray" else c.isNotNull()


def predicate(schema: FieldSchema, p: dict, now: datetime) -> Column:
    field, op, raw = schema.field(p["field"]), p["op"], str(p.get("value", ""))
    if op not in field.allowed:
        raise QueryError("operator_not_allowed", f"{op} on {field.name}")
    c = F.col(f"`{field.name}`")
    if op in NULLITY:
        there = _there(field, c)
        return there if (op == "is_not_null") != bool(p.get("negated")) else ~there
    if raw == "" and not (op in ("=", "!=") and field.kind in ("text", "enum")):
        return F.lit(True)
    if op == "includes":
        made = F.exists(c, lambda x: F.coalesce(x == raw if field.case_sensitive else F.lower(x) == F.lower(F.lit(raw)), F.lit(False)))
    elif op in _FOLDED:
        made = COMPARED[op](F.lower(c), F.lower(F.lit(raw)))
    else:
        made = COMPARED[op](c, F.lit(_length(field, raw) if op.startswith("length_") else operand(field.kind, raw, now, field.name)))
    return ~made & _there(field, c) if p.get("negated") else made


def _length(field: Field, raw: str) -> int:
    if not raw.isascii() or not raw.isdecimal() or (raw != "0" and raw[0] == "0"):
        raise QueryError("invalid_value", f"{field.name} takes a plain length, and {raw!r} isn't one")
    return int(raw)


def condition(schema: FieldSchema, terms: list[dict], now: datetime) -> Column:
    """The whole filter; without terms it is true."""
    literals = 0

    def one(t: dict) -> Column:
        nonlocal literals
        if "all" in t:
            return reduce(lambda a, b: a & b, [one(x) for x in t["all"]])
        literals += 1
        return predicate(schema, t, now)

    made = [reduce(lambda a, b: a | b, [one(x) for x in t["any"]]) if "any" in t else one(t) for t in terms]
    if literals > MOST:
        raise QueryError("too_many_predicates", f"{literals} of at most {MOST}")
    return reduce(lambda a, b: a & b, made, F.lit(True)) if made else F.lit(True)


def where(frame: DataFrame, schema: FieldSchema, terms: list[dict], now: datetime) -> DataFrame:
    return frame.where(condition(schema, terms, now)) if terms else frame


def pushed(data: Dataset, terms: list[dict], now: datetime) -> DataFrame:
    """The relation under what the terms say of its plain numeric, datetime and text columns, in the columns' own types, so that
    file formats can skip by it. Rows that the terms admit all pass; others may."""
    made = [c for t in terms if (c := _own(data, t, now)) is not None]
    return reduce(DataFrame.where, made, data.source)


def _own(data: Dataset, t: dict, now: datetime) -> Column | None:
    """A condition on the relation's columns that holds wherever the term does; None if nothing is known. Of alternatives each must give one."""
    for name, join, need in (("any", lambda a, b: a | b, True), ("all", lambda a, b: a & b, False)):
        if name in t:
            parts = [_own(data, x, now) for x in t[name]]
            known = [c for c in parts if c is not None]
            return reduce(join, known) if known and (len(known) == len(parts) or not need) else None
    raw, op = str(t.get("value", "")), t["op"]
    f = data.schema.field(t["field"])
    kind, c = data.source_type(f), F.col(f"`{f.name}`")
    if raw == "" or t.get("negated") or kind is None or op not in f.allowed:
        return None
    if kind == "string" and f.kind in ("text", "enum") and op == "=":
        return c == raw
    if kind == "double" and f.kind == "number" and (x := number(raw)) is not None and whole_span(op, 0):
        return COMPARED[op](c, F.lit(x))
    if kind in ("int", "bigint") and f.kind == "number" and (x := number(raw)) is not None and abs(x) < 2**31 - 1:
        return _within(c, whole_span(op, x), F.lit)
    if kind in ("timestamp", "timestamp_ntz") and f.kind == "datetime":
        at = millis(instant(raw, now, f.name))  # the field is the column's whole milliseconds
        return _within(c, whole_span(op, at), lambda ms: F.lit(at_millis(ms) if kind == "timestamp" else at_millis(ms).astimezone(UTC).replace(tzinfo=None)))
    return None


def _within(c: Column, span: tuple[int | None, int | None] | None, literal) -> Column | None:
    ends = [] if span is None else [f(c, literal(x)) for f, x in zip((COMPARED[">="], COMPARED["<"]), span, strict=True) if x is not None]
    return reduce(lambda a, b: a & b, ends) if ends else None


def of_dataset(data: Dataset, terms: list[dict], now: datetime) -> DataFrame:
    """A dataset's rows under a filter: what the relation can be asked itself is asked first; the filter then decides."""
    return where(data.over(pushed(data, terms, now)).rows, data.schema, terms, now)


def date_bounds(schema: FieldSchema, terms: list[dict], field: str, now: datetime) -> tuple[datetime | None, datetime | None]:
    """[lower, upper) of a datetime field by the filter's own predicates; alternatives and negations never bound it."""
    spans = (whole_span(t["op"], millis(instant(t["value"], now, t["field"]))) for t in _plain(terms) if schema.field(t["field"]) is schema.field(field) and whole_span(t["op"], 0))
    low, high = reduce(meet, spans, (None, None))
    return None if low is None else at_millis(low), None if high is None else at_millis(high)


def _plain(terms: list[dict]) -> Iterator[dict]:
    """The terms that are single predicates, not negated and with a value."""
    return (t for t in terms if "any" not in t and "all" not in t and not t.get("negated") and t.get("value"))


def negated(p: dict, allowed: tuple[str, ...] | None = None) -> dict:
    """The predicate's negation: by the operator that says the opposite where there is one that is allowed, else by the flag."""
    flagged = bool(p.get("negated"))
    bare = {k: p.get(k, "") for k in ("field", "op", "value")}
    # a length over 0 and a length of 0 are opposites too, as no length is under 0
    empty = {"length_gt": "length_eq", "length_eq": "length_gt"} if bare["value"] == "0" and not flagged else {}
    for other in (empty.get(p["op"]), _OPPOSITE.get(p["op"])):
        if other and (allowed is None or other in allowed):
            return bare | {"op": other}
    return bare if flagged else bare | {"negated": True}


def _either_null_or(terms: list[dict], field: str) -> list[dict]:
    return [{"any": [{"field": field, "op": "is_null", "value": ""}, t]} for t in terms]


#: What each mode of a set filter makes of (field, wanted members, the predicates that exclude them).
_SETS = {
    "any": lambda field, wanted, unwanted: [{"any": wanted}] if wanted else [],
    "all": lambda field, wanted, unwanted: wanted,
    "none": lambda field, wanted, unwanted: _either_null_or(unwanted, field),
    "empty": lambda field, wanted, unwanted: [{"field": field, "op": "is_null", "value": ""}],
}


def set_filter(field: Field, mode: str, values: list[str]) -> list[dict]:
    """any, all, none and empty of an array's members; any and none of a single value, where none keeps nulls."""
    has = "includes" if field.kind == "textarray" else "="
    if mode not in _SETS or (has == "=" and mode in ("all", "empty")):
        raise QueryError("invalid_set_mode", f"{mode} on {field.name}")
    wanted = [{"field": field.name, "op": has, "value": v} for v in dict.fromkeys(values)]
    return _SETS[mode](field.name, wanted, [negated(p, field.allowed) for p in wanted])


def related(frame: DataFrame, key: str, relation: DataFrame, relation_key: str, keep: bool = True) -> DataFrame:
    """The rows whose key the host's relation has (or hasn't: a null key is in neither)."""
    ids = relation.select(F.col(f"`{relation_key}`").alias("related")).where("related is not null")
    c = F.col(f"`{key}`")
    return frame.where(c.isNotNull()).join(ids, c == ids["related"], "left_semi" if keep else "left_anti")
