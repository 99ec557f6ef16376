from datetime import UTC, datetime

import pytest

from sumac.errors import QueryError
from sumac.functions.aggregates import count, sum_
from sumac.functions.scalar import col, nullif
from sumac.operators import requests, rows
from sumac.sources.tables import dataset

NOW = int(datetime(2024, 1, 20, tzinfo=UTC).timestamp() * 1000)


@pytest.fixture(scope="module")
def formulas(spark):
    return {"mean": ({"s": sum_(col("value")), "n": count()}, lambda p: p["s"] / nullif(p["n"], 0))}


def test_rows_and_metrics(spark, sf, formulas):
    data = dataset(spark, sf, "events")
    request = {
        "now": NOW,
        "source": {"where": [{"field": "ts", "op": ">=", "value": "-5d"}, {"field": "value", "op": ">", "value": "0"}], "orderBy": [{"field": "value", "dir": "desc"}], "select": ["event_type", "value"], "limit": 10},
        "metrics": [
            {"id": "n", "op": "count", "groupBy": ["event_type"]},
            {"id": "mean", "op": "count", "expression": "mean", "groupBy": ["event_type"], "sort": [{"key": "group0", "dir": "asc"}]},
            {"id": "shown", "op": "count", "scope": "shownRows", "groupBy": []},
            {"id": "days", "op": "sum", "field": "value", "groupBy": ["ts"], "dateGrouping": {"field": "ts", "interval": "day", "includeEmpty": True, "range": "observed"}},
            {"id": "span", "op": "count", "groupBy": ["ts"], "where": [{"field": "ts", "op": "<", "value": "+3d"}], "dateGrouping": {"field": "ts", "interval": "day", "includeEmpty": True, "range": "query"}},
            {"id": "open", "op": "count", "groupBy": ["ts"], "dateGrouping": {"field": "ts", "interval": "day", "includeEmpty": True, "range": "query"}},
            {"id": "box", "op": "count", "groupBy": ["event_type"], "distribution": {"kind": "box", "input": "value", "whiskers": "tukey"}},
            {"id": "bad", "op": "sum", "field": "event_type", "groupBy": []},
            {"id": "worse", "op": "count", "expression": "nothing", "groupBy": []},
        ],
    }
    got = requests.run(data, request, formulas)
    rows = data.source.where("ts >= timestamp'2024-01-15' and value > 0")
    assert got.total.collect()[0][0] == rows.count()
    assert [r["value"] for r in got.page.collect()] == [r["value"] for r in rows.orderBy(rows.value.desc(), "event_id").limit(10).collect()]
    assert got.page.columns == ["event_type", "value", "event_id"]
    assert {r["group0"]: int(r["value"]) for r in got.metrics["n"].buckets.collect()} == {r["event_type"]: r["count"] for r in rows.groupBy("event_type").count().collect()}
    assert got.metrics["shown"].buckets.collect()[0]["value"] == 10
    assert got.metrics["days"].buckets.count() >= 5 and got.metrics["box"].count() == 5
    assert got.metrics["span"].buckets.count() == 8 and got.metrics["open"].code == "unbounded_range"
    assert got.metrics["bad"].code == "aggregate_not_allowed" and got.metrics["worse"].code == "unknown_formula"


def test_groups(spark, sf, formulas):
    data = dataset(spark, sf, "events")
    request = {
        "now": NOW,
        "grouping": {
            "keys": ["event_type", {"field": "ts", "interval": "month"}],
            "summaries": [{"id": "n", "op": "count"}, {"id": "last", "op": "row", "field": "event_id"}, {"id": "mean", "op": "formula", "expression": "mean"}],
            "representative": {"orderBy": [{"field": "ts", "dir": "desc"}]},
        },
        "result": {"where": [{"field": "n", "op": ">=", "value": "10"}], "orderBy": [{"field": "n", "dir": "desc"}], "limit": 3},
        "metrics": [{"id": "all", "op": "sum", "field": "n", "groupBy": []}],
    }
    got = requests.run(data, request, formulas)
    page = got.page.collect()
    assert len(page) == 3 and page[0]["n"] >= page[1]["n"] and all(r["last"] is not None for r in page)
    assert got.metrics["all"].buckets.collect()[0]["value"] == data.rows.count()


def test_distinct_and_refusals(spark, sf):
    data = dataset(spark, sf, "part")
    got = requests.run(data, {"distinct": {"field": "words", "search": "st", "limit": 3}}).distinct.collect()
    assert len(got) <= 3 and all("st" in r["value"].lower() for r in got)
    with pytest.raises(QueryError):
        requests.run(data, {"drop": True})
    with pytest.raises(QueryError):
        requests.run(data, {"metrics": [{"id": str(k), "op": "count"} for k in range(21)]})


def test_windows_shares_and_whole_intervals(spark, sf):
    data = dataset(spark, sf, "events")
    days = {"field": "ts", "interval": "day", "includeEmpty": True, "range": "query"}
    span = [{"field": "ts", "op": ">=", "value": "2024-01-03T12:00:00Z"}, {"field": "ts", "op": "<", "value": "2024-01-17T06:00:00Z"}]
    slot = {"field": "ts", "interval": "dayOfWeek", "occurrence": {"interval": "day", "includeEmpty": True}}
    request = {
        "now": NOW, "source": {"where": span},
        "metrics": [
            {"id": "trail", "op": "count", "groupBy": ["ts"], "dateGrouping": days, "window": {"periods": 3}},
            {"id": "run", "op": "count", "groupBy": ["ts"], "dateGrouping": days, "window": {"periods": "all", "partial": "include"}},
            {"id": "share", "op": "count", "groupBy": ["event_type"], "share": "total"},
            {"id": "whole", "op": "count", "groupBy": ["ts"], "dateGrouping": {"field": "ts", "interval": "day", "partialIntervals": "exclude"}},
            {"id": "slots", "op": "count", "groupBy": ["ts"], "dateGrouping": slot},
            {"id": "boxes", "op": "count", "groupBy": ["ts"], "dateGrouping": slot, "distribution": {"kind": "box", "input": "value"}},
            {"id": "narrow", "op": "count", "groupBy": ["ts"], "dateGrouping": days | {"range": "custom", "start": "2024-01-05", "end": "2024-01-08"}},
            {"id": "wide", "op": "count", "groupBy": ["ts"], "dateGrouping": days | {"range": "custom", "start": "2024-01-01", "end": "2024-02-01"}},
        ],
    }
    got = requests.run(data, request).metrics
    rows = [r["ts"] for r in data.rows.select("ts").collect() if datetime(2024, 1, 3, 12) <= r["ts"] < datetime(2024, 1, 17, 6)]
    by_day = {d: sum(t.day == d for t in rows) for d in range(3, 18)}
    trail = [r["value"] for r in got["trail"].buckets.orderBy("group0").collect()]
    assert trail[:2] == [None, None] and trail[2:] == [by_day[d] + by_day[d - 1] + by_day[d - 2] for d in range(5, 18)]
    assert max(r["value"] for r in got["run"].buckets.collect()) == len(rows)
    assert abs(sum(r["value"] for r in got["share"].buckets.collect()) - 1) < 1e-12
    assert sorted(r["value"] for r in got["whole"].buckets.collect()) == sorted(by_day[d] for d in range(4, 17) if by_day[d])
    monday = [by_day[d] for d in (8, 15)]
    slots = {r["group0"]: r for r in got["slots"].collect()}
    assert slots[1.0]["value"] == sum(monday) / 2 and slots[1.0]["occurrences"] == 2 and len(slots) == 7
    assert {r["group0"]: (r["min"], r["max"]) for r in got["boxes"].collect()}[1.0] == (min(monday), max(monday))
    assert got["narrow"].code == "invalid_range" and got["wide"].buckets.count() == 31


def test_more_and_previews(spark, sf):
    data = dataset(spark, sf, "part")
    got = requests.run(data, {"distinct": {"field": "p_brand", "limit": 3}})
    assert got.distinct.count() == 3 and got.has_more.collect()[0][0] and not got.has_null.collect()[0][0]
    assert not requests.run(data, {"distinct": {"field": "p_brand", "limit": 1000}}).has_more.collect()[0][0]
    events = dataset(spark, sf, "events").with_computed("r", "number", nullif(col("value") / (col("user_id") % 5), 10**9))
    shown = rows.preview(events, ["event_type"], "r", most=50)
    facts = rows.preview_facts(shown).collect()[0]
    assert facts["processed"] == 50 == sum(r["rows"] for r in shown.collect()) and facts["errors"] > 0 == facts["nulls"]
