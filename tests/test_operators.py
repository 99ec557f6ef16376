from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sumac.errors import QueryError
from sumac.functions.operands import meet, operand, whole_span
from sumac.functions import scalar as S
from sumac.functions.aggregates import avg, count, count_distinct, max_, median, percentile, sum_
from sumac.functions.scalar import col
from sumac.functions.stats import gamma_quantile, gamma_share
from sumac.operators import distributions, filters, grouping, rows, series
from sumac.operators.grouping import Calendar, Summary
from sumac.operators.metrics import Fill, Interval, Metric, Sort, Trailing, bucket_rows, dashboard, evaluate
from sumac.operators.rows import Order
from sumac.schema import Dataset, Field, FieldSchema

NOW = datetime(2025, 6, 10, tzinfo=UTC)
SCHEMA = FieldSchema(
    (
        Field("id", "text", groupable=False), Field("shop", "text", aliases=("store",)), Field("state", "enum"), Field("price", "number", groupable=True), Field("at", "datetime", groupable=True),
        Field("who", "text"), Field("tags", "textarray"), Field("paid", "bool"),
    ),
    "id",
)
ROWS = [
    ("01", "north", "open", 10.0, "2025-06-01 10:00:00", "ann", ["red", "Blue"], True),
    ("02", "north", "open", 30.0, "2025-06-01 23:30:00", "ann", ["red"], False),
    ("03", "north", "done", None, "2025-06-03 09:00:00", "bob", [], None),
    ("04", "south", "done", 20.0, "2025-06-03 12:00:00", "bob", None, True),
    ("05", "south", "open", 200.0, None, "cid", ["BLUE"], False),
    ("06", None, "open", 5.0, "2025-06-05 00:00:00", None, ["green"], True),
    ("07", "", None, 0.0, "2025-06-08 15:00:00", "ann", ["red", None], None),
]


@pytest.fixture(scope="module")
def data(spark):
    frame = spark.createDataFrame(ROWS, "id string, shop string, state string, price double, at string, who string, tags array<string>, paid boolean")
    return Dataset(SCHEMA, frame.withColumn("at", F.col("at").cast("timestamp")))


def ids(frame):
    return sorted(r["id"] for r in frame.collect())


def p(field, op, value="", **more):
    return {"field": field, "op": op, "value": value} | more


FILTERS = [
    ([p("shop", "=", "north")], "01 02 03"),
    ([p("STORE", "!=", "north")], "04 05 07"),
    ([p("shop", "=", "")], "07"),
    ([p("shop", "is_null")], "06 07"),
    ([p("tags", "is_null")], "03 04"),
    ([p("tags", "is_not_null", negated=True)], "03 04"),
    ([p("tags", "includes", "blue")], "01 05"),
    ([p("tags", "includes", "red", negated=True)], "05 06"),
    ([p("price", ">=", "20")], "02 04 05"),
    ([p("price", ">=", "")], "01 02 03 04 05 06 07"),
    ([p("shop", "contains", "OR", negated=True)], "04 05"),
    ([p("who", "length_eq", "3"), p("shop", "length_lt", "1")], "07"),
    ([p("shop", "matches_regex", "^n.*h$")], "01 02 03"),
    ([p("shop", "not_matches_regex", "^n")], "04 05 07"),
    ([p("paid", "=", "T")], "01 04 06"),
    ([p("at", ">=", "-7d"), p("at", "<", "2025-06-08")], "03 04 06"),
    ([{"any": [p("shop", "=", "south"), {"all": [p("state", "=", "open"), p("price", "<", "10")]}]}], "04 05 06"),
]


@pytest.mark.parametrize("terms, expected", FILTERS, ids=str)
def test_filters(data, terms, expected):
    assert ids(filters.where(data.rows, SCHEMA, terms, NOW)) == expected.split()


def test_set_filters_and_negation(data):
    tags, shop = SCHEMA.field("tags"), SCHEMA.field("shop")
    got = lambda f, mode, values: ids(filters.where(data.rows, SCHEMA, filters.set_filter(f, mode, values), NOW))
    assert got(tags, "any", ["red", "green"]) == ["01", "02", "06", "07"]
    assert got(tags, "all", ["red", "blue"]) == ["01"]
    assert got(tags, "none", ["red", "blue"]) == ["03", "04", "06"]
    assert got(tags, "empty", []) == ["03", "04"]
    assert got(shop, "none", ["north"]) == ["04", "05", "06", "07"]
    assert filters.negated(p("price", ">", "3")) == p("price", "<=", "3")
    assert filters.negated(p("shop", "length_gt", "0")) == p("shop", "length_eq", "0")
    assert filters.negated(filters.negated(p("shop", "contains", "x"))) == p("shop", "contains", "x")


@pytest.mark.parametrize("bad", [p("price", "=", "x"), p("paid", "=", "maybe"), p("at", ">", "-5"), p("at", ">", "soon"), p("shop", ">", "a"), p("nope", "=", "1"), p("shop", "length_gt", "01")])
def test_refused_filters(data, bad):
    with pytest.raises(QueryError):
        filters.condition(SCHEMA, [bad], NOW)


def test_pages(data):
    order = [Order("shop", nulls_first=True), Order("price", descending=True)]
    got = [r["id"] for r in rows.page(data.rows, SCHEMA, ["shop"], order, 10).collect()]
    assert got == ["06", "07", "02", "01", "03", "05", "04"]
    assert [r["id"] for r in rows.page(data.rows, SCHEMA, [], order, 2, 3).collect()] == ["01", "03"]
    assert [r["id"] for r in rows.page(data.rows, SCHEMA, [], [Order("who", extract="[b-z](.)")], 3).collect()] == ["05", "01", "02"]
    assert rows.distinct_values(data.rows, SCHEMA, "tags", "e").collect()[0].asDict() == {"value": "red", "rows": 3}
    assert rows.lookup(data, "04").count() == 1
    assert data.hold_to(7) is data
    with pytest.raises(QueryError):
        data.hold_to(6)
    assert data.identity_is_sound().collect()[0]["sound"]


def buckets(result, *columns):
    return [tuple(r[c] for c in (columns or ("group0", "value"))) for r in result.buckets.collect()]


def test_metrics(data):
    n = Metric({"n": count()}, group_by=("shop",))
    assert buckets(evaluate(data.rows, SCHEMA, n, NOW)) == [("north", 3.0), ("south", 2.0), ("", 1.0), (None, 1.0)]
    hidden = evaluate(data.rows, SCHEMA, Metric({"n": count()}, group_by=("shop",), min_count=2), NOW)
    assert buckets(hidden) == [("north", 3.0), ("south", 2.0)] and hidden.facts.collect()[0].asDict() == {"group_count": 2, "hidden_groups": 2, "processed_rows": 7}
    assert buckets(evaluate(data.rows, SCHEMA, Metric({"n": count()}, group_by=("shop",), min_count=("sum", "price", 40)), NOW)) == [("north", 3.0), ("south", 2.0)]
    assert buckets(evaluate(data.rows, SCHEMA, Metric({"n": count()}, group_by=("shop",), min_count=("distinct", "who", 2)), NOW)) == [("north", 3.0), ("south", 2.0)]
    top = evaluate(data.rows, SCHEMA, Metric({"s": sum_(col("price"))}, group_by=("shop",), group_limit=1, other=True), NOW)
    assert buckets(top) == [("south", 220.0)] and tuple(top.other.collect()[0]) == (45.0, None, 5)
    ratio = Metric({"s": sum_(col("price")), "n": count(col("price"))}, lambda q: q["s"] / S.nullif(q["n"], 0), group_by=("shop",), sort=(Sort("group0"),))
    assert buckets(evaluate(data.rows, SCHEMA, ratio, NOW)) == [("", 0.0), ("north", 20.0), ("south", 110.0), (None, 5.0)]
    assert buckets(evaluate(data.rows.where("false"), SCHEMA, Metric({"s": sum_(col("price")), "n": count()}, lambda q: q["n"]), NOW), "value", "count") == [(0.0, 0)]
    failing = Metric({"s": sum_(1 / col("price"))}, group_by=("state",))
    assert buckets(evaluate(data.rows, SCHEMA, failing, NOW), "group0", "error") == [("open", None), ("done", None), (None, "divide_by_zero")]
    both = Metric({"m": median(col("price")), "p": percentile(col("price"), 0.9)}, lambda q: q["p"] - q["m"])
    assert buckets(evaluate(data.rows, SCHEMA, both, NOW), "value") == [(pytest.approx(115 - 15),)]
    with pytest.raises(QueryError):
        percentile(col("price"), 1.5)
    with pytest.raises(QueryError):
        evaluate(data.rows, SCHEMA, Metric({"n": count()}, min_count=2), NOW)
    many = dashboard(data.rows, SCHEMA, {"a": n, "b": Metric({"u": count_distinct(col("who"))}, group_by=("shop",)), "c": Metric({"m": max_(col("at"))})}, NOW)
    assert buckets(many["a"]) == buckets(evaluate(data.rows, SCHEMA, n, NOW)) and dict(buckets(many["b"]))["north"] == 2.0
    assert many["c"].buckets.collect()[0]["value"] == datetime(2025, 6, 8, 15)


def test_calendar_metrics(data):
    day = Calendar("at", "day", "America/New_York")
    got = buckets(evaluate(data.rows, SCHEMA, Metric({"n": count()}, group_by=(day,), fill=Fill()), NOW))
    assert [(None if t is None else (t.day, t.hour), v) for t, v in got] == [((1, 4), 2.0), ((2, 4), 0.0), ((3, 4), 2.0), ((4, 4), 1.0), ((5, 4), 0.0), ((6, 4), 0.0), ((7, 4), 0.0), ((8, 4), 1.0), (None, 1.0)]
    kept = evaluate(data.rows, SCHEMA, Metric({"n": count()}, group_by=(day,), fill=Fill(), min_count=2), NOW)
    assert kept.facts.collect()[0]["hidden_groups"] == 3 and len(buckets(kept)) == 6
    slots = evaluate(data.rows, SCHEMA, Metric({"n": count()}, group_by=(Calendar("at", "dayOfWeek"),), fill=Fill()), NOW)
    assert [v for k, v in buckets(slots) if k is not None] == [0.0, 2.0, 0.0, 1.0, 0.0, 0.0, 3.0]
    utc = Calendar("at", "day")
    last = evaluate(data.rows, SCHEMA, Metric({"n": count()}, group_by=(utc,), fill=Fill(), trailing=Trailing(3)), NOW)
    assert [v for _, v in buckets(last)] == [None, None, 4.0, 2.0, 3.0, 1.0, 1.0, 1.0]
    mean = evaluate(data.rows, SCHEMA, Metric({"s": sum_(col("price"))}, group_by=(utc,), fill=Fill(), trailing=Trailing(2, "mean", True)), NOW)
    assert [v for _, v in buckets(mean)] == [40.0, 20.0, 10.0, 10.0, 2.5, 2.5, 0.0, 0.0]
    pooled = Metric({"a": avg(col("price"))}, group_by=(utc,), fill=Fill(), trailing=Trailing(None))
    assert [v for _, v in buckets(evaluate(data.rows, SCHEMA, pooled, NOW))][-1] == pytest.approx(65 / 5)
    shares = evaluate(data.rows, SCHEMA, Metric({"n": count()}, group_by=("shop", "state"), share="group0"), NOW)
    assert {(a, b): round(v, 6) for a, b, v in buckets(shares, "group0", "group1", "value")}["north", "open"] == round(2 / 3, 6)
    sunday = series.occurrences(data.rows, SCHEMA, Metric({"n": count()}, group_by=(Calendar("at", "dayOfWeek"),), fill=Fill()), [0.0, 1.0], NOW).where("group0 = 7").collect()[0]
    assert (sunday["occurrences"], sunday["value"], sunday["values"]) == (2, 1.5, [1.0, 2.0])
    span = series.whole_intervals(Calendar("at", "week"), datetime(2025, 6, 3, tzinfo=UTC), datetime(2025, 7, 1, tzinfo=UTC), datetime(2025, 6, 25, tzinfo=UTC))
    assert [d.day for d in span] == [9, 23]
    drilled = bucket_rows(data.rows, SCHEMA, Metric({"n": count()}, group_by=(day, "shop")), [datetime(2025, 6, 1, 4, tzinfo=UTC), "north"], NOW)
    assert ids(drilled) == ["01", "02"]


def test_distributions(data, spark):
    b = {r["group0"]: r for r in distributions.box(data.rows, SCHEMA, col("price"), ("shop",)).collect()}
    assert [b["north"][c] for c in ("n", "null_count", "min", "q1", "median", "q3", "max", "mean")] == [2, 1, 10.0, 15.0, 20.0, 25.0, 30.0, 20.0]
    t = distributions.box(data.rows, SCHEMA, col("price"), (), distributions.Box("tukey")).collect()[0]
    assert (t["low"], t["high"], t["outlier_count"], t["outliers"]) == (0.0, 30.0, 1, [200.0])
    many = spark.createDataFrame([(str(k), float(x)) for k, x in enumerate([0] * 100 + list(range(-30, -15)) + list(range(20, 40)))], "id string, price double")
    t = distributions.box(many, FieldSchema((Field("id", "text"), Field("price", "number")), "id"), col("price"), (), distributions.Box("tukey")).collect()[0]
    assert t["outlier_count"] == 35 and t["outliers"] == [float(x) for x in [*range(-30, -20), *range(30, 40)]]
    w = {r["group0"]: r for r in distributions.box(data.rows, SCHEMA, col("price"), ("shop",), distributions.Box("percentile")).collect()}
    assert (w["north"]["low"], w["north"]["high"], w["north"]["outlier_count"], w["north"]["outliers"]) == (12.0, 28.0, 2, [])
    h = distributions.histogram(data.rows, SCHEMA, col("price"), (), 4).collect()[0]
    assert (h["edges"], h["counts"]) == ([0.0, 50.0, 100.0, 150.0, 200.0], [5, 0, 0, 1])
    flat = distributions.histogram(data.rows.where("id = '01'"), SCHEMA, col("price")).collect()[0]
    assert (flat["edges"], flat["counts"]) == ([10.0, 10.0], [1])
    none = distributions.histogram(data.rows.where("id = '03'"), SCHEMA, col("price")).collect()[0]
    assert (none["edges"], none["counts"], none["null_count"]) == ([], [], 1)
    q = distributions.quantiles(data.rows, SCHEMA, col("price"), [0.0, 0.25, 1.0]).collect()[0]
    assert (q["values"], q["median"]) == ([0.0, 6.25, 200.0], 15.0)
    for bad in (lambda: distributions.quantiles(data.rows, SCHEMA, col("price"), [0.5, 0.5]), lambda: distributions.Box("tukey", (0.4, 0.6)), lambda: distributions.histogram(data.rows, SCHEMA, col("price"), (), 99)):
        with pytest.raises(QueryError):
            bad()


def test_intervals(data):
    share = Metric({"k": count(S.if_(col("paid"), 1, None)), "n": count(col("paid"))}, lambda q: q["k"] / q["n"], interval=Interval("proportion", "k", "n"))
    r = evaluate(data.rows, SCHEMA, share, NOW).buckets.collect()[0]
    assert (r["value"], round(r["lower"], 6), round(r["upper"], 6)) == (0.6, 0.230724, 0.882379)
    rate = Metric({"k": count(), "n": sum_(col("price"))}, lambda q: q["k"] / q["n"], interval=Interval("rate", "k", "n"))
    r = evaluate(data.rows, SCHEMA, rate, NOW).buckets.collect()[0]
    assert (round(r["lower"] * 265, 5), round(r["upper"] * 265, 5)) == (2.81436, 14.42268)  # the exact interval of 7 events
    odd = Metric({"k": sum_(col("price") / 4), "n": count()}, lambda q: q["k"], group_by=("shop",), interval=Interval("proportion", "k", "n"))
    assert {r["interval_error"] for r in evaluate(data.rows, SCHEMA, odd, NOW).buckets.where("group0 = 'south'").collect()} == {"interval_domain"}
    for a in (0.5, 1, 7, 150.0):
        for level in (0.001, 0.5, 0.99):
            assert gamma_share(a, gamma_quantile(level, a)) == pytest.approx(level, rel=1e-9)


def test_groups(data):
    made = [Summary("n", count()), Summary("worth", sum_(col("price"))), Summary("first", row="id"), Summary("its_price", row="price"), Summary("inverse", sum_(1 / col("price")))]
    got = {r["shop"]: r for r in grouping.groups(data.rows, SCHEMA, ["shop"], made, [Order("price", descending=True, nulls_first=True)]).collect()}
    assert got["north"]["first"] == "03" and got["north"]["its_price"] is None and got["south"]["first"] == "05"
    assert got[""]["inverse__error"] == "divide_by_zero" and got[""]["inverse"] is None
    assert got[None]["__group_id"] == '[["shop",null]]' and got["north"]["__group_id"] == '[["shop","north"]]'
    ties = grouping.groups(data.rows, SCHEMA, [], [Summary("x", row="id")], [Order("state", descending=True)]).collect()[0]
    assert ties["x"] == "06"  # of the open rows that with the greatest identity
    assert grouping.groups(data.rows.where("false"), SCHEMA, ["shop"], made, [Order("id")]).count() == 0
    with pytest.raises(QueryError):
        grouping.groups(data.rows, SCHEMA, ["price", "price"], [])


def test_relations_and_previews(data, spark):
    known = spark.createDataFrame([("ann",), ("ann",), (None,)], "name string")
    assert ids(filters.related(data.rows, "who", known, "name")) == ["01", "02", "07"]
    assert ids(filters.related(data.rows, "who", known, "name", keep=False)) == ["03", "04", "05"]
    more = data.with_computed("unit", "number", 100 / col("price"))
    seen = [tuple(r) for r in rows.preview(more, ["state"], "unit").where("error is not null").collect()]
    assert seen == [(None, None, "divide_by_zero", 1)]
    again = more.with_computed("twice", "number", S.iferror(col("unit") * 2, 0))
    assert again.rows.where("id = '02'").collect()[0]["twice"] == pytest.approx(200 / 30)
    with pytest.raises(QueryError):
        more.with_computed("unit", "number", col("price"))


def test_box_over_occurrences(spark):
    fields = FieldSchema((Field("id", "number"), Field("at", "datetime", groupable=True)), "id")
    days = [datetime(2024, 1, 7, 12, tzinfo=UTC) + timedelta(days=7 * k) for k in range(8)]
    frame = spark.createDataFrame([(100 * k + n, d) for k, d in enumerate(days) for n in range(40 if k == 7 else k % 3 + 1)], "id long, at timestamp")
    metric = Metric({"n": count()}, group_by=(Calendar("at", "dayOfWeek"),))
    got = series.occurrence_box(frame, fields, metric, distributions.Box("tukey"), NOW).collect()
    assert [(r["group0"], r["n"], r["min"], r["median"], r["max"], r["low"], r["high"], r["outlier_count"], r["outliers"]) for r in got] == [(7, 8, 1, 2, 40, 1, 3, 1, [40])]


@pytest.mark.parametrize("raw", ["1_000", "nan", "inf", "1e999", "0x10", "", "１２"])
def test_operands_are_decimal_numbers(raw):
    if raw == "":
        return
    with pytest.raises(QueryError):
        operand("number", raw, NOW, "price")


def test_spans_of_comparisons():
    assert [whole_span(op, 2.5) for op in ("=", ">", ">=", "<", "<=")] == [(3, 3), (3, None), (3, None), (None, 3), (None, 3)]
    assert [whole_span(op, 2) for op in ("=", ">", ">=", "<", "<=")] == [(2, 3), (3, None), (2, None), (None, 2), (None, 3)]
    assert whole_span("contains", 2) is None and meet((1, None), (2, 9)) == (2, 9) and meet((None, None), (None, None)) == (None, None)


def test_sums_stay_in_range(spark):
    frame = spark.createDataFrame([("a", 9e15), ("a", 9e15), ("b", 1.5)], "g string, x double")
    schema = FieldSchema((Field("g", "text"), Field("x", "number")), "g")
    got = {r["group0"]: (r["value"], r["error"]) for r in evaluate(frame, schema, Metric({"s": sum_(col("x"))}, group_by=("g",)), NOW).buckets.collect()}
    assert got == {"a": (None, "number_range"), "b": (1.5, None)}
