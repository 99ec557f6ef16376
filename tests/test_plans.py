"""Plans are what they should be at scale."""

import io
from contextlib import redirect_stdout
from datetime import UTC

import pytest
from pyspark.sql import functions as F

from sumac.functions.aggregates import count, sum_
from sumac.functions.calendar import bucket
from sumac.functions.scalar import col
from sumac.operators import filters, rows
from sumac.operators.grouping import Calendar
from sumac.operators.metrics import Metric, Trailing, bucket_rows, dashboard, evaluate
from sumac.plans.queries import NOW
from sumac.sources.tables import dataset, read, write
from sumac.streaming.buckets import running


def plan(frame):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf):
    d = dataset(spark, sf, "orders")
    text = plan(filters.where(d.rows, d.schema, [{"field": "o_orderstatus", "op": "=", "value": "F"}], NOW).select("o_orderpriority"))
    assert "EqualTo(o_orderstatus,F)" in text and "ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>" in text


def test_one_partial_aggregation_for_a_metric(spark, sf):
    d = dataset(spark, sf, "orders")
    text = plan(evaluate(d.rows, d.schema, Metric({"n": count(), "s": sum_(col("o_totalprice"))}, lambda p: p["s"] / p["n"], group_by=("status",)), NOW).buckets)
    assert "partial_sum" in text and text.count("Scan parquet") == 2 and "Join" not in text  # the tree and its details


def test_pages_keep_only_their_rows(spark, sf):
    d = dataset(spark, sf, "orders")
    assert "TakeOrderedAndProject" in plan(rows.page(d.rows, d.schema, ["price"], [rows.Order("price")], 10, 5))


def test_dashboards_share_aggregations(spark, sf):
    d = dataset(spark, sf, "orders")
    got = dashboard(d.rows, d.schema, {"a": Metric({"n": count()}, group_by=("status",)), "b": Metric({"s": sum_(col("o_totalprice"))}, group_by=("status",))}, NOW)
    assert set(got) == {"a", "b"} and got["b"].buckets.count() == got["a"].buckets.count()


@pytest.mark.parametrize("key, zone", [("week", "UTC"), ("day", "America/New_York"), ("month", "UTC")])
def test_streams_give_what_tables_give(spark, sf, tmp_path, key, zone):
    d = dataset(spark, sf, "events")
    source = d.rows.select("ts", "event_type", "value")
    write(source.repartition(3), f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    made = running(stream, d.schema, Calendar("ts", key, zone), {"s": sum_(col("value"))}, late=40 * 86_400, by=("event_type",))
    query = made.writeStream.format("memory").queryName("found").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    still = d.rows.groupBy(bucket(F.col("ts"), key, zone).alias("bucket"), "event_type").agg(F.count("*").alias("count"), F.sum("value").alias("s"))
    order = lambda r: (r["bucket"], r["event_type"], r["count"], round(r["s"], 6))
    assert sorted(map(order, spark.table("found").collect())) == sorted(map(order, still.collect()))


def test_formats(spark, sf, tmp_path):
    regions = read(spark, f"{sf}/region.parquet")
    for kind in ("json", "csv"):
        write(regions, f"{tmp_path}/{kind}", kind)
        assert read(spark, f"{tmp_path}/{kind}", kind, schema="r_regionkey int, r_name string").count() == 5


def test_comparisons_reach_the_scan_in_its_own_types(spark, sf):
    d = dataset(spark, sf, "orders")
    terms = [{"field": "price", "op": ">=", "value": "100000"}, {"field": "o_custkey", "op": "<", "value": "70.5"}, {"field": "o_orderdate", "op": ">", "value": "1995-01-01"}]
    made = filters.of_dataset(d, terms, NOW)
    text = plan(made)
    for pushed in ("GreaterThanOrEqual(o_totalprice,100000.0)", "LessThan(o_custkey,71)", "GreaterThanOrEqual(o_orderdate,1995-01-01T00:00:00.001)"):
        assert pushed in text
    assert sorted(r["o_orderkey"] for r in made.collect()) == sorted(r["o_orderkey"] for r in filters.where(d.rows, d.schema, terms, NOW).collect())


def test_metric_filters_and_alternatives_reach_the_scan(spark, sf):
    d = dataset(spark, sf, "orders")
    one = {"field": "price", "op": ">", "value": "100000"}
    m = Metric({"n": count()}, group_by=("status",), where=({"any": [one, {"field": "o_custkey", "op": "=", "value": "7"}]}, {"field": "o_orderpriority", "op": "!=", "value": ""}))
    made = evaluate(d, d.schema, m, NOW).buckets
    assert "Or(GreaterThan(o_totalprice,100000.0)" in plan(made)
    keys = lambda f: sorted((r["group0"], r["value"]) for r in f.collect())
    assert keys(made) == keys(evaluate(d.rows, d.schema, m, NOW).buckets)


def test_drill_downs_are_ranges(spark, sf):
    d = dataset(spark, sf, "events")
    m = Metric({"n": count()}, group_by=(Calendar("ts", "hour"), "event_type"))
    at = d.rows.where("event_type = 'view'").agg(F.min(bucket(F.col("ts"), "hour"))).collect()[0][0].replace(tzinfo=UTC)
    got = bucket_rows(d, d.schema, m, [at, "view"], NOW)
    assert "GreaterThanOrEqual(ts," in plan(got) and "LessThan(ts," in plan(got) and "(event_type,view)" in plan(got)
    assert got.count() == d.rows.where((bucket(F.col("ts"), "hour") == F.lit(at)) & (F.col("event_type") == "view")).count() > 0
    days = Metric({"n": count()}, group_by=(Calendar("ts", "day", "America/New_York"),), trailing=Trailing(3))
    day = bucket(F.col("ts"), "day", "America/New_York")
    last = sorted(r[0] for r in d.rows.select(day).distinct().collect())[3:6]
    want = d.rows.where(day.isin(last)).count()
    assert bucket_rows(d, d.schema, days, [last[-1].replace(tzinfo=UTC)], NOW).count() == want > 0
    inside = bucket_rows(d, d.schema, Metric({}, group_by=("event_type",)), ["view"], NOW, ("value", 10.0, 20.0, False))
    assert inside.count() == d.rows.where("event_type = 'view' and value >= 10 and value < 20").count() and "LessThan(value,20.0)" in plan(inside)
