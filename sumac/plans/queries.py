"""The library's operators over the test tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumac.functions import scalar as S
from sumac.functions.aggregates import avg, count, count_distinct, max_, median, min_, percentile, sum_
from sumac.functions.scalar import col
from sumac.operators import distributions, filters, grouping, rows, series
from sumac.operators.grouping import Calendar, Summary
from sumac.operators.metrics import Fill, Interval, Metric, Sort, Trailing, bucket_rows, dashboard, evaluate
from sumac.operators.rows import Order
from sumac.schema import Dataset, Field, FieldSchema
from sumac.sources.tables import dataset

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The clock of relative filters.
NOW = datetime(2024, 1, 20, tzinfo=UTC)


def _query(sql: str | None, *tables: str):
    """Registers f(dataset, ...) under its name; timestamps go out without zone, as the SQL has them."""

    def register(f: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            frame = f(*[dataset(spark, sf_dir, t) for t in tables])
            return frame.select(*[F.col(f"`{n}`").cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(f"`{n}`") for n, t in frame.dtypes])

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return run

    return register


def _where(d: Dataset, *terms: dict) -> DataFrame:
    return filters.of_dataset(d, list(terms), NOW)


def _p(field: str, op: str, value: str = "", **more) -> dict:
    return {"field": field, "op": op, "value": value} | more


def _named(frame: DataFrame, **names: str) -> DataFrame:
    """new=old, in that order."""
    return frame.select(*[F.col(old).alias(new) for new, old in names.items()])


def _round(frame: DataFrame, digits: int, *names: str) -> DataFrame:
    return frame.withColumns({n: F.round(n, digits) for n in names})


# filters


@_query("SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'", "orders")
def filter_eq(d):
    return _where(d, _p("status", "=", "F")).select("o_orderkey", "o_orderstatus")


@_query("SELECT event_id::DOUBLE AS event_id FROM events WHERE nullif(event_type, 'error') <> 'view'", "events")
def filter_ne_null(d):
    return _where(d, _p("kind", "!=", "view")).select("event_id")


@_query("SELECT o_orderkey::DOUBLE AS o_orderkey FROM orders WHERE o_totalprice >= 100000 AND (o_orderstatus = 'O' OR o_orderpriority LIKE '1-%')", "orders")
def filter_or_group(d):
    return _where(d, _p("price", ">=", "100000"), {"any": [_p("status", "=", "O"), _p("priority", "starts_with", "1-")]}).select("o_orderkey")


@_query("SELECT o_orderkey::DOUBLE AS o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice < 50000) OR (o_orderstatus = 'P' AND o_totalprice > 200000)", "orders")
def filter_or_of_ands(d):
    return _where(d, {"any": [{"all": [_p("status", "=", "F"), _p("price", "<", "50000")]}, {"all": [_p("status", "=", "P"), _p("price", ">", "200000")]}]}).select("o_orderkey")


@_query("SELECT event_id::DOUBLE AS event_id FROM events WHERE NOT contains(lower(nullif(event_type, 'error')), 'ur') AND nullif(event_type, 'error') IS NOT NULL", "events")
def filter_negated_contains(d):
    return _where(d, _p("kind", "contains", "UR", negated=True)).select("event_id")


@_query("SELECT p_partkey::DOUBLE AS p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].* [a-z]+[tg]$')", "part")
def filter_regex(d):
    return _where(d, _p("p_name", "matches_regex", "^[a-m].* [a-z]+[tg]$")).select("p_partkey")


@_query("SELECT p_partkey::DOUBLE AS p_partkey FROM part WHERE length(p_name) > 8 AND right(lower(p_name), 3) <> 'olt'", "part")
def filter_length(d):
    return _where(d, _p("p_name", "length_gt", "8"), _p("p_name", "ends_with", "OLT", negated=True)).select("p_partkey")


@_query("SELECT event_id::DOUBLE AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' AND ts < TIMESTAMP '2024-01-18'", "events")
def filter_relative_time(d):
    return _where(d, _p("ts", ">=", "-4d12h"), _p("ts", "<", "2024-01-18T00:00:00Z")).select("event_id")


@_query("SELECT event_id::DOUBLE AS event_id FROM events WHERE nullif(event_type, 'error') IS NULL", "events")
def filter_is_null(d):
    return _where(d, _p("kind", "is_null")).select("event_id")


@_query("SELECT p_partkey::DOUBLE AS p_partkey FROM part WHERE list_contains(list_transform(string_split(p_name, ' '), lambda x: lower(x)), 'red')", "part")
def filter_includes(d):
    return _where(d, _p("words", "includes", "RED")).select("p_partkey")


@_query("SELECT event_id::DOUBLE AS event_id FROM events WHERE event_type = 'error' OR event_type NOT IN ('view', 'click')", "events")
def set_filter_none(d):
    return _where(d, *filters.set_filter(d.schema.field("kind"), "none", ["view", "click"])).select("event_id")


@_query("SELECT event_id::DOUBLE AS event_id FROM events WHERE nullif(event_type, 'error') IN ('view', 'signup')", "events")
def set_filter_any(d):
    return _where(d, *filters.set_filter(d.schema.field("kind"), "any", ["view", "signup"])).select("event_id")


@_query("SELECT o_orderkey::DOUBLE AS o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", "orders", "customer")
def predicate_relation_semi(d, customers):
    owing = customers.rows.where("c_acctbal < 0")
    return filters.related(d.rows, "o_custkey", owing, "c_custkey").select("o_orderkey")


@_query("SELECT o_orderkey::DOUBLE AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", "orders", "customer")
def predicate_relation_anti(d, customers):
    owing = customers.rows.where("c_acctbal < 0")
    return filters.related(d.rows, "o_custkey", owing, "c_custkey", keep=False).select("o_orderkey")


@_query("SELECT p_partkey::DOUBLE AS p_partkey FROM part WHERE NOT regexp_matches(p_name, 'ring|gear') AND length(p_name) IN (8, 9)", "part")
def filter_not_regex(d):
    return _where(d, _p("p_name", "not_matches_regex", "ring|gear"), _p("p_name", "length_lt", "10"), {"any": [_p("p_name", "length_eq", "8"), _p("p_name", "length_eq", "9")]}).select("p_partkey")


@_query("SELECT p_partkey::DOUBLE AS p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'bolt')", "part")
def set_filter_all(d):
    return _where(d, *filters.set_filter(d.schema.field("words"), "all", ["red", "bolt", "red"])).select("p_partkey")


@_query("SELECT p_partkey::DOUBLE AS p_partkey FROM part WHERE NOT contains(p_name, 'ring') AND p_size < 20", "part")
def filter_negation(d):
    return _where(d, filters.negated(_p("p_name", "contains", "ring")), filters.negated(_p("p_size", ">=", "20"))).select("p_partkey")


# rows


@_query("SELECT event_id::DOUBLE AS event_id, nullif(event_type, 'error') AS kind, value FROM events ORDER BY kind DESC NULLS FIRST, value ASC NULLS LAST, event_id LIMIT 40", "events")
def sort_multi_nulls(d):
    return rows.page(d.rows, d.schema, ["event_id", "kind", "value"], [Order("kind", descending=True, nulls_first=True), Order("value")], 40)


@_query("SELECT p_partkey::DOUBLE AS p_partkey FROM part ORDER BY nullif(regexp_extract(p_brand, '#[2-5]([0-9])', 1), '') DESC NULLS LAST, p_partkey LIMIT 30", "part")
def sort_regex_extract(d):
    return rows.page(d.rows, d.schema, [], [Order("p_brand", descending=True, extract="#[2-5]([0-9])")], 30)


@_query("SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50", "orders")
def page_offset(d):
    return rows.page(_where(d, _p("status", "=", "O")), d.schema, ["o_totalprice"], [Order("price", descending=True)], 25, 50).select("o_orderkey", "o_totalprice")


@_query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'", "orders")
def page_total(d):
    return rows.total(_where(d, _p("status", "=", "O")))


@_query("SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7", "orders")
def row_lookup(d):
    return rows.lookup(d, 7).select("o_orderkey", "o_totalprice")


@_query("SELECT 'p_brand' AS field, count(DISTINCT p_brand) AS distinct_values, min(p_brand) AS least, max(p_brand) AS greatest, count(*) FILTER (p_brand IS NULL) AS nulls FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type), min(p_type), max(p_type), count(*) FILTER (p_type IS NULL) FROM part", "part")
def field_stats(d):
    return rows.field_stats(d.rows, d.schema, ["p_brand", "p_type"])


@_query("SELECT w AS value, count(*) AS \"rows\" FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w ORDER BY \"rows\" DESC, value LIMIT 10", "part")
def distinct_values(d):
    return rows.distinct_values(d.rows, d.schema, "words", limit=10)


@_query("SELECT p_name AS value, count(*) AS \"rows\" FROM part WHERE contains(lower(p_name), 'bolt') GROUP BY p_name ORDER BY \"rows\" DESC, value LIMIT 12", "part")
def distinct_search(d):
    return rows.distinct_values(d.rows, d.schema, "p_name", "BOLT", 12)


@_query("SELECT bool_or(nullif(event_type, 'error') IS NULL) AS has_null FROM events", "events")
def distinct_has_null(d):
    return rows.has_null(d.rows, d.schema, "kind")


@_query("SELECT count(*) AS rows, count(event_id) AS ids, count(*) = count(DISTINCT event_id) AS sound FROM events", "events")
def identity_check(d):
    return d.identity_is_sound()


@_query("SELECT o_orderstatus, CASE WHEN o_totalprice > 150000 THEN 'big' ELSE 'small' END AS value, NULL::VARCHAR AS error, count(*) AS \"rows\" FROM orders GROUP BY ALL", "orders")
def preview_frequency(d):
    size = S.if_(col("o_totalprice") > 150000, "big", "small")
    return rows.preview(d.with_computed("size", "text", size), ["status"], "size")


@_query("SELECT count(*) > 5 AS has_more FROM (SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 'e'))", "part")
def distinct_has_more(d):
    return rows.has_more(d.rows, d.schema, "p_name", "E", 5)


@_query("SELECT count(*)::BIGINT AS processed, count(*) FILTER (user_id % 5 <> 0 AND event_type = 'view')::BIGINT AS nulls, count(*) FILTER (user_id % 5 = 0)::BIGINT AS errors FROM events", "events")
def preview_counts(d):
    made = d.with_computed("r", "number", S.if_(col("event_type") != "view", col("value") / (col("user_id") % 5), S.nullif(0 * (col("value") / (col("user_id") % 5)), 0)))
    return rows.preview_facts(rows.preview(made, ["event_type"], "r"))


# computed fields


@_query("SELECT event_id::DOUBLE AS event_id, round(value * 2 - user_id % 7, 6) AS a, CASE WHEN user_id % 5 <> 0 THEN round(value / (user_id % 5), 6) END AS b, CASE WHEN user_id % 5 = 0 THEN 'divide_by_zero' END AS b_error, floor(value * 10 + 0.5) / 10 AS c FROM events", "events")
def computed_arith(d):
    a, b, c = col("value") * 2 - col("user_id") % 7, col("value") / (col("user_id") % 5), S.round_(col("value"), 1)
    return d.rows.select("event_id", F.round(a.value, 6).alias("a"), F.round(b.value, 6).alias("b"), b.error.alias("b_error"), c.value.alias("c"))


@_query("SELECT p_partkey::DOUBLE AS p_partkey, upper(left(p_name, 3)) || ':' || right(p_brand, 2) AS a, replace(lower(p_name), 'bolt', 'nut') AS b, nullif(split_part(p_name, ' ', 2), '') AS c, lpad(p_brand, 12, '*') AS d, length(p_name)::DOUBLE AS e, len(string_split(p_name, ' '))::DOUBLE AS f FROM part", "part")
def computed_text(d):
    t, b = col("p_name"), col("p_brand")
    made = {"a": S.concat(S.upper(S.left(t, 3)), ":", S.right(b, 2)), "b": S.replace(S.lower(t), "bolt", "nut"), "c": S.split_part(t, " ", 2), "d": S.lpad(b, 12, "*"), "e": S.length(col("p_name")), "f": S.word_count(t)}
    return d.rows.select("p_partkey", *[c.value.alias(n) for n, c in made.items()])


@_query("SELECT p_partkey::DOUBLE AS p_partkey, regexp_matches(p_name, '(?i)BOLT') AS a, nullif(regexp_extract(p_name, '([a-z]+) w', 1), '') AS b, regexp_replace(p_brand, '([0-9])([0-9])', '\\2-\\1', 'g') AS c FROM part", "part")
def computed_regex(d):
    made = {"a": S.regex_test(col("p_name"), "BOLT", "i"), "b": S.regex_extract(col("p_name"), "([a-z]+) w", 1), "c": S.regex_replace(col("p_brand"), "([0-9])([0-9])", "$2-$1")}
    return d.rows.select("p_partkey", *[c.value.alias(n) for n, c in made.items()])


@_query("SELECT event_id::DOUBLE AS event_id, CASE WHEN nullif(event_type, 'error') = 'view' THEN 'v' ELSE 'other' END AS a, CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'purchase' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS b, coalesce(nullif(event_type, 'error'), '-') AS c, CASE WHEN user_id % 2 = 0 THEN -1.0 ELSE value / (user_id % 2) END AS d FROM events", "events")
def computed_conditional(d):
    k, t = col("kind"), col("event_type")
    made = {"a": S.if_(k == "view", "v", "other"), "b": S.switch(t, ("click", 1), ("purchase", 2), otherwise=0), "c": S.coalesce_(k, "-"), "d": S.iferror(col("value") / (col("user_id") % 2), -1)}
    return d.rows.select("event_id", *[c.value.alias(n) for n, c in made.items()])


@_query("SELECT o_orderkey::DOUBLE AS o_orderkey, year(o_orderdate)::DOUBLE AS a, isodow(o_orderdate)::DOUBLE AS b, date_trunc('month', o_orderdate)::TIMESTAMP AS c, o_orderdate::TIMESTAMP + INTERVAL 1 MONTH AS d, trunc(date_diff('day', o_orderdate::TIMESTAMP, TIMESTAMP '1998-01-01'))::DOUBLE AS e, strftime(o_orderdate, '%Y/%m') AS f FROM orders", "orders")
def computed_dates(d):
    t = col("o_orderdate")
    made = {"a": S.year(t), "b": S.weekday(t), "c": S.date_trunc("month", t), "d": S.date_add("month", 1, t), "e": S.date_diff("day", t, S.to_datetime("1998-01-01")), "f": S.format_date(t, "YYYY/MM")}
    return d.rows.select("o_orderkey", *[c.value.alias(n) for n, c in made.items()])


@_query("SELECT p_partkey::DOUBLE AS p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), '|') AS a, string_split(p_name, ' ')[2] AS b, len(string_split(p_name, ' '))::DOUBLE AS c, list_contains(string_split(p_name, ' '), 'bolt') AS d FROM part", "part")
def computed_array(d):
    w = col("words")
    made = {"a": S.join(S.array_sort(w), "|"), "b": S.array_get(w, 2), "c": S.array_length(w), "d": S.array_contains(w, "bolt")}
    return d.rows.select("p_partkey", *[c.value.alias(n) for n, c in made.items()])


_LOGIC = """SELECT event_id::DOUBLE AS event_id, CASE WHEN value > 80 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS a, NOT (kind = 'view') AS b,
value > 50 AND kind = 'view' AS c, value > 50 OR kind = 'view' AS d, kind IS NULL AS e, coalesce(kind, '') = '' AS f, event_type IN ('view', 'click') AS g,
value BETWEEN 10 AND 20 AS h, -value AS i, nullif(event_type, 'click') AS j, value <= 50 AND value <> 10 AS k FROM (SELECT *, nullif(event_type, 'error') AS kind FROM events)"""


@_query(_LOGIC, "events")
def computed_logic(d):
    k, v, t = col("kind"), col("value"), col("event_type")
    made = {
        "a": S.ifs((v > 80, "high"), (v > 20, "mid"), otherwise="low"), "b": ~(k == "view"), "c": (v > 50) & (k == "view"), "d": (v > 50) | (k == "view"), "e": S.is_null(k), "f": S.is_empty(k),
        "g": S.in_(t, "view", "click"), "h": S.between(v, 10, 20), "i": -v, "j": S.nullif(t, "click"), "k": (v <= 50) & (v != 10),
    }
    return d.rows.select("event_id", *[c.value.alias(n) for n, c in made.items()])


_CONVERT = """SELECT o_orderkey::DOUBLE AS o_orderkey, CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE x::VARCHAR END AS a, CASE WHEN y = floor(y) THEN y::BIGINT::VARCHAR ELSE y::VARCHAR END AS b,
o_custkey::DOUBLE AS c, CASE WHEN o_orderstatus = 'F' THEN true END AS d, o_orderdate::TIMESTAMP AS e, CASE WHEN o_orderstatus <> 'F' THEN 'invalid_boolean' END AS d_error
FROM (SELECT *, o_totalprice * 256 AS x, o_custkey / 8192.0::DOUBLE AS y FROM orders)"""


@_query(_CONVERT, "orders")
def computed_convert(d):
    date = S.concat(S.format_date(col("o_orderdate"), "YYYY-MM-DD"), "T", S.format_date(col("o_orderdate"), "HH:mm:ss"), "Z")
    true = S.to_boolean(S.if_(col("o_orderstatus") == "F", " TRUE ", "other"))
    made = {"a": S.to_text(col("o_totalprice") * 256), "b": S.to_text(col("o_custkey") / 8192), "c": S.to_number(S.concat(" ", S.to_text(col("o_custkey")))), "d": true, "e": S.to_datetime(date)}
    return d.rows.select("o_orderkey", *[c.value.alias(n) for n, c in made.items()], true.error.alias("d_error"))


_TEXT = """SELECT p_partkey::DOUBLE AS p_partkey, substr(p_name, 2, 5) AS a, trim(w) AS b, ltrim(w) AS c, rtrim(w) AS d, rpad(p_brand, 12, '*') AS e, array_to_string(string_split(p_name, ' '), '+') AS f,
concat_ws('/', p_brand, p_name) AS g, contains(lower(p_name), 'bolt') AS h, starts_with(p_name, 's') AS i, ends_with(lower(p_name), 'el') AS j, url_encode(p_name) AS k, substr(p_name, 3) AS l
FROM (SELECT *, '  ' || p_name || '   ' AS w FROM part)"""


@_query(_TEXT, "part")
def computed_text_more(d):
    t, b = col("p_name"), col("p_brand")
    w = S.concat("  ", t, "   ")
    made = {
        "a": S.substring(col("p_name"), 2, 5), "b": S.trim(w), "c": S.ltrim(w), "d": S.rtrim(w), "e": S.rpad(b, 12, "*"), "f": S.join(S.split(t, " "), "+"), "g": S.concat_ws("/", b, t),
        "h": S.contains(t, "BOLT", ignore_case=True), "i": S.starts_with(t, "s"), "j": S.ends_with(t, "EL", ignore_case=True), "k": S.url_encode(t), "l": S.substring(t, 3),
    }
    return d.rows.select("p_partkey", *[c.value.alias(n) for n, c in made.items()])


_MATH = """SELECT event_id::DOUBLE AS event_id, abs(value - 50) AS a, floor(value) AS b, ceil(value) AS c, trunc(value - 50) AS d, round(sqrt(value), 9) AS e, floor(value * 100 + 0.5) / 100 AS f,
round(pow(value, 2), 6) AS g, greatest(10.0, least(20.0, value)) AS h, least(value, user_id) AS i, greatest(value, user_id::DOUBLE) AS j FROM events"""


@_query(_MATH, "events")
def computed_math(d):
    v, u = col("value"), col("user_id")
    made = {
        "a": S.abs_(v - 50), "b": S.floor(v), "c": S.ceil(v), "d": S.trunc(v - 50), "e": S.sqrt(v), "f": S.round_(v, 2), "g": S.power(v, 2), "h": S.clamp(v, 10, 20), "i": S.least(v, u), "j": S.greatest(v, u),
    }
    rounded = {"e": 9, "g": 6}
    return d.rows.select("event_id", *[(F.round(c.value, rounded[n]) if n in rounded else c.value).alias(n) for n, c in made.items()])


@_query("SELECT event_id::DOUBLE AS event_id, month(ts)::DOUBLE AS a, day(ts)::DOUBLE AS b, hour(ts)::DOUBLE AS c, date_trunc('millisecond', ts)::TIMESTAMP + INTERVAL 36 HOUR AS d, trunc(date_sub('hour', TIMESTAMP '2024-01-01', date_trunc('millisecond', ts)))::DOUBLE AS e, date_trunc('hour', ts)::TIMESTAMP AS f FROM events", "events")
def computed_dates_more(d):
    t = col("ts")
    made = {"a": S.month(t), "b": S.day(t), "c": S.hour(t), "d": S.date_add("hour", 36, t), "e": S.date_diff("hour", S.to_datetime("2024-01-01"), t), "f": S.date_trunc("hour", t)}
    return d.rows.select("event_id", *[c.value.alias(n) for n, c in made.items()])


@_query("SELECT p_partkey::DOUBLE AS p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name || ' ' || p_name, ' '))), '|') AS a, len(string_split(p_brand, '#'))::DOUBLE AS b FROM part", "part")
def computed_array_more(d):
    twice = S.split(S.concat(col("p_name"), " ", col("p_name")), " ")
    made = {"a": S.join(S.array_sort(S.array_unique(twice)), "|"), "b": S.array_length(S.split(col("p_brand"), "#"))}
    return d.rows.select("p_partkey", *[c.value.alias(n) for n, c in made.items()])


# aggregation


def _metric(d: Dataset, metric: Metric, **names: str) -> DataFrame:
    return _named(evaluate(d, d.schema, metric, NOW).buckets, **names)


@_query("SELECT round(sum(o_totalprice), 2) AS value, count(*) AS count FROM orders", "orders")
def agg_total(d):
    return _round(_metric(d, Metric({"s": sum_(col("o_totalprice"))}), value="value", count="count"), 2, "value")


@_query("SELECT o_orderstatus AS status, round(avg(o_totalprice), 4) AS value, count(*) AS count FROM orders GROUP BY 1", "orders")
def agg_grouped(d):
    return _round(_metric(d, Metric({"s": avg(col("o_totalprice"))}, group_by=("status",)), status="group0", value="value", count="count"), 4, "value")


@_query("SELECT nullif(event_type, 'error') AS kind, count(DISTINCT user_id)::DOUBLE AS value FROM events GROUP BY 1", "events")
def agg_count_distinct(d):
    return _metric(d, Metric({"u": count_distinct(col("user_id"))}, group_by=("kind",)), kind="group0", value="value")


@_query("SELECT nullif(event_type, 'error') AS kind, round(sum(value) / nullif(count(DISTINCT user_id), 0), 6) AS value FROM events GROUP BY 1", "events")
def agg_formula_ratio(d):
    m = Metric({"n": sum_(col("value")), "d": count_distinct(col("user_id"))}, lambda p: p["n"] / S.nullif(p["d"], 0), group_by=("kind",))
    return _round(_metric(d, m, kind="group0", value="value"), 6, "value")


@_query("SELECT event_type, round(median(value), 6) AS value FROM events GROUP BY 1", "events")
def agg_median(d):
    return _round(_metric(d, Metric({"m": median(col("value"))}, group_by=("event_type",)), event_type="group0", value="value"), 6, "value")


@_query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9) - quantile_cont(l_extendedprice, 0.1), 4) AS value FROM lineitem GROUP BY 1", "lineitem")
def agg_percentiles(d):
    x = col("l_extendedprice")
    m = Metric({"a": percentile(x, 0.9), "b": percentile(x, 0.1)}, lambda p: p["a"] - p["b"], group_by=("l_returnflag",))
    return _round(_metric(d, m, l_returnflag="group0", value="value"), 4, "value")


@_query("SELECT o_orderstatus AS status, min(o_orderpriority) AS value FROM orders GROUP BY 1", "orders")
def agg_min_text(d):
    return _metric(d, Metric({"m": min_(col("o_orderpriority"))}, group_by=("status",)), status="group0", value="value")


@_query("SELECT o_custkey::DOUBLE AS customer, count(*)::DOUBLE AS value FROM orders GROUP BY 1 HAVING count(*) >= 18", "orders")
def agg_min_count_rows(d):
    return _metric(d, Metric({"n": count()}, group_by=("o_custkey",), min_count=18), customer="group0", value="value")


@_query("SELECT count(*) FILTER (n >= 18) AS group_count, count(*) FILTER (n < 18) AS hidden_groups, sum(n)::BIGINT AS processed_rows FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)", "orders")
def agg_hidden_groups(d):
    return evaluate(d.rows, d.schema, Metric({"n": count()}, group_by=("o_custkey",), min_count=18), NOW).facts


@_query("SELECT user_id::DOUBLE AS user_id, round(sum(value), 4) AS value FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 5", "events")
def agg_min_count_distinct(d):
    m = Metric({"s": sum_(col("value"))}, group_by=("user_id",), min_count=("distinct", "event_type", 5))
    return _round(_metric(d, m, user_id="group0", value="value"), 4, "value")


@_query("SELECT o_custkey::DOUBLE AS customer, count(*)::DOUBLE AS value FROM orders GROUP BY 1 HAVING sum(o_totalprice) >= 2000000", "orders")
def agg_min_count_sum(d):
    return _metric(d, Metric({"n": count()}, group_by=("o_custkey",), min_count=("sum", "o_totalprice", 2_000_000)), customer="group0", value="value")


@_query("SELECT o_custkey::DOUBLE AS customer, count(*)::DOUBLE AS value FROM orders GROUP BY 1 ORDER BY value DESC, customer LIMIT 10", "orders")
def agg_top_n(d):
    return _metric(d, Metric({"n": count()}, group_by=("o_custkey",), group_limit=10), customer="group0", value="value")


_TOP = "WITH g AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY {by} DESC, o_custkey) AS k FROM g) "


@_query(_TOP.format(by="n") + "SELECT sum(n)::DOUBLE AS value, sum(n)::BIGINT AS count FROM r WHERE k > 10", "orders")
def agg_top_n_other(d):
    return evaluate(d.rows, d.schema, Metric({"n": count()}, group_by=("o_custkey",), group_limit=10, other=True), NOW).other.select("value", "count")


@_query(_TOP.format(by="round(s / n, 6)") + "SELECT round(sum(s) / sum(n), 4) AS value, sum(n)::BIGINT AS count FROM r WHERE k > 10", "orders")
def agg_ratio_other(d):
    m = Metric({"s": sum_(col("o_totalprice")), "n": count()}, lambda p: S.round_(p["s"] / p["n"], 6), group_by=("o_custkey",), group_limit=10, other=True)
    return _round(evaluate(d.rows, d.schema, m, NOW).other.select("value", "count"), 4, "value")


@_query("SELECT o_orderstatus AS status, count(*)::DOUBLE AS value FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) GROUP BY 1", "orders")
def agg_shown_rows(d):
    shown = rows.page(d.rows, d.schema, ["o_orderstatus"], [Order("price", descending=True)], 100)
    return _named(evaluate(shown, d.schema, Metric({"n": count()}, group_by=("status",)), NOW).buckets, status="group0", value="value")


@_query("SELECT event_type, count(*)::DOUBLE AS value FROM events WHERE value > 50 GROUP BY 1", "events")
def agg_metric_where(d):
    return _metric(d, Metric({"n": count()}, group_by=("event_type",), where=(_p("value", ">", "50"),)), event_type="group0", value="value")


@_query("SELECT o_orderpriority AS priority, count(*)::DOUBLE AS value, round(avg(o_totalprice), 4) AS y FROM orders GROUP BY 1", "orders")
def agg_scatter(d):
    m = Metric({"n": count(), "a": avg(col("o_totalprice"))}, lambda p: p["n"], lambda p: p["a"], group_by=("priority",))
    return _round(_metric(d, m, priority="group0", value="value", y="y"), 4, "y")


@_query("SELECT event_type, CASE WHEN min(user_id % 5) = 0 THEN NULL ELSE 0.0 END AS value, CASE WHEN min(user_id % 5) = 0 THEN 'divide_by_zero' END AS error FROM events GROUP BY 1", "events")
def agg_input_error(d):
    m = Metric({"s": sum_(col("value") / (col("user_id") % 5))}, lambda p: p["s"] * 0, group_by=("event_type",))
    return _metric(d, m, event_type="group0", value="value", error="error")


@_query("SELECT o_orderstatus AS status, 'n' AS metric, count(*)::DOUBLE AS value FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, 'dear', count(*) FILTER (o_totalprice > 100000)::DOUBLE FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 'p', count(DISTINCT o_custkey)::DOUBLE FROM orders GROUP BY 1", "orders")
def agg_dashboard(d):
    dear = S.if_(col("o_totalprice") > 100000, 1, None)
    made = {"n": Metric({"n": count()}, group_by=("status",)), "dear": Metric({"n": count(dear)}, group_by=("status",)), "p": Metric({"u": count_distinct(col("o_custkey"))}, group_by=("priority",))}
    got = dashboard(d.rows, d.schema, made, NOW)
    frames = [r.buckets.select(F.col("group0").alias("status"), F.lit(n).alias("metric"), "value") for n, r in got.items()]
    return frames[0].unionAll(frames[1]).unionAll(frames[2])


# distributions and intervals

_BOX = "SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY 1"


@_query(f"SELECT event_type, n, round(lo, 6) AS low, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3, round(hi, 6) AS high FROM ({_BOX})", "events")
def dist_box_minmax(d):
    got = distributions.box(d.rows, d.schema, col("value"), ("event_type",))
    return _round(_named(got, event_type="group0", n="n", low="low", q1="q1", median="median", q3="q3", high="high"), 6, "low", "q1", "median", "q3", "high")


@_query(f"SELECT b.event_type, round(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), 6) AS low, round(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), 6) AS high, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outlier_count FROM events e JOIN ({_BOX}) b USING (event_type) GROUP BY 1", "events")
def dist_box_tukey(d):
    got = distributions.box(d.rows, d.schema, col("value"), ("event_type",), distributions.Box("tukey"))
    return _round(_named(got, event_type="group0", low="low", high="high", outlier_count="outlier_count"), 6, "low", "high")


@_query(f"SELECT b.event_type, round(any_value(p10), 6) AS low, round(any_value(p90), 6) AS high, count(*) FILTER (value < p10 OR value > p90) AS outlier_count FROM events e JOIN ({_BOX}) b USING (event_type) GROUP BY 1", "events")
def dist_box_percentile(d):
    got = distributions.box(d.rows, d.schema, col("value"), ("event_type",), distributions.Box("percentile"))
    return _round(_named(got, event_type="group0", low="low", high="high", outlier_count="outlier_count"), 6, "low", "high")


@_query("WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT o_orderstatus, least(7, (SELECT count(*) FROM range(0, 8) t(i) WHERE o_totalprice >= lo + (hi - lo) * (i / 8.0::DOUBLE)) - 1) AS bin FROM orders, e) SELECT o_orderstatus AS status, bin::BIGINT AS bin, count(*) AS n FROM b GROUP BY 1, 2", "orders")
def dist_histogram(d):
    got = distributions.histogram(d.rows, d.schema, col("o_totalprice"), ("status",), 8)
    return got.select(F.col("group0").alias("status"), F.posexplode("counts").alias("bin", "n")).where("n > 0").select("status", F.col("bin").cast("long").alias("bin"), "n")


@_query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS a, round(quantile_cont(value, 0.5), 6) AS b, round(quantile_cont(value, 0.95), 6) AS c FROM events GROUP BY 1", "events")
def dist_quantiles(d):
    got = distributions.quantiles(d.rows, d.schema, col("value"), [0.05, 0.5, 0.95], ("event_type",))
    return got.select(F.col("group0").alias("event_type"), *[F.round(F.col("values")[k], 6).alias(n) for k, n in enumerate("abc")])


@_query("WITH g AS (SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS k, count(*)::DOUBLE AS n FROM orders GROUP BY 1), v AS (SELECT *, k / n AS p, (n - k) / n AS q, 1.959963984540054 AS z FROM g), w AS (SELECT *, z * sqrt(p * q / n + z * z / (4 * n * n)) AS d, z * z / (2 * n) AS s FROM v) SELECT priority, round(p, 9) AS value, round(p * p / (p + s + d), 9) AS lower, round(1 - q * q / (q + s + d), 9) AS upper FROM w", "orders")
def interval_wilson(d):
    m = Metric({"k": count(S.if_(col("o_orderstatus") == "F", 1, None)), "n": count()}, lambda p: p["k"] / p["n"], group_by=("priority",), interval=Interval("proportion", "k", "n"))
    return _round(_metric(d, m, priority="group0", value="value", lower="lower", upper="upper"), 9, "value", "lower", "upper")


#: The bounds of a Poisson count by halving: below the lower one k or more, above the upper one k or fewer events have the chance 0.025.
_POISSON = """WITH RECURSIVE g AS (SELECT event_type, count(*)::DOUBLE AS k, sum(value) AS n FROM events GROUP BY 1),
b AS (
  SELECT event_type, k, n, s, 0.0::DOUBLE AS lo, 2 * k + 20 AS hi, 0 AS step FROM g, (VALUES (0), (1)) t(s)
  UNION ALL
  SELECT event_type, k, n, s, CASE WHEN up THEN m ELSE lo END, CASE WHEN up THEN hi ELSE m END, step + 1
  FROM (SELECT *, CASE WHEN s = 0 THEN 1 - p < 0.025 ELSE p > 0.025 END AS up
        FROM (SELECT *, list_sum(list_transform(range(0, k::BIGINT + s), lambda i: exp(i * ln(m) - m - lgamma(i + 1)))) AS p FROM (SELECT *, (lo + hi) / 2 AS m FROM b WHERE step < 60)))
)
SELECT event_type, round(any_value(k / n), 9) AS value, round(max(lo) FILTER (s = 0) / any_value(n), 9) AS lower, round(max(lo) FILTER (s = 1) / any_value(n), 9) AS upper FROM b WHERE step = 60 GROUP BY 1"""


@_query(_POISSON, "events")
def interval_poisson(d):
    m = Metric({"k": count(), "n": sum_(col("value"))}, lambda p: p["k"] / p["n"], group_by=("event_type",), interval=Interval("rate", "k", "n"))
    return _round(_metric(d, m, event_type="group0", value="value", lower="lower", upper="upper"), 9, "value", "lower", "upper")


# calendar and series


def _calendar(interval: str, zone: str = "UTC", every: int = 1):
    return lambda d: _metric(d, Metric({"n": count()}, group_by=(Calendar("ts", interval, zone, every),)), bucket="group0", value="value")


for _unit in ("hour", "day", "week", "month", "year"):
    _made = _calendar(_unit)
    _made.__name__ = f"calendar_{_unit}"
    _query(f"SELECT date_trunc('{_unit}', ts)::TIMESTAMP AS bucket, count(*)::DOUBLE AS value FROM events GROUP BY 1", "events")(_made)


@_query("SELECT date_trunc('day', ts - INTERVAL 5 HOUR)::TIMESTAMP + INTERVAL 5 HOUR AS bucket, count(*)::DOUBLE AS value FROM events GROUP BY 1", "events")
def calendar_timezone(d):  # the events are of January, when New York has one offset
    return _calendar("day", "America/New_York")(d)


@_query("SELECT time_bucket(INTERVAL 3 DAY, ts, TIMESTAMP '1970-01-01')::TIMESTAMP AS bucket, count(*)::DOUBLE AS value FROM events GROUP BY 1", "events")
def calendar_every(d):
    return _calendar("day", every=3)(d)


@_query("SELECT b AS bucket, count(event_id)::DOUBLE AS value FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-09', INTERVAL 1 DAY)) AS b) LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') ON date_trunc('day', ts) = b GROUP BY 1", "events")
def calendar_fill(d):
    span = Fill(datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 2, 10, tzinfo=UTC))
    m = Metric({"n": count()}, group_by=(Calendar("ts", "day"),), where=(_p("event_type", "=", "error"),), fill=span)
    return _metric(d, m, bucket="group0", value="value")


@_query("SELECT hour(ts)::DOUBLE AS slot, event_type, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2", "events")
def cycle_hour_of_day(d):
    return _metric(d, Metric({"n": count()}, group_by=(Calendar("ts", "hourOfDay"), "event_type")), slot="group0", event_type="group1", value="value")


@_query("SELECT isodow(ts)::DOUBLE AS slot, round(sum(value), 4) AS value FROM events GROUP BY 1", "events")
def cycle_day_of_week(d):
    m = Metric({"s": sum_(col("value"))}, group_by=(Calendar("ts", "dayOfWeek"),), fill=Fill())
    return _round(_metric(d, m, slot="group0", value="value"), 4, "value")


@_query("SELECT isodow(day)::DOUBLE AS slot, count(*) AS occurrences, sum(n)::BIGINT AS count, round(avg(n), 6) AS value FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1) GROUP BY 1", "events")
def occurrence_mean(d):
    got = series.occurrences(d.rows, d.schema, Metric({"n": count()}, group_by=(Calendar("ts", "dayOfWeek"),), fill=Fill()), now=NOW)
    return _round(_named(got, slot="group0", occurrences="occurrences", count="count", value="value"), 6, "value")


@_query("SELECT isodow(day)::DOUBLE AS slot, count(*) AS n, min(n)::DOUBLE AS low, round(quantile_cont(n, 0.25), 6) AS q1, median(n)::DOUBLE AS median, round(quantile_cont(n, 0.75), 6) AS q3, max(n)::DOUBLE AS high FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1) GROUP BY 1", "events")
def occurrence_box(d):
    got = series.occurrence_box(d.rows, d.schema, Metric({"n": count()}, group_by=(Calendar("ts", "dayOfWeek"),), fill=Fill()), now=NOW)
    return _round(_named(got, slot="group0", n="n", low="low", q1="q1", median="median", q3="q3", high="high"), 6, "q1", "q3")


_DAYS = "WITH s AS (SELECT unnest(generate_series(min(date_trunc('day', o_orderdate))::TIMESTAMP, max(date_trunc('day', o_orderdate))::TIMESTAMP, INTERVAL 1 DAY)) AS bucket FROM orders), g AS (SELECT bucket, count(o_orderkey)::DOUBLE AS n, coalesce(sum(o_custkey), 0) AS s FROM s LEFT JOIN orders ON date_trunc('day', o_orderdate) = bucket GROUP BY 1) "


def _trailing(d: Dataset, t: Trailing, **parts) -> DataFrame:
    m = Metric(parts or {"n": count()}, (lambda p: p["s"] / p["n"]) if parts else None, group_by=(Calendar("o_orderdate", "day"),), fill=Fill(), trailing=t)
    return _metric(d, m, bucket="group0", value="value", intervals="intervals")


@_query(_DAYS + "SELECT bucket, CASE WHEN count(*) OVER w = 7 THEN round(sum(s) OVER w / nullif(sum(n) OVER w, 0), 6) END AS value, count(*) OVER w AS intervals FROM g WINDOW w AS (ORDER BY bucket ROWS 6 PRECEDING)", "orders")
def window_trailing_total(d):
    return _round(_trailing(d, Trailing(7), s=sum_(col("o_custkey")), n=count()), 6, "value")


@_query(_DAYS + "SELECT bucket, sum(n) OVER (ORDER BY bucket) AS value, count(*) OVER (ORDER BY bucket) AS intervals FROM g", "orders")
def window_running(d):
    return _trailing(d, Trailing(None))


@_query(_DAYS + "SELECT bucket, round(avg(n) OVER w, 6) AS value, count(*) OVER w AS intervals FROM g WINDOW w AS (ORDER BY bucket ROWS 27 PRECEDING)", "orders")
def window_mean(d):
    return _round(_trailing(d, Trailing(28, "mean", partial=True)), 6, "value")


@_query("SELECT o_orderstatus AS status, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 9) AS value FROM orders GROUP BY 1", "orders")
def share_total(d):
    return _round(_metric(d, Metric({"s": sum_(col("o_totalprice"))}, group_by=("status",), share="total"), status="group0", value="value"), 9, "value")


@_query("SELECT o_orderstatus AS status, o_orderpriority AS priority, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 9) AS value FROM orders GROUP BY 1, 2", "orders")
def share_group0(d):
    return _round(_metric(d, Metric({"n": count()}, group_by=("status", "priority"), share="group0"), status="group0", priority="group1", value="value"), 9, "value")


@_query("SELECT date_trunc('month', ts)::TIMESTAMP AS bucket, count(*)::DOUBLE AS value FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY 1", "events")
def whole_intervals(d):
    clock = datetime(2024, 2, 20, tzinfo=UTC)
    m = Metric({"n": count()}, group_by=(Calendar("ts", "month"),))
    made = series.bounded(m, datetime(2023, 12, 5, tzinfo=UTC), datetime(2024, 3, 1, tzinfo=UTC), clock)
    return _named(evaluate(d.rows, d.schema, made, clock).buckets, bucket="group0", value="value").where("value > 0")


# groups as rows

_HAVING = [_p("n", ">=", "50"), _p("total", ">", "0")]


def _by_priority(d: Dataset) -> DataFrame:
    parts = {"s": sum_(col("o_totalprice")), "n": count()}
    made = [Summary("n", count()), Summary("total", sum_(col("o_totalprice"))), Summary("mean", parts=parts, formula=lambda p: p["s"] / S.nullif(p["n"], 0)), Summary("buyers", count_distinct(col("o_custkey")))]
    return grouping.groups(_where(d, {"any": [_p("status", "=", "F"), _p("status", "=", "O")]}), d.schema, ["priority", "status"], made)


_GROUPED = FieldSchema((Field(grouping.IDENTITY, "text"), Field("priority", "text"), Field("status", "enum"), Field("n", "number"), Field("total", "number"), Field("mean", "number"), Field("buyers", "number", groupable=True)), grouping.IDENTITY)


@_query("SELECT '[[\"priority\",\"' || o_orderpriority || '\"],[\"status\",\"' || o_orderstatus || '\"]]' AS __group_id, o_orderpriority AS priority, o_orderstatus AS status, count(*)::DOUBLE AS n, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice) / count(*), 4) AS mean, count(DISTINCT o_custkey)::DOUBLE AS buyers FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 2, 3", "orders")
def group_rows(d):
    got = _by_priority(d)
    return _round(_round(got.select(grouping.IDENTITY, "priority", "status", "n", "total", "mean", "buyers"), 2, "total"), 4, "mean")


@_query("SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*)::DOUBLE AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2 HAVING count(*) >= 50 AND sum(o_totalprice) > 0 ORDER BY sum(o_totalprice) DESC LIMIT 5", "orders")
def group_having(d):
    kept = filters.where(_by_priority(d), _GROUPED, _HAVING, NOW)
    return _round(rows.page(kept, _GROUPED, ["priority", "status", "n", "total"], [Order("total", descending=True)], 5).select("priority", "status", "n", "total"), 2, "total")


@_query("SELECT o_custkey::DOUBLE AS customer, count(*)::DOUBLE AS n, max_by(o_orderkey, (o_totalprice, o_orderkey))::DOUBLE AS best, max_by(o_orderstatus, (o_totalprice, o_orderkey)) AS best_status FROM orders GROUP BY 1", "orders")
def group_representative(d):
    made = [Summary("n", count()), Summary("best", row="o_orderkey"), Summary("best_status", row="status")]
    got = grouping.groups(d.rows, d.schema, ["o_custkey"], made, [Order("price", descending=True)])
    return got.select(F.col("o_custkey").alias("customer"), "n", "best", "best_status")


@_query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, max(o_totalprice) AS dearest FROM orders GROUP BY 1", "orders")
def group_calendar_key(d):
    return grouping.groups(d.rows, d.schema, [Calendar("o_orderdate", "month")], [Summary("dearest", max_(col("o_totalprice")))]).select(F.col("o_orderdate").alias("month"), "dearest")


@_query("SELECT count(*)::DOUBLE AS value, sum(n)::DOUBLE AS y FROM (SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderpriority, o_orderstatus) WHERE n >= 50", "orders")
def metrics_over_groups(d):
    m = Metric({"g": count(), "n": sum_(col("n"))}, lambda p: p["g"], lambda p: p["n"], where=(_p("n", ">=", "50"),))
    return _named(evaluate(_by_priority(d), _GROUPED, m, NOW).buckets, value="value", y="y")


@_query("SELECT event_id::DOUBLE AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' AND event_type = 'error'", "events")
def drilldown_bucket(d):
    m = Metric({"n": count()}, group_by=(Calendar("ts", "week"), "kind"))
    return bucket_rows(d, d.schema, m, [datetime(2024, 1, 8, tzinfo=UTC), None], NOW).select("event_id")


@_query("SELECT event_id::DOUBLE AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-06' AND ts < TIMESTAMP '2024-01-09' AND event_type = 'click'", "events")
def drilldown_window(d):
    m = Metric({"n": count()}, group_by=(Calendar("ts", "day"), "event_type"), fill=Fill(), trailing=Trailing(3))
    return bucket_rows(d, d.schema, m, [datetime(2024, 1, 8, tzinfo=UTC), "click"], NOW).select("event_id")


@_query("SELECT event_id::DOUBLE AS event_id FROM events WHERE value >= 25 AND value <= 50 AND event_type = 'click'", "events")
def drilldown_bin(d):
    return bucket_rows(d, d.schema, Metric({}, group_by=("event_type",)), ["click"], NOW, ("value", 25.0, 50.0, True)).select("event_id")


@_query("SELECT o_orderpriority AS priority, count(*)::DOUBLE AS n, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice) / count(*), 4) AS mean FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING count(*) >= 10", "orders")
def flagship(d):
    """Filter, group, formula, HAVING and order in one plan."""
    parts = {"s": sum_(col("o_totalprice")), "n": count()}
    made = [Summary("n", count()), Summary("total", sum_(col("o_totalprice"))), Summary("mean", parts=parts, formula=lambda p: p["s"] / S.nullif(p["n"], 0))]
    got = grouping.groups(_where(d, {"any": [_p("status", "=", "F"), _p("status", "=", "O")]}), d.schema, ["priority"], made)
    schema = FieldSchema((Field(grouping.IDENTITY, "text"), Field("priority", "text"), Field("n", "number"), Field("total", "number"), Field("mean", "number")), grouping.IDENTITY)
    kept = filters.where(got, schema, [_p("n", ">=", "10")], NOW)
    return _round(_round(rows.page(kept, schema, ["priority", "n", "total", "mean"], [Order("total", descending=True)], 100).drop(grouping.IDENTITY), 2, "total"), 4, "mean")


# a relation that is itself a join


def _sales(lines: Dataset, orders: Dataset, customers: Dataset) -> Dataset:
    joined = lines.source.join(orders.source, F.col("l_orderkey") == F.col("o_orderkey")).join(customers.source, F.col("o_custkey") == F.col("c_custkey"))
    fields = (*lines.schema.fields, Field("segment", "enum", "c_mktsegment"), Field("ordered", "datetime", "o_orderdate", groupable=True))
    return Dataset(FieldSchema(fields, "id"), joined)


_SALES = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "


@_query("SELECT c_mktsegment AS segment, round(sum(l_extendedprice * (1 - l_discount)), 0) AS value, count(*) AS count " + _SALES + "WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1", "lineitem", "orders", "customer")
def join_revenue_by_segment(lines, orders, customers):
    d = _sales(lines, orders, customers)
    revenue = col("l_extendedprice") * (1 - col("l_discount"))
    kept = filters.of_dataset(d, [_p("l_shipdate", ">=", "1996-01-01")], NOW)
    got = evaluate(kept, d.schema, Metric({"r": sum_(revenue)}, group_by=("segment",)), NOW).buckets
    return _round(_named(got, segment="group0", value="value", count="count"), 0, "value")


@_query("SELECT c_mktsegment AS segment, date_trunc('year', o_orderdate)::TIMESTAMP AS year, quantile_cont(l_quantity, 0.5) AS value " + _SALES + "GROUP BY 1, 2", "lineitem", "orders", "customer")
def join_median_by_segment_and_year(lines, orders, customers):
    d = _sales(lines, orders, customers)
    m = Metric({"q": median(col("l_quantity"))}, group_by=(Calendar("ordered", "year"), "segment"))
    return _named(evaluate(d.rows, d.schema, m, NOW).buckets, segment="group1", year="group0", value="value")
