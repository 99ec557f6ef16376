import pytest
from pyspark.sql import functions as F

from sumac.functions.scalar import col
from sumac.operators import distributions, percentiles
from sumac.schema import Field, FieldSchema

SCHEMA = FieldSchema((Field("id", "number"), Field("g", "text"), Field("x", "number")), "id")


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_large_groups_give_the_same(spark, monkeypatch, keys):
    monkeypatch.setattr(percentiles, "SMALL", 500)
    monkeypatch.setattr(percentiles, "ACCURACY", 100)
    frame = spark.range(6000).select(
        F.col("id").cast("double"), F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 < 3, F.lit("b")).when(F.col("id") < 40, "c").otherwise("a").alias("g"),
        F.when(F.col("id") % 17 > 0, F.pmod(F.xxhash64("id"), F.lit(900)).cast("double") - 400).alias("x"),
    )
    p = [0.0, 0.013, 0.25, 0.5, 0.77, 0.999, 1.0]
    names = [f"group{k}" for k in range(len(keys))]
    got = distributions.quantiles(frame, SCHEMA, col("x"), p, keys)
    plain = frame.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.percentile("x", F.array(*map(F.lit, p))).alias("values"))
    rounded = lambda f: sorted(([*[r[n] for n in names], [round(v, 9) for v in r["values"]]] for r in f.collect()), key=str)
    assert rounded(got) == rounded(plain)
    assert distributions.quantiles(frame.where("false"), SCHEMA, col("x"), p, keys).count() == (0 if keys else 1)


def test_boxes_list_their_outliers(spark):
    values = [float(x) for x in [*range(100), *[1000 + k for k in range(30)], -500, -500, -400]]
    frame = spark.createDataFrame([(float(k), "a", v) for k, v in enumerate(values)] + [(900.0, "b", 1.0), (901.0, "b", None)], "id double, g string, x double")
    got = {r["group0"]: r for r in distributions.box(frame, SCHEMA, col("x"), ("g",), distributions.Box("tukey")).collect()}
    q1, q3 = got["a"]["q1"], got["a"]["q3"]
    out = sorted(v for v in values if not q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1))
    assert got["a"]["outlier_count"] == len(out) > 2 * distributions.LISTED and got["a"]["outliers"] == out[:10] + out[-10:]
    assert (got["b"]["low"], got["b"]["high"], got["b"]["outliers"], got["b"]["null_count"]) == (1.0, 1.0, [], 1)
    for whiskers in ("minmax", "tukey", "percentile"):
        none = distributions.box(frame.where("false"), SCHEMA, col("x"), (), distributions.Box(whiskers)).collect()
        assert [(r["count"], r["n"], r["median"], r["outlier_count"], r["outliers"]) for r in none] == [(0, 0, None, 0, None)]
        whole = distributions.box(frame, SCHEMA, col("x"), (), distributions.Box(whiskers)).collect()[0]
        assert (whole["count"], whole["n"], whole["null_count"]) == (135, 134, 1)
