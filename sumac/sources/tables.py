"""Relations to bind schemas to: files of any format that Spark reads, and the tables of a folder with their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sumac.errors import QueryError
from sumac.schema import Dataset, Field, FieldSchema

FORMATS = ("parquet", "orc", "json", "csv", "text", "avro")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A relation from files. Text formats need a schema: it is never inferred, which would read the files twice."""
    if kind not in FORMATS:
        raise QueryError("unknown_format", kind)
    if kind in ("json", "csv") and schema is None:
        raise QueryError("missing_schema", f"{kind} files need a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(frame: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    writer = frame.write.format(kind).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def sql(spark: SparkSession, query: str, **args) -> DataFrame:
    """A trusted statement of the host as a relation; its arguments are bound, not pasted."""
    return spark.sql(query, args=args or None)


#: The declared schemas of the test tables. Identities are unique; ``lineitem`` needs four columns for one.
SCHEMAS = {
    "orders": FieldSchema(
        (
            Field("o_orderkey", "number", groupable=True), Field("o_custkey", "number", groupable=True), Field("o_orderstatus", "enum", aliases=("status",)),
            Field("o_totalprice", "number", aliases=("price",)), Field("o_orderdate", "datetime", groupable=True), Field("o_orderpriority", "text", aliases=("priority",)),
        ),
        "o_orderkey",
    ),
    "events": FieldSchema(
        (
            Field("event_id", "number"), Field("ts", "datetime", groupable=True), Field("user_id", "number", groupable=True), Field("event_type", "enum"),
            Field("kind", "text", "nullif(event_type, 'error')"), Field("value", "number"), Field("amount", "number", "CASE WHEN event_type <> 'view' THEN value END"), Field("props", "text"),
        ),
        "event_id",
    ),
    "part": FieldSchema(
        (
            Field("p_partkey", "number"), Field("p_name", "text"), Field("p_brand", "enum"), Field("p_type", "text"), Field("words", "textarray", "split(p_name, ' ')"),
            Field("p_size", "number", groupable=True), Field("p_retailprice", "number"),
        ),
        "p_partkey",
    ),
    "customer": FieldSchema((Field("c_custkey", "number"), Field("c_name", "text"), Field("c_nationkey", "number", groupable=True), Field("c_acctbal", "number"), Field("c_mktsegment", "enum")), "c_custkey"),
    "lineitem": FieldSchema(
        (
            Field("id", "text", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)", groupable=False), Field("l_orderkey", "number", groupable=True), Field("l_partkey", "number"),
            Field("l_quantity", "number", groupable=True), Field("l_extendedprice", "number"), Field("l_discount", "number", groupable=True), Field("l_tax", "number"), Field("l_returnflag", "enum"),
            Field("l_linestatus", "enum"), Field("l_shipdate", "datetime", groupable=True),
        ),
        "id",
    ),
}


def dataset(spark: SparkSession, folder: str, name: str) -> Dataset:
    return Dataset(SCHEMAS[name], read(spark, f"{folder}/{name}.parquet"))
