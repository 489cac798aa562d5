"""Neighbour lists as text lines ``qid,qclass<TAB>id|distance|class<TAB>...``.

The long form has a row per neighbour: query_key, query_class, rank, db_key, distance,
db_class. With ``layout="doc"`` an entry is id|class|distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simjoin.sources.features import format_key, parse_key

LAYOUTS = {"code": (1, 2), "doc": (2, 1)}  # places of distance and class in an entry


def nested(results: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_key, query_class, neighbours): one row per query.

    With ``queries`` (key, classification), those without a neighbour have an empty array.
    """
    entry = F.struct("rank", "db_key", "distance", "db_class")
    rows = results.groupBy("query_key", "query_class").agg(F.array_sort(F.collect_list(entry)).alias("neighbours"))
    if queries is None:
        return rows
    own = queries.select(F.col("key").alias("query_key"), F.col("classification").alias("query_class"))
    empty = F.array().cast(rows.schema["neighbours"].dataType)
    return own.join(rows, ["query_key", "query_class"], "left").withColumn("neighbours", F.coalesce("neighbours", empty))


def to_lines(results: DataFrame, queries: DataFrame | None = None, layout: str = "code") -> DataFrame:
    d, c = LAYOUTS[layout]
    fields = lambda n: [x for _, x in sorted([(0, format_key(n["db_key"])), (d, n["distance"].cast("string")), (c, n["db_class"].cast("string"))], key=lambda p: p[0])]
    entries = F.transform("neighbours", lambda n: F.concat_ws("|", *fields(n)))
    head = F.concat_ws(",", format_key(F.col("query_key")), F.col("query_class").cast("string"))
    return nested(results, queries).select(F.concat_ws("\t", F.concat(F.array(head), entries)).alias("value"))


def write(results: DataFrame, path: str, queries: DataFrame | None = None, layout: str = "code") -> None:
    to_lines(results, queries, layout).write.mode("overwrite").text(path)


def parse(lines: DataFrame, layout: str = "code") -> DataFrame:
    """The long form; ranks follow (distance, key), whatever the order in the line."""
    d, c = LAYOUTS[layout]
    parts = F.split("value", "\t")
    rows = lines.select(F.split(parts[0], ",").alias("q"), F.explode(F.slice(parts, 2, 1 << 30)).alias("e")).select("q", F.split("e", r"\|").alias("e"))
    rows = rows.select(parse_key(F.col("q")[0]).alias("query_key"), F.col("q")[1].cast("int").alias("query_class"), parse_key(F.col("e")[0]).alias("db_key"), F.col("e")[d].cast("float").alias("distance"), F.col("e")[c].cast("int").alias("db_class"))
    order = W.partitionBy("query_key").orderBy("distance", "db_key")
    return rows.select("query_key", "query_class", F.row_number().over(order).alias("rank"), "db_key", "distance", "db_class")


def read(spark: SparkSession, path: str, layout: str = "code") -> DataFrame:
    return parse(spark.read.text(path), layout)
