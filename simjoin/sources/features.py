"""Feature records: text lines ``id;classification;other;bin:value;...`` and adapters.

The canonical row is (key, classification, other, bin_keys, bin_values); ``key`` is a struct
of three integers whose order is that of its parts. Joins take (key, classification, vector).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "struct<five_minute_id:int,client_id:int,server_id:int>"


def parse_key(text: Column) -> Column:
    """``a``, ``a_b`` or ``a_b_c``; a single part is the client's id."""
    parts, zero = F.split(text, "_"), F.lit(0)
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)).cast("int"), zero)
    one = F.size(parts) == 1
    return F.struct(F.when(one, zero).otherwise(at(0)).alias("five_minute_id"), F.when(one, at(0)).otherwise(at(1)).alias("client_id"), at(2).alias("server_id"))


def format_key(key: Column) -> Column:
    """``a_b``, with a third part only if it is not zero."""
    third = F.when(key["server_id"] != 0, key["server_id"].cast("string"))
    return F.concat_ws("_", key["five_minute_id"].cast("string"), key["client_id"].cast("string"), third)


def parse_classified_key(text: Column) -> Column:
    """``key:class`` as a struct of both."""
    return F.struct(parse_key(F.substring_index(text, ":", 1)).alias("key"), F.substring_index(text, ":", -1).cast("int").alias("classification"))


def format_classified_key(key: Column, classification: Column) -> Column:
    return F.concat_ws(":", format_key(key), classification.cast("string"))


def without_prefix(line: Column) -> Column:
    """The record behind the first comma, if there is one."""
    return F.when(F.instr(line, ",") > 1, F.substring(line, F.instr(line, ",") + 1, F.length(line))).otherwise(line)


#: What a record looks like: a key, a class, a default, and bins with their values.
RECORD = r"^\s*\d+(_\d+){0,2};-?\d+;[^;:]+(;\d+:[^;:]+)*;?\s*$"


def checked(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """The records of those lines that are well formed, and the other lines (``line``), without blank ones.

    A line is well formed if it has the shape of a record and all its numbers are numbers
    that fit. Both read the lines, so keep them stored where they come from.
    """
    line, parts = without_prefix(F.col(column)), F.split(without_prefix(F.col(column)), ";")
    bins = F.filter(F.slice(parts, 4, 1 << 30), lambda b: F.length(F.trim(b)) > 0)
    number = lambda x: F.trim(x).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    whole = lambda x: F.length(F.regexp_replace(F.trim(x), "^-?0*", "")) <= 9
    keys = F.forall(F.split(F.get(parts, F.lit(0)), "_"), whole)
    good = line.rlike(RECORD) & keys & whole(F.get(parts, F.lit(1))) & number(F.get(parts, F.lit(2))) & F.forall(bins, lambda b: whole(F.split_part(b, F.lit(":"), F.lit(1))) & number(F.split_part(b, F.lit(":"), F.lit(2))))
    rows = lines.where(F.length(F.trim(F.col(column))) > 0)
    good = F.coalesce(good, F.lit(False))
    return parse(rows.where(good), column), rows.where(~good).select(F.col(column).alias("line"))


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records of text lines; blank lines are left out, a malformed one is an error (``checked`` sets them aside)."""
    line = without_prefix(F.col(column))
    parts = F.split(line, ";")
    ok = line.rlike(RECORD)
    checked = F.when(ok, parts).otherwise(F.raise_error(F.concat(F.lit("malformed feature record: "), line)).cast("array<string>"))
    bins = F.filter(F.slice(F.col("p"), 4, 1 << 30), lambda b: F.length(F.trim(b)) > 0)
    rows = lines.where(F.length(F.trim(F.col(column))) > 0).select(checked.alias("p")).withColumn("b", bins)
    pick = lambda i, kind: F.transform("b", lambda x: F.trim(F.split(x, ":")[i]).cast(kind))
    return rows.select(parse_key(F.trim(F.col("p")[0])).alias("key"), F.col("p")[1].cast("int").alias("classification"), F.col("p")[2].cast("float").alias("other"), pick(0, "int").alias("bin_keys"), pick(1, "float").alias("bin_values"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def to_lines(features: DataFrame) -> DataFrame:
    bins = F.zip_with("bin_keys", "bin_values", lambda k, v: F.concat_ws(":", k.cast("string"), v.cast("string")))
    head = F.concat_ws(";", format_key(F.col("key")), F.col("classification").cast("string"), F.col("other").cast("string"))
    return features.select(F.when(F.size(bins) > 0, F.concat_ws(";", head, F.array_join(bins, ";"))).otherwise(head).alias("value"))


def write(features: DataFrame, path: str) -> None:
    to_lines(features).write.mode("overwrite").text(path)


def dimension(features: DataFrame) -> int:
    """The last named bin of any record plus one."""
    last = features.agg(F.max(F.array_max("bin_keys"))).first()[0]
    return 0 if last is None else last + 1


def dense(features: DataFrame, dim: int | None = None) -> DataFrame:
    """(key, classification, vector): each bin up to ``dim`` with its value or the default."""
    dim = dimension(features) if dim is None else dim
    ascending = F.forall(F.sequence(F.lit(2), F.greatest(F.size("bin_keys"), F.lit(2))), lambda i: F.coalesce(F.get(F.col("bin_keys"), i - 2) < F.get(F.col("bin_keys"), i - 1), F.lit(True)))
    values = F.when(ascending, F.map_from_arrays("bin_keys", "bin_values")).otherwise(F.raise_error(F.lit("bins are not in ascending order")).cast("map<int,float>"))
    rows = features.select("key", "classification", "other", values.alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.col("other"))) if dim else F.array().cast("array<float>")
    return rows.select("key", "classification", vector.alias("vector"))


def from_vectors(df: DataFrame, key: str, vector: str, classification: str | None = None) -> DataFrame:
    """(key, classification, vector) of a table with a numeric key and an array of numbers; a long key stays one."""
    kind = "long" if df.schema[key].dataType.typeName() == "long" else "int"
    k = F.struct(F.lit(0).alias("five_minute_id"), F.col(key).cast(kind).alias("client_id"), F.lit(0).alias("server_id"))
    return df.select(k.alias("key"), (F.col(classification) if classification else F.lit(0)).cast("int").alias("classification"), F.col(vector).cast("array<float>").alias("vector"))


def sparse(objects: DataFrame, other: float = 0.0) -> DataFrame:
    """Dense rows as records: the bins that differ from ``other``, and always the last."""
    indexed = F.transform("vector", lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    named = F.filter(F.col("_bins"), lambda b: (b["v"] != F.lit(other).cast("float")) | (b["i"] == F.size("_bins") - 1))
    rows = objects.select("key", "classification", indexed.alias("_bins")).withColumn("_bins", named)
    return rows.select("key", "classification", F.lit(other).cast("float").alias("other"), F.col("_bins.i").alias("bin_keys"), F.col("_bins.v").alias("bin_values"))


def vectors_of_lines(spark: SparkSession, path: str, with_coordinates: bool = False) -> DataFrame:
    """K-means input: ``id;v1;v2;...`` (coords null) or ``id|coords;v1;...``; decimal commas are taken."""
    return parse_vector_lines(spark.read.text(path), with_coordinates)


def parse_vector_lines(lines: DataFrame, with_coordinates: bool = False) -> DataFrame:
    parts = F.split(F.col("value"), ";")
    head, bar = parts[0], F.instr(parts[0], "|")
    name = F.when(bar > 0, F.substring(head, 1, bar - 1)).otherwise(head) if with_coordinates else head
    coords = F.when(bar > 0, F.substring(head, bar, F.length(head))) if with_coordinates else F.lit(None).cast("string")
    numbers = F.transform(F.filter(F.slice(parts, 2, 1 << 30), lambda v: F.length(F.trim(v)) > 0), lambda v: F.replace(F.trim(v), F.lit(","), F.lit(".")).cast("double"))
    return lines.where(F.length(F.trim(F.col("value"))) > 0).select(F.trim(name).cast("int").alias("id"), coords.alias("coords"), numbers.alias("vector"))
