"""What several operators of this package share: shared storage and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own; a
    cluster without it is an error, because executors could not see each other's files.
    """
    path = spark.conf.get(SHARED, None)
    if path:
        return path.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {SHARED} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="simjoin-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_made: list[list[str]] = []  # of the open ``scratch`` blocks


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again; cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes the table of a frame that ``stored`` has made and nothing reads any more."""
    _delete(df.sparkSession, df.stored_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at the end of the block, all tables that operators have stored in it.

    Results are lazy and read those tables, so write a result before the block ends. Gives
    the list of what will go; a path that is taken off it stays.
    """
    _made.append([])
    try:
        yield _made[-1]
    finally:
        for path in _made.pop():
            _delete(spark, path)


#: What gives the same rows in the same partitions whenever it is computed. An RDD need not: its rows may come in another order.
_STEADY = ("Project", "Filter", "SubqueryAlias", "LogicalRelation", "LocalRelation", "Range", "View")


def steady(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it only reads, selects and filters a table; else stored first.

    For operators that number rows by their place in a partition and read them again.
    """

    def only_reads(node) -> bool:
        children = node.children()
        return node.nodeName() in _STEADY and all(only_reads(children.apply(i)) for i in range(children.size()))

    plan = df._jdf.queryExecution().optimizedPlan()
    return df if plan.deterministic() and only_reads(plan) else stored(df, name)


#: Bits of a sieve for each id, and at most (a table of 2^19 pairs of numbers).
SIEVE_BITS, SIEVE_MOST = 16, 1 << 25


@dataclass(frozen=True)
class Sieve:
    """A bitmap of hashed ids, of bounded size, that tells rows that surely lack from rows that may have one of them.

    It is a filter before a join, never instead of one: beyond two million ids it lets more
    other rows pass, which costs their way through the join and nothing else.
    """

    words: DataFrame  # (w, mask): 64 bits each, those with any bit set
    bits: int

    @staticmethod
    def of(ids: DataFrame) -> Sieve:
        """Of the first column of ``ids``, a stored table of integers."""
        n = ids.count()
        bits = min(SIEVE_MOST, max(1 << 10, 1 << (SIEVE_BITS * n).bit_length()))
        bit = _bit(F.col(ids.columns[0]), bits)
        return Sieve(ids.groupBy(F.shiftrightunsigned(bit, 6).alias("w")).agg(F.bit_or(_mask(bit)).alias("mask")), bits)


def _bit(id_: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(id_.cast("long")), F.lit(bits).cast("long"))


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))


def sifted(df: DataFrame, own: Column, sieve: Sieve, has: bool = True) -> DataFrame:
    """The rows of ``df`` whose id, ``own``, the sieve may have, or else those whose id it surely lacks (nulls among them)."""
    words, bit = sieve.words.select("w", "mask"), _bit(own, sieve.bits)
    on = (F.shiftrightunsigned(bit, 6) == words["w"]) & (words["mask"].bitwiseAND(_mask(bit)) != 0) & own.isNotNull()
    return df.join(F.broadcast(words), on, "left_semi" if has else "left_anti")


#: A key with more rows than this, and than a thousandth of all, is frequent; so there are a thousand at most.
FREQUENT, SHARES = 10_000, 1_000


def frequent(counted: DataFrame, total: int) -> DataFrame:
    """The keys (all columns but ``copies``) of the frequent rows of ``counted``."""
    return counted.where(F.col("copies") > max(FREQUENT, total // SHARES)).drop("copies")


def uneven_join(left: DataFrame, right: DataFrame, hot: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, of which a key has one row, where few keys may have most of left's rows.

    ``hot`` has the frequent keys, a thousand at most, so their rows of ``right`` are
    broadcast; the other keys meet in a shuffle, as all do if no key is frequent.
    """
    if not hot.limit(1).count():
        return left.join(right, key, how)
    hot = F.broadcast(hot.select(key))
    often = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how)
    return often.unionByName(left.join(hot, key, "left_anti").join(right, key, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_schema(batches: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for columns in batches:
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column; null becomes the empty string."""
    return [x or "" for x in column.to_pylist()]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns cannot clash with those an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])
