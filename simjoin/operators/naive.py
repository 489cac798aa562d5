"""The exact join by blocks: every query meets every block of the database."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simjoin.functions.metric import Metric
from simjoin.operators.topk import QUERIES, Search, best, partitions, plain_search, searched

#: Objects of a block of the database.
BLOCK = 50_000
#: Pairs that are worth a task of their own.
PAIRS_OF_A_TASK = 1_000_000


def blocks_and_ways(n_q: int, n_db: int, tasks: int, block: int = BLOCK) -> tuple[int, int]:
    """Into how many blocks the database is dealt, and into how many the queries.

    Enough for the wanted number of tasks, and for the size of a block; among those, so that
    the fewest rows move: a query to each block, an object to each way.
    """
    tasks = max(1, min(tasks, n_q * n_db // PAIRS_OF_A_TASK))
    least = max(1, -(-n_db // block))
    blocks = max(least, min(round(math.sqrt(tasks * n_db / max(1, n_q))), tasks))
    return blocks, max(1, -(-n_q // QUERIES), -(-tasks // blocks))


def joined_by_blocks(queries: DataFrame, database: DataFrame, k: int, search: Search, block: int = BLOCK) -> DataFrame:
    """Each query meets each block of the database, by ``search``, and the blocks' lists are merged.

    The database is dealt to blocks by a hash of the key, and each query goes to every
    block; a block returns its k nearest for each query. Query keys are unique. Nothing is
    broadcast, and each object moves ``ways`` times, the number of query blocks. The number
    of blocks follows the work and the cluster, not the tables, until a block is full.
    """
    n_db, n_q = database.count(), queries.count()
    blocks, ways = blocks_and_ways(n_q, n_db, partitions(database), block)
    database = database.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("string"))
    queries = queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<string>")))
    shares = None if ways == 1 else F.broadcast(queries.sparkSession.range(blocks).select(F.col("id").cast("string").alias("g"), F.lit(ways).alias("ways"), F.lit(1).alias("parts")))
    return best(searched(queries, database, search, shares=shares), k, repeated=False)


def knn_naive(queries: DataFrame, database: DataFrame, k: int, metric: Metric | None = None, block: int = BLOCK) -> DataFrame:
    """The k nearest objects of each query; both sides have key, classification, vector."""
    return joined_by_blocks(queries, database, k, plain_search(k, metric), block)
