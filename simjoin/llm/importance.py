"""Importance resampling towards a target distribution, by hashed n-grams.

The features of both corpora are counted in buckets. A bucket's gain, the logarithm of how
much more frequent it is in the target, is an array of fixed size that every task holds, so
that a text is scored by looking its features up. Documents then draw by perturbed scores
(Gumbel noise from a hash of the id): the highest are a sample without replacement in
proportion to exp(weight).

The draw sorts nothing as a whole. Scores are whole numbers; an exact histogram of them, summed
from the top, gives the offset of every score's ranks and the score at which the draw ends.
Only the rows from there on are ranked, by id within their score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simjoin.llm.common import own_columns, partitions, stored

BUCKETS = 10_000
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
#: Ids that share a key of the histogram beside the score, so that one score is no task's whole work.
IDS = 1 << 20

# Fixed value: words are runs of digits, letters in lower case and all that is not ASCII.
_CLASS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Resampling:
    """Parameters: ``percent`` of the documents with ``least`` words are drawn; features are runs of up to ``longest`` words."""

    buckets: int = BUCKETS
    longest: int = 1
    least: int = 20
    percent: int = 10
    seed: int = 2024


def words(text: str) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about a megabyte."""
    raw = text.encode().translate(_CLASS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        if found := raw[at:end].split():
            yield found
        at = end


def feature_buckets(text: str, how: Resampling) -> Iterator[tuple[np.ndarray, int]]:
    """The buckets of a text's features, and how many words they are of, piece by piece."""
    tail: list[bytes] = []
    for new in words(text):
        found = [np.fromiter(map(zlib.crc32, new), np.uint32, len(new)) % how.buckets]
        held = tail + new
        for n in range(2, how.longest + 1):
            first = max(0, len(tail) - n + 1)  # runs that end among the tail's words were told before
            runs = [zlib.crc32(b" ".join(held[i : i + n])) for i in range(first, len(held) - n + 1)]
            found.append(np.array(runs, np.uint32) % how.buckets)
        tail = held[len(held) - how.longest + 1 :] if how.longest > 1 else []
        yield np.concatenate(found).astype(np.int64), len(new)


def bucket_counts(texts: DataFrame, how: Resampling = Resampling()) -> np.ndarray:
    """How many features all rows of ``texts`` (text; null: none) have in each bucket.

    A task adds up its own rows, so that what is brought together is its counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(how.buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found, _ in feature_buckets(text.as_py() or "", how):
                    total += np.bincount(found, minlength=how.buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    counted = own_columns(texts, "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(how.buckets, np.int64)
    for row in counted.collect():  # a row per bucket
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))."""
    s, t, size = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, how: Resampling = Resampling()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, n_words, weight, score (all long).

    A null or empty text has no features and weight 0. A null doc_id is hashed as an empty
    string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((len(batch), 3), np.int64)
            for i, text in enumerate(batch.column(1)):
                for found, n in feature_buckets(text.as_py() or "", how):
                    rows[i] += (len(found), n, gain[found].sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T)], names=["doc_id", "n_features", "n_words", "weight"])

    named = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weighed = named.mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise.cast("long"))


def histogram(eligible: DataFrame) -> DataFrame:
    """Of each score and slice of ids, how many rows it has and how many come before it: (score, slice, n, before).

    Higher scores come first, then smaller ids; a null id comes last. The rows are dealt to
    ranges and summed there; only the ranges' totals meet on the driver.
    """
    slice_ = F.coalesce(F.expr(f"doc_id div {IDS}"), F.lit((1 << 63) - 1)).alias("slice")
    counted = eligible.groupBy("score", slice_).agg(F.count("*").alias("n"))
    order = [F.desc("score"), F.asc("slice")]
    # stored, as the bounds of ranges may differ when they are drawn again
    ranges = stored(counted.repartitionByRange(partitions(eligible.sparkSession), *order).withColumn("range", F.spark_partition_id()), "histogram")
    totals, offset, base = ranges.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect(), 0, []
    for row in totals:
        base.append((row["range"], offset))
        offset += row["n"]
    base_of = F.broadcast(eligible.sparkSession.createDataFrame(base, "range int, base long"))  # a row per range
    upto = F.sum("n").over(W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranges.withColumn("upto", upto).join(base_of, "range").select("score", "slice", "n", (F.col("base") + F.col("upto") - F.col("n")).alias("before"))


def drawn(rows: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """``scored`` rows with their rank in the draw: null, or 1, 2, 3, ... by score, then smaller doc_id.

    Rows of fewer than ``least`` words take no part. Of the others, ``percent`` of a hundred
    are drawn, rounded down. Null ids come last among equal scores; rows that agree in score
    and id are ordered by their other columns. An empty table gives an empty result.
    """
    rows = stored(rows, "scores")
    eligible = rows.where(F.col("n_words") >= how.least)
    quota = how.percent * eligible.count() // 100
    before = stored(histogram(eligible).where(F.col("before") < quota), "offsets")
    cutoff = before.agg(F.min("score")).first()[0]
    if cutoff is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    slice_ = F.coalesce(F.expr(f"doc_id div {IDS}"), F.lit((1 << 63) - 1))
    surviving = (F.col("n_words") >= how.least) & (F.col("score") >= cutoff)
    within = F.row_number().over(W.partitionBy("score", "slice").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "n_words"))
    ranked = rows.where(surviving).withColumn("slice", slice_).join(before.drop("n"), ["score", "slice"], "left").withColumn("rank", F.col("before") + within)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank"))).select(*rows.columns, "rank")
    return ranked.unionByName(rows.where(~surviving).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_features, n_words, weight, score, rank.

    ``target`` (text) is what the draw should look like; if neither has features, all gains
    are 0. Other columns are ignored; see ``scored`` and ``drawn`` for nulls and ties.
    """
    gain = gains(bucket_counts(docs, how), bucket_counts(target, how))
    return drawn(scored(docs, gain, how), how)
