"""Line dedup over a corpus, in DataFrame functions alone.

A line's key is its stripped, lower-cased text. The keys' digests are dealt to ranges and
sorted by document and position inside them, so that a window reads each key's lines in
that order and tells the first document from the others. Digests that very many lines share
would be one task's work; of these, a thousand at most, the first document comes from an
aggregation and is broadcast to their lines, which then do not move at all.

What comes back is a bitmap per document, not its text, and only words of the bitmap in
which lines go are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simjoin.llm.common import FREQUENT, SHARES, Sieve, own_columns, partitions, sifted, stored

#: Code points of a key, at least, for its lines to count as repeated.
LEAST = 10
#: Items that the sketch of frequent digests tracks; it errs by less than a thousandth of a thousandth part of this.
TRACKED = 10_000
# Fixed value: what is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The type of a bitmap; a word stands for 64 lines, those of ``word`` x 64 and on, and a bit is set for a line that stays.
BITMAP = "array<struct<word:int,mask:bigint>>"


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash); the hash tells apart the rows that share an id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text, F.xxhash64(text).alias("text_hash"))


def _lines(text: str = "text") -> Column:
    return F.split(text, "\n", -1)


def line_keys(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The lines whose key has ``least`` code points: (digest, doc_id, text_hash, position).

    ``digest`` is the first half of the key's SHA-256.
    """
    key = F.translate("line", UPPER, LOWER)
    lines = _texts(docs).select("doc_id", "text_hash", F.posexplode(_lines()).alias("position", "line")).withColumn("line", F.btrim("line", F.lit(BLANKS)))
    # lower case leaves the length as it is, and is made for long enough lines alone
    return lines.where(F.length("line") >= least).select(F.substring(F.unhex(F.sha2(key, 256)), 1, 16).alias("digest"), "doc_id", "text_hash", "position")


def _frequent(lines: DataFrame) -> DataFrame:
    """The digests, by their hash ``h``, of more lines than ``FREQUENT`` and than a thousandth of all: a thousand rows at most.

    A sketch that errs by a fraction of a thousandth finds them, so some with a little less
    may be among them. Which they are decides where lines are compared and nothing else.
    """
    # one aggregate gives both, so the table is read once
    told = lines.select(F.xxhash64("digest").alias("h")).agg(F.expr(f"approx_top_k(h, {SHARES}, {TRACKED})").alias("top"), F.count("*").alias("n"))
    return told.select("n", F.inline("top").alias("h", "lines")).where(F.col("lines") > F.greatest(F.lit(FREQUENT), F.expr(f"n div {SHARES}"))).select("h")


def repeated(lines: DataFrame) -> DataFrame:
    """Those of ``line_keys`` that go, as (doc_id, text_hash, position): an earlier document holds their digest.

    Documents are in the order of doc_id, null last; ``lines`` must be a stored table.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("position").asc()]
    hot = stored(_frequent(lines), "hot-lines").hint("broadcast")
    h = F.xxhash64("digest")
    often = lines.join(hot, h == hot["h"], "left_semi")
    # max_by and the like do not tell nulls apart; a null id is the holder only if no other is
    holders = often.groupBy("digest").agg(F.min("doc_id").alias("holder"))
    moved = [often.join(F.broadcast(holders), "digest")]
    seldom = lines.join(hot, h == hot["h"], "left_anti")
    # the range partitioning on the digest is what the window needs, so nothing moves again
    ranges = seldom.repartitionByRange(partitions(lines.sparkSession), "digest").sortWithinPartitions("digest", *order)
    moved.append(ranges.withColumn("holder", F.first("doc_id").over(W.partitionBy("digest").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))))
    both = moved[0].select("doc_id", "text_hash", "position", "holder").unionByName(moved[1].select("doc_id", "text_hash", "position", "holder"))
    return both.where(~F.col("doc_id").eqNullSafe(F.col("holder"))).drop("holder")


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The bitmaps of the documents of which lines go: (doc_id, text_hash, keep, n_dropped).

    ``keep`` has, for 64 lines each, a mask of those that stay; words of which all stay are
    left out. Rows that share doc_id and text share their bitmap. See ``deduplicated`` for
    nulls and ties.
    """
    lines = stored(line_keys(docs, least), "line-keys")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.expr("position % 64"))
    words = repeated(lines).groupBy("doc_id", "text_hash", F.expr("position div 64").cast("int").alias("word")).agg(F.bit_or(bit).alias("gone"))
    word = F.struct("word", F.bitwise_not("gone").alias("mask"))
    found = words.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(word)).alias("keep"), F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"))
    return found.select("doc_id", "text_hash", F.col("keep").cast(BITMAP).alias("keep"), "n_dropped")


def kept_text(text: str, keep: str) -> Column:
    """The lines of ``text`` that the bitmap ``keep`` (null: all) lets stay, joined again."""
    after = lambda i: F.when(i > 0, F.get(keep, i - 1)["word"]).otherwise(-1)
    # every word in its place, up to the last in which lines go
    dense = F.flatten(F.transform(keep, lambda w, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), w["word"] - after(i) - 1), F.array(w["mask"]))))
    with_words = F.transform(F.array(dense), lambda words: F.array_join(F.filter(_lines(text), lambda line, i: F.coalesce(F.getbit(F.get(words, F.floor(i / 64).cast("int")), i % 64), F.lit(1)) == 1), "\n"))
    return F.when(F.col(keep).isNull(), F.col(text)).otherwise(F.get(with_words, 0))


def deduplicated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text without repeated lines, n_lines, n_dropped.

    Lines end at \\n. Of a key of ``least`` code points or more that several documents hold,
    the lines stay in the document of the smallest doc_id, all of them, and go elsewhere.

    A null or empty text is one empty line. Rows that share a doc_id are one holder: none of
    them loses a line to another. Null ids are one id, larger than all others. Repeated rows
    are told each by itself. Other columns are ignored; an empty table gives an empty result.
    """
    docs, marks = _texts(docs), stored(keep_bitmaps(docs, least), "keep-bitmaps")
    named = docs.withColumn("n_lines", F.size(_lines()).cast("long"))
    own = F.xxhash64("doc_id", "text_hash")
    sieve = Sieve.of(stored(marks.select(F.xxhash64("doc_id", "text_hash").alias("id")), "keep-ids"))
    whole = sifted(named, own, sieve, has=False).select("doc_id", "text", "n_lines", F.lit(0).cast("long").alias("n_dropped"))
    some = sifted(named, own, sieve).alias("d").join(marks.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_hash") == F.col("m.text_hash")), "left")
    some = some.select("d.doc_id", "d.text", "d.n_lines", "m.keep", F.coalesce("m.n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
    return some.select("doc_id", kept_text("text", "keep").alias("text"), "n_lines", "n_dropped").unionByName(whole)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of what ``deduplicated`` gives."""
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))
