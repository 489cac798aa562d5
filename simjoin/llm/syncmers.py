"""Document fingerprints from closed syncmers.

A k-mer of a text's bytes is an anchor if the smallest of its inner s-mers, by hash, is its
first or its last. That depends on the k-mer alone, so a change elsewhere in the text moves
no anchor. A fingerprint is the anchors with the smallest hashes, each with its position;
likeness is the share of the joint smallest anchors that both texts have at one offset.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simjoin.llm.common import own_columns, partitions

K, S = 12, 4
#: Anchors of a fingerprint.
ANCHORS = 64
#: Anchors within this many bytes of the common offset are at that offset.
SLACK = 64
#: Ranges of documents for each shuffle partition.
RANGES = 4

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def anchors(data: bytes, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the closed syncmers of ``data`` (s is 4, k at most 12)."""
    n = len(data) - k + 1
    if n < 1:
        if not data:
            return np.empty(0, np.int64), np.empty(0, np.uint32)
        return np.zeros(1, np.int64), np.frombuffer(hashlib.blake2b(data, digest_size=4).digest(), "<u4").astype(np.uint32)
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    word = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
    h = word * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    w = k - s + 1
    least, have = h, 1
    while have < w:
        step = min(have, w - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = np.flatnonzero((h[:n] == least[:n]) | (h[w - 1 : w - 1 + n] == least[:n]))
    x = (word[at].astype(np.uint64) | word[at + 4].astype(np.uint64) << np.uint64(32)) * _M1
    x ^= (x >> np.uint64(29)) + word[at + k - 4].astype(np.uint64) * _M2
    x *= _M3
    return at, (x >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str, most: int = ANCHORS) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` smallest distinct hashes in order, and the first position of each."""
    at, h = anchors(text.encode("utf-8"))
    if len(h) > 4 * most:  # most texts repeat few anchors
        few = np.argpartition(h, 2 * most)[: 2 * most]
        few.sort()
        if len(np.unique(h[few])) > most:  # the largest hash there may have places elsewhere, so it must not be taken
            at, h = at[few], h[few]
    value, first = np.unique(h, return_index=True)
    return value[:most], at[first[:most]]


def told(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """Eight hex digits of each hash and then its position, in hex and followed by a semicolon."""
    return "".join(f"{h:08x}{p:x};" for h, p in zip(print_[0].tolist(), print_[1].tolist(), strict=True))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most: int = ANCHORS) -> float:
    """0 to 1; of equal fingerprints 1."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    joint = np.union1d(a[0], b[0])[:most]
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    keep = both <= joint[-1]
    shift = np.sort(a[1][i[keep]] - b[1][j[keep]])
    if not len(shift):
        return 0.0
    # the most anchors whose offsets lie within the slack of each other
    at_one = int((np.searchsorted(shift, shift + SLACK, "right") - np.arange(len(shift))).max())
    return at_one / len(joint)


def edited(text: str, other: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def compared(docs: DataFrame) -> DataFrame:
    """Each document (doc_id, text) against its edited text and against the next document.

    The next document is that of the next smaller doc_id, after the last the first; the
    edited text ends in as much of its beginning as the document's own last half has. Rows
    that share a doc_id follow each other by a hash of their text; a null doc_id comes last.
    A null text is empty; two empty texts are alike (1), an empty one is like no other (0).
    Other columns are ignored and an empty table gives an empty result.

    Documents are dealt to ranges of ids, those without one to ranges of their hashes. The first of each range also goes, as a guest, to
    the range before, so neighbours meet without a global sort; texts move once, compressed.
    """
    spark = docs.sparkSession
    docs = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    n = partitions(spark) * RANGES
    cuts = np.array(sorted(set(docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("q")).first().q or [])), np.int64)
    ids = docs.where("doc_id is not null").select("doc_id", F.lit(None).cast("string").alias("text"))
    first = {r[0]: r[1] for r in _ranged(ids, cuts, {}).groupBy("range").agg(F.max("doc_id")).collect()}
    first |= {r[0]: (None, r[1]) for r in _ranged(docs.where("doc_id is null"), cuts, {}).groupBy("range").agg(F.min("tie")).collect()}
    held = sorted(first)  # ids grow with ranges, so the next documents of a range's last lie in the range below
    guests: dict = {}
    for r, below in zip(held, [held[-1], *held[:-1]] if held else [], strict=True):
        guests.setdefault(first[below], []).append(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        now: tuple | None = None  # of the document that waits for its next: range, id, text, fingerprint
        done = False

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        rows: list[tuple] = []
        for batch in batches:
            for range_, doc, guest, body in zip(*(batch.column(i) for i in range(4)), strict=True):
                range_, doc, guest = range_.as_py(), doc.as_py(), guest.as_py()
                if now and now[0] != range_:
                    now, done = None, False
                if done:  # further guests of the same id
                    continue
                text = unzip.decompress(body.as_py()).decode("utf-8")
                print_ = fingerprint(text)
                if now:
                    new = edited(now[2], text)
                    other = fingerprint(new)
                    rows.append((now[1], len(now[2]), hashlib.sha256(new.encode("utf-8")).hexdigest(), told(now[3]), told(other), likeness(now[3], other), likeness(now[3], print_)))
                now, done = (range_, doc, text, print_), bool(guest)
                if len(rows) >= 512:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    dealt = _ranged(docs, cuts, guests).repartition(partitions(spark), "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "tie")
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("range", "doc_id", "guest", "body").mapInArrow(run, kind)


#: Ranges of documents without an id.
NO_ID_RANGES = 256


def _ranged(docs: DataFrame, cuts: np.ndarray, guests: dict) -> DataFrame:
    """(range, doc_id, guest, tie, body): the documents in their ranges, and as guests in others.

    Ranges without ids are below 0, and their hashes grow downwards. ``guests`` has the
    ranges that a document, by its id or by None and its hash, also goes to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0).slice(at, 512).to_pylist(), batch.column(1).slice(at, 512).to_pylist(), strict=True):
                    data = (text or "").encode("utf-8")
                    body, tie = zip_.compress(data), int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)
                    rows.append((-1 - (tie + (1 << 63)) * NO_ID_RANGES // (1 << 64) if doc is None else int(np.searchsorted(cuts, doc)), doc, False, tie, body))
                    rows += [(r, doc, True, tie, body) for r in guests.get((None, tie) if doc is None else doc, ())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], names=["range", "doc_id", "guest", "tie", "body"])

    return docs.mapInArrow(run, "range long, doc_id long, guest boolean, tie long, body binary")
