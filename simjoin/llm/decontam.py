"""Benchmark decontamination over a distributed positional inverted index.

The index holds the postings of all words of the training documents and is stored once,
whatever the test items are. It is dealt out by documents: a shard is some two million
words of whole documents laid on one line, and has a row for each of its terms with the
term's places on that line. A search reads the rows of the test terms alone. In each shard
a window's rarest list gives candidate starts, and the lists of its other terms, rarest
first, are intersected with them after shifting by their offsets. The same lists give
proximity matches, where the terms may come in any order within a few words.

Test items are cut into overlapping pieces and taken in blocks of bounded size; each block
is a query set against the stored index, and no block reads the texts again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simjoin.llm.common import Sieve, own_columns, partitions, sifted, stored, with_schema

WINDOW = 10
#: Terms of a window within this many words of its rarest term make a proximity match.
NEAR = 12
#: Words of a shard; one document is never divided, so a longer one is a shard by itself.
SHARD_WORDS = 1 << 21
#: Words of test items that are sent to the executors at a time, and of a piece of an item.
BLOCK_WORDS, PIECE_WORDS = 500_000, 10_000
#: Candidates that a task holds at a time.
CANDIDATES = 2_000_000

# Word bytes are 0-9, a-z (A-Z lower-cased) and all bytes of non-ASCII characters.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


# --- the index ----------------------------------------------------------------------------
def encoded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^35 as bytes of seven bits, low ones first, and where each begins (and the last ends)."""
    size = 1 + sum((values >> 7 * k > 0).astype(np.int64) for k in range(1, 5))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    for k in range(5):
        held = np.flatnonzero(size > k)
        out[at[held] + k] = (values[held] >> 7 * k & 127) | np.where(size[held] > k + 1, 128, 0)
    return out, at


def decoded(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], data[:-1] < 128]))
    nth = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * nth, start)


INDEX = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("body", pa.binary())])


def shard_rows(shard: int, docs: list[tuple[int | None, int, int]], ids: list[np.ndarray], terms: list[bytes]) -> pa.RecordBatch:
    """A shard's rows: its documents (id, digest, words), then the postings of each term.

    ``ids`` are the terms of each document's words, as places in ``terms``. A posting list
    is the differences of the places on the shard's line.
    """
    head = np.array([[d is not None, d or 0, digest, n] for d, digest, n in docs], np.int64).tobytes()
    line = np.concatenate([*ids, np.empty(0, np.int32)])
    place = np.argsort(line, kind="stable")
    count = np.bincount(line, minlength=len(terms))
    first = np.cumsum(count) - count
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    body, at = encoded(step)
    edge = np.append(at[first], len(body)).astype(np.int32)
    bodies = pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(edge), pa.py_buffer(body)])
    columns = {"shard": np.full(len(terms) + 1, shard), "term": pa.array([None, *terms], pa.binary()), "n": np.append(len(docs), count), "body": pa.concat_arrays([pa.array([head], pa.binary()), bodies])}
    return next(with_schema([columns], INDEX))


def build_index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The stored postings of the documents (doc_id, text): shard, term, n, body.

    One narrow pass; the row without a term describes the documents of a shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, total = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int | None, int, int]] = []
        ids: list[np.ndarray] = []
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        for batch in batches:
            for doc, text, digest in zip(*(batch.column(i) for i in range(3)), strict=True):
                found = words(text.as_py())
                ids.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                held.append((doc.as_py(), digest.as_py(), len(found)))
                total += len(found)
                if total >= shard_words or len(held) >= shard_words:
                    yield shard_rows(shard, held, ids, list(known))
                    shard, total = shard + 1, 0
                    held, ids = [], []
                    known.clear()
        if held:
            yield shard_rows(shard, held, ids, list(known))

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), digest(F.col("text")))
    return stored(source.mapInArrow(run, "shard long, term binary, n long, body binary"), "postings")


def digest(text):
    """What tells the texts of rows apart that share a doc_id."""
    return F.xxhash64(text).alias("digest")


# --- the test items -----------------------------------------------------------------------
@dataclass
class Windows:
    """The windows of one block of test items, as arrays."""

    vocabulary: dict[bytes, int]
    items: list[int | None]
    item: np.ndarray  # of each window, an index into items
    length: np.ndarray
    terms: np.ndarray  # windows x size, -1 behind the end
    order: np.ndarray  # windows x size: offsets, rarest term first, -1 behind the end

    @staticmethod
    def of(rows: list[tuple[int | None, list[bytes]]], size: int) -> Windows:
        vocabulary: dict[bytes, int] = {}
        items: dict[int | None, int] = {}
        made = [np.empty((0, size + 2), np.int32)]
        for i, found in rows:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found], np.int32)
            if not len(ids):
                continue
            n = min(size, len(ids))
            part = np.full((len(ids) - n + 1, size + 2), -1, np.int32)
            part[:, 0], part[:, 1] = items.setdefault(i, len(items)), n
            part[:, 2 : 2 + n] = np.lib.stride_tricks.sliding_window_view(ids, n)
            made.append(part)
        each = np.unique(np.concatenate(made), axis=0)
        return Windows(vocabulary, list(items), each[:, 0], each[:, 1].astype(np.int64), each[:, 2:], np.zeros((len(each), size), np.int32))

    def rank(self, counts: np.ndarray) -> None:
        """Order the offsets of each window by how often the corpus has their terms."""
        held = self.terms >= 0
        rarity = np.where(held, np.append(counts, 0)[self.terms], np.iinfo(np.int64).max)
        self.order = np.argsort(rarity, axis=1, kind="stable").astype(np.int32)
        self.order[~np.take_along_axis(held, self.order, 1)] = -1


def pieces(items: DataFrame, size: int, most: int = PIECE_WORDS) -> DataFrame:
    """(item_id, words, n): the items' words, joined by spaces, in pieces that have each window of an item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(batch.column(i) for i in range(2)), strict=True):
                found = words(text.as_py())
                for at in range(0, max(len(found) - size + 1, min(len(found), 1)), most):
                    part = found[at : at + most + size - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()], pa.int64()), pa.array([b" ".join(part)], pa.binary()), pa.array([len(part)], pa.int64())], names=["item_id", "words", "n"])

    source = items.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return stored(source.mapInArrow(run, "item_id long, words binary, n long").distinct(), "items")


def blocks(index: DataFrame, items: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[tuple[Windows, DataFrame]]:
    """The windows of the items, block by block, ranked by the terms' counts in the index, and the terms (term, q)."""
    spark, cut = index.sparkSession, pieces(items, size, min(PIECE_WORDS, block_words))
    parts = max(1, -(-(cut.agg(F.sum("n")).first()[0] or 0) // block_words))
    for part in range(parts):
        mine = cut.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)) == part).select("item_id", "words")
        w = Windows.of(sorted(((r[0], bytes(r[1]).split()) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), size)
        terms = _terms(spark, w.vocabulary)
        counts = np.zeros(len(w.vocabulary), np.int64)
        for r in index.join(F.broadcast(terms), "term").groupBy("q").agg(F.sum("n")).collect():
            counts[r[0]] = r[1]
        w.rank(counts)
        yield w, terms


def _terms(spark: SparkSession, vocabulary: dict[bytes, int]) -> DataFrame:
    """(term, q) of a block's terms; their number is bounded by the block's words."""
    return spark.createDataFrame(pa.table({"term": pa.array(list(vocabulary), pa.binary()), "q": pa.array(list(vocabulary.values()), pa.int32())}))


# --- the search ---------------------------------------------------------------------------
def _holds(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether the sorted keys have one from lo to hi, each inclusive."""
    at = np.searchsorted(keys, lo)
    return (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= hi)


def intersect(n_words: np.ndarray, lists: dict[int, tuple[int, bytes]], w: Windows, near: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(document, window, start) of the phrases and (document, window) of proximity matches in one shard.

    ``lists`` has the length and the encoded places of each term that the shard has. Only
    windows all of whose terms are there are looked for, and only their lists decoded.
    """
    edge = np.concatenate([[0], np.cumsum(n_words)])  # of the documents on the shard's line
    span = int(edge[-1]) + 1
    has = np.zeros(len(w.vocabulary) + 1, bool)
    has[list(lists)] = True
    has[-1] = True  # behind a short window's end
    alive = np.flatnonzero(has[w.terms].all(1))
    none = (np.empty(0, np.int64),) * 3, (np.empty(0, np.int64),) * 2
    if not len(alive):
        return none
    used = np.unique(w.terms[alive])
    used = used[used >= 0].tolist()
    n = np.array([lists[q][0] for q in used], np.int64)
    step = decoded(np.frombuffer(b"".join(lists[q][1] for q in used), np.uint8))
    first, total = np.cumsum(n) - n, np.cumsum(step)
    place = total - np.repeat(total[first] - step[first], n)  # each list begins with a place, then has differences
    keys = np.repeat(np.array(used, np.int64) * span, n) + place
    rarest = w.terms[alive, w.order[alive, 0]].astype(np.int64)
    lo, hi = np.searchsorted(keys, rarest * span), np.searchsorted(keys, (rarest + 1) * span)
    total = np.cumsum(hi - lo)
    phrases, close = [], []
    for chunk in np.split(np.arange(len(alive)), np.searchsorted(total, np.arange(CANDIDATES, int(total[-1]), CANDIDATES))):
        n = hi[chunk] - lo[chunk]
        win = np.repeat(alive[chunk], n)
        place = keys[np.repeat(lo[chunk] - np.cumsum(n) + n, n) + np.arange(n.sum())] - np.repeat(rarest[chunk], n) * span
        doc = np.searchsorted(edge, place, "right") - 1
        start = place - w.order[win, 0]
        inside = (start >= edge[doc]) & (start + w.length[win] <= edge[doc + 1])
        for exact, out in ((True, phrases), (False, close)):
            k, p, d = (win[inside], start[inside], doc[inside]) if exact else (win, place, doc)
            for j in range(1, w.terms.shape[1]):
                offset = w.order[k, j].astype(np.int64)
                base = w.terms[k, offset].astype(np.int64) * span
                if exact:
                    low = high = base + p + offset
                else:
                    low, high = base + np.maximum(p - near, edge[d]), base + np.minimum(p + near, edge[d + 1] - 1)
                ok = (offset < 0) | _holds(keys, low, high)
                k, p, d = k[ok], p[ok], d[ok]
            out.append((d, k, p - edge[d]))
    d, k, p = (np.concatenate(x) for x in zip(*phrases, strict=True))
    dc, kc, _ = (np.concatenate(x) for x in zip(*close, strict=True))
    return (d, k, p), (dc, kc)


def _by_doc(n: int, doc: np.ndarray, values: np.ndarray) -> list[list[int]]:
    """The distinct values of each of n documents."""
    if not len(doc):
        return [[] for _ in range(n)]
    pairs = np.unique(np.stack([doc, values]), axis=1)
    return [x.tolist() for x in np.split(pairs[1], np.searchsorted(pairs[0], np.arange(1, n)))]


def found(n_words: np.ndarray, lists: dict[int, tuple[int, bytes]], w: Windows, near: int) -> tuple[list[list[int]], list[list[int]], list[list[int]]]:
    """Of each document of a shard: hit word positions, items with a phrase, items with a proximity match."""
    n = len(n_words)
    (doc, k, start), (near_doc, near_k) = intersect(n_words, lists, w, near)
    length = w.length[k]
    at = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
    named = lambda found: [[w.items[i] for i in x if w.items[i] is not None] for x in found]
    return _by_doc(n, np.repeat(doc, length), at), named(_by_doc(n, doc, w.item[k])), named(_by_doc(n, near_doc, w.item[near_k]))


MATCH = pa.schema([("shard", pa.int64()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.int64())), ("near_items", pa.list_(pa.int64()))])
#: Documents in one batch of results.
DOCS = 2_048


def search(index: DataFrame, w: Windows, terms: DataFrame, near: int = NEAR, every: bool = True) -> DataFrame:
    """Phrases and proximity matches of the windows: a row for each document, or, without ``every``, for those with any.

    The rows of the terms are brought together by shard; nothing else of the index moves.
    """
    sent = index.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(shard: int, head: bytes, lists: dict[int, tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            there, ids, digests, n_words = np.frombuffer(head, np.int64).reshape(-1, 4).T
            hits, items, close = found(n_words, lists, sent.value, near)
            keep = [i for i in range(len(ids)) if every or hits[i] or close[i]]
            for at in range(0, len(keep), DOCS):
                rows = keep[at : at + DOCS]
                pick = lambda x: [x[i] for i in rows]  # noqa: B023, E731
                yield from with_schema([{"shard": np.full(len(rows), shard), "nth": rows, "doc_id": [int(ids[i]) if there[i] else None for i in rows], "digest": digests[rows], "n_words": n_words[rows], "hits": pick(hits), "items": pick(items), "near_items": pick(close)}], MATCH)

        at, head, lists = None, b"", {}
        for batch in batches:
            for shard, q, n, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if shard != at:
                    if at is not None:
                        yield from of(at, head, lists)
                    at, lists = shard, {}
                if q is None:
                    head = body
                else:
                    lists[q] = (n, body)
        if at is not None:
            yield from of(at, head, lists)

    mine = index.join(F.broadcast(terms), "term", "left").where("term is null or q is not null").select("shard", "q", "n", "body")
    dealt = mine.repartition(partitions(index.sparkSession), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "shard long, nth long, doc_id long, digest long, n_words long, hits array<int>, items array<long>, near_items array<long>")


def _matches(docs: DataFrame, items: DataFrame, size: int, near: int, block_words: int, every: bool) -> DataFrame:
    docs, items = own_columns(docs, "doc_id", "text"), own_columns(items, "item_id", "text")
    index = build_index(docs)
    parts = [search(index, w, terms, near, every and not k) for k, (w, terms) in enumerate(blocks(index, items, size, block_words))]
    out = parts[0]
    if len(parts) > 1:  # the first has a row for each document, the others for those with matches
        for p in parts[1:]:
            out = out.unionByName(p)
        lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items", "near_items")]
        out = out.groupBy("shard", "nth").agg(*[F.first(c).alias(c) for c in ("doc_id", "digest", "n_words")], *lists)
    return out


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, near: int = NEAR, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document (doc_id, text): what it shares with the test items (item_id, text).

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and with them
    ``hits`` (word positions), ``items`` and ``near_items`` (item ids, the latter of
    proximity matches, which include the phrases).

    A null or empty text has no words. Items without words have no window; items with a
    null item_id make hits but are not listed, and items that share an item_id are one item
    of several texts. Rows that repeat, or share a doc_id, are judged each by itself;
    repeated items count once. Empty tables give no rows, or rows without hits. Other
    columns of either table are ignored.
    """
    out = _matches(docs, items, size, near, block_words, True)
    n_hit, names = F.size("hits").cast("long"), F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "hits", "items", "near_items")


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, near: int = NEAR, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, with all their columns, that have no window of any test item.

    The same index and search tell which rows go, by doc_id and a digest of the text; rows
    that cannot be among them, by the ``Sieve``, are not moved. Nulls, ties and empty
    tables: as above.
    """
    gone = _matches(docs, items, size, near, block_words, False).where(F.size("hits") > 0).select("digest", "doc_id").distinct()
    gone = stored(gone, "contaminated")
    sieve, own = Sieve.of(gone), F.xxhash64(docs["text"])
    maybe = sifted(docs, own, sieve)
    on = (F.xxhash64(maybe["text"]) == gone["digest"]) & maybe["doc_id"].cast("long").eqNullSafe(gone["doc_id"])
    return sifted(docs, own, sieve, False).unionByName(maybe.join(gone, on, "left_anti"))
