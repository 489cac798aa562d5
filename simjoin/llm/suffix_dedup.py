"""Exact substring deduplication with suffix arrays.

Every byte that lies in a window of ``WINDOW`` bytes that also starts earlier in the corpus
is removed. Two windows can be equal only if the smallest hash among their inner k-mers, the
window's anchor, is equal; so the text is cut into segments of windows with one anchor,
segments whose anchor occurs once are left out, and the rest are dealt by anchor to shards.

A shard builds the suffix array of its segments by Larsson-Sadakane refinement and their
common prefixes by Kasai's walk, both in numpy, and marks what repeats within it. Segments
of a frequent anchor are spread over several shards; the first occurrences that those shards
hold are cut into ranges by binary search over sampled splitters and merged range by range.

Documents move in compressed blocks of about a megabyte. Anchors are exchanged as numbers,
once; texts only for the segments that may repeat, and as blocks to where the answers are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simjoin.llm.common import own_columns, partitions, steady, stored

WINDOW, K = 100, 24
#: Text of a block, and of a shard, in bytes; a shard's arrays should fit a processor's cache.
BLOCK_BYTES, SHARD_BYTES = 1 << 20, 1 << 18
#: Segments of one anchor in one shard, about a megabyte; beyond, they are spread.
HOT = 8_000
#: Windows of a segment at most; longer runs of one anchor are cut.
RUN = 1_024
#: Windows that are hashed at a time, about 60 bytes of arrays each; so a long text costs little more than itself.
PIECE = 1 << 20
#: Segments' text that a task hands on at a time, in bytes.
SENT = 1 << 23
#: Sampled strings for each range that the first occurrences of spread anchors are merged in.
PER_RANGE = 20
#: Suffixes that a lane of Kasai's walk passes; more lanes make longer numpy steps.
LANE = 8

_M = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = np.iinfo(np.int64).max


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, big-endian, zero behind the end."""
    out = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):  # pairs, fours, eights
        out = (out[:-shift] << np.uint64(8 * shift)) | out[shift:]
    return out


def segments(data: bytes, window: int = WINDOW, count: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, windows, anchor) of the runs of windows with one anchor, for each ``PIECE`` of windows.

    Pieces overlap in bytes, not in windows, and a run ends at its piece's end, as it may
    anywhere. With ``count`` also how often, 1 or 2 for more, the anchor's hash stands in the
    run: if once, no two windows of the run are equal.
    """
    for at in range(0, max(len(data) - window + 1, 1), PIECE):
        start, *more = _segments(data[at : at + PIECE + window - 1], window, count)
        yield start + at, *more


def _segments(data: bytes, window: int, count: bool, k: int = K) -> tuple[np.ndarray, ...]:
    n = len(data) - window + 1
    if n < 1:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))[: 3 + count]
    word = words_of(np.frombuffer(data, np.uint8))
    h = np.zeros(len(data) - k + 1, np.uint64)
    for at in range(0, k, 8):
        h = (h ^ word[at : at + len(h)]) * _M
        h ^= h >> np.uint64(31)
    gram, have, w = h, 1, window - k + 1
    while have < w:
        step = min(have, w - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(start, n))
    if (size > RUN).any():
        pieces = -(-size // RUN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + nth * RUN
        size = np.diff(np.append(start, n))
    if not count:
        return start, size, h[start]
    length = size + w - 1  # k-mers of a run
    first = np.cumsum(length) - length
    held = gram[np.repeat(start - first, length) + np.arange(length.sum())] == np.repeat(h[start], length)
    return start, size, h[start], np.minimum(np.add.reduceat(held.astype(np.int32), first), 2)


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``text`` in the order of their first ``depth`` bytes or more, and their ranks.

    Suffixes of one rank have these bytes in common.

    Larsson and Sadakane: a rank is the last place of its group, groups are refined by the
    ranks ``h`` further on, ``h`` doubles, and suffixes alone in their group are left alone.
    """
    n = len(text)
    key = words_of(text)
    order = np.argsort(key).astype(np.int32)  # suffixes of a group are in no order, so no sort has to be stable
    new = np.concatenate([[True], np.diff(key[order]) != 0])
    del key
    rank = np.full(n + depth, -1, np.int32)  # -1 behind the end
    ends = np.append(np.flatnonzero(new)[1:], n) - 1
    group = ends[np.cumsum(new) - 1].astype(np.int32)
    rank[order] = group
    h = 8
    alone = np.concatenate([new, [True]])
    places = np.flatnonzero(~(alone[:-1] & alone[1:]))  # of suffixes in groups of several
    while h < depth and len(places):
        suffix = order[places]
        mine = rank[suffix]
        key = (mine.astype(np.int64) << 32) | (rank[suffix + np.int32(h)] + np.int32(1))
        by = np.argsort(key)
        key, suffix = key[by], suffix[by]
        order[places] = suffix  # groups are contiguous in places and in order
        new = np.concatenate([[True], key[1:] != key[:-1]])
        ends = np.append(np.flatnonzero(new)[1:], len(key)) - 1
        rank[suffix] = places[ends[np.cumsum(new) - 1]]
        alone = np.concatenate([new, [True]])
        places = places[~(alone[:-1] & alone[1:])]
        h *= 2
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, rank: np.ndarray | None = None) -> np.ndarray:
    """Bytes, up to ``most``, that each suffix of ``order`` shares with the one before it.

    Suffixes of one ``rank`` are known to share as many and are not compared.

    Kasai's walk in text order, where a prefix shortens by at most one from a suffix to the
    next; stretches of ``LANE`` suffixes are walked side by side, and words are compared. Where
    a prefix reached ``most``, the order behind it is not known, so the next one starts anew
    unless it has the same neighbour.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    known = np.zeros(n, bool)
    if rank is not None:
        known[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    word = words_of(np.concatenate([text, np.zeros(most + 8, np.uint8)]))
    at = np.arange(0, n, LANE)
    shared = np.zeros(len(at), np.int64)
    out = np.zeros(n, np.int16)
    for _ in range(LANE):
        i = at[at < n]
        j = before[i]
        held = np.where((shared[: len(i)] < most) | (j == before[i - 1] + 1), np.maximum(shared[: len(i)] - 1, 0), 0)
        go = np.flatnonzero((j >= 0) & (held < most) & ~known[i])
        held[j < 0] = 0
        held[known[i]] = most
        while len(go):
            x = word[i[go] + held[go]] ^ word[j[go] + held[go]]
            same = x == 0
            held[go[same]] += 8
            last, x = go[~same], x[~same]
            held[last] += sum((x < np.uint64(1 << b)).view(np.int8) for b in range(8, 64, 8))  # leading zero bytes
            go = go[same]
            go = go[held[go] < most]
        held = np.minimum(held, np.minimum(most, n - np.maximum(i, j)))
        out[i] = held
        shared[: len(i)] = held
        at = at + 1
    return out[order]


class Shard:
    """Segments of one shard: what repeats within, and the first occurrences of spread ones.

    Of equal segments the first goes into the suffix array; all windows of the others repeat.
    """

    def __init__(self, columns: list[np.ndarray], text: np.ndarray, window: int = WINDOW):
        """``columns``: doc, block, idx, start, size, spread of each segment, in corpus order."""
        end, data = np.cumsum(columns[4] + window - 1), text.tobytes()
        seen: dict[bytes, int] = {}
        at = [seen.setdefault(data[a:b], i) for i, (a, b) in enumerate(zip([0, *end[:-1].tolist()], end.tolist()))]
        new = np.array(at) == np.arange(len(at))
        self.again = [c[~new] for c in columns]
        columns, text = [c[new] for c in columns], np.frombuffer(b"".join(seen), np.uint8)
        self.doc, self.block, self.idx, self.start, self.size, self.spread = columns
        length = self.size + window - 1
        self.base, self.text, self.window = np.cumsum(length) - length, text, window
        order, rank = suffix_array(text, window)
        fresh = common_prefixes(text, order, window, rank) < window
        kind = np.cumsum(fresh) - 1  # suffixes of one kind begin with the same window
        owned = np.zeros(len(text), bool)
        owned[np.repeat(self.base - np.cumsum(self.size) + self.size, self.size) + np.arange(self.size.sum())] = True
        keep = owned[order]
        order, kind = order[keep].astype(np.int64), kind[keep]
        heads = np.flatnonzero(np.diff(kind, prepend=-1))
        first = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, len(order)))) if len(order) else order
        self.repeated = np.zeros(len(text), bool)  # text order is corpus order
        self.repeated[order[order > first]] = True
        self.firsts = np.minimum.reduceat(order, heads) if len(order) else order

    def marks(self) -> list[np.ndarray]:
        """(block, idx, start, end) of removed bytes."""
        edge = np.flatnonzero(np.diff(np.concatenate([[False], self.repeated, [False]]).astype(np.int8)))
        lo, hi = edge[::2], edge[1::2]  # runs end at segments, whose last bytes own no window
        of = np.searchsorted(self.base, lo, "right") - 1
        shift = self.start[of] - self.base[of]
        _, block, idx, start, size, _ = self.again
        found = ((self.block[of], block), (self.idx[of], idx), (lo + shift, start), (hi - 1 + shift + self.window, start + size + self.window - 1))
        return [np.concatenate(x) for x in found]

    def strings(self) -> Iterator[tuple[int, int, int, int, bytes]]:
        """(doc, block, idx, start, window) of the first occurrences in spread segments, in their order."""
        of = np.searchsorted(self.base, self.firsts, "right") - 1
        at = np.flatnonzero(self.spread[of])
        data = self.text.tobytes()
        for p, s in zip(self.firsts[at].tolist(), of[at].tolist(), strict=True):
            yield int(self.doc[s]), int(self.block[s]), int(self.idx[s]), int(self.start[s] + p - self.base[s]), data[p : p + self.window]


def blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, ends, body): documents in the order of their partition, compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, bodies, size = TaskContext.get().partitionId() << 40, [], [], 0
        zip_ = zstandard.ZstdCompressor(level=1)

        def out() -> pa.RecordBatch:
            ends = np.cumsum([len(b) for b in bodies])
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([zip_.compress(b"".join(bodies))], pa.binary())], names=["block", "ids", "ends", "body"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc.as_py())
                bodies.append(text.as_py() or b"")
                size += len(bodies[-1])
                if size >= BLOCK_BYTES:
                    yield out()
                    block, ids, bodies, size = block + 1, [], [], 0
        if ids:
            yield out()

    return docs.mapInArrow(run, "block long, ids array<long>, ends array<long>, body binary")


def _documents(ends: list[int], body: bytes) -> Iterator[bytes]:
    data, at = zstandard.ZstdDecompressor().decompress(body), 0
    for end in ends:
        yield data[at:end]
        at = end


def _anchors(made: DataFrame, window: int) -> DataFrame:
    """(anchor, block, n): how often each anchor stands in a block, at most twice for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ends, body in zip(*(batch.column(i) for i in (0, 2, 3)), strict=True):
                found = [x[2:] for d in _documents(ends.as_py(), body.as_py()) for x in segments(d, window, count=True)]
                anchor, of = np.unique(np.concatenate([a for a, _ in found]), return_inverse=True)
                n = np.bincount(of, np.concatenate([c for _, c in found]), len(anchor))
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(np.full(len(anchor), block.as_py())), pa.array(n.astype(np.int32))], names=["anchor", "block", "n"])

    return made.mapInArrow(run, "anchor long, block long, n int")


def _repeated_anchors(found: DataFrame, n: int, hot: int) -> DataFrame:
    """(block, anchor, n, before) of the anchors that stand in the corpus more than once.

    ``before`` is how often a hot anchor, which stands more than ``hot`` times, stands in
    earlier blocks, so that it tells which share of the anchor a block is in; else it is -1.
    An anchor's rows pass in the order of blocks and are held until there are ``hot`` at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray) -> pa.RecordBatch:
            head = np.flatnonzero(np.diff(rows[0], prepend=rows[0][0] ^ 1))
            size = np.diff(np.append(head, rows.shape[1]))
            total, upto = np.repeat(np.add.reduceat(rows[2], head), size), np.cumsum(rows[2]) - rows[2]
            before = np.where(total > hot, upto - np.repeat(upto[head], size), -1)
            keep = total > 1
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (rows[1], rows[0], rows[2], before)], names=["block", "anchor", "n", "before"])

        kept, streamed = np.empty((3, 0), np.int64), 0  # rows of the last anchor; how often it stood, once it is known to be hot
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if streamed:
                same = int(np.searchsorted(rows[0], last, "right"))
                upto = streamed + np.cumsum(rows[2, :same])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[1, :same], rows[0, :same], rows[2, :same], upto - rows[2, :same])], names=["block", "anchor", "n", "before"])
                streamed, rows = int(upto[-1]) if same else streamed, rows[:, same:]
                if not rows.shape[1]:
                    continue
                streamed = 0
            rows = np.concatenate([kept, rows], axis=1)
            last = rows[0, -1]
            at = int(np.searchsorted(rows[0], last))
            if at:
                yield out(rows[:, :at])
            kept = rows[:, at:]
            if kept[2].sum() > hot:
                yield out(kept)
                kept, streamed = kept[:, :0], int(kept[2].sum())
        if kept.shape[1]:
            yield out(kept)

    return found.repartition(n, "anchor").sortWithinPartitions("anchor", "block").mapInArrow(run, "block long, anchor long, n long, before long")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M
    return x ^ (x >> np.uint64(32))


def _dealt(made: DataFrame, again: DataFrame, shards: int, window: int, hot: int) -> DataFrame:
    """The segments that may repeat, with the shard of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, ends, body, anchors in zip(*batch.columns, strict=True):
                block, known = block.as_py(), np.array(sorted((a["anchor"], a["before"]) for a in anchors.as_py()), np.int64).reshape(-1, 2)
                met = np.zeros(len(known), np.int64)  # segments of each anchor so far
                found: list[tuple[np.ndarray, ...]] = []
                bodies, size_of = [], 0

                def out() -> pa.RecordBatch:
                    columns = [np.concatenate(x) for x in zip(*found, strict=True)]
                    columns.insert(2, np.full(len(bodies), block))
                    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(bodies, pa.binary())], names=["shard", "doc", "block", "idx", "start", "size", "spread", "body"])

                for idx, (doc, data) in enumerate(zip(ids.as_py(), _documents(ends.as_py(), body.as_py()), strict=True)):
                    for start, size, anchor in segments(data, window):
                        at = np.minimum(np.searchsorted(known[:, 0], anchor.view(np.int64)), len(known) - 1)
                        of = np.flatnonzero(known[at, 0] == anchor.view(np.int64))
                        at, start, size = at[of], start[of], size[of]
                        by = np.argsort(at, kind="stable")
                        head = np.flatnonzero(np.diff(at[by], prepend=-1))
                        nth = np.empty(len(at), np.int64)  # of the anchor's segments in this block
                        nth[by] = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at)))) + met[at[by]]
                        met += np.bincount(at, minlength=len(known))
                        spread = known[at, 1] >= 0
                        salt = np.where(spread, (known[at, 1] + nth) // hot, 0).astype(np.uint64)
                        shard = (_mixed(anchor[of]) + salt * np.uint64(0xD1B54A32D192ED03)) % np.uint64(shards)
                        found.append((shard.astype(np.int64), np.full(len(of), _NO_ID if doc is None else doc), np.full(len(of), idx), start, size, spread.astype(np.int64)))
                        bodies += [data[s:e] for s, e in zip(start.tolist(), (start + size + window - 1).tolist(), strict=True)]
                        size_of += int((size + window - 1).sum())
                        if size_of >= SENT:
                            yield out()
                            found, bodies, size_of = [], [], 0
                if bodies:
                    yield out()

    lists = again.groupBy("block").agg(F.collect_list(F.struct("anchor", "before")).alias("anchors"))
    return made.join(lists, "block").select("block", "ids", "ends", "body", "anchors").mapInArrow(run, "shard long, doc long, block long, idx long, start long, size long, spread long, body binary")


def _searched(dealt: DataFrame, n: int, window: int) -> DataFrame:
    """(shard, doc, block, idx, start, end, string): marks, and with a string first occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pieces: list[tuple[list[np.ndarray], np.ndarray]]) -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*(c for c, _ in pieces), strict=True)]
            s = Shard(columns[1:], np.concatenate([t for _, t in pieces]), window)
            marks, strings = s.marks(), list(s.strings())
            n, more = len(marks[0]), [np.array([r[i] for r in strings], np.int64) for i in range(4)]
            told = [np.full(n + len(strings), columns[0][0]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(more[0])])]
            told += [np.concatenate(x) for x in zip(marks, (*more[1:], more[3] + window), strict=True)]
            told.append(pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([r[4] for r in strings], pa.binary())]))
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in told], names=["shard", "doc", "block", "idx", "start", "end", "string"])

        now, pieces = -1, []
        for batch in batches:
            if not len(batch):
                continue
            columns, body = [c.to_numpy() for c in batch.columns[:7]], batch.column(7)
            ends = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1]
            data = np.frombuffer(body.buffers()[2], np.uint8)
            first = np.flatnonzero(np.diff(columns[0], prepend=-1))
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(batch)], strict=True):
                if columns[0][lo] != now and pieces:
                    yield out(pieces)
                    pieces = []
                now = columns[0][lo]
                # copies: a batch's memory is not kept
                pieces.append(([c[lo:hi].copy() for c in columns], data[ends[lo] : ends[hi]].copy()))
        if pieces:
            yield out(pieces)

    return dealt.repartition(n, "shard").sortWithinPartitions("shard", "doc", "block", "idx", "start").mapInArrow(run, "shard long, doc long, block long, idx long, start long, end long, string binary")


def _merged(strings: DataFrame, n: int) -> DataFrame:
    """Marks of first occurrences in one shard that come later than those in another."""
    total = strings.count()
    share = max(1, total // (n * PER_RANGE))
    sample = sorted(bytes(r[0]) for r in strings.where(F.pmod(F.xxhash64("string"), F.lit(share)) == 0).select("string").distinct().limit(4 * n * PER_RANGE).collect())
    cuts = np.array([s + b"\x01" for s in sample[:: max(1, len(sample) // n)]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([s.as_py() + b"\x01" for s in batch.column(5)])
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, own)), *batch.columns], names=["range", *batch.schema.names])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            strings = batch.column(5).to_pylist()
            later = [s == t for s, t in zip(strings, [last, *strings[:-1]], strict=True)]
            last = strings[-1] if strings else last
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(later, pa.bool_())) for i in (1, 2, 3, 4)], names=["block", "idx", "start", "end"])

    columns = "doc long, block long, idx long, start long, end long, string binary"
    ranged = strings.select("doc", "block", "idx", "start", "end", "string").mapInArrow(cut, "range long, " + columns)
    ordered = ranged.repartition(n, "range").sortWithinPartitions("string", "doc", "block", "idx", "start")
    return ordered.select("doc", "block", "idx", "start", "end", "string").mapInArrow(merge, "block long, idx long, start long, end long")


def removed(docs: DataFrame, window: int = WINDOW, hot: int = HOT, keep_text: bool = False) -> DataFrame:
    """One row per document (doc_id, text): what is left of it.

    Texts are UTF-8 bytes. A byte is removed if it lies in a ``window``-byte string that
    also starts earlier: in a smaller doc_id, or in the same document before. Returns
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with
    ``keep_text``, kept (the remaining bytes, which may cut characters in two).

    A null text is empty. A null doc_id counts as larger than any other. Rows that share a
    doc_id are documents in the order of their rows, so of repeated rows the first keeps its
    bytes. Texts of any length are taken whole; other columns are ignored; an empty table
    gives an empty result.

    The documents are read three times and their blocks are numbered by partition, so an
    input that is not simply read from a table is stored first.
    """
    n = partitions(docs.sparkSession)
    docs = steady(own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), "documents")
    made = blocks(docs)
    again = stored(_repeated_anchors(_anchors(made, window), n, hot), "anchors")
    count = again.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, int(count) * (WINDOW + WINDOW // 2) // SHARD_BYTES)
    found = stored(_searched(_dealt(made, again, shards, window, hot), n, window), "repeats")
    marks = found.where("string is null").select("block", "idx", "start", "end")
    marks = marks.unionByName(_merged(found.where("string is not null"), n))
    lists = marks.groupBy("block").agg(F.collect_list(F.struct("idx", "start", "end")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, ends, body, told in zip(*batch.columns, strict=True):
                ids = ids.as_py()
                cuts: list[list[tuple[int, int]]] = [[] for _ in ids]
                for m in told.as_py() or ():
                    cuts[m["idx"]].append((m["start"], m["end"]))
                rows: list[tuple] = []
                for doc, data, spans in zip(ids, _documents(ends.as_py(), body.as_py()), cuts, strict=True):
                    kept, at, n_spans = [], 0, 0
                    for start, end in sorted(spans):
                        if start > at or not n_spans:
                            n_spans += 1
                            kept.append(data[at:start])
                        at = max(at, end)
                    left = b"".join([*kept, data[at:]])
                    rows.append((doc, len(data), len(data) - len(left), n_spans, hashlib.sha256(left).hexdigest(), left))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 5 + keep_text]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text])

    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return made.join(lists, "block", "left").select("ids", "ends", "body", "marks").mapInArrow(run, out)
