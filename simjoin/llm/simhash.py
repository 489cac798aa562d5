"""SimHash near-duplicates over an inverted index of byte positions with count filtering.

A fingerprint of B bytes within d differing bits of another shares at least B - d of its
bytes in their places. Lists of single bytes would hold a 256th of the corpus each, so the
index lists *sets* of byte positions, chosen so that every pair with the guaranteed number
of shared bytes meets in at least one list. Where two fingerprints meet, their shared
positional bytes are tallied, pairs below the guaranteed minimum are dropped, and the rest
are verified on all bits. Equal fingerprints are one entry. A list yields a star for each of
its components, not all pairs, and components come from the stars.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simjoin.llm.common import Sieve, own_columns, partitions, sifted, stored
from simjoin.llm.components import components

SEED = 42
WORDS, MAX_BITS = 4, 4
#: Rows of a list from which on it is dealt to several tasks; what is then searched at once is two blocks of so many.
LONG_LIST = 20_000
#: Rows of a longer list that are compared with the rest of it before that.
STEPS = 4_096
#: Rows of lists that are compared many lists at a time, and links held before they are thinned to stars.
SHORT, HELD = 256, 4_000_000


def shingles(text: str | None, n: int) -> list[bytes]:
    """Runs of n words, each joined by a space; of fewer words, the whole sequence."""
    # bytes.lower() takes A-Z only and bytes.split() cuts at 0x20 and 0x09-0x0D only
    found = (text or "").encode("utf-8").lower().split()
    if len(found) <= n:
        return [b" ".join(found)] if found else []
    joined, ends = b" ".join(found), []
    at = -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [joined[s:e] for s, e in zip(starts, ends[n - 1 :], strict=False)]


def fingerprint(text: str | None, n: int = WORDS, lanes: int = 1, distinct: bool = False) -> np.ndarray:
    """``lanes`` unsigned 64-bit words; lane i hashes with seed 42 + i. No words: all zero.

    A run of words counts as often as it stands in the text, or once if ``distinct``.
    """
    return _fingerprint(set(shingles(text, n)) if distinct else shingles(text, n), lanes)


def _fingerprint(parts: Collection[bytes], lanes: int) -> np.ndarray:
    out = np.zeros(lanes, np.uint64)
    if not parts:
        return out
    first = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts))
    for lane in range(lanes):
        if lane:  # a bijective mix of the first hash stands for a hash with another seed
            h = (first ^ np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
        else:
            h = first
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 65_536):
            ones += np.unpackbits(h[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[lane] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, n: int, lanes: int) -> DataFrame:
    """(doc_id, f0, f1, ...) as signed 64-bit columns."""
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), n, lanes) for t in batch.column(1)], np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(lanes))], names=["doc_id", *names])

    return own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in names))


def position_sets(n_bytes: int, shared: int, width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` positions such that any ``shared`` of ``n_bytes`` positions hold one of them.

    For three of four, Turan's design is taken: the positions are dealt to three classes,
    and a set lies in one class, or two of it in one class and one in the class after. Else
    they are dealt to so few classes that some class has ``width`` of any ``shared``
    positions (pigeonhole principle), and all sets within a class are taken.
    """
    if width == 1:
        return [(i,) for i in range(n_bytes - shared + 1)]
    if width == 3 and shared == 4:
        fits = lambda c: sorted(x % 3 for x in c) in ([0, 0, 0], [1, 1, 1], [2, 2, 2], [0, 0, 1], [1, 1, 2], [0, 2, 2])
        return [c for c in combinations(range(n_bytes), 3) if fits(c)]
    groups = max(1, (shared - 1) // (width - 1))
    return [c for g in range(groups) for c in combinations(range(g, n_bytes, groups), width)]


def _byte(i: int) -> Column:
    return F.shiftrightunsigned(F.col(f"f{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(255).cast("long"))


def _key(k: int, where: tuple[int, ...]) -> Column:
    out = F.lit(k).cast("long")
    for i in where:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(i))
    return out


def _short(f: np.ndarray, runs: np.ndarray, max_bits: int, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each of many short runs (first, end) of rows: each row against those that follow, by their lag."""
    n, start, size = len(f), runs[:, 0], runs[:, 1] - runs[:, 0]
    rows = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    left = np.repeat(runs[:, 1], size) - rows - 1  # rows of the run that follow
    links, held, lag = [np.empty((2, 0), np.int64)], 0, 1
    while len(rows := rows[(keep := left >= lag)]):
        left = left[keep]
        for at in range(0, len(rows), 1 << 18):
            a = rows[at : at + (1 << 18)]
            x = f[a] ^ f[a + lag]
            if min_bytes:
                keep = (x.view(np.uint8).reshape(len(a), -1) == 0).sum(1) >= min_bytes
                a, x = a[keep], x[keep]
            a = a[np.bitwise_count(x).sum(1, dtype=np.int64) <= max_bits]
            links.append(np.stack([a, a + lag]))
            held += len(a)
            if held > HELD:
                root = roots(n, *np.concatenate(links, axis=1))
                a = np.flatnonzero(root != np.arange(n))
                links, held = [np.stack([a, root[a]])], len(a)
        lag += 1
    return tuple(np.concatenate(links, axis=1))


def reached(f: np.ndarray, max_bits: int, min_bytes: int, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(root, open): of each row the first row that links lead to, and which rows still have rows to be compared with.

    A search through the graph that forms no pairs: a row is compared with the rows that were
    not reached yet, so a dense group takes about as many comparisons as it has rows. With
    ``steps``, at most so many rows are compared with the rest; without it, none stay open.
    """
    n = len(f)
    root, rest, left = np.arange(n), f, np.arange(n)  # left: rows not reached, rest: their fingerprints
    ahead: list[int] = []
    taken = 0
    while len(left) and (steps is None or taken < steps):
        if ahead:
            at = ahead.pop()
        else:
            at, left, rest = int(left[0]), left[1:], rest[1:]
        x = rest ^ f[at]
        near = np.bitwise_count(x).sum(1, dtype=np.int64) <= max_bits
        if min_bytes:
            near[near] = (x[near].view(np.uint8).reshape(-1, x.itemsize * x.shape[1]) == 0).sum(1) >= min_bytes
        if near.any():
            ahead += (found := left[near]).tolist()
            root[found] = root[at]
            left, rest = left[~near], rest[~near]
        taken += 1
    waits = np.zeros(n, bool)
    if len(left):
        waits[left] = waits[ahead] = True
    return root, waits


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows."""
    label = np.arange(n)
    while len(a):
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        label = new[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def _parts(key: int, f: np.ndarray, where: tuple[int, ...] | None, limit: int) -> Iterator[np.ndarray]:
    """The keys of a long list's rows in the next round: by each byte but those of its key, or else by pairs of blocks."""
    hashed = lambda *x: xxhash.xxh64_intdigest(repr((key, *x)).encode(), SEED) - 2**63
    if where is not None:
        held = f.view(np.uint8).reshape(len(f), -1)
        for p in range(held.shape[1]):
            if p not in where:
                yield np.array([hashed(p, v) for v in range(256)], np.int64)[held[:, p]]
        return
    n = -(-len(f) // limit)
    block = np.arange(len(f)) % n
    keys = np.array([[hashed(i, j) for j in range(n)] for i in range(n)], np.int64)
    for other in range(n):
        yield keys[np.minimum(block, other), np.maximum(block, other)]


def near_edges(nodes: DataFrame, lanes: int, sets: list[tuple[int, ...]], max_bits: int, min_bytes: int, guaranteed: bool, further: tuple[int, ...] = ()) -> DataFrame:
    """Links (a, b) between rows of ``nodes`` (node, f0, ...) that connect those whose fingerprints are near.

    ``sets`` are the positions whose bytes make the key of a list. With ``further``, such a
    list is divided in its task, once for each of these distances, by the byte that far
    behind the key's last (around the end), so that a row moves once for several lists.
    A list is sorted together within its partition and its components are told as stars. A
    list of over ``LONG_LIST`` rows goes through rounds. With ``guaranteed``, where every
    link shares ``min_bytes`` bytes, it is first dealt out by each of the bytes outside its
    key, which all links have in common with one of the new lists. A list that has
    all the bytes that are guaranteed is searched for so many steps that a dense group is
    done; the rows that are still to be compared are dealt to pairs of blocks, each a task's
    work of its own. So all links are found, whatever the length of a list.
    """
    names, width = [f"f{i}" for i in range(lanes)], len(sets[0])
    kind = f"key long, a long, b long, {', '.join(f'{x} long' for x in names)}"
    schema = pa.schema([(x, pa.int64()) for x in ("key", "a", "b", *names)])
    limit, steps = LONG_LIST, STEPS  # workers import this module afresh

    def searched(lists: DataFrame, then: str | None, first: bool) -> DataFrame:
        lists = lists.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key", "node")

        def divided(key: np.ndarray, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """The keys of lists, and the rows in their order."""
            if not first or not further:
                yield key, np.arange(len(key))
                return
            held = f.view(np.uint8).reshape(len(f), -1)
            last = np.array([s[-1] for s in sets])[key >> 8 * width]
            for d in further:
                sub = key << 8 | held[np.arange(len(f)), (last + d) % held.shape[1]]
                yield sub * (max(further) + 1) + d, np.argsort(sub, kind="stable")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
                key, node, f = rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 2:]).view(np.uint64)
                links = []
                for sub, by in divided(key, f):
                    key_, f_ = sub[by], f[by]
                    edge = np.flatnonzero(np.concatenate([[True], key_[1:] != key_[:-1], [True]]))
                    runs = np.stack([edge[:-1], edge[1:]], axis=1)
                    size = runs[:, 1] - runs[:, 0]
                    links.append(by[np.stack(_short(f_, runs[(size > 1) & (size <= SHORT)], max_bits, min_bytes))])
                    for lo, hi in runs[size > SHORT].tolist():
                        mine, where = f_[lo:hi], None
                        if then == "bytes" and hi - lo > limit:
                            where, waits = sets[int(key_[lo]) >> 8 * width], np.ones(hi - lo, bool)
                        else:
                            root, waits = reached(mine, max_bits, min_bytes, steps if then and hi - lo > limit else None)
                            a = np.flatnonzero(root != np.arange(hi - lo))
                            links.append(by[lo + np.stack([a, root[a]])])
                        if waits.any():
                            mine, of_ = mine[waits], pa.array(node[by[lo:hi]][waits])
                            for keys in _parts(int(key_[lo]), mine, where, limit):
                                yield pa.RecordBatch.from_arrays([pa.array(keys), of_, pa.nulls(len(mine), pa.int64()), *(pa.array(mine.view(np.int64)[:, i]) for i in range(lanes))], schema=schema)
                root = roots(len(f), *np.concatenate(links, axis=1))
                a = np.flatnonzero(root != np.arange(len(f)))
                pairs = np.unique(np.sort(np.stack([node[a], node[root[a]]], axis=1), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *[pa.nulls(len(pairs), pa.int64())] * lanes], schema=schema)

            kept: list[np.ndarray] = []
            for batch in batches:
                if not len(batch):
                    continue
                rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
                last_ = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
                if last_:
                    yield from of(np.concatenate([*kept, rows[:last_]]))
                    kept = []
                elif kept and kept[0][0, 0] != rows[0, 0]:
                    yield from of(np.concatenate(kept))
                    kept = []
                kept.append(rows[last_:])
            if kept:
                yield from of(np.concatenate(kept))

        return stored(lists.mapInArrow(run, kind), "links")

    lists = nodes.select(F.explode(F.array(*[_key(k, s) for k, s in enumerate(sets)])).alias("key"), "node", *names)
    out: DataFrame | None = None
    for then in (*["bytes"] * (guaranteed and width < min_bytes), "blocks", None):  # what becomes of long lists
        found = searched(lists, then, out is None)
        edges, lists = found.where("key is null").select("a", "b"), found.where("key is not null").select("key", F.col("a").alias("node"), *names)
        out = out.unionByName(edges) if out else edges
        if not lists.limit(1).count():
            break
    return out


def _nodes(prints: DataFrame, key: list[str], *more: str) -> DataFrame:
    """A node, the smallest doc_id, for each ``key`` of which rows with a doc_id are there; ``more`` depends on the key."""
    return stored(prints.where("doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("node"), *[F.first(x).alias(x) for x in more]), "nodes")


def _labelled(prints: DataFrame, nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """``prints`` with component_id from the links between nodes, of which each ``key`` has one."""
    # a doc_id with several keys is one document
    several = [F.min(x).alias(f"min_{x}") for x in key] + [F.max(x).alias(f"max_{x}") for x in key]
    differ = " or ".join(f"min_{x} <> max_{x}" for x in key)
    twice = prints.where("doc_id is not null").groupBy("doc_id").agg(*several).where(differ).select("doc_id")
    joined = prints.select("doc_id", *key).join(twice, "doc_id").join(nodes.select(*key, "node"), key).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = components(edges.unionByName(joined))
    roots_ = nodes.join(found, "node", "left").select(*key, F.coalesce("root", "node").alias("component_id"))
    out = prints.join(roots_, key, "left")
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def _told(labelled: DataFrame, lanes: int) -> DataFrame:
    text = F.concat(*[F.lpad(F.lower(F.hex(f"f{i}")), 16, "0") for i in range(lanes)])
    return labelled.select("doc_id", text.alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, lanes: int = 1, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document (doc_id, text): doc_id, fingerprint (hex), component_id.

    Fingerprints of ``lanes`` x 64 bits link at ``max_bits`` or fewer differing bits, and a
    component's id is the smallest doc_id in it. The index is exact: with B bytes it lists
    sets of positions of which any B - max_bits positions hold one (20 sets of three
    positions for 64 bits and 4 bits).

    Empty and null texts have the fingerprint zero and link like any other. Rows that share
    a doc_id count as one document with several texts, so their components join. A row with
    a null doc_id has a fingerprint but no component and links nothing. An empty table gives
    an empty result; other columns are ignored.
    """
    shared = 8 * lanes - max_bits
    if shared < 1:
        raise ValueError("so many differing bits guarantee no shared byte")
    names = [f"f{i}" for i in range(lanes)]
    prints = stored(fingerprints(docs, words, lanes), "fingerprints")
    nodes = _nodes(prints, names)
    edges = near_edges(nodes, lanes, position_sets(8 * lanes, shared, min(3, shared)), max_bits, shared, True)
    return _told(_labelled(prints, nodes, edges, names), lanes)


# For similarities: 256 bits; a list for each of 32 byte positions, divided by the bytes one to
# five positions behind; links at 58 or fewer differing bits are candidates.
LANES, CANDIDATE_BITS, CANDIDATE_BYTES = 4, 58, 3
RING, BEHIND = [(i,) for i in range(32)], (1, 2, 3, 4, 5)


#: A digest of a document's distinct runs of words: documents are taken for equal by it, never by their fingerprint.
SET_KEY = ["g0", "g1"]


def _wide(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, g0, g1, f0, ...): the digest of each document's set of runs, and the fingerprint of that set."""
    names = [*SET_KEY, *(f"f{i}" for i in range(LANES))]

    def of(text: str | None) -> np.ndarray:
        runs = sorted(set(shingles(text, words)))
        digest = xxhash.xxh3_128_digest(b"".join(len(r).to_bytes(8, "little") + r for r in runs))
        return np.concatenate([np.frombuffer(digest, np.int64), _fingerprint(runs, LANES).view(np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([of(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(len(names)))], names=["doc_id", *names])

    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in names))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, marks): the sorted distinct 32-bit hashes of a document's runs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [np.unique(np.fromiter((xxhash.xxh32_intdigest(p, SEED) for p in shingles(t.as_py(), words)), np.uint32)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], names=["node", "marks"])

    return docs.mapInArrow(run, "node long, marks binary")


def alike(sets: list[np.ndarray], similarity: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of all pairs of ``sets`` whose Jaccard similarity is reached.

    With ``side`` (a number for each set) only pairs across sides are compared. Rarest
    members first, two such sets share one of their first n - ceil(similarity * n) + 1, so an
    inverted index over those finds every pair; pairs that are connected already are skipped.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    if len(sets) < 2:
        return []
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rank[token]
    own = [np.sort(token[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
    first = [x[: len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1] for x in own]
    lengths = np.array([len(x) for x in first])
    keys, rows = np.concatenate(first), np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]  # postings, each in order of rows
    label, flag, out = np.arange(len(sets)), np.zeros(len(count), bool), []
    for i in range(len(sets)):
        if not sizes[i]:
            continue
        lo, hi = np.searchsorted(keys, first[i]), np.searchsorted(keys, first[i], "right")
        near = np.unique(np.concatenate([rows[x:y] for x, y in zip(lo, hi, strict=True)]))
        near = near[(near < i) & (np.minimum(sizes[near], sizes[i]) >= similarity * np.maximum(sizes[near], sizes[i]) - 1e-9)]
        if side is not None:
            near = near[side[near] != side[i]]
        flag[own[i]] = True
        while len(near := near[label[near] != label[i]]):
            some, near = near[:64], near[64:]
            both = np.add.reduceat(flag[np.concatenate([own[k] for k in some])].astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            for k in some[both >= similarity * (sizes[some] + sizes[i] - both)]:
                if label[k] != label[i]:
                    label[label == label[k]] = label[i]
                    out.append((int(k), i))
        flag[own[i]] = False
    return out


#: Sets, and bytes of sets, in one block of a family.
FAMILY_SETS, FAMILY_BYTES = 8_192, 32 << 20


def _verified(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the nodes of each family that are as similar: a forest of them for each two blocks.

    A family of one block is compared in one place. A larger one is dealt to g blocks by a
    hash, and each pair of blocks is compared in a place of its own, so all pairs are.
    """
    n = F.greatest(F.ceil(F.count("*") / FAMILY_SETS), F.ceil(F.sum(F.length("marks")) / FAMILY_BYTES), F.lit(1)).cast("long")
    dealt = sets.join(sets.groupBy("family").agg(n.alias("g")), "family").withColumn("block", F.pmod(F.xxhash64("node", "marks"), "g"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("other")
    dealt = dealt.select("family", "node", "block", "marks", other).select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "block", "marks")
    dealt = dealt.repartition(partitions(sets.sparkSession), "family", "lo", "hi").sortWithinPartitions("family", "lo", "hi", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            rows = sorted(set(rows))
            node, side = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            found = alike([np.frombuffer(r[2], np.uint32) for r in rows], similarity, side if len(set(side.tolist())) > 1 else None)
            found = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], names=["a", "b"])

        at, kept = None, []
        for batch in batches:
            places = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for k, place in enumerate(places):
                if place != at:
                    if len(kept) > 1:
                        yield of(kept)
                    at, kept = place, []
                kept.append((batch.column(3)[k].as_py(), batch.column(4)[k].as_py(), batch.column(5)[k].as_py()))
        if len(kept) > 1:
            yield of(kept)

    return dealt.mapInArrow(run, "a long, b long")


def _similar(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, g0, g1, f0, ..., component_id) of the documents."""
    docs = own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    prints = stored(_wide(docs, words), "fingerprints")
    nodes = _nodes(prints, SET_KEY, *[f"f{i}" for i in range(LANES)])
    found = components(near_edges(nodes.select("node", *[f"f{i}" for i in range(LANES)]), LANES, RING, CANDIDATE_BITS, CANDIDATE_BYTES, False, BEHIND))
    family = found.select("node", F.col("root").alias("family")).unionByName(found.select(F.col("root").alias("node"), F.col("root").alias("family")).distinct())
    family = stored(family, "families")
    maybe = sifted(docs, docs["doc_id"], Sieve.of(family.select("node")))
    marks = _sets(maybe.select(F.col("doc_id").alias("node"), "text"), words)
    sets = stored(marks.join(family, "node").select("family", "node", "marks"), "marks")
    return _labelled(prints, nodes, _verified(sets, similarity), SET_KEY)


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked by Jaccard similarity of their word runs.

    Candidates come from the positional index over wide fingerprints of distinct runs: a pair at similarity
    0.8 differs in 39 of 256 bits on average (standard deviation 6), meets in some list with
    probability 0.99 and at 0.9 with more than 0.9999. Documents connected by candidates, directly or
    not, are a family; of each list stars suffice for that. Within a
    family all pairs are compared by the word runs themselves. Documents with equal sets of
    runs are one; those with equal fingerprints are candidates like any other. Nulls, ties
    and empty tables: as ``near_duplicates``.

    Texts are read twice and never move; what moves of them are the hashed runs of those
    documents that are in a family, and a few more that pass the ``Sieve``.
    """
    return _told(_similar(docs, words, similarity), LANES)


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, with all their columns, less all but the smallest doc_id of each group.

    Rows with a null doc_id stay. Of rows that share the kept doc_id all stay. Null and
    empty texts are alike, so one of them stays; an empty table stays empty. Columns may
    have any names. Rows that cannot go, by the ``Sieve``, are not moved.
    """
    found = stored(_similar(docs, words, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("_drop")).distinct(), "dropped")
    sieve = Sieve.of(found)
    maybe = sifted(docs, docs["doc_id"], sieve)
    return sifted(docs, docs["doc_id"], sieve, False).unionByName(maybe.join(found, maybe["doc_id"].cast("long") == found["_drop"], "left_anti"))
