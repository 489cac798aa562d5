import hashlib
import random

import numpy as np
import pytest

from simjoin.llm import common
from simjoin.llm import suffix_dedup as sd
from tests.llm.conftest import docs_of


def brute(rows, w=100):
    """Rows in corpus order -> (doc_id, n_bytes, n_removed, n_spans, sha256)."""
    seen, out = set(), []
    for doc, text in rows:
        b = (text or "").encode()
        cut = bytearray(len(b))
        for s in range(len(b) - w + 1):
            if b[s : s + w] in seen:
                cut[s : s + w] = b"\x01" * w
            seen.add(b[s : s + w])
        kept = bytes(x for x, c in zip(b, cut) if not c)
        n = sum(1 for i, c in enumerate(cut) if c and (i == 0 or not cut[i - 1]))
        out.append((doc, len(b), len(b) - len(kept), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_suffix_array_and_prefixes(letters):
    t = np.random.default_rng(letters).integers(97, 97 + letters, 400).astype(np.uint8)
    t = np.concatenate([t, t[:150], t])
    b, (order, rank) = t.tobytes(), sd.suffix_array(t, 100)
    assert sorted(order.tolist()) == list(range(len(b)))
    assert [b[i : i + 100] for i in order] == sorted(b[i : i + 100] for i in range(len(b)))
    shared = sd.common_prefixes(t, order, 100)
    assert (shared == sd.common_prefixes(t, order, 100, rank)).all()
    assert all(b[i : i + 100] == b[j : j + 100] for i, j in zip(order[1:].tolist(), order[:-1].tolist()) if rank[i] == rank[j])
    for k in range(1, len(order)):
        x, y = b[order[k] :][:100], b[order[k - 1] :][:100]
        assert shared[k] == next((c for c in range(min(len(x), len(y))) if x[c] != y[c]), min(len(x), len(y)))


@pytest.mark.parametrize("piece", [sd.PIECE, 700])
def test_segments_cover_every_window(monkeypatch, piece):
    monkeypatch.setattr(sd, "PIECE", piece)
    data = np.random.default_rng(1).integers(97, 100, 3_000).astype(np.uint8).tobytes() + b"ab" * 2_000
    start, size, anchor, n = (np.concatenate(x) for x in zip(*sd.segments(data, count=True), strict=True))
    assert start[0] == 0 and (np.diff(start) == size[:-1]).all() and start[-1] + size[-1] == len(data) - 99
    assert size.max() <= min(sd.RUN, piece) and n[-1] == 2
    ((start, *_),) = sd.segments(b"short")
    assert not len(start)


def test_long_texts_are_walked_in_pieces(spark):
    """Repeats across the borders of pieces are found whole, between documents and within one."""
    text = "".join(map(chr, np.random.default_rng(3).integers(33, 127, 2_300_000)))
    rows = [(1, text), (2, text[sd.PIECE - 200_000 : sd.PIECE + 200_000]), (3, text[:150] + "é" * 300_000 + text[-150:])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in sd.removed(docs_of(spark, *rows)).collect()}
    # of the third, the copied ends go, and all windows of é but the first of both kinds
    assert got == {1: (2_300_000, 0, 0), 2: (400_000, 400_000, 1), 3: (600_300, 600_298, 2)}


@pytest.mark.parametrize("hot", [3, 50, 10_000])
def test_places_of_blocks_among_an_anchor(spark, hot):
    """Rows of a hot anchor stream past, with what stands before them, however batches are cut."""
    rng = np.random.default_rng(hot)
    rows = [(a, b, int(rng.integers(1, 3))) for a, m in enumerate([1, 2, 700, 5, 40, 1, 900]) for b in rng.choice(2_000, m, replace=False).tolist()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = spark.createDataFrame(rows, "anchor long, block long, n int").repartition(4)
        got = sorted((r.anchor, r.block, r.n, r.before) for r in sd._repeated_anchors(found, 2, hot).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for a in range(7):
        own = sorted((b, n) for x, b, n in rows if x == a)
        total = sum(n for _, n in own)
        want += [(a, b, n, sum(m for _, m in own[:i]) if total > hot else -1) for i, (b, n) in enumerate(own) if total > 1]
    assert got == want


@pytest.mark.parametrize("hot", [1_000, 2])
def test_against_brute_force(spark, hot):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcde é"), rng.integers(1, 9)))
    parts = [" ".join(word() for _ in range(40)) for _ in range(12)]
    rows = [(i, " ".join(parts[j] for j in rng.integers(0, 12, rng.integers(0, 6)))) for i in range(40)]
    rows += [(50, "xy" * 400), (51, "yx" * 300), (52, parts[0]), (53, parts[0]), (54, "z" * 99), (55, "z" * 100), (56, "z" * 101)]
    df = docs_of(spark, *rows).repartition(5)
    got = sorted((tuple(r) for r in sd.removed(df, hot=hot).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 1_000


def test_odd_rows(spark, odd, none):
    got = {}
    for r in sd.removed(odd, keep_text=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [r.n_removed for r in got[2] + got[3] + got[1] + got[7]] == [0] * 6 and bytes(got[3][0].kept) == b""
    long = odd.where("doc_id = 4").first().text.encode()
    assert got[4][0].n_removed + len(got[4][0].kept) == len(long) == got[5][0].n_removed and got[5][0].n_spans == 1
    assert sd.removed(none).count() == 0
    twice = docs_of(spark, (9, "q" * 50 + "r" * 60), (9, "q" * 50 + "r" * 60), (None, "q" * 50 + "r" * 60))
    assert sorted(r.n_removed for r in sd.removed(twice).collect()) == [0, 110, 110]


def test_rows_of_an_rdd_are_stored(spark, monkeypatch):
    """An RDD may give its rows in another order each time it is read."""
    made = []
    monkeypatch.setattr(common, "stored", lambda df, name: made.append(name) or df)
    shuffled = spark.sparkContext.parallelize(range(100), 3).mapPartitions(lambda rows: sorted(rows, key=lambda _: random.random())).map(lambda i: (i, str(i)))
    common.steady(shuffled.toDF("doc_id long, text string"), "rdd")
    common.steady(spark.range(5).selectExpr("id as doc_id", "'x' as text"), "range")
    assert made == ["rdd"]
