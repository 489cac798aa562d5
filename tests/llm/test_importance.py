import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from simjoin.llm import importance
from simjoin.llm.importance import Resampling
from tests.llm.conftest import docs_of


def features(text, longest=1):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, how):
    bucket = lambda f: zlib.crc32(f.encode()) % how.buckets
    s, t = ([0] * how.buckets for _ in range(2))
    for rows, counts in ((docs, s), (target, t)):
        for _, text in rows:
            for f in features(text, how.longest)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + how.buckets) / ((a + 1) * (sum(t) + how.buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc, text in docs:
        w, f = features(text, how.longest)
        h = int(hashlib.sha256(f"{how.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        rows.append([doc, len(f), len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    part = sorted((r for r in rows if r[2] >= how.least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(part[: how.percent * len(part) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=str)


def told(docs, target, how):
    return sorted((tuple(r) for r in importance.resampled(docs, target, how).collect()), key=str)


def texts(rng, n, words):
    pool = [f"Word{i}" for i in range(200)] + ["Ünï", "漢字", "x.y", "A-b"]
    return [(i if rng.random() < 0.9 else rng.choice([None, 3]), " ".join(rng.choice(pool) for _ in range(rng.randint(0, words)))) for i in range(n)]


@pytest.mark.parametrize("how", [Resampling(), Resampling(buckets=64, longest=3, least=5, percent=35, seed=1), Resampling(percent=100, least=0)])
def test_against_plain(spark, how, monkeypatch):
    monkeypatch.setattr(importance, "IDS", 16)
    monkeypatch.setattr(importance, "PIECE", 40)
    rng = random.Random(how.buckets)
    docs, target = [*texts(rng, 300, 60), (7, None), (8, "")], [*texts(rng, 20, 30), (1, None)]
    assert told(docs_of(spark, *docs).repartition(6), docs_of(spark, *target), how) == plain(docs, target, how)


def test_equal_scores_and_the_cutoff(spark, monkeypatch):
    """Rows of one score are ranked by id, over several slices of ids, and the draw ends among them."""
    monkeypatch.setattr(importance, "IDS", 10)
    rows = [(i, 30, 30, 0, 5) for i in range(95)] + [(None, 30, 30, 0, 5), (200, 30, 30, 0, 9), (-3, 30, 30, 0, 5), (300, 3, 3, 0, 99), (4, 30, 30, 0, 5)]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, n_words long, weight long, score long").repartition(7)
    got = {(r.doc_id, r["rank"]) for r in importance.drawn(df, Resampling(percent=50)).where("rank is not null").collect()}
    ids = [200, -3, *sorted([*range(95), 4])]
    assert got == set(zip(ids, range(1, 50)))


def test_odd_tables(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert told(odd, odd, Resampling(percent=60, least=2)) == plain(rows, rows, Resampling(percent=60, least=2))
    assert told(none, none, Resampling()) == [] and told(none, odd, Resampling()) == []
    assert told(odd, none, Resampling()) == plain(rows, [], Resampling())
    assert told(odd.where(F.col("text").isNull()), none, Resampling()) == plain([(2, None), (None, None)], [], Resampling())


def test_the_draw_moves_towards_the_target(spark):
    rng = np.random.default_rng(5)
    of = lambda share: " ".join(rng.choice(["apple", "stone"], 40, p=[share, 1 - share]))
    docs = docs_of(spark, *[(i, of(0.9 if i % 10 == 0 else 0.1)) for i in range(2000)])
    found = importance.resampled(docs, docs_of(spark, *[(i, of(0.9)) for i in range(50)]))
    assert found.where("rank is not null").count() == 200
    assert found.where("rank is not null and doc_id % 10 = 0").count() > 190
