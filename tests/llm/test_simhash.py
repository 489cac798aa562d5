import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from simjoin.llm import components, simhash
from simjoin.llm.common import Sieve, sifted
from simjoin.llm.queries import QUERIES
from tests.llm.conftest import docs_of


def plain_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for t in ("", " \n", "One two", "A b C d", "a b c d e É f g h g h g h", "x " * 500):
        assert int(simhash.fingerprint(t)[0]) == plain_fingerprint(t)


def test_position_sets_hit_every_shared_choice():
    sets = simhash.position_sets(8, 4, 3)
    assert len(sets) == 20
    assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 4))
    for n, shared, width in ((8, 5, 3), (8, 3, 2), (8, 2, 1), (16, 6, 3)):
        sets = simhash.position_sets(n, shared, width)
        assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(n), shared))


def links(f, bits):
    label = list(range(len(f)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in combinations(range(len(f)), 2):
        if bin(int(f[i]) ^ int(f[j])).count("1") <= bits:
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def found_by_index(spark, f, lists=simhash.LONG_LIST, steps=simhash.STEPS):
    """The component of each fingerprint, through the index on Spark."""
    df = spark.createDataFrame([(i, int(np.uint64(x).astype(np.int64))) for i, x in enumerate(f)], "node long, f0 long")
    simhash.LONG_LIST, simhash.STEPS, before = lists, steps, (simhash.LONG_LIST, simhash.STEPS)
    try:
        edges = simhash.near_edges(df, 1, simhash.position_sets(8, 4, 3), 4, 4, True)
    finally:
        simhash.LONG_LIST, simhash.STEPS = before
    root = {r.node: r.root for r in components.components(edges).collect()}
    return [root.get(i, i) for i in range(len(f))]


def flipped(rng, x, bits):
    return int(x) ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False))


@pytest.mark.parametrize("lists, steps", [(20_000, 4_096), (3, 4_096), (3, 1)])
def test_index_finds_every_link(spark, lists, steps):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    f = [int(b) for b in base] + [flipped(rng, base[rng.integers(30)], rng.integers(1, 7)) for _ in range(200)]
    # a family that three bytes and a constant fourth do not tell apart, more than a short list holds
    f += [int(x) for x in rng.integers(0, 2**32, 500, dtype=np.uint64)]
    f += [f[-k] ^ 0b1111 << 7 * k for k in range(1, 4)] + [flipped(rng, 77, 3) for _ in range(300)]
    f = list(dict.fromkeys(f))
    assert found_by_index(spark, f, lists, steps) == links(f, 4)


def test_long_list_of_four_equal_bytes(spark):
    rng = np.random.default_rng(6)
    f = [int(x) for x in np.unique(rng.integers(0, 2**32, 21_000, dtype=np.uint64))]
    planted = f[0] ^ 0x01010101  # a bit in each of the other four bytes
    f = [x for x in f if x != planted] + [planted]
    got = found_by_index(spark, f)
    assert got[-1] == got[0] == 0
    near = lambda k: np.flatnonzero(np.bitwise_count(np.array(f, np.uint64) ^ np.uint64(f[k])) <= 4)
    assert all(got[j] == got[k] for k in range(0, len(f), 50) for j in near(k))


def test_search_reaches_what_links_reach():
    rng = np.random.default_rng(4)
    f = np.unique(np.array([flipped(rng, 77, 3) for _ in range(600)] + [flipped(rng, 2**60 + 5, 30) for _ in range(300)], np.uint64)).reshape(-1, 1)
    root, waits = simhash.reached(f, 4, 4)
    want = links(f[:, 0], 4)
    assert not waits.any() and simhash.roots(len(f), np.arange(len(f)), root).tolist() == want
    a, b = simhash._short(f, np.array([[0, len(f)]]), 4, 4)
    assert simhash.roots(len(f), a, b).tolist() == want
    # cut short, what is linked and what waits hold all links between them
    root, waits = simhash.reached(f, 4, 4, 20)
    at = np.flatnonzero(waits)
    rest = simhash.reached(f[at], 4, 4)[0]
    assert len(at) and simhash.roots(len(f), np.concatenate([np.arange(len(f)), at]), np.concatenate([root, at[rest]])).tolist() == want


def test_whole_query_against_brute_force(spark):
    """All of the smallest documents table, by the definition."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    f = [plain_fingerprint(t) for t in docs.text]
    order = np.argsort(docs.doc_id.to_numpy(), kind="stable")
    want, label = {}, links([f[i] for i in order], 4)
    for k, i in enumerate(order):
        want[int(docs.doc_id[i])] = (f"{f[i]:016x}", int(docs.doc_id[order[label[k]]]))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and any(v[1] != k for k, v in want.items())


def test_odd_rows(spark, odd, none):
    got = {}
    for r in simhash.near_duplicates(odd).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {r.fingerprint for i in (2, 3, 6) for r in got[i]} == {"0" * 16} and {got[i][0].component_id for i in (2, 3, 6)} == {2}
    assert [r.component_id for r in got[1]] == [1, 1, 1] and [r.component_id for r in got[None]] == [None, None]
    assert got[5][0].component_id == 4 and got[7][0].component_id == 7
    assert simhash.near_duplicates(none).count() == 0


def test_similar_groups(spark, odd, none):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(2_000)]
    base = [list(rng.choice(words, 300)) for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    near = []
    for i in range(30):  # three changed words of 300: similarity 0.9 at five words
        b = base[i].copy()
        for at in (50, 150, 250):
            b[at] = "changed"
        near.append((100 + i, " ".join(b)))
        b = base[i].copy()
        b[:200] = rng.choice(words, 200)
        near.append((200 + i, " ".join(b)))  # a third in common
    kept = sorted(r.doc_id for r in simhash.one_of_each(docs_of(spark, *rows, *near)).collect())
    assert kept == [*range(30), *range(200, 230)]
    out = simhash.one_of_each(odd)
    assert out.columns == odd.columns and sorted(str(r.doc_id) for r in out.collect()) == sorted(["1", "1", "1", "2", "4", "7", "None", "None"])
    assert simhash.one_of_each(none).count() == 0


def test_equal_fingerprints_are_verified(spark):
    own = [" ".join(f"w{k}x{i}" for i in range(100)) for k in range(9)]
    line = " ".join(f"line{i}" for i in range(9)) + " "
    rows = [(3 * j + k, own[3 * j + k] + " " + filler) for j, filler in enumerate((". " * 120, "na " * 150, line * 200)) for k in range(3)]
    rows.append((100, rows[4][1] + " "))  # the same runs
    assert sorted(r.doc_id for r in simhash.one_of_each(docs_of(spark, *rows)).collect()) == list(range(9))


def jaccard_groups(texts, n=5, least=0.8):
    sets = [set(simhash.shingles(t, n)) for t in texts]
    ok = [(i, j) for i, j in combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    return ok, simhash.roots(len(sets), *np.array(ok, np.int64).reshape(-1, 2).T).tolist()


def loose_family(count, words, edits):
    rng = np.random.default_rng(11)
    base = np.array([f"w{i}" for i in range(words)], object)
    out = []
    for k in range(count):
        t = base.copy()
        t[rng.choice(words, edits, replace=False)] = [f"e{k}x{i}" for i in range(edits)]
        out.append(" ".join(t))
    return out


def test_alike_finds_every_pair():
    texts = loose_family(60, 400, 6)
    marks = [np.array(sorted({xxhash.xxh32_intdigest(p, 1) for p in simhash.shingles(t, 5)}), np.uint32) for t in texts]
    ok, want = jaccard_groups(texts)
    assert ok and len(set(want)) > 1
    found = np.array(simhash.alike(marks, 0.8), np.int64).reshape(-1, 2)
    assert simhash.roots(60, *found.T).tolist() == want
    side = np.arange(60) % 2
    found = np.array(simhash.alike(marks, 0.8, side), np.int64).reshape(-1, 2)
    across = np.array([p for p in ok if side[p[0]] != side[p[1]]], np.int64).reshape(-1, 2)
    assert simhash.roots(60, *found.T).tolist() == simhash.roots(60, *across.T).tolist()


def test_loose_families_keep_their_links(spark, monkeypatch):
    texts = loose_family(150, 400, 6)
    _, want = jaccard_groups(texts)
    for sets in (8_192, 40):
        monkeypatch.setattr(simhash, "FAMILY_SETS", sets)
        got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs_of(spark, *enumerate(texts))).collect()}
        assert [got[i] for i in range(150)] == want


def test_repetition_does_not_hide_copies(spark):
    text, line = " ".join(f"w{i}" for i in range(300)), " " + " ".join(f"line{i}" for i in range(12))
    rows = [(k, text + line * n) for k, n in enumerate((2, 12, 1, 40))]
    assert (simhash.fingerprint(rows[0][1], 5, 4, True) == simhash.fingerprint(rows[1][1], 5, 4, True)).all()
    assert [r.doc_id for r in simhash.one_of_each(docs_of(spark, *rows)).collect()] == [0]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got.get(i, i) for i in range(41)} == {0} and {got.get(100 + i, 100 + i) for i in range(50)} == {100} and 0 not in got


def test_sieve_loses_none(spark):
    ids = spark.range(0, 3_000, 3).selectExpr("id * id as id")
    rows = spark.range(-50, 9_000).selectExpr("id as doc_id", "id as w", "id as mask").unionByName(spark.sql("select cast(null as long) as doc_id, 1L as w, 2L as mask"))
    sieve = Sieve.of(ids)
    has, lacks = sifted(rows, rows["doc_id"], sieve), sifted(rows, rows["doc_id"], sieve, False)
    assert has.columns == rows.columns and has.count() + lacks.count() == rows.count() and has.count() < 1_500
    assert {r.doc_id for r in has.collect()} >= {k * k for k in range(0, 94, 3)} and lacks.where("doc_id is null").count() == 1
    assert sifted(rows, rows["doc_id"], Sieve.of(ids.limit(0))).count() == 0
