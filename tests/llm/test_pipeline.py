"""The pipeline's stages on the smallest tables, and the queries' SQL twins."""

import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from simjoin.llm import common, pii, simhash
from simjoin.llm.packing import encoder
from simjoin.llm.queries import ORACLES, QUERIES, pseudonym_key, tokenizer_path
from simjoin.llm.simhash import shingles

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage was given and kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    assert all(df.columns == columns for df in out[:-1])
    return [df.toPandas() for df in out]


def test_toxic_documents_go(spark, kept):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().set_index("doc_id")
    left = set(kept[1].doc_id)
    gone = [i not in left for i in labels.index]
    assert np.mean([g for g, t in zip(gone, labels.toxic) if t]) > 0.8 and np.mean([g for g, t in zip(gone, labels.toxic) if not t]) < 0.05


def test_one_of_each_group_stays(kept):
    before, after = kept[1], set(kept[2].doc_id)
    runs = {i: frozenset(shingles(t, 5)) for i, t in zip(before.doc_id, before.text)}
    alike = lambda a, b: len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b])
    ids = sorted(runs)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if alike(a, b)]
    assert not [p for p in pairs if p[0] in after and p[1] in after]
    assert all(any(b == i for _, b in pairs) for i in ids if i not in after)


def test_no_window_of_the_benchmark_is_left(spark, kept):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(w[k : k + 10]) for t in spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas().text for w in [split(t)] for k in range(len(w) - 9)}
    bad = {i for i, t in zip(kept[2].doc_id, kept[2].text) for w in [split(t)] if any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))}
    assert set(kept[3].doc_id) == set(kept[2].doc_id) - bad


def test_pseudonyms_and_pieces(spark, kept):
    f, before = pii.Feistel(pseudonym_key(spark)), dict(zip(kept[3].doc_id, kept[3].text))
    after = dict(zip(kept[4].doc_id, kept[4].text))
    assert after == {i: pii.replaced(t, pii.spans(t, f)) for i, t in before.items()}
    encode, total = encoder(tokenizer_path()), 0
    for r in kept[5].itertuples():
        ids = encode(after[r.doc_id]) + b"\x01\0\0\0"
        assert zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        total += r.length
    assert total == sum(len(encode(t)) // 4 + 1 for t in after.values())


def test_run_is_the_stages(spark, kept):
    got = corpus_pipeline.run(spark, DATA).toPandas()
    assert sorted(zip(got.doc_id, got.start, got.ids_crc32)) == sorted(zip(kept[5].doc_id, kept[5].start, kept[5].ids_crc32))


def test_odd_and_empty_tables(spark, odd, none, tmp_path):
    """Through every stage: nulls, empty and long texts, repeated rows, columns of clashing names; and no rows at all."""
    toxic = [(100 + i, f"vile awful nasty words number {i}") for i in range(60)] + [(200 + i, f"kind calm plain words number {i}") for i in range(60)]
    item = "ten words of a test item that a document holds"
    more = spark.createDataFrame([(*r, *([0] * 5), "k", "p", "i", "s", 0) for r in [*toxic, (300, f"before {item} after"), (301, "call 555-123-4567 now or mail a@b.example")]], odd.schema)
    labels = [(i, 1, int(i < 200)) for i, _ in toxic if i % 2]
    tables = {"documents": odd.unionByName(more), "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string")}
    for empty in (False, True):
        path = str(tmp_path / str(empty))
        for name, df in tables.items():
            (df.limit(0) if empty else df).write.parquet(f"{path}/{name}.parquet")
        docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, path)
            if name != "packing":
                assert out.columns == odd.columns
            out.write.parquet(f"{path}/{name}")
            docs = spark.read.parquet(f"{path}/{name}")
            kept.append(sorted((str(r.doc_id) for r in docs.collect())))
        if empty:
            assert kept == [[]] * 5
            continue
        assert not set(kept[0]) & {str(100 + i) for i in range(60)} and {str(200 + i) for i in range(60)} <= set(kept[0])
        assert kept[0].count("1") == 3 and kept[0].count("None") == 2
        assert kept[1].count("1") == 3 and kept[1].count("None") == 2 and [x for x in kept[1] if len(x) == 1 and x in "23456"] == ["2", "4"]
        assert set(kept[1]) - set(kept[2]) == {"300"} and kept[3] == kept[2]
        texts = {r.doc_id: r for r in spark.read.parquet(f"{path}/pii").collect()}
        assert "555-123-4567" not in texts[301].text and "a@b" not in texts[301].text and texts[2].text is None and texts[301].n_chars == len(texts[301].text)
        assert set(kept[4]) == set(kept[3]) and kept[4].count("2") == 1
        assert corpus_pipeline.run(spark, path).count() == len(kept[4])


def test_scratch_tables_go(spark, odd):
    with common.scratch(spark):
        before = set(Path(common.shared_dir(spark).removeprefix("file:")).iterdir())
        assert simhash.near_duplicates(odd).count() == odd.count()
        made = set(Path(common.shared_dir(spark).removeprefix("file:")).iterdir()) - before
        assert made
    assert not any(p.exists() for p in made)


def test_what_is_read_again_is_steady(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert common.steady(table.select("doc_id").where("doc_id > 1"), "t").inputFiles() == table.inputFiles()
    for df in (table.repartition(3), table.distinct(), table.select(F.rand().alias("r"))):
        assert common.steady(df, "t").inputFiles() != table.inputFiles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got, found = QUERIES[name](spark, DATA), con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(str(r[names.index(c)]) for c in got.columns) for r in found.fetchall()) == sorted(tuple(map(str, r)) for r in got.collect())


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and len([q for q in QUERIES if q.startswith("op")]) == 13
