import hashlib
import random

import pytest
from pyspark.sql import functions as F

from simjoin.llm import line_dedup
from tests.llm.conftest import docs_of

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain(rows, least=10):
    """(doc_id, n_lines, n_dropped, digest) of each row, in order."""
    split = [(d, (t or "").split("\n")) for d, t in rows]
    place = lambda d: (d is None, d or 0)
    first = {}
    for d, lines in split:
        for k in map(key, lines):
            first[k] = min(first.get(k, place(d)), place(d))
    out = []
    for d, lines in split:
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == place(d)]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def told(docs, **options):
    return sorted((tuple(r) for r in line_dedup.digests(line_dedup.deduplicated(docs, **options)).collect()), key=str)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert told(odd) == plain(rows)
    assert told(none) == [] and line_dedup.keep_bitmaps(none).count() == 0


def test_edges(spark):
    rows = [
        (5, "A shared line\nown line of five\nA SHARED LINE  "),
        (2, "\ta shared line\r\nshort\n\nshort\nÄ shared line\nä shared line"),
        (3, "short\n a shared line\na shared line\nä shared line\n123456789\n1234567890"),
        (9, "123456789\n1234567890\n\n"),
        (None, "1234567890\nonly without id here\nonly without id here"),
        (None, "only without id here"),
        (7, "\n"),
        (8, "a\x0bshared line\n\x1ca shared line"),
    ]
    assert told(docs_of(spark, *rows)) == plain(rows)


@pytest.mark.parametrize("frequent", [10_000, 3])
def test_random_lines(spark, frequent, monkeypatch):
    """Many lines over many words of the bitmaps, with and without frequent digests."""
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(line_dedup, "SHARES", 50)
    rng = random.Random(7)
    pool = [f"Sentence number {i} of the pool" for i in range(300)]
    rows = [(rng.choice([None, *range(40)]), "\n".join(rng.choice([pool[0], rng.choice(pool), "tiny", f"unique {rng.random()}", ""]) for _ in range(rng.choice([1, 3, 63, 64, 65, 400])))) for _ in range(60)]
    assert told(docs_of(spark, *rows).repartition(5)) == plain(rows)


def test_bitmaps_are_sparse(spark):
    lines = [f"line number {i:05d}" for i in range(10_000)]
    rows = [(1, "\n".join([lines[63], lines[64], lines[9_999]])), (2, "\n".join(lines))]
    (found,) = line_dedup.keep_bitmaps(docs_of(spark, *rows)).collect()
    assert found.doc_id == 2 and found.n_dropped == 3 and [w.word for w in found.keep] == [0, 1, 156]
    assert [64 - bin(w.mask & (1 << 64) - 1).count("1") for w in found.keep] == [1, 1, 1]


def test_no_python_and_no_text_in_the_ranges(spark):
    docs = docs_of(spark, (1, "a line that repeats"), (2, "a line that repeats"))
    found = line_dedup.deduplicated(docs)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    ranges = line_dedup.repeated(spark.createDataFrame([(b"0" * 16, 1, 1, 0)], "digest binary, doc_id long, text_hash long, position int"))
    plan = ranges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning(digest" not in plan.split("Window", 1)[1]


def test_other_limits(spark):
    rows = [(1, "abc\nabcd"), (2, "abc\nabcd")]
    assert told(docs_of(spark, *rows), least=4) == plain(rows, 4)
    assert line_dedup.deduplicated(docs_of(spark, *rows), 4).where(F.col("doc_id") == 2).first().text == "abc"
