import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from simjoin.llm import packing
from simjoin.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(["<|endoftext|>", "<|endoftext|", "<|", " ", "\n"])), max_size=8).map("".join))
def test_ids_are_those_of_the_tokenizer(reference, text):
    for t in (text, text + " it's  naïve\t\n x²3½ _a-b <|endoftext|> \x1c\x85\xa0 ", f"a b<|endoftext|>c{text}"):
        assert np.frombuffer(packing.encoder(tokenizer_path())(t), "<u4").tolist() == reference(t)


def test_added_tokens_as_ordinary_text():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    for text in ("a b<|endoftext|>c", "<|endoftext|>", "漢<|endoftext|><|endoftext|>"):
        assert np.frombuffer(packing.encoder(tokenizer_path(), False)(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@given(st.integers(1, 20_000))
def test_cuts_cover_in_powers_of_two(n):
    pieces = packing.cuts(n, 2048)
    assert sum(z for _, z in pieces) == n and all(z & (z - 1) == 0 and z <= 2048 for _, z in pieces)
    assert [s for s, _ in pieces] == np.cumsum([0, *(z for _, z in pieces)])[:-1].tolist()


def test_odd_rows(spark, odd, none, reference):
    rows = packing.pack(odd, tokenizer_path(), keep_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length == 1 << r.bucket for r in rows)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    assert [r.ids for r in rows if r.doc_id in (2, 3)] == [[1], [1]]
    four = sorted((r.start, r.ids) for r in rows if r.doc_id == 4)
    assert [i for _, x in four for i in x] == [*reference(odd.where("doc_id = 4").first().text), 1]
    assert sum(r.length for r in rows if r.doc_id == 1) == sum(len(reference(r.text)) + 1 for r in odd.where("doc_id = 1").collect())
    assert packing.pack(none, tokenizer_path()).count() == 0
    assert packing.bucket_report(packing.pack(odd, tokenizer_path())).agg({"padding": "sum"}).first()[0] == 0
    with pytest.raises(ValueError):
        packing.pack(odd, tokenizer_path(), max_tokens=1000)


def test_buckets_on_disk(spark, odd, tmp_path):
    packing.write_buckets(packing.pack(odd, tokenizer_path()), str(tmp_path / "b"))
    assert {r.bucket for r in spark.read.parquet(str(tmp_path / "b")).collect()} >= {0, 11}
