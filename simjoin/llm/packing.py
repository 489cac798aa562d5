"""Packing by power-of-two decomposition.

A document's token count is written in binary and the document is cut into one piece per
set bit, largest first; what exceeds the sequence limit is cut into pieces of that limit.
A piece is a sequence by itself, so no sequence crosses documents, nothing is padded
(every length is a power of two), and equal lengths form the buckets that batches are
drawn from. The work is a single narrow pass: no shuffle at any size of the corpus.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simjoin.llm.common import own_columns, with_schema

MAX_TOKENS = 2048
END_ID = 1
#: Words that a Python worker remembers the ids of; beyond it, the memory starts anew.
REMEMBERED = 400_000

# Fixed value: how the byte-level vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same pattern with its classes written out for code points below U+0250, where the
# standard library's engine can take it; texts with other code points use the pattern above.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \u0085\u00a0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\u0000-ɏ]")


def _byte_of() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: visible Latin-1 is itself, the rest follows U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Ids(dict):
    """Piece of text -> its ids as little-endian uint32 bytes, encoded on first sight."""

    def __init__(self, encoding):
        super().__init__()
        self.encode = encoding.encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        ids = self[piece] = np.array(self.encode(piece), dtype="<u4").tobytes()
        return ids


class Encoder:
    """Token ids of whole texts, as the library of the file's format gives them.

    The string of an added token in a text is that token, as there; with ``added`` false it
    is ordinary text.
    """

    def __init__(self, path: str, added: bool = True):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        if any(t[k] for t in held["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take more than their own string are not supported")
        self.added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in held["added_tokens"] if added}
        # of tokens that begin alike the longest is taken
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        byte_of, vocab = _byte_of(), model["vocab"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        if any(vocab[m] != 256 + i for i, m in enumerate(merged)):
            raise ValueError("ids of this vocabulary do not follow the order of its merges")
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merged)}
        encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole, self.ids = encoding.encode_ordinary, _Ids(encoding)

    def __call__(self, text: str) -> bytes:
        if self.cut and self.cut.search(text):
            return b"".join(self.added[t] if i % 2 else self.plain(t) for i, t in enumerate(self.cut.split(text)))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if _BEYOND.search(text):
            return np.array(self.whole(text), dtype="<u4").tobytes()
        return b"".join(map(self.ids.__getitem__, _LATIN.findall(text)))


@functools.lru_cache(maxsize=2)
def encoder(path: str, added: bool = True) -> Encoder:
    return Encoder(path, added)


def cuts(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole limits, then the binary digits of the rest."""
    out = [(s, limit) for s in range(0, n - n % limit, limit)]
    start, rest = n - n % limit, n % limit
    while rest:
        piece = 1 << (rest.bit_length() - 1)
        out.append((start, piece))
        start, rest = start + piece, rest - piece
    return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bucket", pa.int32())])


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, keep_ids: bool = False, added: bool = True) -> DataFrame:
    """One row per piece of the documents (doc_id, text).

    ``tokenizer`` is the path of a byte-level BPE file, readable on every executor (it is
    installed there, as a library's data). ``max_tokens`` must be a power of two. With
    ``keep_ids`` the rows carry the ids as well. With ``added`` false, the strings of added
    tokens (as "<|endoftext|>") in texts are ordinary text, for untrusted corpora. ``bucket`` is the binary logarithm of the
    length, ``sequence_id`` a number that is unique within the result.

    A null text is an empty one: its document is the single end id. A null doc_id stays
    null. Rows that repeat, or share a doc_id, are packed each by itself. An empty table
    gives an empty result; other columns are ignored. A text of any length is taken whole.
    """
    if max_tokens & (max_tokens - 1) or max_tokens < 1:
        raise ValueError("max_tokens must be a power of two")
    schema = SCHEMA.append(pa.field("ids", pa.list_(pa.int64()))) if keep_ids else SCHEMA
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, next_id = encoder(tokenizer, added), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows: dict[str, list] = {f.name: [] for f in schema}
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    pieces = cuts(len(ids) // 4, max_tokens)
                    rows["doc_id"] += [doc] * len(pieces)
                    rows["doc_tokens"] += [len(ids) // 4] * len(pieces)
                    for start, length in pieces:
                        rows["start"].append(start)
                        rows["length"].append(length)
                        rows["ids_crc32"].append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                        if keep_ids:
                            rows["ids"].append(np.frombuffer(ids, "<u4", length, 4 * start).astype(np.int64))
                n = len(rows["start"])
                rows["sequence_id"] = np.arange(next_id, next_id + n)
                rows["offset"] = np.zeros(n, np.int64)
                rows["bucket"] = np.log2(np.array(rows["length"], dtype=np.int64).clip(1)).astype(np.int32)
                next_id += n
                yield from with_schema([rows], schema)

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + ", ids array<long>" * keep_ids
    return own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, out)


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, one folder for each length, for batches of equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)


def bucket_report(packed: DataFrame) -> DataFrame:
    """Sequences and tokens of each length; ``padding`` is always 0, which the row shows."""
    return packed.groupBy("bucket").agg(F.count("*").alias("sequences"), F.sum("length").alias("tokens"), F.sum(F.pow(F.lit(2.0), "bucket").cast("long") - F.col("length")).alias("padding"))
