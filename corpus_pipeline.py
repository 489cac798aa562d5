"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes what its predecessor kept, as it was written and read again, and applies
one operator of ``simjoin.llm`` to all of it.

All but the last return the rows they keep with all columns, whatever these are called.
Rows that repeat are rows like others until near copies go. A null text is like an empty
one, but stays null; a null doc_id never makes a row go but for what its own text holds.
An empty table passes through every stage and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from simjoin.llm import decontam, packing, pii, simhash, toxicity
from simjoin.llm.common import discard, scratch, stored, table
from simjoin.llm.queries import pseudonym_key, tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose severity the ordinal model puts above the lowest grade.

    The model is fitted to those labels whose documents are there, 8 000 of them at most.
    Without labels of both classes nothing goes, or, if all are toxic, everything. Null and
    empty texts have no evidence and are judged by the thresholds alone, which keeps them.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("not rejected").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies.

    Near means five-word runs with a Jaccard similarity of 0.8 or more. Null and empty texts
    are copies of each other. Rows with a null doc_id stay, and of rows that share the kept
    doc_id all stay.
    """
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten consecutive words of a benchmark item.

    A shorter item has to be held whole. Null and empty texts hold nothing; items without
    words make nothing go; rows that share a doc_id are judged each by its own text.
    """
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With pseudonyms for personal data; n_chars follows. All rows stay, null texts null."""
    return pii.pseudonymised(docs, pseudonym_key(spark)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of power-of-two lengths that the documents are cut into.

    A null or empty text is the end id alone; rows that repeat are packed each by itself.
    """
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("packing", pack),
]

#: The stages train a model, hash and tokenize, which SQL does not express; tests/llm hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each stage's result is written and read again.

    What a stage stored for itself, and its input, are deleted once its result is written.
    The last stage is one narrow pass over its input, which therefore stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(docs.stored_path)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
