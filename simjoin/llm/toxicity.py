"""Toxicity as an ordinal regression with cumulative links.

Severity has grades 0 .. G - 1. All grade boundaries share one weight vector over sparse
text features and differ in their threshold alone: P(grade > j) = sigmoid(w.x - t_j) with
t_0 < t_1 < ... The score of a document is its expected severity, the sum of these.

A document is judged by its worst part: its words are cut into windows of ``WINDOW`` words,
each half over the one before, and its score is the largest of any. So a toxic passage counts
the same wherever it stands and however much text there is around it. The model is trained
by the same rule: in each step a row's slope goes to the window that is its worst then.

Labels say toxic or not. Toxic training rows are graded by how dense their evidence is: the
largest share of a window's words that have a feature which tells toxic rows from others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simjoin.llm.common import own_columns

#: Labelled rows that are used at most, the first by a hash of their id.
SAMPLE = 8_000
FEATURES = 4_096
GRADES = 3
#: Documents with a probability of any severity from here on are rejected.
REJECT_FROM = 0.5
#: Chi-square (one degree of freedom) from which a feature counts as telling.
TELLING = 20.0
#: Words that a Python worker remembers the features of.
REMEMBERED = 500_000
#: How far toxic rows, which are few, weigh more than others: at 1 both classes weigh the same, at 0 all rows.
BALANCE = 0.5
PREFIXES = (4, 5, 6)
#: Words of a window; the next one starts half as many on, and the last may be shorter.
WINDOW = 50
#: Bytes of a text up to which a labelled row may be in the sample, which so has a bound in bytes.
SAMPLE_TEXT = 1 << 16

_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word, and its beginnings, which stand for its family."""
    return [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)]


def value(count: float) -> float:
    """How much ``count`` occurrences in a window say."""
    return math.log2(1 + count)


def windows(words: int) -> list[tuple[int, int]]:
    """(start, end) of the windows over so many words; a text of one window's length or less has one."""
    half = WINDOW // 2
    return [(at, min(at + WINDOW, words)) for at in range(0, max(words - half, 1), half)]


@dataclass(frozen=True)
class Model:
    """Weights by feature, and the thresholds between grades, in order."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def probabilities(self, score: float) -> list[float]:
        """P(grade > j) for each threshold."""
        return [1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds]


class Scorer:
    """Scores texts; remembers which features the words it met have."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def score(self, text: str | None) -> float:
        """The score of the worst window; windows without features have zero, and weights are not negative."""
        known, weights, half = self.known, self.model.weights, WINDOW // 2
        words, blocks = 0, {}  # features of each half of a window that has any
        for words, found in enumerate(_WORD.finditer((text or "").lower()), 1):
            w = found[0]
            has = known.get(w)
            if has is None:
                if len(known) > REMEMBERED:
                    known.clear()
                has = known[w] = tuple(f for f in features(w) if f in weights)
            if has:
                block = blocks.setdefault((words - 1) // half, {})
                for f in has:
                    block[f] = block.get(f, 0) + 1
        best, last, nothing = 0.0, len(windows(words)) - 1, {}
        for n in {min(x, last) for b in blocks for x in (b - 1, b) if x >= 0}:
            one, two = blocks.get(n, nothing), blocks.get(n + 1, nothing)
            score = sum(weights[f] * value(c + two.get(f, 0)) for f, c in one.items())
            best = max(best, score + sum(weights[f] * value(c) for f, c in two.items() if f not in one))
        return best


class _Rows:
    """Training rows as arrays: the distinct words of each window, their counts, and each word's features."""

    def __init__(self, texts: Iterator[str | None]):
        words: dict[str, int] = {}
        self.ids, self.counts, self.first = [], [], []  # of windows; the first window of each row
        for text in texts:
            found = _WORD.findall((text or "").lower())
            found = np.fromiter((words.setdefault(w, len(words)) for w in found), np.int64, len(found))
            self.first.append(len(self.ids))
            for start, end in windows(len(found)):
                ids, counts = np.unique(found[start:end], return_counts=True)
                self.ids.append(ids)
                self.counts.append(counts)
        self.names: dict[str, int] = {}
        self.of = np.full((len(words), 1 + len(PREFIXES)), -1, np.int64)
        for w, i in words.items():
            for j, f in enumerate(features(w)):
                self.of[i, j] = self.names.setdefault(f, len(self.names))

    def select(self, toxic: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The features whose presence in a row tells toxic ones best (chi-square), and their log-odds.

        Features of the other class are not taken and weights are not negative, so that no
        text around a toxic passage speaks for it.
        """
        present = np.zeros((2, len(self.names)))
        for first, end, y in zip(self.first, [*self.first[1:], len(self.ids)], toxic, strict=True):
            held = np.unique(self.of[np.concatenate(self.ids[first:end])])
            present[y, held[held >= 0]] += 1
        n0, n1 = np.bincount(toxic, minlength=2)
        b, a = present
        share = (a + b) / (n1 + n0)
        gain = np.where(a + b >= 3, (a / n1 - b / n0) ** 2 / np.maximum(share * (1 - share), 1e-9), 0) * (n1 + n0)
        best = np.lexsort((np.arange(len(gain)), -gain))[:most]
        best = best[(gain[best] >= TELLING) & (a[best] * n0 > b[best] * n1)]
        return best, np.log((a[best] + 0.5) / (n1 + 1)) - np.log((b[best] + 0.5) / (n0 + 1))


def slopes(eta: np.ndarray, t: np.ndarray, grade: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades, rows weighted, and its derivatives by scores and thresholds."""
    n, each = len(eta), np.arange(len(eta))
    above = np.concatenate([np.ones((1, n)), 1 / (1 + np.exp(-np.clip(eta - t[:, None], -60, 60))), np.zeros((1, n))])  # P(grade >= j)
    p = np.maximum(above[grade, each] - above[grade + 1, each], 1e-12)
    slope = above * (1 - above)
    up, down = weight * slope[grade, each] / p, weight * slope[grade + 1, each] / p
    d_t = np.array([(np.where(grade == j + 1, up, 0) - np.where(grade == j, down, 0)).sum() for j in range(len(t))]) / n
    return float(-(weight * np.log(p)).mean()), (down - up) / n, d_t


def train(rows: list[tuple[str | None, int]], grades: int = GRADES, most: int = FEATURES, steps: int = 300, l2: float = 1e-3) -> Model:
    """Fits the model to (text, toxic) rows on the driver; the caller bounds their number."""
    toxic = np.array([int(y or 0) for _, y in rows], np.int64)
    if not len(rows) or toxic.min() == toxic.max():  # nothing to tell apart
        low = -1.0 if len(rows) and toxic.min() else 1.0
        return Model({}, tuple(low * 10 + j for j in range(grades - 1)))
    data = _Rows(t for t, _ in rows)
    chosen, odds = data.select(toxic, most)
    column = np.full(len(data.names) + 1, -1)  # the last for no feature
    column[chosen] = np.arange(len(chosen))
    row, col, val, density = [], [], [], np.zeros(len(data.ids))
    for i, (ids, counts) in enumerate(zip(data.ids, data.counts, strict=True)):
        held, n = column[data.of[ids]], int(counts.sum())
        density[i] = (counts * ((held >= 0) & (odds[held] > 1.5)).any(1)).sum() / max(n, 1) if len(chosen) else 0
        found = np.bincount(held[held >= 0], np.broadcast_to(counts[:, None], held.shape)[held >= 0], len(chosen)) if len(chosen) else np.empty(0)
        at = np.flatnonzero(found)
        row += [i] * len(at)
        col += at.tolist()
        val += [value(c) for c in found[at]]
    row, col, val, first = np.array(row, np.int64), np.array(col, np.int64), np.array(val), np.array(data.first)
    density, of = np.maximum.reduceat(density, first), np.repeat(np.arange(len(rows)), np.diff(np.append(first, len(data.ids))))
    cuts = np.quantile(density[toxic == 1], [j / (grades - 1) for j in range(1, grades - 1)])
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, density, "right"), 0).clip(0, grades - 1)

    weight = np.where(toxic == 1, ((toxic == 0).sum() / toxic.sum()) ** BALANCE, 1.0)
    weight /= weight.mean()
    w, t = 0.1 * odds, np.log(np.linspace(0.9, 0.99, grades - 1) / np.linspace(0.1, 0.01, grades - 1))
    moment = [np.zeros(len(w) + len(t)) for _ in range(2)]
    for step in range(1, steps + 1):
        eta = np.bincount(row, val * w[col], len(data.ids))
        worst = np.lexsort((-eta, of))[first]  # one window of each row
        _, slope, d_t = slopes(eta[worst], t, grade, weight)
        d_eta = np.zeros(len(data.ids))
        d_eta[worst] = slope
        g = np.concatenate([np.bincount(col, val * d_eta[row], len(w)) + l2 * w, d_t])
        for k, x in enumerate((g, g * g)):
            moment[k] = (0.9, 0.999)[k] * moment[k] + (0.1, 0.001)[k] * x
        move = 0.1 * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-8)
        w, t = np.maximum(w - move[: len(w)], 0), np.maximum.accumulate(t - move[len(w) :] + 1e-6 * np.arange(grades - 1))
    return Model({f: float(w[column[i]]) for f, i in data.names.items() if column[i] >= 0}, tuple(map(float, t)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Model:
    """The model of the labelled documents: at most ``sample`` of them, the first by a hash of doc_id.

    Of these, texts of over ``SAMPLE_TEXT`` bytes are left out of the training, so the driver
    gets half a gigabyte at most, whatever the texts' lengths; scoring takes every text whole. Labels with a null, and labels of documents that are not there, are left out. Without
    both classes the model rejects nothing, or, with toxic rows alone, everything.
    """
    labels = own_columns(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") != 0).cast("int").alias("toxic"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    few = docs.sparkSession.createDataFrame(chosen, labels.schema)  # at most ``sample`` pairs of numbers
    texts = own_columns(docs, "doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT).join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return train([(r.text, r.toxic) for r in texts.orderBy("doc_id").collect()], **options)


def scored(docs: DataFrame, model: Model, reject_from: float = REJECT_FROM) -> DataFrame:
    """The rows, with all their columns, and severity (expected grade), grade, rejected.

    ``grade`` is the number of boundaries that are passed with probability 0.5 or more. A
    null or empty text is one window without features, so it is scored like any text without evidence.
    Columns of the added names are replaced. Rows are scored each by itself in one narrow
    pass; ties, repeated rows, null ids and empty tables need nothing special.
    """
    columns = [c for c in docs.columns if c not in ("severity", "grade", "rejected")]
    kind = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    sent, text_at = docs.sparkSession.sparkContext.broadcast(model), columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            p = [sent.value.probabilities(scorer.score(t.as_py())) for t in batch.column(text_at)]
            more = [pa.array([sum(x) for x in p], pa.float64()), pa.array([sum(y >= 0.5 for y in x) for x in p], pa.int32()), pa.array([x[0] >= reject_from for x in p], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, "severity", "grade", "rejected"])

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, kind + ", severity double, grade int, rejected boolean")
