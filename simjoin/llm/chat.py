"""Chat formatting from reply trees.

A tree's messages name their parents. Root-to-leaf paths are enumerated by self-joins that
double the length of the known path ends, so a thread of n messages takes log2(n) rounds.
Branches are ranked by mean score; each chosen path is written as one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simjoin.llm.common import own_columns, stored

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escaped(text: str) -> str:
    """Without the start of any control string; ``unescaped`` undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the ranges of code points that count for the loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"{START}{escaped(role).replace('\n', '\\\n')}\n"
        body = escaped(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), spans


_HEAD = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n", re.DOTALL)


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        end = text.index(END, head.end())
        turns.append((unescaped(head[1]), unescaped(text[head.end() : end])))
        at = end + len(END) + 1
    return turns


def paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """The best ``keep`` root-to-leaf paths of each root: (tree, leaf, rank, node, depth).

    ``messages`` has tree, node, parent (null or unknown: a root) and score (null: 0). The
    score of a path is the mean of its messages; ties go to the smaller leaf. Messages
    whose parents run in a circle belong to no path. A tree's nodes are unique: of a node
    that stands twice, each row would be a message of its own on every path through it.
    """
    joined = lambda a, b, x, y: (F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))) & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))
    m = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    own = m.select("tree", "node")
    up = m.alias("m").join(own.alias("p"), joined("m", "p", "parent", "node"), "left").select("m.tree", "m.node", F.col("p.node").alias("anc"), F.lit(1).cast("long").alias("steps"), "score", "m.node")
    up = up.toDF("tree", "node", "anc", "steps", "score", "top")
    levels, done = [up := stored(up, "levels")], []
    most = up.count().bit_length() + 1  # more only a circle needs
    while True:
        # from node up to, not including, anc: steps messages with that score; top is the last of them
        done.append(up.where("anc is null"))
        up = up.where("anc is not null")
        if len(levels) >= most or not up.limit(1).count():
            break
        known = up
        for d in done:
            known = known.unionByName(d)
        a, b = up.alias("a"), known.alias("b")
        up = a.join(b, joined("a", "b", "anc", "node")).select("a.tree", "a.node", "b.anc", (F.col("a.steps") + F.col("b.steps")).alias("steps"), (F.col("a.score") + F.col("b.score")).alias("score"), "b.top")
        levels.append(up := stored(up, "levels"))
    up = done[0]
    for d in done[1:]:
        up = up.unionByName(d)
    parents = levels[0].where("anc is not null").select("tree", "anc").distinct()
    leaves = up.alias("u").join(parents.alias("p"), joined("u", "p", "node", "anc"), "left_anti")
    order = W.partitionBy("tree", "top").orderBy(F.desc(F.col("score") / F.col("steps")), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("tree", F.col("node").alias("leaf"), "rank", "node")
    for level in reversed(levels):  # every distance is a sum of powers of two
        c, u = chosen.alias("c"), level.where("anc is not null").alias("u")
        chosen = stored(chosen.unionByName(c.join(u, joined("c", "u", "node", "node")).select("c.tree", "c.leaf", "c.rank", F.col("u.anc").alias("node"))), "paths")
    depth = up.select("tree", "node", F.col("steps").alias("depth"))
    return chosen.alias("c").join(depth.alias("d"), joined("c", "d", "node", "node")).select("c.tree", "c.leaf", "c.rank", "c.node", "d.depth")


def conversations(messages: DataFrame, keep: int = 1) -> DataFrame:
    """Chosen paths as conversations: tree, leaf, rank, formatted, loss (ranges of code points).

    ``messages``: tree, node, parent, score, role, text. Nodes are unique within a tree; null
    roles and texts are empty. A null tree is a tree like others. Other columns are ignored;
    an empty table gives an empty result. A conversation is one value, so it is written by
    one task, however long it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                made = [formatted([(t["role"], t["text"]) for t in sorted(turns, key=lambda t: t["depth"])]) for turns in part.column(3).to_pylist()]
                loss = pa.array([[{"start": s, "end": e} for s, e in spans] for _, spans in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([t for t, _ in made], pa.string()), loss], names=["tree", "leaf", "rank", "formatted", "loss"])

    text = own_columns(messages, "tree", "node", "role", "text").alias("m")
    found = paths(messages, keep).alias("p")
    on = F.col("p.tree").eqNullSafe(F.col("m.tree")) & (F.col("p.node") == F.col("m.node"))
    turn = F.struct(F.col("p.depth").alias("depth"), F.coalesce("m.role", F.lit("")).alias("role"), F.coalesce("m.text", F.lit("")).alias("text"))
    grouped = found.join(text, on).select("p.tree", "p.leaf", "p.rank", turn.alias("turn")).groupBy("tree", "leaf", "rank").agg(F.collect_list("turn").alias("turns"))
    return grouped.mapInArrow(run, "tree long, leaf long, rank int, formatted string, loss array<struct<start:long,end:long>>")


def from_rows(rows: DataFrame) -> DataFrame:
    """Conversations by turn (conv_id, turn, role, text) as reply trees: a chain each.

    Rows of one turn, and repeated rows, follow each other by role, then text; a null turn
    comes first. A null conv_id is a conversation like others.
    """
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    rows = own_columns(rows, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long").alias("tree"), "turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return stored(rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"), "messages")


def digests(made: DataFrame) -> DataFrame:
    """What the formatted conversations (tree, formatted, loss) say when read back, one row each.

    Rows that repeat are told each by itself, a null tree stays null, and an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
                sha = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()
                yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "n_turns": [len(turns)], "turns_sha256": [sha(said)], "loss_chars": [len(loss)], "loss_sha256": [sha(loss)], "formatted_chars": [len(text)]})

    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return made.select("tree", "formatted", "loss").mapInArrow(run, out)
