"""Repair of the structure of conversations, as a fold in SQL functions.

A conversation should be, by role initials, (s?(ua)+)?. Edits keep a turn, change its role,
delete it or insert an empty one, and the cheapest sequence of them is found by a dynamic
program over the four states in which such a prefix can end: nothing, s, u, a. A state holds
the cheapest (cost, audit) so far; a turn replaces the four by the least of the ways into
each, which ``aggregate`` does over the turns in order.

Turns are first dealt to ranges by conversation and place and numbered there, so that a
conversation of any length is cut into chunks of ``CHUNK`` turns. A chunk is folded from
each of the four states by itself; what comes out is a small matrix, and those of a
conversation are joined in order, in two levels. So no array of turns is longer than a chunk.

Of two audits of equal cost for the same turns neither begins the other, as the longer one
would hold more insertions and cost more; hence the least of two stays the least whatever
follows, which is what lets states and chunks keep one each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simjoin.llm.common import own_columns, partitions, stored

#: Turns of a chunk, and chunks of a block, as powers of two.
CHUNK, BLOCK = 8, 6
#: What edits cost, and what a truncated turn costs that stays.
RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5
# Blanks, sentence ends, and pairs of role initials that may follow each other.
BLANKS, ENDS, LEGAL = " \t\n\x0b\x0c\r", ".!?", ("su", "ua", "au")

#: More than any repair costs.
NEVER = 1 << 50
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# --- damage ---------------------------------------------------------------------------------
def damaged(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats the row, 4 makes
    it the user's. A null role or text, and a null id or turn in what is hashed, is one space.
    """
    rows = own_columns(rows, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    or_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", or_blank("conv_id"), or_blank("turn")).cast("binary")) % 20
    rows = rows.withColumn("fault", fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(or_blank("text"), ENDS, "")).otherwise(or_blank("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(or_blank("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))).drop("col")


# --- the fold, in SQL ------------------------------------------------------------------------
# Expressions of four states, each (cost, audit, roles); ``roles`` tells, as u or a, the role
# that a turn gets, as k or d that it stays or goes, and as U or A what is inserted behind it.
def _state(cost: str, audit: str, roles: str) -> str:
    return f"named_struct('cost', CAST({cost} AS BIGINT), 'audit', {audit}, 'roles', {roles})"


def _then(state: str, cost: int | str, letter: str, role: str) -> str:
    return _state(f"{state}.cost + {cost}", f"concat({state}.audit, '{letter}')", f"concat({state}.roles, '{role}')")


def _four(*states: str) -> str:
    return "named_struct(" + ", ".join(f"'s{i}', {state}" for i, state in enumerate(states)) + ")"


def _with_insertions(v: str) -> str:
    into_u = ", ".join(_then(f"{v}.s{i}", INSERT, "I", "U") for i in (0, 1, 3))
    into_a = ", ".join([_then(f"{v}.s2", INSERT, "I", "A"), *[_then(f"{v}.s{i}", 2 * INSERT, "II", "UA") for i in (0, 1)]])
    return _four(f"{v}.s0", f"{v}.s1", f"least({v}.s2, {into_u})", f"least({v}.s3, {into_a})")


def _turn(v: str, t: str) -> str:
    """The four states after turn ``t`` (initial, gone: has to be deleted, cut: truncated)."""
    gone = [_then(f"{v}.s{i}", DELETE, "D", "d") for i in range(4)]
    cut = f"IF({t}.cut, {CUT}, 0)"

    def stays(i: int, initial: str) -> str:
        kept, renamed = _then(f"{v}.s{i}", cut, "K", "k"), _then(f"{v}.s{i}", f"{cut} + {RENAME}", "R", initial)
        return f"IF({t}.initial = '{initial}', {kept}, {renamed})"

    ways = {1: [f"IF({t}.initial = 's', {_then(f'{v}.s0', cut, 'K', 'k')}, {_state(str(NEVER), repr(''), repr(''))})"], 2: [stays(i, "u") for i in (0, 1, 3)], 3: [stays(2, "a")]}
    return _four(*[f"IF({t}.gone, {gone[i]}, least({', '.join([gone[i], *ways[i]])}))" if i in ways else gone[i] for i in range(4)])


def _from(state: int) -> str:
    return _four(*[_state("0" if i == state else str(NEVER), "''", "''") for i in range(4)])


_STARTS = f"array({', '.join(_from(s) for s in range(4))})"


def _after(v: str, cells: str) -> str:
    """The four states after a chunk, from those before it and its matrix."""
    both = lambda i, j, x: f"{v}.s{i}.{x}, {cells}[{i}].s{j}.{x}"
    way = lambda i, j: _state(both(i, j, "cost").replace(",", " +"), f"concat({both(i, j, 'audit')})", f"concat({both(i, j, 'roles')})")
    return _four(*[f"least({', '.join(way(i, j) for i in range(4))})" for j in range(4)])


#: The matrix of a chunk of turns. What a lambda is given is made once, however often it is read.
_FOLD = f"transform({_STARTS}, start -> aggregate(turns, start, (v, t) -> transform(array({_turn('v', 't')}), w -> {_with_insertions('w')})[0]))"
#: The matrix of matrices in order, and the cheapest way through all of them.
_JOIN = f"transform({_STARTS}, start -> aggregate(parts, start, (v, c) -> {_after('v', 'c')}))"
_BEST = f"aggregate(parts, transform(array({_from(0)}), w -> {_with_insertions('w')})[0], (v, c) -> {_after('v', 'c')}, v -> least(v.s0, v.s3))"


# --- plans ----------------------------------------------------------------------------------
@dataclass(frozen=True)
class Repairs:
    """``turns``: the input in order, numbered (``at``). ``found``: per conversation its report and its plan."""

    turns: DataFrame
    found: DataFrame


def _numbered(rows: DataFrame) -> DataFrame:
    """The turns in order: ``at`` grows with conversation, turn (null first), role and text, and has gaps only where ranges meet.

    Stored, as ranges may be drawn differently when they are drawn again. Rows that agree in
    everything are told apart by their place in the input, so ranges can part them too; which
    of them comes first does not matter.
    """
    rows = own_columns(rows, "conv_id", "turn", "role", "text")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], F.monotonically_increasing_id().alias("tie"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "tie")]
    ranges = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    core = F.rtrim("text", F.lit(BLANKS))
    last = F.substring(core, -1, 1)
    flags = [F.substring("role", 1, 1).alias("initial"), (core == "").alias("blank"), (~last.isin(*ENDS)).alias("cut"), said.alias("said")]
    return stored(ranges.drop("tie").select(F.monotonically_increasing_id().alias("at"), "*", *flags), "turns").withColumn("chunk", F.shiftright("at", CHUNK))


def plans(rows: DataFrame) -> Repairs:
    """The cheapest repairs of the conversations of ``rows`` (conv_id, turn, role, text).

    Turns of one number, and repeated rows, follow each other by role, then text. A null role
    or text is one space. A null conv_id is a conversation like others. Other columns are
    ignored; an empty table gives none.
    """
    turns = _numbered(rows)
    light = turns.drop("role", "text")
    # a kind's turns are brought together one for each chunk, so that one said very often stays small
    kinds = light.groupBy("conv_id", "said", "chunk").agg(F.min("at").alias("at"))
    firsts = kinds.withColumn("n", F.row_number().over(W.partitionBy("conv_id", "said").orderBy("at"))).where("n = 1").select("at", F.lit(True).alias("first"))
    flagged = light.join(firsts, "at", "left").withColumn("again", ~F.col("blank") & F.col("first").isNull())
    here = W.partitionBy("conv_id", "chunk").orderBy("at")
    pair = F.concat(F.lag("initial").over(here), F.col("initial"))
    new_turn = F.coalesce(~F.col("turn").eqNullSafe(F.lag("turn").over(here)), F.lit(True)) & F.col("turn").isNotNull()
    flagged = flagged.withColumns({"illegal": ~pair.isin(*LEGAL), "new_turn": new_turn, "gone": F.col("blank") | F.col("again")})
    count = lambda test: F.count_if(test)
    chunks = flagged.groupBy("conv_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("at", "initial", "gone", "cut"))).alias("turns"),
        F.count("*").alias("n"), F.min("at").alias("at"), count(F.col("blank")).alias("blank"), count(F.col("again")).alias("duplicate"), count(~F.col("gone") & F.col("cut")).alias("truncated"), count(F.col("illegal")).alias("illegal"), count(F.col("new_turn")).alias("distinct"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.min_by(F.struct("turn", "initial"), "at").alias("front"), F.max_by(F.struct("turn", "initial"), "at").alias("back"),
    )
    chunks = chunks.withColumn("cells", F.expr(_FOLD)).drop("turns")
    # what meets where chunks meet
    line = W.partitionBy("conv_id").orderBy("chunk")
    before = F.lag("back").over(line)
    chunks = chunks.withColumns({"before": before, "offset": F.sum("n").over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("n"), "block": F.shiftright("chunk", BLOCK)})
    across = F.coalesce((~F.concat(F.col("before.initial"), F.col("front.initial")).isin(*LEGAL)).cast("long"), F.lit(0))
    same = F.coalesce((F.col("before.turn") == F.col("front.turn")).cast("long"), F.lit(0))
    chunks = chunks.withColumns({"illegal": F.col("illegal") + across, "distinct": F.col("distinct") - same})
    sums = ("blank", "duplicate", "truncated", "illegal", "distinct")
    totals = [F.sum(c).alias(c) for c in sums] + [F.min("low").alias("low"), F.max("high").alias("high")]
    in_order = lambda key: F.transform(F.array_sort(F.collect_list(F.struct(key, "cells"))), lambda x: x["cells"])
    place = F.struct("chunk", "at", "offset", "n")
    blocks = chunks.groupBy("conv_id", "block").agg(in_order("chunk").alias("parts"), F.array_sort(F.collect_list(place)).alias("places"), *totals)
    blocks = blocks.withColumn("cells", F.expr(_JOIN)).drop("parts")
    whole = blocks.groupBy("conv_id").agg(in_order("block").alias("parts"), F.flatten(F.collect_list("places")).alias("places"), *totals)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0))
    whole = whole.withColumn("best", F.expr(_BEST)).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", F.regexp_extract_all("best.roles", F.lit("[kdua][UA]*"), 0).alias("steps"), F.regexp_extract("best.roles", "^[UA]*", 0).alias("lead"), "places")
    return Repairs(turns, stored(whole, "repairs"))


def _added(letters: Column) -> Column:
    return F.transform(F.filter(F.split(letters, ""), lambda x: x != ""), lambda x: F.struct(F.when(x == "U", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))


def _replayed(plan: Repairs) -> DataFrame:
    """The turns with ``told``: what stands in their place, an array of (role, text, edit)."""
    own = lambda p: F.struct(p["chunk"], p["at"].alias("start"), F.when(p["offset"] == 0, F.col("lead")).otherwise("").alias("lead"), F.slice("steps", (p["offset"] + 1).cast("int"), p["n"].cast("int")).alias("steps"))
    pieces = plan.found.select("conv_id", F.explode(F.transform("places", own)).alias("p")).select("conv_id", "p.*")
    t, p = plan.turns.drop("said").alias("t"), pieces.alias("p")
    rows = t.join(p, F.col("t.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("t.chunk") == F.col("p.chunk")))
    i = (F.col("t.at") - F.col("p.start")).cast("int")
    rows = rows.select("t.conv_id", "t.at", "t.role", "t.text", F.get("p.steps", i).alias("step"), F.when(i == 0, F.col("p.lead")).otherwise("").alias("lead"))
    first = F.substring("step", 1, 1)
    role = F.when(first == "k", F.col("role")).when(first == "u", "user").otherwise("assistant")
    stays = F.when(first == "d", F.array().cast("array<struct<role:string,text:string,edit:string>>")).otherwise(F.array(F.struct(role.alias("role"), F.col("text"), F.when(first == "k", "K").otherwise("R").alias("edit"))))
    return rows.select("conv_id", "at", F.concat(_added(F.col("lead")), stays, _added(F.expr("substring(step, 2)"))).alias("told"))


def repaired(rows: DataFrame, plan: Repairs | None = None) -> DataFrame:
    """The repaired turns: conv_id, at and i (by which a conversation's turns are in order), role, text, edit (K, R or I)."""
    told = _replayed(plan or plans(rows))
    return told.select("conv_id", "at", F.posexplode("told").alias("i", "t")).select("conv_id", "at", "i", "t.role", "t.text", "t.edit")


def _hashes(told: DataFrame) -> DataFrame:
    """A conversation's hash is made turn by turn, in order, so that no text of it is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, lines = None, None, 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])
        for batch in batches:
            for own, said in zip(batch.column(0), batch.column(1), strict=True):
                if sha is None or own.as_py() != conv:
                    if sha is not None:
                        yield out()
                    conv, sha, lines = own.as_py(), hashlib.sha256(), 0
                if said.is_valid:
                    sha.update(b"\n" * (lines > 0) + said.as_py().encode())
                    lines += 1
        if sha is not None:
            yield out()

    lines = F.array_join(F.transform("told", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    said = told.select("conv_id", "at", F.when(F.size("told") > 0, lines).alias("said"))
    return said.repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "said").mapInArrow(run, "conv_id long, repaired_sha256 string")


def report(rows: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``original`` (conv_id) names conversations that may have no turns left: they have zeros
    and the hash of nothing. Faults are counted before the repair; a turn has its first fault
    only. A conversation's hash is that of ``role:text`` lines joined by newlines; it is the
    one thing that a single task makes of a whole conversation, turn by turn. See ``plans``
    for nulls, ties and repeated rows.
    """
    plan = plans(rows)
    found = plan.found.drop("steps", "lead", "places").alias("f").join(_hashes(_replayed(plan)).alias("h"), F.col("f.conv_id").eqNullSafe(F.col("h.conv_id"))).select("f.*", "h.repaired_sha256")
    ids = (rows if original is None else original).select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("o")
    out = ids.join(found.alias("f"), F.col("o.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    counts = [F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("o.conv_id", *counts, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
