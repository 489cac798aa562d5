import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from simjoin.llm import repair

BLANKS = " \t\n\x0b\x0c\r"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        told = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        text = "" if fault == 1 else text.translate(str.maketrans("", "", ".!?")) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def cheapest(turns):
    """The least (cost, audit) by a search over whole prefixes, and the repaired lines; ``turns``: (role, text, gone, cut)."""
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if i == len(turns) and state in ("", "a"):
            return cost, audit, lines
        if (i, state) in seen:
            continue
        seen.add((i, state))
        goes = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for to, name in (("u", "user"), ("a", "assistant")):
            if to in goes:
                heapq.heappush(queue, (cost + 5, audit + "I", i, to, (*lines, f"{name}:")))
        if i == len(turns):
            continue
        role, text, gone, cut = turns[i]
        heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, lines))
        if not gone:
            if role[:1] in goes and role[:1]:
                heapq.heappush(queue, (cost + 5 * cut, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
            for to, name in (("u", "user"), ("a", "assistant")):
                if to in goes:
                    heapq.heappush(queue, (cost + 5 * cut + 1, audit + "R", i + 1, to, (*lines, f"{name}:{text}")))


def plain(rows, originals):
    place = lambda x: (x is not None, x or 0)
    out = []
    for conv in {r[0] for r in originals}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (place(r[1]), r[2], r[3]))
        seen, turns, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            core = text.strip(BLANKS)
            blank, again, cut = not core, (role, text) in seen, core[-1:] not in (".", "!", "?") or not core
            seen.add((role, text))
            for name, fault in (("blank", blank), ("duplicate", again), ("truncated", cut)):
                if fault:
                    count[name] += 1
                    break
            turns.append((role, text, blank or again, cut))
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(turns)
        out.append((conv, gaps, *count.values(), illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)


def told(spark, rows, originals=None):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = repair.report(df, originals and spark.createDataFrame(originals, SCHEMA))
    return sorted((tuple(r) for r in found.collect()), key=str)


def conversations(rng, n, longest):
    texts = ["Yes.", "No!", "cut off", "", " \n", "Really?  ", "A longer sentence, with an end. ", "ünï"]
    roles = ["user", "assistant", "system", "assistant", "user", "tool", "", " "]
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            out.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), rng.choice(roles[: rng.choice([2, 3, 8])]), f"{rng.choice(texts)}" if rng.random() < 0.5 else f"{turn} {rng.choice(texts)}"))
    return out


@pytest.mark.parametrize("chunk", [8, 1])
def test_random_conversations(spark, chunk, monkeypatch):
    """Also with chunks of two turns and blocks of two chunks, so that what is joined is joined often."""
    monkeypatch.setattr(repair, "CHUNK", chunk)
    monkeypatch.setattr(repair, "BLOCK", chunk)
    rows = conversations(random.Random(chunk), 60, 14)
    assert told(spark, rows) == plain(rows, rows)


def test_damage_and_what_it_leaves(spark):
    rng = random.Random(3)
    rows = [(None if r[0] == 5 else r[0], r[1], None if r[2] == " " else r[2], None if not r[3] else r[3]) for r in conversations(rng, 80, 4)]
    rows += [(1000 + i, 0, "user", "Alone.") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in repair.damaged(df.withColumns({"at": F.lit(1), "chunk": F.lit("x")})).collect()]
    assert sorted(got, key=str) == sorted(damaged(rows), key=str)
    found = told(spark, damaged(rows), rows)
    assert found == plain(damaged(rows), rows)
    assert any(r[1:] == (0, 0, 0, 0, 0, 0, "", sha("")) for r in found)


def test_known_repairs(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Well?"), (2, 0, "assistant", "Hello."), (3, 0, "system", "Be kind."), (4, 0, "user", "A."), (4, 1, "assistant", "B."), (4, 5, "assistant", "B."), (5, 7, "user", "cut")]
    found = {r[0]: r for r in told(spark, rows)}
    assert found[1][6:8] == (1, "KR") and found[2][6:8] == (2, "D") and found[3][6:8] == (2, "D")
    assert found[4] == (4, 3, 0, 1, 0, 1, 2, "KKD", sha("user:A.\nassistant:B.")) and found[5][6:8] == (2, "D")


def test_a_long_conversation_in_parts(spark):
    """Thousands of turns, of which a third are one repeated row: many chunks, and every text of the repair in order."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"Turn {t}.") for t in range(3000)] + [(1, 3000, "user", "The same.")] * 1500
    ((_, gaps, _, duplicate, _, _, _, audit, digest),) = told(spark, rows)
    want = plain(rows, rows)[0]
    assert (gaps, duplicate, audit, digest) == (0, 1499, want[7], want[8])
    made = repair.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("at", "i").collect()
    assert sha("\n".join(f"{r.role}:{r.text}" for r in made)) == digest
    assert [r.role for r in made] == ["user", "assistant"] * (len(made) // 2)


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.report(repair.damaged(none), none).count() == 0 and repair.repaired(none).count() == 0
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("at", "chunk", "said", "n", "first", "cells", "cut")})
    assert repair.report(extra).collect()[0].audit == "KK"
