import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import duckdb
import pytest

from helixframe.llm import repair
from helixframe.llm.queries import ORACLE_SQL, op13_repair

from .helpers import SF, empty

WHITE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    """The rule, row by row; keeps every conversation's id."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        held = by[conv]
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            role, text = "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            held += [(turn, role, text)] * (2 if fault == 3 else 1)
    return by


def plain(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, *(" " if x is None else x for x in (role, text))))
    return by


def faults(turns):
    seen = set()
    for _, role, text in turns:
        bare = text.rstrip(WHITE)
        yield "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))


def cheapest(turns, kinds):
    """(cost, audit, lines), backwards from the end: the best way on from each place and state."""
    follow = {0: "su", 1: "u", 2: "a", 3: "u"}
    after = {"s": 1, "u": 2, "a": 3}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(turns) and state in (0, 3) else []
        if inserts < 2:
            for r in follow[state].replace("s", ""):
                c, e, out = best(i, after[r], inserts + 1)
                found.append((c + 3, "I" + e, (f"{names[r]}:", *out)))
        if i < len(turns):
            _, role, text = turns[i]
            c, e, out = best(i + 1, state, 0)
            found.append((c + 4, "D" + e, out))
            if kinds[i] in ("", "truncated"):
                late = 3 * (kinds[i] == "truncated")
                if role[:1] and role[:1] in follow[state]:
                    c, e, out = best(i + 1, after[role[:1]], 0)
                    found.append((c + late, "K" + e, (f"{role}:{text}", *out)))
                for r in follow[state].replace("s", ""):
                    c, e, out = best(i + 1, after[r], 0)
                    found.append((c + 3 + late, "R" + e, (f"{names[r]}:{text}", *out)))
        return min(found, default=(1 << 40, "", ()))

    for i in range(len(turns), 0, -50):  # shallow recursion
        for s in range(4):
            best(i, s, 0)
    return best(0, 0, 0)


def brute(by):
    out = []
    for conv, turns in by.items():
        turns = sorted(turns, key=lambda t: (t[0] is not None, *((0,) if t[0] is None else (t[0],)), *t[1:]))
        kinds = list(faults(turns))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(turns, kinds)
        out.append((conv, gaps, *map(kinds.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def odd(seed, conversations=30, turns=9):
    rng = random.Random(seed)
    said = ["Yes.", "No!", "Why?", "so", "and then ", "", " \n", None, "é…", "Yes.\t"]
    rows = [(c, rng.choice([None, *range(turns)]), rng.choice(["system", "user", "assistant", "tool", "user", "assistant", "", None, "Sam"]), rng.choice(said)) for c in [None, *range(conversations)] for _ in range(rng.randint(1, turns))]
    return rows + rows[:7]


SCHEMA = "conv_id long, turn long, role string, text string, c string, ways int, present boolean"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, True) for r in rows], SCHEMA)


def test_table(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert rows_of(op13_repair(spark, SF)) == brute(damage(rows))


def test_sql(spark):
    with duckdb.connect() as db:
        db.sql(f"create view conversations as from '{SF}/conversations.parquet'")
        found, query = db.sql(ORACLE_SQL["op13_repair"]), op13_repair(spark, SF)
        assert found.columns == query.columns
        assert sorted(found.fetchall(), key=str) == rows_of(query)


def test_odd_rows(spark):
    rows = odd(1) + [(500, 1, "user", "x" * 200_000 + "."), (500, 2, "assistant", "y" * 200_000)]
    df = frame(spark, rows)
    assert rows_of(repair.digest(df)) == brute(plain(rows))
    assert rows_of(repair.digest(repair.damaged(df), present_col="present")) == brute(damage(rows))
    assert repair.digest(empty(df)).count() == 0
    gone = df.selectExpr("conv_id", "turn", "role", "text", "conv_id > 3 as present")
    assert rows_of(repair.digest(gone, present_col="present")) == brute({c: t if c is not None and c > 3 else [] for c, t in plain(rows).items()})
    texts = {r["conv_id"]: r["repaired"] for r in repair.repaired(df).collect()}
    assert all(LEGAL.fullmatch("".join(t["role"][0] for t in turns)) for turns in texts.values())


@pytest.mark.parametrize("long, block, fan", [(0, 3, 2), (5, 1, 2), (4, 2, 64)])
def test_long_conversations(spark, monkeypatch, long, block, fan):
    """Blocks and levels give what whole conversations give, with a hot one, ties, repeats and many parts."""
    monkeypatch.setattr(repair, "LONG", long)
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN", fan)
    monkeypatch.setattr(repair, "BATCH_ROWS", 16)
    rng = random.Random(7)
    rows = odd(2) + [(77, rng.choice([None, 3, *range(40)]), rng.choice(["user", "assistant", "tool"]), rng.choice(["a.", "b", "c!", f"{i}?"])) for i in range(120)]
    rows += [(78, 5, "user", "same.")] * 30
    df = frame(spark, rows)
    assert rows_of(repair.digest(df)) == brute(plain(rows))
    parts = [r for r in repair.repaired(df).collect() if r["conv_id"] == 77]
    assert len(parts) == parts[0]["parts"] > 1


def test_all_edits():
    """The backward search of these tests against every sequence of edits for short conversations."""
    rng = random.Random(5)
    for _ in range(60):
        turns = [(i, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b", ""])) for i in range(rng.randint(0, 3))]
        kinds = list(faults(turns))
        found = []
        for marks in itertools.product("KRD", repeat=len(turns)):
            if any(m != "D" and k in ("blank", "duplicate") for m, k in zip(marks, kinds)):
                continue
            for gaps in itertools.product(range(3), repeat=len(turns) + 1):
                audit = "".join("I" * g + m for g, m in itertools.zip_longest(gaps, marks, fillvalue=""))
                choices = itertools.product(*["ua" if e in "IR" else "-" for e in audit])
                for roles in choices:
                    at, out, cost = iter(zip(turns, kinds)), "", 0
                    for e, r in zip(audit, roles):
                        turn, kind = next(at) if e != "I" else (None, "")
                        cost += {"K": 0, "R": 3, "D": 4, "I": 3}[e] + 3 * (kind == "truncated" and e != "D")
                        out += "" if e == "D" else turn[1][0] if e == "K" else r
                    if LEGAL.fullmatch(out):
                        found.append((cost, audit))
        assert min(found) == cheapest(turns, kinds)[:2]
