from collections import defaultdict

import duckdb

from helixframe.llm import chat
from helixframe.llm.queries import ORACLE_SQL, op5_chat_rotation

from .helpers import SF, empty


def brute(turns, size):
    by, roles = defaultdict(list), defaultdict(set)
    for conv, turn, role, text in turns:
        role = (role if role and role.strip(" ") else "unknown").replace("<|", "< |")
        by[conv, -1 if turn is None else turn // size].append(((turn is not None, turn), role, (text or "").replace("<|", "< |")))
        if role != "system":
            roles[conv].add(role)
    out = []
    for (conv, segment), rows in by.items():
        rows = sorted(rows)
        for speaker, part in [(s, i) for s in roles[conv] for i in range(-(-len(rows) // size))]:
            text, mask = "", []
            for _, role, said in (held := rows[part * size : (part + 1) * size]):
                text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == speaker else f"<|user name={role}|>\n"
                start = len(text)
                text += said + "<|end|>\n"
                mask += [(start, len(text))] * (role == speaker)
            out.append((conv, speaker, segment, part, len(held), text, mask))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((*tuple(r)[:6], [tuple(x) for x in r["mask"]]) for r in df.collect()), key=str)


def test_table(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    assert rows_of(chat.rotated(turns)) == brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in turns.collect()], 64)


def test_sql(spark):
    with duckdb.connect() as db:
        db.sql(f"create view conversations as from '{SF}/conversations.parquet'")
        found = db.sql(ORACLE_SQL["op5_chat_rotation"])
        assert found.columns == op5_chat_rotation(spark, SF).columns
        assert sorted(found.fetchall(), key=str) == sorted(map(tuple, op5_chat_rotation(spark, SF).collect()), key=str)


def test_odd_rows(spark):
    rows = [(1, 0, "system", "be é"), (1, 1, "anna", "hi <|end|> x"), (1, 2, "bo", None), (1, 2, "bo", None), (1, 3, "anna", "y" * 100_000), (1, None, "cy", "late")]
    rows += [(2, 0, "system", "alone"), (None, 0, None, "who"), (None, 1, " ", "me"), (3, 5, "a<|b", "t"), *[(9, i, ["p", "q"][i % 2], f"t{i}") for i in range(40)], *[(10, None, "p", f"t{i}") for i in range(30)], *[(11, 7, "pq"[i % 2], f"t{i}") for i in range(20)]]
    turns = spark.createDataFrame([(*r, "clash", 3) for r in rows], "conv_id long, turn long, role string, text string, speaker string, segment int")
    assert rows_of(chat.rotated(turns, 8)) == brute(rows, 8)
    assert chat.rotated(empty(turns)).count() == 0
