"""Conversation repair: the cheapest edits that make roles follow ``(s?(ua)+)?``, found by a recursive query.

Turns are ordered by number (nulls first), role and text. A turn's first fault counts: blank (no
character but white space), duplicate (an earlier turn has its role and text) or truncated (its last
character but white space is none of ``.!?``). Edits: Keep a turn (0), Rerole it to user or assistant
(3), Delete it (4; blank and duplicate turns have to go), Insert an empty turn of either (3); a
truncated turn that stays costs 3 more. Of equally cheap edits those whose initials are least win.

The method: conversations are hash-partitioned and sorted; a task passes them, some thousand turns at
a time, to a DuckDB recursive query that advances one turn for all conversations of the batch and
keeps, for each grammar state, the least cost and with it the least audit. Keeping one audit a state is
exact: two audits of one cost over the same turns are never the beginning of one another.

A conversation of more than LONG turns is not gathered. Equal turns of it become one with a count, its
turns are range-partitioned in order and cut into blocks of BLOCK; the recursion runs from every state
through each block, and again over FAN blocks at a time, until one table a conversation is left; going
back down, each block learns the states that it begins and ends in. So a hot conversation spreads over
tasks. What one task has to see in a row for it is what the result holds in one value (audit, hash).

Grammar states: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn;
0 and 3 may end. ``repaired`` gives a row for each part of a conversation: one, or one for each block.

Defined cases: a null role or text is one space, a null conversation id is a conversation of its own, a
turn of an empty or unknown role cannot be kept; repeated rows are duplicates; rows whose ``present``
column is false only name their conversation, which has zeros and an empty audit if it has no other;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, columns_as, forget, map_batches, saved, spread_join

#: Turns of a conversation up to which one batch holds it whole.
LONG = 256
#: Distinct turns of a block of a longer one, and blocks that are joined at a time.
BLOCK, FAN = 256, 64
#: Turns and bytes of text that one recursive query takes, plus one conversation.
BATCH_ROWS, BATCH_BYTES = 8192, 32 << 20
#: Long conversations that are broadcast; beyond, they are joined by a shuffle.
BROADCAST = 100_000
WHITE = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, LATE = 4, 3, 3, 3
#: Roles' initials that may follow in each state, and the state after them.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
#: Inserts that end a conversation in each state.
ENDS = {0: "", 1: "II", 2: "I", 3: ""}

STATS = "blank long, duplicate long, truncated long, illegal long"
FOUND = f"conv_id long, part long, parts long, gaps long, {STATS}, cost long, audit string, repaired array<struct<role:string,text:string>>"
WAYS = "ways array<struct<before:int,state:int,cost:long,edits:string,trail:string>>"
BLOCKS = f"conv_id long, task int, seq int, low long, high long, turns long, first_turn long, last_turn long, head string, tail string, {STATS}"


def _free(state: int) -> list[int]:
    return [t for initial, t in NEXT[state].items() if initial != "s"]


def edit_steps() -> list[tuple[str, int, int, int, str]]:
    """(kind, state, state after, cost, edits): the cheapest edits at one turn with inserts before it, least initials first among equals.

    Kinds: a turn's initial if it may stay, ``x`` for any other one, upper case if it is truncated, ``-`` if it has to go.
    """
    found: dict[tuple, tuple] = {}
    for state in NEXT:
        reach, frontier = [(state, 0, "")], [(state, 0, "")]
        for _ in range(2):
            frontier = [(t, c + INSERT, e + "I") for s, c, e in frontier for t in _free(s)]
            reach += frontier
        for s, cost, edits in reach:
            for kind in "suaxSUAX-":
                late = LATE * kind.isupper()
                options = [(s, DELETE, "D")]
                if kind != "-":
                    options += [(t, REROLE + late, "R") for t in _free(s)]
                    options += [(t, late, "K") for initial, t in NEXT[s].items() if initial == kind.lower()]
                for t, c, e in options:
                    key, value = (kind, state, t), (cost + c, edits + e)
                    found[key] = min(found.get(key, value), value)
    return [(*key, *value) for key, value in found.items()]


#: Cheapest ways through the steps of each c, one step a recursion for all of them.
RECURSION = """
    with recursive paths(c, begin, i, state, cost, audit, trail) as (
        select c, begin, 0::bigint, begin, 0::bigint, '', begin::varchar from (select distinct c from steps), begins
        union all
        select c, begin, i, state, best.cost, best.audit, best.trail from (
            select p.c, p.begin, p.i + 1 as i, s.state, min({'cost': p.cost + s.cost, 'audit': p.audit || s.edits, 'trail': p.trail || s.state}) as best
            from paths p join steps s on s.c = p.c and s.i = p.i and s.before = p.state
            group by p.c, p.begin, p.i, s.state))
    select c, begin, state, cost, audit, trail from paths join (select c, max(i) + 1 as n from steps group by c) using (c) where i = n
"""


class Query:
    """One DuckDB connection of a task."""

    def __init__(self, begins: tuple[int, ...]):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self.db.execute("create table edits(kind varchar, before integer, state integer, cost bigint, edits varchar)")
        self.db.executemany("insert into edits values (?, ?, ?, ?, ?)", edit_steps())
        self.db.execute("create table begins as select unnest(?::integer[]) as begin", [list(begins)])

    def mark(self, rows: pa.Table, known: bool) -> None:
        """``turns`` of rows (c, i, turn, role, said, initial, blank, ended, copies[, again]) with their fault; and their steps."""
        again = "again" if known else "row_number() over (partition by c, role, said order by i) > 1"
        self.db.register("rows", rows)
        self.db.execute(f"""
            create or replace temp table turns as select c, i, turn, initial, copies, case when blank then 1 when again then 2 when ended then 0 else 3 end as fault
            from (select *{'' if known else ', ' + again + ' as again'} from rows)""")
        self.db.unregister("rows")
        self.db.execute(f"""
            create or replace temp table steps as select c, i, before, state, cost + {DELETE} * copies as cost, edits || repeat('D', copies) as edits
            from (select *, case when fault in (1, 2) then '-' when fault = 3 then upper(k) else k end as kind
                  from (select *, case when initial in ('s', 'u', 'a') then initial else 'x' end as k from turns)) join edits using (kind)""")

    def stats(self) -> list[tuple]:
        """One row for each c, in order."""
        return self.db.execute("""
            select c, min(turn), max(turn), count(distinct turn), arg_min_null(turn, i), arg_max_null(turn, i), arg_min(initial, i), arg_max(initial, i),
                sum((fault = 1)::int * (copies + 1)), sum((fault = 2)::int + (fault <> 1)::int * copies), sum((fault = 3)::int),
                sum((last is not null and (last || initial) not in ('su', 'ua', 'au'))::int + copies)
            from (select *, lag(initial) over (partition by c order by i) as last from turns) group by c order by c""").fetchall()

    def ways(self) -> list[tuple]:
        return self.db.execute(RECURSION).fetchall()

    def joined(self, steps: pa.Table) -> list[tuple]:
        """The recursion over other steps: (c, i, before, state, cost, edits)."""
        self.db.register("given", steps)
        self.db.execute("create or replace temp table steps as from given")
        self.db.unregister("given")
        return self.ways()


def applied(audit: str, state: int, turns: list[tuple[str, str, str, int]]) -> list[dict]:
    """The edited turns of (role, text, initial, copies)."""
    out, at = [], iter([t for role, text, initial, copies in turns for t in [(role, text, initial)] * (copies + 1)])
    for edit in audit:
        role, text, initial = ("", "", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        out.append({"role": role, "text": text})
        state = NEXT[state][initial if edit == "K" else role[0]]
    return out


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = columns_as(turns, conv_id=conv_col, turn=turn_col, role=role_col, said=text_col, **({"present": present_col} if present_col else {}))
    end = F.substring(F.rtrim(space("said"), F.lit(WHITE)), -1, 1)
    named = F.coalesce(F.col("present"), F.lit(False)) if present_col else F.lit(True)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("said").alias("said"), named.alias("present")).select(
        "*", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), end.isin(".", "!", "?").alias("ended"), F.lit(0).cast("long").alias("copies")
    )


def _groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.Table]:
    """Tables of BATCH_ROWS rows or BATCH_BYTES and what completes the last group of rows that are equal in ``names``, if any are given."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + len(batch), size + batch.nbytes
        if rows >= BATCH_ROWS or size >= BATCH_BYTES:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = _starts(table, *names)[-1] if names else len(table)
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut)
            held = rest.combine_chunks().to_batches()
            rows, size = len(rest), sum(b.nbytes for b in held)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(table: pa.Table, *names: str) -> list[int]:
    values = list(zip(*(table.column(n).to_pylist() for n in names)))
    return [i for i in range(len(values)) if not i or values[i] != values[i - 1]]


def _indexed(table: pa.Table, starts: list[int]) -> pa.Table:
    """With c, the number of a row's group, and i, its place there; of rows that are present, where that is a column."""
    c = [g for g, (a, b) in enumerate(zip(starts, [*starts[1:], len(table)])) for _ in range(b - a)]
    table = table.append_column("c", pa.array(c, pa.int64()))
    if "present" in table.column_names:
        table = table.filter(table["present"])
    first: dict[int, int] = {}
    i = [n - first.setdefault(g, n) for n, g in enumerate(table["c"].to_pylist())]
    return table.append_column("i", pa.array(i, pa.int64()))


def _whole(rows: DataFrame) -> DataFrame:
    """FOUND of conversations that a batch can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        query, end = Query((0,)), {s: (INSERT * len(e), e) for s, e in ENDS.items()}
        for table in _groups(batches, "conv_id"):
            starts = _starts(table, "conv_id")
            live = _indexed(table, starts)
            query.mark(live, known=False)
            stats = {r[0]: r[1:] for r in query.stats()}
            best: dict[int, tuple] = {}
            for c, _, state, cost, audit, _ in query.ways():
                ending = (cost + end[state][0], audit + end[state][1])
                best[c] = min(best.get(c, ending), ending)
            turns: dict[int, list] = {}
            for c, *turn in zip(*(live[n].to_pylist() for n in ("c", "role", "said", "initial", "copies"))):
                turns.setdefault(c, []).append(turn)
            out: dict[str, list] = {n: [] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")}
            for c in range(len(starts)):
                low, high, n, _, _, _, _, *counts = stats.get(c, (None, None, 0, None, None, None, None, 0, 0, 0, 0))
                cost, audit = best.get(c, (0, ""))
                values = (0 if low is None else high - low + 1 - n, *counts, cost, audit, applied(audit, 0, turns.get(c, [])))
                for held, value in zip(out.values(), values):
                    held.append(value)
            yield out | {"conv_id": table["conv_id"].take(pa.array(starts)), "part": [0] * len(starts), "parts": [1] * len(starts)}

    return _streamed(rows, run, FOUND)


def _streamed(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over all batches of a task, as ``map_batches`` does it for one."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spec = StructType.fromDDL(schema)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(spec)
        for out in run(batches):
            arrays = [v.combine_chunks().cast(f.type) if isinstance(v := out[f.name], pa.ChunkedArray) else pa.array(v, f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return rows.mapInArrow(step, spec)


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of sorted rows with their statistics, ways from every state to every other and turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        query, task, seq = Query(tuple(NEXT)), TaskContext.get().partitionId(), 0
        for table in _groups(batches):
            first = _starts(table, "conv_id")
            starts = [i for a, b in zip(first, [*first[1:], len(table)]) for i in range(a, b, BLOCK)]
            table = _indexed(table, starts)
            query.mark(table, known=True)
            ways: list[list] = [[] for _ in starts]
            for c, begin, state, cost, audit, trail in query.ways():
                ways[c].append({"before": begin, "state": state, "cost": cost, "edits": audit, "trail": trail})
            _, *stats = zip(*query.stats())
            names = ("low", "high", "turns", "first_turn", "last_turn", "head", "tail", "blank", "duplicate", "truncated", "illegal")
            said = [dict(zip(("role", "said", "initial", "copies"), r)) for r in zip(*(table[n].to_pylist() for n in ("role", "said", "initial", "copies")))]
            yield dict(zip(names, stats)) | {
                "conv_id": table["conv_id"].take(pa.array(starts)),
                "task": [task] * len(starts),
                "seq": range(seq, seq := seq + len(starts)),
                "ways": ways,
                "said": [said[a:b] for a, b in zip(starts, [*starts[1:], len(table)])],
            }

    return _streamed(rows, run, f"{BLOCKS}, {WAYS}, said array<struct<role:string,said:string,initial:string,copies:long>>")


def _joined(nodes: DataFrame) -> DataFrame:
    """One level up: (conv_id, ord, ways) of FAN consecutive nodes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        query = Query(tuple(NEXT))
        for table in _groups(batches, "conv_id", "up"):
            starts = _starts(table, "conv_id", "up")
            table = _indexed(table, starts)
            steps = [(c, i, w["before"], w["state"], w["cost"], w["edits"]) for c, i, ways in zip(*(table[n].to_pylist() for n in ("c", "i", "ways"))) for w in ways]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            given = pa.table([pa.array(x, t) for x, t in zip(zip(*steps), kinds)], names=["c", "i", "before", "state", "cost", "edits"])
            ways: list[list] = [[] for _ in starts]
            for c, begin, state, cost, audit, trail in query.joined(given):
                ways[c].append({"before": begin, "state": state, "cost": cost, "edits": audit, "trail": trail})
            at = pa.array(starts)
            yield {"conv_id": table["conv_id"].take(at), "ord": table["up"].take(at), "ways": ways}

    dealt = nodes.withColumn("up", F.floor(F.col("ord") / FAN)).repartition("conv_id", "up").sortWithinPartitions("conv_id", "up", "ord")
    return _streamed(dealt.select("conv_id", "up", "ways"), run, f"conv_id long, ord long, {WAYS}")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _long_parts(rows: DataFrame) -> DataFrame:
    """FOUND of conversations that are cut into blocks, one row a block; counts and cost of the conversation stand in its first part, else 0."""
    names = ["conv_id", "turn", "role", "said", "initial", "blank", "ended"]
    distinct = saved(rows.where("present").groupBy(*names).agg((F.count("*") - 1).alias("copies")).withColumn("text_key", F.md5("said")).withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), "turn")).withColumn("key", F.struct("conv_id")), "turns")
    firsts = distinct.groupBy("key", "role", "text_key").agg(F.min("at").alias("first"))
    marked = spread_join(distinct, firsts, ["key", "role", "text_key"]).withColumn("again", F.col("at") > F.col("first"))
    begin = F.substring("said", 1, 256)  # decides only where rows go, and keeps the sample of range bounds small
    dealt = marked.repartitionByRange("conv_id", "turn", "role", begin).sortWithinPartitions("conv_id", "turn", "role", "said")
    blocks = saved(_blocks(dealt.select(*names, "copies", "again")), "blocks")
    place = W.partitionBy("conv_id").orderBy("task", "seq")
    level = saved(blocks.select("conv_id", (F.row_number().over(place) - 1).cast("long").alias("ord"), "task", "seq", "ways"), "ways")
    levels = [level]
    while (levels[-1].agg(F.max("ord")).first()[0] or 0) > 0:
        levels.append(saved(_joined(levels[-1]), "ways"))

    # the top: from nothing to the cheapest end
    end = lambda s: F.element_at(F.create_map(*[F.lit(x) for k, e in ENDS.items() for x in (k, e)]), s)
    options = F.filter("ways", lambda w: w["before"] == 0)
    ended = F.transform(options, lambda w: F.struct((w["cost"] + INSERT * F.length(end(w["state"]))).alias("cost"), F.concat(w["edits"], end(w["state"])).alias("edits"), w["state"].alias("state")))
    chosen = levels[-1].select("conv_id", "ord", F.lit(0).alias("before"), F.array_min(ended).alias("best")).select("conv_id", "ord", "before", F.col("best.state").alias("state"))
    for upper, lower in zip(levels[:0:-1], levels[-2::-1]):
        way = F.filter("ways", lambda w: (w["before"] == F.col("before")) & (w["state"] == F.col("state")))[0]
        trails = _on(upper, chosen).select("conv_id", "ord", way["trail"].alias("trail"))
        digit = lambda s, i: F.substring(s, i, 1).cast("int")
        below = trails.select("conv_id", "ord", "trail", F.posexplode(F.sequence(F.lit(0), F.length("trail") - 2)).alias("j", "_"))
        chosen = below.select("conv_id", (F.col("ord") * FAN + F.col("j")).alias("ord"), F.expr("cast(substring(trail, j + 1, 1) as int)").alias("before"), F.expr("cast(substring(trail, j + 2, 1) as int)").alias("state"))
    way = F.filter("ways", lambda w: (w["before"] == F.col("before")) & (w["state"] == F.col("state")))[0]
    edits = _on(level, chosen).select("conv_id", "ord", "task", "seq", "before", "state", way["cost"].alias("cost"), way["edits"].alias("edits"))

    narrow = blocks.drop("ways", "said").withColumn("ord", (F.row_number().over(place) - 1).cast("long"))
    last = lambda c: F.lag(c).over(place)
    crossing = (last("tail").isNotNull() & ~F.concat(last("tail"), "head").isin("su", "ua", "au")).cast("long")
    counted = narrow.select("*", crossing.alias("crossing"), F.coalesce((last("last_turn") == F.col("first_turn")).cast("long"), F.lit(0)).alias("shared"))
    total = lambda c: F.sum(c).alias(c)
    sums = counted.groupBy("conv_id").agg(
        F.count("*").alias("parts"),
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns") + F.sum("shared"), F.lit(0)).alias("gaps"),
        *map(total, ("blank", "duplicate", "truncated")),
        (F.sum("illegal") + F.sum("crossing")).alias("illegal"),
    )
    costs = edits.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.max_by("state", "ord").alias("last_state"))
    totals = _on(sums, costs, ["conv_id"])
    merged = _on(edits.drop("cost"), totals, ["conv_id"])  # totals: one row a conversation of over LONG turns, met by one row a block
    held = merged.join(blocks.select("task", "seq", "said"), ["task", "seq"])
    tail = F.when(F.col("ord") == F.col("parts") - 1, end(F.col("last_state"))).otherwise("")
    first = F.col("ord") == 0
    counts = [F.when(first, F.col(c)).otherwise(0).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")]
    cost = F.when(first, F.col("cost") + INSERT * F.length(end(F.col("last_state")))).otherwise(0)
    ready = held.select("conv_id", F.col("ord").alias("part"), "parts", *counts, cost.alias("cost"), F.concat("edits", tail).alias("audit"), "before", "said")

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            out = {n: column(batch, n) for n in ("conv_id", "part", "parts", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")}
            said = [[tuple(t.values()) for t in turns] for turns in column(batch, "said").to_pylist()]
            yield out | {"repaired": [applied(*x) for x in zip(column(batch, "audit").to_pylist(), column(batch, "before").to_pylist(), said)]}

        return step

    out = saved(map_batches(ready, make, FOUND), "repaired")
    forget(distinct, blocks, *levels)
    return out


def _on(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Inner join of two tables whose conversation ids may be null."""
    on = on or ["conv_id", "ord"]
    right = b.select(*[F.col(c).alias(f"_{c}") if c in on else c for c in b.columns])
    both = None
    for c in on:
        equal = _same(c, f"_{c}")
        both = equal if both is None else both & equal
    return a.join(right, both).drop(*[f"_{c}" for c in on])


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Conversations of up to LONG turns, and longer ones (None without any)."""
    crowded = saved(rows.where("present").groupBy("conv_id").count().where(F.col("count") > LONG).select(F.struct("conv_id").alias("key")), "crowded")
    n = crowded.count()
    if not n:
        forget(crowded)
        return rows, None
    keyed = rows.withColumn("key", F.struct("conv_id"))
    few = F.broadcast(crowded) if n <= BROADCAST else crowded
    return keyed.join(few, "key", "left_anti").drop("key"), keyed.join(few, "key", "left_semi").drop("key")


def _parts(turns: DataFrame, *columns) -> tuple[DataFrame, DataFrame | None]:
    short, long = _split(_turns(turns, *columns))
    dealt = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "said")
    return _whole(dealt), _long_parts(long) if long is not None else None


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """(conv_id, part, parts, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired array<struct<role, text>>); a conversation's counts and cost are in its first part."""
    short, long = _parts(turns, conv_col, turn_col, role_col, text_col, present_col)
    return short.unionByName(long) if long is not None else short


def digest(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """One row a conversation, with the SHA-256 of its repaired ``role:text`` lines. Parts of long ones pass through their task in order, one at a time."""
    short, long = _parts(turns, conv_col, turn_col, role_col, text_col, present_col)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    line = lambda t: F.concat(t["role"], F.lit(":"), t["text"])
    out = short.select(*names, "audit", F.sha2(F.array_join(F.transform("repaired", line), "\n"), 256).alias("repaired_sha256"))
    if long is None:
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashed, audit, started = hashlib.sha256(), [], False
        for batch in batches:
            for row in batch.to_pylist():
                for t in row["repaired"]:
                    hashed.update(("\n" * started + f"{t['role']}:{t['text']}").encode())
                    started = True
                audit.append(row["audit"])
                if row["part"] == 0:
                    head = {n: row[n] for n in names}
                if row["part"] == row["parts"] - 1:
                    yield {n: [v] for n, v in (head | {"audit": "".join(audit), "repaired_sha256": hashed.hexdigest()}).items()}
                    hashed, audit, started = hashlib.sha256(), [], False

    ordered = long.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    kinds = ", ".join(f"{n} long" for n in names)
    return out.unionByName(_streamed(ordered, run, f"{kinds}, audit string, repaired_sha256 string"))


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present): faults by crc32(``conv:turn``) % 20: 0 drops a turn (present is false), 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats it, 4 makes its role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = columns_as(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.withColumn("fault", F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20)
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(space("role"))
    times = F.explode(F.array_repeat(F.col("fault") != 0, F.when(F.col("fault") == 3, 2).otherwise(1))).alias("present")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times)
