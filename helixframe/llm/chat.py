"""Multi-party perspective rotation, by DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that participant as the
assistant, the others as named users, and the loss mask over what the participant says. Roles are
the participants; ``system`` turns are rendered as such for everyone and never learned from.

A row is one part of one segment of a rendering: a segment holds the turns from segment *
turns_per_segment on, and its parts ``turns_per_segment`` rows each, in order. It has more than one
part only where turn numbers repeat or are missing. However long a conversation is and however its
turns are numbered, so many rows at most are gathered in one place, and mask spans count within the
part's text. Parts are gathered first and then meet the conversation's participants, one row each, in
a join that adaptive execution may split, so a hot conversation spreads over tasks both times.

Defined cases: a null text is empty; a null or blank role is the participant ``unknown``; turns with
a null number come in segment -1, by role and text; equal turn numbers are ordered by role, then
text, and repeated rows repeat; a null conversation id is a conversation of its own; a conversation
of system turns only has no participant and so no row; an empty table gives no rows; other columns
are ignored. ``<|`` within a text or role is written ``< |``, so texts cannot forge markers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_as

SYSTEM = "system"
END = "<|end|>\n"


def rotated(turns: DataFrame, turns_per_segment: int = 64, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, speaker, segment, part, n_turns, text, mask array<struct<start, stop>>): half-open character ranges to learn from."""
    rows = columns_as(turns, conv=conv_col, turn=turn_col, role=role_col, said=text_col)
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = rows.select(
        F.struct("conv").alias("key"),  # a struct of null joins, null does not
        F.coalesce(F.floor(F.col("turn") / turns_per_segment), F.lit(-1)).alias("segment"),
        "turn",
        plain(F.coalesce(F.when(F.trim("role") != "", F.col("role")), F.lit("unknown"))).alias("role"),
        plain(F.coalesce("said", F.lit(""))).alias("said"),
    )
    speakers = rows.where(F.col("role") != SYSTEM).select("key", F.col("role").alias("speaker")).distinct()
    nth = F.row_number().over(W.partitionBy("key", "segment").orderBy("turn", "role", "said")) - 1
    parts = rows.withColumn("part", F.floor(nth / turns_per_segment))
    turns_of = parts.groupBy("key", "segment", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "said"))).alias("turns"))
    seen = turns_of.join(speakers, "key")

    def piece(x):
        own = x["role"] == F.col("speaker")
        head = F.when(x["role"] == SYSTEM, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), x["role"], F.lit("|>\n")))
        return F.struct(own.alias("own"), F.length(head).alias("head"), F.concat(head, x["said"], F.lit(END)).alias("piece"))

    held = seen.select("key", "speaker", "segment", "part", F.transform("turns", piece).alias("pieces"))

    def walk(acc, x):
        stop = acc["at"] + F.length(x["piece"])
        span = F.struct((acc["at"] + x["head"]).alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(x["own"], F.array_append(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("mask"))
    return held.select(
        F.col("key.conv").alias("conv_id"),
        "speaker",
        "segment",
        "part",
        F.size("pieces").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("text"),
        F.aggregate("pieces", start, walk)["mask"].alias("mask"),
    )
