"""Chat formatting by perspective rotation.

For every participant of a conversation, the dialogue is rendered with that speaker as the assistant, all others as named
users, and system turns as they are. Masks are the character spans that the assistant of that rendering says.

A conversation comes in parts of `part_turns` turns (the last one: what is left), whatever numbers its turns have, so that no group
grows with a conversation; the spans count from the start of their part. Turns are counted over a range partition of all
conversations, so one with most of all turns is no larger a task than others.

Defined results: turns are ordered by number (null first), speaker and text; a null role is the speaker `unknown`, a null
text an empty one; repeated rows are separate turns; a conversation of system turns only has no participant and gives no row; a
null conversation id is a conversation of its own; an empty table gives no rows; columns besides `conv_id`, `turn`, `role`
and `text` are not looked at. Texts are rendered whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.llm.common import numbered

SYSTEM = "system"
UNKNOWN = "unknown"
HEAD = "<|{}|>\n"
END = "<|end|>\n"


def perspectives(conversations: DataFrame, part_turns: int = 1024) -> DataFrame:
    """conv_id, speaker, part, n_turns, text, spans (array of start, stop), masked (number of characters in spans)."""
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("1"), F.col("conv_id").cast("string")), F.lit("0")).alias("tree"),
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"),
        F.coalesce("text", F.lit("")).alias("said"),
        F.monotonically_increasing_id().alias("row"),  # deals out rows that are equal in all else
    )
    turns = numbered(rows, ["turn", "role", "said", "row"]).withColumn("part", F.floor(F.col("place") / part_turns).cast("int"))
    speakers = turns.filter(F.col("role") != SYSTEM).select(F.col("conv_id").alias("__conv"), F.col("role").alias("speaker")).distinct()
    rotated = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("__conv")))
    mine = F.col("role") == F.col("speaker")
    head = (
        F.when(mine, HEAD.format("assistant"))
        .when(F.col("role") == SYSTEM, HEAD.format(SYSTEM))
        .otherwise(F.concat(F.lit("<|user:"), "role", F.lit("|>\n")))
    )
    rows = rotated.withColumns({"head": head, "body": F.concat("said", F.lit(END)), "mine": mine})
    grouped = rows.groupBy("conv_id", "speaker", "part").agg(
        F.array_sort(F.collect_list(F.struct("place", "head", "body", "mine"))).alias("turns")
    )
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["head"]) + F.length(t["body"])).alias("at"),
            F.when(
                t["mine"],
                F.array_append(
                    a["spans"],
                    F.struct(
                        (a["at"] + F.length(t["head"])).alias("start"),
                        (a["at"] + F.length(t["head"]) + F.length(t["body"])).alias("stop"),
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return grouped.select(
        "conv_id",
        "speaker",
        "part",
        F.size("turns").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), "").alias("text"),
        spans.alias("spans"),
    ).withColumn("masked", F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"]))
