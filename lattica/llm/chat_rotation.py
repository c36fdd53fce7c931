"""Multi-party perspective rotation of dialogues.

Every participant of a conversation is given the dialogue with themselves as the assistant: their
turns are the assistant's and are trained on; everybody else is a user with a name; system turns
stay system turns.  A turn is rendered in a row of its own, so a conversation of any length is never
gathered; its rows in the order of ``turn`` are the rendered dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import stored

#: A participant whose role is null.
UNKNOWN = "unknown"


def rotate(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>", system: str = "system") -> DataFrame:
    """``conv_id, perspective, turn, role, name, rendered, train, mask_start, mask_end``.

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored.  ``role`` names the speaker.  A row comes for
    every turn and every participant of its conversation; a conversation with system turns
    alone has no participants and no rows.  ``mask_start, mask_end`` are the code points of ``rendered``
    that are trained on (the assistant's text and its end mark), equal where ``train`` is false.  A null text is
    empty, a null role is the speaker "unknown", a null conv_id is one conversation; repeated rows and ties
    of ``turn`` are kept as they are.
    """
    own = turns.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("said"),
    )
    # A few speakers for each conversation, combined before the shuffle; stored, so that the
    # join shuffles the turns itself and those of one huge conversation can be split.
    people = stored(
        own.where(F.col("speaker") != system).select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct(),
        "participants",
    )
    mine = F.col("speaker") == F.col("perspective")
    role = F.when(mine, "assistant").when(F.col("speaker") == system, system).otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit(start), role, F.when(role == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(""), F.lit("\n"))
    rendered = F.concat(head, F.col("said"), F.lit(end), F.lit("\n"))
    begin = F.length(head)
    return own.join(people, F.col("conv_id").eqNullSafe(F.col("conv"))).select(
        "conv_id",
        "perspective",
        "turn",
        role.alias("role"),
        name.alias("name"),
        rendered.alias("rendered"),
        mine.alias("train"),
        begin.alias("mask_start"),
        F.when(mine, F.length(rendered) - 1).otherwise(begin).alias("mask_end"),
    )
