"""Chat formatting by perspective rotation (DataFrame functions only).

A dialogue of several parties is rendered once for every participant: that speaker's turns are the
assistant's and carry the loss, the others speak as named users, system turns stay system turns.  The
result has one row for each rendered turn, in place by its offset, so that no dialogue has to fit in one
row; joined in order of ``seq`` the rows of a perspective are its rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.llm._common import cut, join_small, running_total, text_or_empty

#: Fixed values of the template.
START, END, LINE = "<|im_start|>", "<|im_end|>", "\n"
SYSTEM, ASSISTANT, USER, UNNAMED = "system", "assistant", "user", "unknown"
#: Turns that one running total goes over at once.
SEGMENT_TURNS = 256


def spoken_name(role: Column) -> Column:
    """A speaker's name as the template writes it: letters, digits, _ and - stay, the rest become _."""
    return F.regexp_replace(F.coalesce(F.nullif(role, F.lit("")), F.lit(UNNAMED)), "[^A-Za-z0-9_-]", "_")


def plain(text: Column) -> Column:
    """Text in which the template's marks are broken by a blank, so that content can't open or close a turn."""
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<| $1|>")


def participants(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Views (key, viewer, perspective), and the few speakers (key, raw, name) who share a written name with another.

    Speakers are told apart by their roles as given.  Of those whose written names are equal, the first by
    role keeps it and the others add a full stop, which no written name has, and their number.
    """
    people = turns.groupBy("key", F.when(~F.col("is_system"), F.col("raw")).alias("viewer")).agg(F.lit(1).alias("_"))
    base = F.when(F.col("viewer").isNotNull(), spoken_name(F.col("viewer")))
    rank = F.row_number().over(Window.partitionBy("key", "base").orderBy("viewer"))
    heard = F.max(F.col("viewer").isNotNull()).over(Window.partitionBy("key"))
    named = people.select("key", "viewer", base.alias("base")).withColumns({"rank": rank, "heard": heard})
    named = named.filter("viewer IS NOT NULL OR NOT heard")
    written = F.when(F.col("rank") > 1, F.concat("base", F.lit("."), F.col("rank").cast("string"))).otherwise(F.col("base"))
    views = cut(named.select("key", "viewer", written.alias("perspective"), "rank"))
    renamed = cut(views.filter("viewer IS NOT NULL AND rank > 1").select("key", F.col("viewer").alias("raw"), F.col("perspective").alias("name")))
    return views.drop("rank"), renamed


def rotate(conversations: DataFrame) -> DataFrame:
    """Rows conv_id, perspective, turn, seq, role, name, rendered, mask, start, stop.

    Reads conv_id, turn, role and text.  ``role`` is as rendered, ``name`` is null but for users;
    ``rendered`` is the whole turn with its marks, ``start`` and ``stop`` its place in the rendering in
    characters, ``seq`` its place in turns from 0, ``mask`` whether it carries the loss.  Participants are
    the distinct roles of a conversation but system, each by a written name of its own (see
    ``participants``), which ``perspective`` gives; a null or empty role is one participant, "unknown".  A
    conversation of system turns alone is rendered once, with a null perspective and no loss.  Turns go by
    turn number, null last, ties by role and text; repeated rows are turns of their own.  A null conv_id
    is one more conversation; a null text is empty.  An empty table gives no rows.
    """
    raw = F.coalesce(F.col("role").cast("string"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    turns = conversations.select(
        "conv_id", key.alias("key"), F.col("turn").cast("long").alias("turn"), raw.alias("raw"), (raw == SYSTEM).alias("is_system"), plain(text_or_empty()).alias("text"),
    )
    views, renamed = participants(turns)
    named = join_small(turns, renamed, ["key", "raw"], "left").withColumn("spoken", F.coalesce("name", spoken_name(F.col("raw")))).drop("name")
    seen = named.join(views, "key")
    own = ~F.col("is_system") & F.col("raw").eqNullSafe(F.col("viewer"))
    role = F.when(F.col("is_system"), SYSTEM).when(own, ASSISTANT).otherwise(USER)
    name = F.when(~F.col("is_system") & ~own, F.col("spoken"))
    head = F.concat(F.lit(START), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit(LINE))
    shown = seen.withColumns({
        "mask": own, "shown": role, "name": name, "rendered": F.concat(head, F.col("text"), F.lit(END + LINE)),
        "who": F.coalesce(F.concat(F.lit("="), F.col("viewer")), F.lit("")), "last": F.coalesce("turn", F.lit(2**62)), "one": F.lit(1).cast("long"),
    })
    shown = shown.withColumns({"segment": F.floor(F.col("last") / SEGMENT_TURNS), "size": F.length("rendered").cast("long")})
    placed = running_total(shown, ["key", "who"], "segment", ["last", "raw", "text"], {"start": "size", "seq": "one"})
    return placed.select("conv_id", "perspective", "turn", "seq", F.col("shown").alias("role"), "name", "rendered", "mask", "start", (F.col("start") + F.col("size")).alias("stop"))
