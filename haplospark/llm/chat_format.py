r"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation gets a rendering of the whole dialogue in which that speaker is the assistant and
all others are named users.  Characters of the assistant's turns (with their end marker) are masked in, that is, trained
on; all others are context.  Speakers in ``SETTING`` (``system``) are no participants: their turns stay as they are.

A conversation is rendered in parts of ``PART`` turn numbers each, and a part in pieces of ``PART`` turns (more than one only where numbers
are null or repeat), so no task collects more than a piece, however long a conversation is; parts and pieces in order, put together, are
the whole dialogue.  Speakers are found by a partial aggregation over
(conversation, speaker), and joined to the parts.  All of it is built-in expressions.

What stands in a text or a name cannot pass for a marker: ``<|`` in either, and ``|>`` in a name, get a backslash between their two characters (and one
more where some are there already, so it can be undone).

Defined edge cases: turns are ordered by turn (null first), speaker, text; repeated rows are repeated turns.  A null text
is empty; a null speaker is called ``unknown``, and is one participant with any other of that name; a null conversation id is a conversation of its own.  A
null turn belongs to the first part.  A conversation of system turns alone has no perspective and gives no row.  Other
columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = 1024
SETTING = ("system",)
UNKNOWN = "unknown"
END = "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_name(name: Column) -> Column:
    return F.regexp_replace(escaped(name), r"\|(\\*)>", r"|\\$1>")


def _header(speaker: Column, perspective: Column) -> Column:
    setting = F.concat(F.lit("<|"), speaker, F.lit("|>\n"))
    return F.when(speaker.isin(*SETTING), setting).when(speaker == perspective, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), speaker, F.lit("|>\n")))


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, part, piece, n_turns, n_masked, text, mask (array of (start, end) in code points of the part, end exclusive)."""
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), escaped_name(F.coalesce(F.col(speaker), F.lit(UNKNOWN))).alias("who"), escaped(F.coalesce(F.col(text), F.lit(""))).alias("said"),
        F.coalesce(F.floor(F.col(turn) / PART), F.lit(0)).cast("int").alias("part"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "who", "said"))
    parts = rows.withColumn("piece", F.floor((place - 1) / PART).cast("int")).groupBy("conv_id", "part", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "who", "said"))).alias("turns"))
    people = rows.where(~F.col("who").isin(*SETTING)).select(F.col("conv_id").alias("__conv"), F.col("who").alias("perspective")).distinct()
    seen = parts.join(people, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    me = F.col("perspective")
    pieces = F.transform("turns", lambda t: F.struct(_header(t["who"], me).alias("head"), F.concat(t["said"], F.lit(END)).alias("body"), (t["who"] == me).alias("own")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.char_length(p["head"])
        end = begin + F.char_length(p["body"])
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["mask"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["mask"]).alias("mask"))

    shown = seen.withColumn("pieces", pieces)
    mask = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), none.alias("mask")), step, lambda acc: acc["mask"])
    out = shown.select("conv_id", "perspective", "part", "piece", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"), mask.alias("mask"))
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return out.select("conv_id", "perspective", "part", "piece", "n_turns", masked.alias("n_masked"), "text", "mask")


def mask_text(mask: Column) -> Column:
    """``start:end`` joined by commas."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
