"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as assistant and the others as
named users; the mask covers what the assistant says, with its end mark.  A system turn stays one in every
perspective.  Dialogues are rendered in blocks of BLOCK turn numbers, so that no task holds a whole long
conversation.  A row is one block of one perspective: ``at`` is where it begins in the perspective's whole text, and
masks are places in the whole text.  dialogues() joins the blocks of perspectives that are known to fit in a row.

Cases.  Turns are ordered by (turn, role, text).  Turns without a number come first, spread over NO_TURN blocks by a hash of
role and text and in that order.  Null texts are empty; a null role is a user "unknown" and no participant.  Rows with a null
conversation are one conversation.  Repeated rows are repeated turns.  Control marks in a text or a role are broken up
by a blank, line ends in a role become blanks.  A conversation of system turns only has no participant and no row.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, NO_TURN = 64, 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _broken(col: Column) -> Column:
    return F.replace(col, F.lit("<|"), F.lit("< |"))


def _other(role: Column, system: str) -> Column:
    """What stands for a role that isn't the speaker's."""
    name = F.translate(_broken(F.coalesce(role, F.lit("unknown"))), "\n\r", "  ")
    return F.when(role == system, system).otherwise(F.concat(F.lit("user name="), name))


def rotate(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """(conv_id, speaker, block, n_turns, at, rendered, mask): mask is an array of (start, end) in characters."""
    own_turn = F.col(turn)
    said = df.select(
        F.col(conv_id).alias("conv_id"),
        F.coalesce(F.floor(own_turn / BLOCK), -1 - F.pmod(F.xxhash64(F.col(role), F.col(text)), F.lit(NO_TURN))).cast("long").alias("block"),
        F.struct(own_turn.alias("turn"), F.col(role).alias("role"), _broken(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("said"),
    )
    blocks = said.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("said")).alias("said"))
    # sizes come from a narrow table: a block as all others see it, and what its own turns change for a speaker
    fixed = len(OPEN) + 1 + len(CLOSE)
    narrow = said.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("said.role").alias("r"), F.length("said.text").alias("n"))
    narrow = narrow.groupBy("c", "b", "r").agg(F.count(F.lit(1)).alias("turns"), F.sum("n").alias("chars"))
    sizes = narrow.groupBy("c", "b").agg(F.sum(F.col("chars") + F.col("turns") * (F.length(_other(F.col("r"), system)) + fixed)).alias("size"))
    speakers = narrow.where(F.col("r") != system).select(F.col("c").alias("c2"), F.col("r").alias("speaker")).distinct()
    change = narrow.select(F.col("c").alias("c3"), F.col("b").alias("b3"), F.col("r").alias("r3"), (F.col("turns") * (len("assistant") - F.length(_other(F.col("r"), system)))).alias("change"))
    views = sizes.join(speakers, F.col("c").eqNullSafe(F.col("c2")))
    views = views.join(change, F.col("c").eqNullSafe(F.col("c3")) & (F.col("b") == F.col("b3")) & (F.col("speaker") == F.col("r3")), "left")
    so_far = Window.partitionBy("c", "speaker").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    views = views.select("c", "b", "speaker", F.coalesce(F.sum(F.col("size") + F.coalesce("change", F.lit(0))).over(so_far), F.lit(0)).cast("long").alias("at"))
    views = blocks.join(views, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    head = lambda s: F.concat(F.lit(OPEN), F.when(s["role"] == F.col("speaker"), "assistant").otherwise(_other(s["role"], system)), F.lit("\n"))
    turns = F.transform("said", lambda s: F.struct(head(s).alias("head"), F.concat(s["text"], F.lit(CLOSE)).alias("body"), F.coalesce(s["role"] == F.col("speaker"), F.lit(False)).alias("own")))
    views = views.select("conv_id", "speaker", "block", "at", turns.alias("turns"))
    kind = "array<struct<start: long, end: long>>"
    zero = F.struct(F.col("at").alias("at"), F.array().cast(kind).alias("mask"))

    def step(a, t):
        start = a["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        return F.struct(end.alias("at"), F.when(t["own"], F.concat(a["mask"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(a["mask"]).alias("mask"))

    rendered = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), "")
    return views.select("conv_id", "speaker", "block", F.size("turns").cast("long").alias("n_turns"), "at", rendered.alias("rendered"), F.aggregate("turns", zero, step)["mask"].alias("mask"))


def dialogues(rotated: DataFrame) -> DataFrame:
    """(conv_id, speaker, n_turns, rendered, mask): whole perspectives, for conversations that fit in a row."""
    own = rotated.groupBy("conv_id", "speaker").agg(F.sort_array(F.collect_list(F.struct("block", "n_turns", "rendered", "mask"))).alias("x"))
    n_turns = F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["n_turns"])
    return own.select("conv_id", "speaker", n_turns.alias("n_turns"), F.array_join("x.rendered", "").alias("rendered"), F.flatten("x.mask").alias("mask"))
