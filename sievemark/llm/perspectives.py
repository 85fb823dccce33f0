"""Chat formatting by perspective rotation, in DataFrame functions only.

A dialogue of several speakers becomes one training text for each of them: that speaker is the assistant, all others
are users with their names, and only the assistant's words (with the end marker, which it has to learn) count for the
loss.

Turns move once, by dialogue.  A window puts them in order and sums up the lengths of what comes before each of them,
as if nobody were the assistant; in a perspective, a turn stands later than that by a fixed amount for each turn of the
assistant before it.  So the spans of a perspective follow from the assistant's turns alone, without a fold over the
dialogue.  A text is a value of one row, which the engine limits to 2 GiB: a dialogue beyond that has no rendered row and
raises an error, and :func:`perspective_turns` gives it turn by turn instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Speakers whose turns set the scene: they are rendered as they are in every perspective and have none themselves.
NARRATORS = ("system",)
#: The name of a speaker that is null or blank.
UNNAMED = "unknown"
_USER, _ASSISTANT = "user name=", "assistant"
#: Code points of a text that surely fit into a row, at four bytes each.
MOST_CHARACTERS = 500_000_000


def _safe(text: Column) -> Column:
    """Markers inside a text are broken up, so that they can't end a turn."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "<| $1 |>")


def _name(speaker: Column) -> Column:
    name = F.regexp_replace(F.trim(F.coalesce(speaker.cast("string"), F.lit(""))), r"[\x00-\x20]+", "_")
    return F.when(name == "", F.lit(UNNAMED)).otherwise(_safe(name))


def _turns(turns: DataFrame, id_col: str, turn_col: str, speaker_col: str, text_col: str, narrators: tuple[str, ...]) -> DataFrame:
    """``conv_, alone_, at, name, scene, body, before``: the turns of each dialogue, numbered from 0.

    ``body`` is the text with the end marker and ``before`` the code points before the turn if nobody is the
    assistant.  A turn without a dialogue id is a dialogue of its own, told apart by ``alone_``.
    """
    conv = turns[id_col].cast("long")
    t = turns.select(
        conv.alias("conv_"), F.when(conv.isNull(), F.monotonically_increasing_id()).alias("alone_"), turns[turn_col].cast("long").alias("turn"),
        _name(turns[speaker_col]).alias("name"), F.concat(_safe(turns[text_col]), F.lit(END)).alias("body"),
    )
    t = t.withColumn("scene", F.col("name").isin(*narrators))
    head = F.lit(len(START) + 1) + F.length("name") + F.when(F.col("scene"), 0).otherwise(len(_USER))
    order = Window.partitionBy("conv_", "alone_").orderBy(F.col("turn").asc_nulls_last(), "name", "body")
    upto = F.sum((head + F.length("body") + 1).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return t.select("conv_", "alone_", (F.row_number().over(order) - 1).cast("long").alias("at"), "name", "scene", "body", F.coalesce(upto, F.lit(0)).alias("before"))


def _head(t: Column, assistant: Column) -> Column:
    role = F.when(t["name"] == assistant, F.lit(_ASSISTANT)).when(t["scene"], t["name"]).otherwise(F.concat(F.lit(_USER), t["name"]))
    return F.concat(F.lit(START), role, F.lit("\n"))


def _shift(assistant: Column) -> Column:
    """By how much a turn of the assistant is longer than the same turn of a user."""
    return F.lit(len(_ASSISTANT) - len(_USER)) - F.length(assistant)


def perspectives(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """``conv_id, assistant, n_turns, text, spans, n_loss_chars``: a row for each dialogue and speaker in it, with the
    whole dialogue.

    ``spans`` are half-open ranges of code points of ``text`` that count for the loss, in order.  Equal turn numbers
    are ordered by name and text; a null number comes last.  A dialogue of narrators alone has no perspective and
    gives no row.  A null text is an empty turn, a null or blank speaker is ``UNNAMED``; repeated rows are repeated
    turns; a turn without a dialogue id is a dialogue of its own; other columns are ignored; an empty table gives an
    empty result.  A dialogue of more than ``MOST_CHARACTERS`` raises an error.
    """
    t = _turns(turns, id_col, turn_col, speaker_col, text_col, narrators)
    too_long = F.concat(F.lit("dialogue "), F.coalesce(F.col("conv_").cast("string"), F.lit("without id")), F.lit(" does not fit into a row: use perspective_turns"))
    fits = F.when(F.col("before") + F.length("body") > MOST_CHARACTERS, F.raise_error(too_long).cast("long")).otherwise(F.col("before"))
    entry = F.struct("at", "name", "scene", "body", fits.alias("before"))
    seen = t.groupBy("conv_", "alone_").agg(F.sort_array(F.collect_list(entry)).alias("turns_"))
    speakers = F.array_distinct(F.transform(F.filter("turns_", lambda t: ~t["scene"]), lambda t: t["name"]))
    seen = seen.withColumn("assistant", F.explode(speakers))
    own = F.filter("turns_", lambda t: t["name"] == F.col("assistant"))

    def span(t: Column, i: Column) -> Column:
        start = t["before"] + i * _shift(F.col("assistant")) + F.lit(len(START) + len(_ASSISTANT) + 1)
        return F.struct(start.cast("long").alias("start"), (start + F.length(t["body"])).cast("long").alias("end"))

    text = F.array_join(F.transform("turns_", lambda t: F.concat(_head(t, F.col("assistant")), t["body"], F.lit("\n"))), "")
    out = seen.select(F.col("conv_").alias(id_col), "assistant", F.size("turns_").cast("long").alias("n_turns"), text.alias("text"), F.transform(own, span).alias("spans"))
    return out.withColumn("n_loss_chars", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))


def perspective_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """``conv_id, assistant, at, head, body, start, end, loss``: the same perspectives with a row for each turn, for
    dialogues of any length.

    ``head``, ``body`` and a line feed, of all turns by ``at``, are the text of a perspective; ``start`` and ``end``
    say where the body lies in it, and ``loss`` whether it counts.  No row holds more than a turn, and windows spill.
    """
    t = _turns(turns, id_col, turn_col, speaker_col, text_col, narrators)
    speakers = t.where(~F.col("scene")).select(F.col("conv_").alias("c_"), F.col("alone_").alias("a_"), F.col("name").alias("assistant")).distinct()
    j = t.join(speakers, t["conv_"].eqNullSafe(F.col("c_")) & t["alone_"].eqNullSafe(F.col("a_")))
    me = F.col("assistant")
    mine = F.col("name") == me
    earlier = F.sum(mine.cast("long")).over(Window.partitionBy("conv_", "alone_", "assistant").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    j = j.withColumn("earlier", F.coalesce(earlier, F.lit(0))).withColumn("head", _head(F.struct("name", "scene"), me))
    start = F.col("before") + F.col("earlier") * _shift(me) + F.length("head")
    return j.select(F.col("conv_").alias(id_col), "assistant", "at", "head", "body", start.alias("start"), (start + F.length("body")).alias("end"), mine.alias("loss"))


def span_text(spans: Column) -> Column:
    """Spans as text, ``start-end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
