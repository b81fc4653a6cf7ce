"""Chat formatting by multi-party perspective rotation (operator 8, DataFrame functions only).

Every participant of a conversation gets the dialogue rendered with their turns as the assistant's and all
others' as named users'; the mask marks what is to be learned: their own words and the marks that end them.
A rendering is a run of rows, one for each turn, with its place in the whole, so that no dialogue is ever
gathered; joined in order of ``position`` the segments are the dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT_SHARE, small, stage, table, with_facts

#: The marks of the format. In texts their first character is set apart, so that no text can pose as a mark.
START, END, MARK, SET_APART = "<|im_start|>", "<|im_end|>", "<|", "< |"
#: Speakers whose turns are instructions: shown to all, learned by none.
INSTRUCTIONS = ("system",)
NOBODY = "unknown"
#: All characters that end a line; in names they are spaces.
LINE_ENDS = "\r\n\x0b\x0c\x85\u2028\u2029"


def set_apart(text: Column) -> Column:
    """Text that holds no mark."""
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(MARK), F.lit(SET_APART))


def in_order(turns: DataFrame, conversation: Column, turn: Column, speaker: Column, text: Column) -> DataFrame:
    """(conv, turn, speaker, text, part, seq): sorted over all; ``part`` numbers the sorted parts, ``seq`` rises.

    One conversation may span parts, also where all of its turns have one number. Staged, so that the parts
    and numbers stay as they are.
    """
    said = turns.select(conversation.alias("conv"), turn.alias("turn"), speaker.cast("string").alias("speaker"), set_apart(text).alias("text"))
    keys = [F.col("conv").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("speaker").asc_nulls_last(), F.col("tie"), F.col("row")]
    numbered = said.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stage(ordered.select("conv", "turn", "speaker", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "chat-order")


def views(said: DataFrame) -> DataFrame:
    """The rows of ``in_order`` once for each participant of their conversation, with ``perspective``."""
    per = stage(said.groupBy("conv", "speaker").agg(F.count("*").alias("n")), "chat-speakers")
    total = per.agg(F.sum("n")).first()[0] or 0
    turns = per.groupBy(F.col("conv").alias("of")).agg(F.sum("n").alias("turns"))
    who = per.where(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*INSTRUCTIONS)).join(turns, F.col("conv").eqNullSafe(F.col("of"))).select("conv", F.col("speaker").alias("perspective"), "turns")
    who = stage(who, "chat-views")
    # Long conversations keep their place where their participants are few enough to be broadcast; else the result itself is larger by that number.
    return with_facts(said, who, "conv", F.col("turns") > HOT_SHARE * total).drop("turns")


def rotate(turns: DataFrame, conversation: Column, turn: Column, speaker: Column, text: Column) -> DataFrame:
    """(conv, perspective, position, turn, speaker, segment, start, mask_start, mask_end): a row for each
    participant and turn.

    Participants are a conversation's distinct speakers but for ``INSTRUCTIONS`` and null; a conversation
    without one gives no row. Turns go by number, nulls last, equal numbers by speaker and text; a null
    speaker is a user named ``unknown``; a null text is empty. Marks in texts and in names are set apart, and
    line ends in names are spaces, so neither can pose as a turn. ``start`` is the segment's first character in
    the whole rendering; the mask's bounds count likewise and are null where nothing is learned. A null
    conversation is one of its own. Repeated rows are turns of their own. An empty table gives an empty
    result. A conversation of n participants and m turns gives n * m rows: that is its size, also where each turn has a speaker of its own.
    """
    each = views(in_order(turns, conversation, turn, speaker, text))
    mine = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    instructs = F.coalesce(F.col("speaker").isin(*INSTRUCTIONS), F.lit(False))
    name = F.translate(set_apart(F.coalesce("speaker", F.lit(NOBODY))), LINE_ENDS, " " * len(LINE_ENDS))
    head = F.when(mine, F.lit(f"{START}assistant\n")).when(instructs, F.concat(F.lit(START), "speaker", F.lit("\n"))).otherwise(F.concat(F.lit(f"{START}user name="), name, F.lit("\n")))
    each = each.withColumn("mine", mine).withColumn("head", head).withColumn("size", F.length("head") + F.length("text") + len(END) + 1)

    # Places within a part, and for the one conversation that goes on from an earlier part what lies before.
    sums = each.groupBy("conv", "perspective", "part").agg(F.count("*").alias("turns"), F.sum("size").alias("chars"))
    earlier = W.partitionBy("conv", "perspective").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(F.col("conv").alias("c_conv"), F.col("perspective").alias("c_perspective"), F.col("part").alias("c_part"), F.sum("turns").over(earlier).alias("turns_before"), F.sum("chars").over(earlier).alias("chars_before")).where("turns_before is not null")
    within = W.partitionBy("conv", "perspective", "part").orderBy("seq")
    placed = each.withColumn("nth", F.row_number().over(within)).withColumn("upto", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)))
    both = placed.join(small(stage(carried, "chat-carried")), F.col("conv").eqNullSafe(F.col("c_conv")) & (F.col("perspective") == F.col("c_perspective")) & (F.col("part") == F.col("c_part")), "left")
    start = F.coalesce("chars_before", F.lit(0)) + F.col("upto") - F.col("size")
    learned = start + F.length("head")
    return both.select(
        "conv", "perspective", (F.coalesce("turns_before", F.lit(0)) + F.col("nth")).cast("long").alias("position"), "turn", "speaker",
        F.concat("head", "text", F.lit(f"{END}\n")).alias("segment"), start.cast("long").alias("start"),
        F.when(F.col("mine"), learned).cast("long").alias("mask_start"), F.when(F.col("mine"), learned + F.length("text") + len(END)).cast("long").alias("mask_end"),
    )


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, from the view of each of their speakers."""
    turns = table(spark, sf_dir, "conversations")
    return rotate(turns, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")).withColumnRenamed("conv", "conv_id")


OP8_SQL = f"""
with said as (select conv_id, turn, role, replace(coalesce(text, ''), '{MARK}', '{SET_APART}') as body from conversations),
who as (select distinct conv_id, role as perspective from said where role is not null and role not in ('system')),
each as (
  select said.*, perspective, role is not distinct from perspective as mine,
    case when role is not distinct from perspective then '{START}assistant' || chr(10) when role = 'system' then '{START}system' || chr(10)
      else '{START}user name=' || translate(replace(coalesce(role, '{NOBODY}'), '{MARK}', '{SET_APART}'), {' || '.join(f'chr({ord(c)})' for c in LINE_ENDS)}, '{' ' * len(LINE_ENDS)}') || chr(10) end as head
  from said join who on said.conv_id is not distinct from who.conv_id),
sized as (select *, length(head) + length(body) + {len(END) + 1} as size from each),
placed as (
  select *, row_number() over w as position, sum(size) over w - size as start
  from sized window w as (partition by conv_id, perspective order by turn nulls last, role nulls last, body rows unbounded preceding))
select conv_id, perspective, position::bigint as position, turn, role as speaker, head || body || '{END}' || chr(10) as segment, start::bigint as start,
  case when mine then start + length(head) end::bigint as mask_start, case when mine then start + length(head) + length(body) + {len(END)} end::bigint as mask_end
from placed
"""
