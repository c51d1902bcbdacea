"""Chat formatting by perspective rotation (operator 7).

Every participant of a conversation gets the whole dialogue with itself as the assistant, the
others as named users, and a loss mask over its own turns.  The result has a row for each
(conversation, perspective, turn): the rendered segment, its character range in the rendered
dialogue and the trained range inside it.  A dialogue is the concatenation of its segments in
order of ``position``; it is never gathered into one row, so one conversation may hold any share
of all turns.  Offsets are prefix sums in two levels: within blocks of ``BLOCK`` turn numbers,
then over the blocks' totals.

Defined results: a null role is the participant ``unknown``, a null text is empty, turns with a
null number come first, equal numbers are ordered by role and text (repeated rows stay, in any
order, being equal); a null conversation id is a conversation of its own.  Marks inside texts and names are
broken up and line ends in names are spaces, so no turn can forge another.  ``system`` turns are
rendered as they are for every perspective and ``system`` is no participant; a conversation
without any other speaker has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 4096
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What begins a mark, and what stands for it inside names and texts.
MARK, PLAIN = "<|im_", "<| im_"
NARRATOR = "system"


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, position, turn, speaker, role, segment, start, end, train_start, train_end."""
    turns = conversations.select(
        "conv_id",
        "turn",
        F.translate(F.replace(F.coalesce("role", F.lit("unknown")), F.lit(MARK), F.lit(PLAIN)), "\r\n", "  ").alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(PLAIN)).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    people = turns.where(F.col("speaker") != NARRATOR).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    rows = turns.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker") == NARRATOR, NARRATOR).otherwise("user")
    head = F.concat(F.lit(OPEN), role, F.when(role == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(""), F.lit("\n"))
    rows = rows.select("*", role.alias("role"), F.length(head).alias("head"), F.concat(head, "text", F.lit(CLOSE)).alias("segment"))
    rows = rows.withColumn("size", F.length("segment").cast("long"))

    by = ["conv_id", "perspective", "block"]
    order = [F.col("turn").asc_nulls_first(), "speaker", "text"]
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(inside)).withColumn("upto", F.sum("size").over(inside))
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("block_n"), F.sum("size").alias("block_size"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(c).alias(f"t_{c}") for c in by],
        F.coalesce(F.sum("block_n").over(earlier), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("size0"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("t_conv_id")) & (F.col("perspective") == F.col("t_perspective")) & (F.col("block") == F.col("t_block"))
    out = rows.join(totals, same)
    start = F.col("size0") + F.col("upto") - F.col("size")
    trained = lambda x: F.when(own, x.cast("long"))
    return out.select(
        "conv_id",
        "perspective",
        (F.col("n0") + F.col("n") - 1).alias("position"),
        "turn",
        "speaker",
        "role",
        "segment",
        start.alias("start"),
        (start + F.col("size")).alias("end"),
        trained(start + F.col("head")).alias("train_start"),
        trained(start + F.col("size") - len(CLOSE) + len("<|im_end|>")).alias("train_end"),
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
