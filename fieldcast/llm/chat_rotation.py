"""Chat formatting: one rendering of a dialogue per participant.

Each participant (every role but the system's) is the assistant once; the other
participants become named users and the system's turns stay. A rendering is the
rendered turns in order, so it is kept as rows: where each turn stands in the
rendered dialogue, its text, and which of its characters are trained on. No row
or task holds a whole conversation; ``assembled`` joins the rows to strings for
callers whose conversations are known to fit.

A turn's order is (turn, role, text); repeated rows stay and stand side by
side. A null role reads ``unknown``, a null text is empty, null ids are one
conversation, white space at the ends of a text goes. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.llm._text import BLANK

SYSTEM = "system"
#: turns whose lengths one window adds up
BLOCK = 1024


def _head(role: Column, speaker: Column) -> Column:
    return (F.when(role == SYSTEM, F.lit("<|system|>\n"))
            .when(role == speaker, F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n"))))


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, turn, role, chat_role, name, rendered, char_start,
    char_end, train_start, train_end (null unless the speaker's own turn)."""
    said = turns.select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
        F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANK)).alias("body"))
    people = (said.where(F.col("role") != SYSTEM).groupBy("conv_id", "role").count()
              .select(F.col("conv_id").alias("_c"), F.col("role").alias("speaker")))
    views = said.join(people, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    own = F.col("role") == F.col("speaker")
    views = views.withColumn("rendered", F.concat(
        _head(F.col("role"), F.col("speaker")), F.col("body"), F.lit("<|end|>\n")))
    # offsets in two steps: blocks of turns first, then the turns of a block
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("long")
    views = views.withColumns({"_b": block, "_n": F.length("rendered").cast("long")})
    per = (views.groupBy("conv_id", "speaker", "_b").agg(F.sum("_n").alias("_n"))
           .select(F.col("conv_id").alias("_c"), F.col("speaker").alias("_s"),
                   F.col("_b").alias("_bb"),
                   (F.sum("_n").over(Window.partitionBy("conv_id", "speaker").orderBy("_b"))
                    - F.col("_n")).alias("_before")))
    inside = (Window.partitionBy("conv_id", "speaker", "_b").orderBy("turn", "role", "body")
              .rowsBetween(Window.unboundedPreceding, 0))
    end = F.col("_before") + F.col("_upto")
    head = F.length(_head(F.col("role"), F.col("speaker")))
    return (views.withColumn("_upto", F.sum("_n").over(inside))
            .join(per, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("speaker") == F.col("_s"))
                  & (F.col("_b") == F.col("_bb")))
            .select("conv_id", "speaker", "turn", "role",
                    F.when(F.col("role") == SYSTEM, SYSTEM).when(own, "assistant")
                    .otherwise("user").alias("chat_role"),
                    F.when((F.col("role") != SYSTEM) & ~own, F.col("role")).alias("name"),
                    "rendered", (end - F.col("_n")).alias("char_start"), end.alias("char_end"),
                    F.when(own, end - F.col("_n") + head).alias("train_start"),
                    F.when(own, end - 1).alias("train_end")))


def assembled(rows: DataFrame) -> DataFrame:
    """conv_id, speaker, text and mask spans; a conversation must fit a row."""
    packed = F.array_sort(F.collect_list(F.struct("char_start", "rendered", "train_start",
                                                  "train_end")))
    spans = F.transform(F.filter("p", lambda x: x["train_start"].isNotNull()),
                        lambda x: F.struct(x["train_start"].alias("start"),
                                           x["train_end"].alias("end")))
    return (rows.groupBy("conv_id", "speaker").agg(packed.alias("p"))
            .select("conv_id", "speaker", F.array_join("p.rendered", "").alias("text"),
                    spans.alias("trained")))
