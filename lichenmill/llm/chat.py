"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: the whole text of all turns before it as context
and its reply, which alone is trainable. A conversation of n turns is written out once for each of its
replies, so the examples' size grows with n times the replies; only one example is held at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import own_names

#: The template: start role separator text end.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """No control string is left: backslashes are doubled, then ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undoes ``escape``: between ``<`` and ``|`` a single backslash stands only where it was put in."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_examples(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), trainable, text, loss_start, loss_length (code points of the reply, escaped, in the text).

    Each trained turn is an example that begins with the conversation's first turn and ends with that
    turn. Turns after the last trained reply, or a conversation without one, are a last example that is
    not trainable: the whole conversation with an empty mask, so that no turn is lost. Turns follow by
    turn (null first), ties by role, then text. A null text or role is empty. Rows of null conv_id belong
    to no conversation that could order them: each is a conversation of its own, with a null conv_id.
    Repeated rows are turns of their own; extra columns are ignored; no rows give no examples.
    """
    rows = own_names(
        conversations,
        conv_id=F.col("conv_id").cast("long"),
        turn=F.col("turn"),
        role=F.coalesce(F.col("role"), F.lit("")),
        text=F.coalesce(F.col("text"), F.lit("")),
    )
    # null conv_ids are spread over keys of their own, so that they are no hot group
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE))
    said = F.struct(
        "turn",
        F.col("role").alias("said_by"),
        F.col("text").alias("raw"),
        F.concat(head, escape(F.col("text")), F.lit(END)).alias("segment"),
        F.length(escape(F.col("text"))).alias("size"),
    )
    whole = rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list(said)).alias("turns"))
    segments = whole.select(
        "conv_id",
        F.transform("turns", lambda x: x["segment"]).alias("segments"),
        F.transform("turns", lambda x: x["size"]).alias("sizes"),
        F.filter(F.transform("turns", lambda x, i: F.when(x["said_by"] == trained_role, i)), lambda i: i.isNotNull()).alias("targets"),
    )
    last = F.size("segments") - 1
    rest = F.when(F.coalesce(F.array_max("targets"), F.lit(-1)) < last, F.array(last)).otherwise(F.array().cast("array<int>"))
    each = segments.select("conv_id", "segments", "sizes", F.size("targets").alias("n"), F.posexplode(F.concat("targets", rest)).alias("example", "upto"))
    size = F.get("sizes", F.col("upto"))
    made = each.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        (F.col("example") < F.col("n")).alias("trainable"),
        F.array_join(F.slice("segments", F.lit(1), F.col("upto") + 1), "").alias("text"),
        size.alias("size"),
    )
    return made.select(
        "conv_id",
        "example",
        "trainable",
        "text",
        F.when(F.col("trainable"), F.length("text") - len(END) - F.col("size")).cast("long").alias("loss_start"),
        F.when(F.col("trainable"), F.col("size")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, read from the examples' texts and masks alone.

    The last example holds all turns. Every other one must be how the last one begins, or an error is raised.
    formatted_chars counts all examples' texts. Examples of null conv_id are read one by one.
    """
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    masked = unescape(F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int")))
    parsed = examples.select(
        "conv_id",
        alone.alias("alone"),
        "example",
        "text",
        F.length("text").alias("chars"),
        F.struct("example", F.length("text").alias("chars"), F.xxhash64("text").alias("hash"), F.when(F.col("trainable"), masked).otherwise(F.lit("")).alias("loss")).alias("part"),
        "trainable",
    )
    joined = parsed.groupBy("conv_id", "alone").agg(
        F.max_by("text", "example").alias("whole"),
        F.array_sort(F.collect_list("part")).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
        F.count_if("trainable").alias("n_examples"),
    )
    begins = F.forall("parts", lambda x: F.xxhash64(F.substring(F.col("whole"), F.lit(1), x["chars"])) == x["hash"])
    turns = F.filter(F.split("whole", F.lit(r"<\|im_start\|>")), lambda x: F.length(x) > 0)
    role = lambda x: F.substring_index(x, MIDDLE, 1)
    body = lambda x: F.substring_index(F.substring_index(x, MIDDLE, -1), END, 1)
    said = F.transform(turns, lambda x: F.concat(unescape(role(x)), F.lit("\n"), unescape(body(x)), F.lit("\n")))
    said_all = F.when(begins, F.array_join(said, "")).otherwise(F.raise_error(F.lit("an example's context is not how its conversation begins")))
    loss_all = F.array_join(F.transform("parts", lambda x: x["loss"]), "")
    return joined.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said_all, 256).alias("turns_sha256"),
        F.length(loss_all).cast("long").alias("loss_chars"),
        F.sha2(loss_all, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
