"""Chat formatting: one example per assistant turn, with all turns before it as context.

A turn is written ``<s>role[INST]text[/INST]</s>``. Inside roles and texts, a backslash is
doubled and one is put after the first character of each control string, so no control string
occurs there, and the reverse is exact.
"""

from pyspark.sql import Column, DataFrame, functions as F

_OPEN, _MIDDLE, _CLOSE, _END = "<s>", "[INST]", "[/INST]", "</s>"


def escaped(text: Column) -> Column:
    """Return a text in which no control string occurs."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])(/?(?:s>|INST\]))", r"$1\\$2")


def unescaped(text: Column) -> Column:
    """Return the text that ``escaped`` was given."""
    return F.regexp_replace(text, r"\\([\\/sI])", "$1")


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """Return one row per example: ``conv_id``, ``example``, ``is_last``, ``text``, and the mask.

    Each assistant turn becomes an example: the turns before it, then itself. Only the code
    points of its text from ``loss_start``, ``loss_chars`` of them, are trainable. What a
    conversation says after its last assistant turn is in one more example, with ``loss_chars``
    0; so is a conversation without any. The longest example, ``is_last``, thus holds all turns.

    Turns are ordered by ``turn``, then role and text, nulls first; repeated rows are repeated
    turns. Null roles and texts are empty; the rows with a null ``conv_id`` are one conversation.
    Other columns are ignored. An empty table gives no rows. A conversation is gathered in one
    row, and its examples grow with the square of its turns, for such is the format.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    head = F.transform(
        "turns",
        lambda turn: F.concat(F.lit(_OPEN), escaped(turn["role"]), F.lit(_MIDDLE)),
    )
    body = F.transform("turns", lambda turn: escaped(turn["text"]))
    is_reply = F.transform("turns", lambda turn: turn["role"] == "assistant")
    # The places of the examples' last turns, counted from 1.
    ends = F.expr(
        "filter(sequence(1, size(is_reply)), k -> is_reply[k - 1] OR k = size(is_reply))"
    )
    parts = whole.select(
        "conv_id", head.alias("head"), body.alias("body"), is_reply.alias("is_reply")
    )
    parts = parts.withColumn("written", F.expr(
        f"zip_with(head, body, (h, b) -> concat(h, b, '{_CLOSE}{_END}'))"
    ))
    examples = parts.select("*", F.posexplode(ends).alias("example", "last"))
    before = F.array_join(F.slice("written", F.lit(1), F.col("last") - 1), "")
    own_head = F.element_at("head", F.col("last"))
    own_body = F.element_at("body", F.col("last"))
    is_target = F.element_at("is_reply", F.col("last"))
    return examples.select(
        "conv_id",
        "example",
        (F.col("last") == F.size("written")).alias("is_last"),
        before.alias("context"),
        own_head.alias("own_head"),
        own_body.alias("own_body"),
        is_target.alias("is_target"),
    ).select(
        "conv_id",
        "example",
        "is_last",
        F.concat("context", "own_head", "own_body", F.lit(_CLOSE + _END)).alias("text"),
        (F.length("context") + F.length("own_head")).alias("loss_start"),
        F.when(F.col("is_target"), F.length("own_body")).otherwise(0).alias("loss_chars"),
    )


def read_turns(text: Column) -> Column:
    """Return the turns of a formatted text as an array of ``role`` and ``text``."""
    ended = F.split(text, _END, -1)
    marked = F.slice(ended, F.lit(1), F.size(ended) - 1)

    def parsed(one):
        part = F.split(one, r"\[/?INST\]", -1)
        return F.struct(
            unescaped(F.substring(part[0], len(_OPEN) + 1, 2**31 - 1)).alias("role"),
            unescaped(part[1]).alias("text"),
        )

    return F.transform(marked, parsed)


def read_back(examples: DataFrame) -> DataFrame:
    """Return per conversation what its formatted examples hold, read from their text alone."""
    loss = unescaped(
        F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_chars"))
    )
    turns = F.when(F.col("is_last"), read_turns(F.col("text")))
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))),
        "",
    )
    read = examples.select(
        "conv_id", "example", loss.alias("loss"), turns.alias("turns"), F.length("text").alias("n")
    ).select(
        "conv_id",
        "n",
        F.struct("example", "loss").alias("loss"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
    )
    whole = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.array_sort(F.collect_list("loss"))["loss"], "").alias("loss"),
        F.sum("n").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    return whole.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
