r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one training example: its context is the formatted text of all turns before it,
its target is that reply, and only the target carries loss. A conversation that ends with other turns gives one
more example without a target, so that every turn is part of some output.

A turn is written ``<|start|>role\ntext<|end|>\n``. Inside roles and texts a backslash becomes ``\0``, ``<``
becomes ``\1``, ``[`` becomes ``\2`` and, in roles, a line feed ``\3``. So neither the marks of this
template nor ``</s>``, ``[INST]`` and the like, which all begin with ``<`` or ``[``, can come from a text, and
``unescaped`` gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|start|>", "<|end|>\n"
_CODES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2")]
_ROLE_CODES = [*_CODES, ("\n", "\\3")]


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column) -> Column:
    return _replaced(F.coalesce(text, F.lit("")), _CODES)


def unescaped(text: Column) -> Column:
    """Every backslash of an escaped text begins a code, so codes can be undone one after the other, ``\\0`` last."""
    return _replaced(text, [(new, old) for old, new in reversed(_CODES)])


def unescaped_role(role: Column) -> Column:
    return _replaced(role, [(new, old) for old, new in reversed(_ROLE_CODES)])


def conversation_turns(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(id, heads, bodies): the written head ``<|start|>role\\n`` and body ``text<|end|>\\n`` of each turn, in turn order.

    Turns are ordered by (turn, role, text), nulls first; repeated rows stay. Null roles and texts are empty.
    """
    head = F.concat(
        F.lit(START), _replaced(F.coalesce(F.col(role_col), F.lit("")), _ROLE_CODES), F.lit("\n")
    )
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"),
        head.alias("head"), F.concat(escaped(F.col(text_col)), F.lit(END)).alias("body"),
    )
    grouped = rows.groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    return grouped.select(
        F.col("_id").alias(id_col), F.col("_turns.head").alias("heads"), F.col("_turns.body").alias("bodies")
    )


def prefix_examples(turns: DataFrame, id_col: str = "conv_id", assistant: str = "assistant") -> DataFrame:
    """(id, example, target_turn, context, target, closing): one row per assistant turn, and one for a tail without a reply.

    ``context`` ends with the head of the reply; ``target`` is its body and is null in the closing row of a
    conversation that ends with other turns. ``closing`` marks the example that holds all turns. ``example`` counts from 0 in turn order. A row is built when its
    index was exploded, so memory holds one conversation and one example at a time.
    """
    reply = F.lit(f"{START}{assistant}\n")
    size = F.size("heads")
    spots = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.get("heads", i) == reply)
    ends = F.when(F.get("heads", size - 1) == reply, spots).otherwise(F.concat(spots, F.array(size)))
    written = F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b))
    spread = turns.withColumn("_written", written).select(
        id_col, "heads", "bodies", "_written", F.posexplode(ends).alias("example", "target_turn")
    )
    before = F.array_join(F.slice("_written", F.lit(1), F.col("target_turn")), "")
    return spread.select(
        id_col,
        "example",
        "target_turn",
        F.concat(before, F.coalesce(F.get("heads", F.col("target_turn")), F.lit(""))).alias("context"),
        F.get("bodies", F.col("target_turn")).alias("target"),
        (F.col("target_turn") >= F.size("heads") - 1).alias("closing"),
    )


def read_turns(written: Column) -> Column:
    """The (role, text) turns of a formatted text."""
    pieces = F.split(F.substring(written, len(START) + 1, 2_147_483_647), _quoted(END + START))
    inner = F.transform(pieces, lambda p: F.struct(
        unescaped_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescaped(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.lit(2_147_483_647))).alias("text"),
    ))
    return inner


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def read_back(examples: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all taken from the written examples.

    The turns are those of a conversation's closing example, which holds all of them. The loss text is the
    unescaped text of all targets in order. ``formatted_chars`` adds up the code points of all examples.
    Only targets and one digest row per conversation are shuffled, not the contexts.
    """
    reply = unescaped(F.substring(F.col("target"), F.lit(1), F.length("target") - len(END)))
    whole = F.concat("context", F.coalesce("target", F.lit("")))
    turns = read_turns(F.substring(whole, F.lit(1), F.length(whole) - len(END)))
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = examples.select(
        id_col, "example", F.length(whole).alias("chars"),
        F.when(F.col("closing"), turns).alias("_turns"),
        F.when(F.col("target").isNotNull(), F.struct("example", reply.alias("text"))).alias("loss"),
    ).select(
        id_col, "chars", "loss", F.size("_turns").cast("long").alias("turns"),
        F.when(F.col("_turns").isNotNull(), F.sha2(told, 256)).alias("digest"),
    )
    per = rows.groupBy(id_col).agg(
        F.max("turns").alias("n_turns"),
        F.max("digest").alias("turns_sha256"),
        F.array_join(F.sort_array(F.collect_list("loss"))["text"], "").alias("_loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return per.select(
        id_col,
        "n_turns",
        "turns_sha256",
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
