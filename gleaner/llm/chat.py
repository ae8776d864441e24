"""Chat formatting: prefix-target expansion with a reversible template.

Every turn is written as ``<s>[ROLE]role[/ROLE]text</s>``. Control strings inside a role or a text get a
backslash after their first character and backslashes are doubled, so a formatted conversation can always be
split at ``</s>`` and read back. Each trainable turn becomes one example whose context is the formatted prefix
before it; the context is kept as a length into the conversation, because writing every prefix out grows with
the square of a conversation. ``materialize`` writes the prefixes for those who want them.

Defined results: null role or text counts as empty; a null turn sorts first; rows with equal turn sort by role,
then text; a null conv_id is a conversation of its own; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings.
TURN_OPEN, TURN_CLOSE = "<s>", "</s>"
ROLE_OPEN, ROLE_CLOSE = "[ROLE]", "[/ROLE]"
CONTROL = r"(<|\[)(/?(?:s>|INST\]|ROLE\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row a turn: conv_id, seq (from 0), role, head, body, context_chars (formatted text before the turn)."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.select(
        "*",
        F.concat(F.lit(TURN_OPEN + ROLE_OPEN), escape(F.col("role")), F.lit(ROLE_CLOSE)).alias("head"),
        escape(F.col("text")).alias("body"),
    ).withColumn("piece_chars", (F.length("head") + F.length("body") + len(TURN_CLOSE)).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("seq"),
        "role",
        "head",
        "body",
        F.coalesce(F.sum("piece_chars").over(before), F.lit(0)).alias("context_chars"),
    )


def format_conversations(conversations: DataFrame, trainable: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv_id, formatted, examples (seq, context_chars, loss_start, loss_end).

    The four numbers of an example are the turn, the length of its context and the half-open span of its only
    trainable text, in characters of ``formatted``.
    """
    loss_start = F.col("context_chars") + F.length("head")
    example = F.struct("seq", "context_chars", loss_start.alias("loss_start"), (loss_start + F.length("body")).alias("loss_end"))
    piece = F.struct("seq", F.concat("head", "body", F.lit(TURN_CLOSE)).alias("piece"))
    return (
        format_turns(conversations)
        .groupBy("conv_id")
        .agg(
            F.array_sort(F.collect_list(piece)).alias("pieces"),
            F.array_sort(F.collect_list(F.when(F.col("role").isin(*trainable), example))).alias("examples"),
        )
        .select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "examples")
    )


def _part(start: Column, end: Column) -> Column:
    return F.substring(F.col("formatted"), (start + 1).cast("int"), (end - start).cast("int"))


def expand_targets(formatted: DataFrame, materialize: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One row a trainable turn: conv_id, seq, context_chars, loss_start, loss_end, target; with materialize also context.

    With columns to keep, a conversation without a trainable turn keeps one row of nulls beside them. A context that does
    not end where its turn begins is an error.
    """
    explode = F.explode_outer if keep else F.explode
    out = formatted.select("conv_id", *keep, "formatted", explode("examples").alias("e")).select("conv_id", *keep, "formatted", "e.*")
    start = F.col("context_chars")
    ends = (start == 0) | (_part(start - len(TURN_CLOSE), start) == TURN_CLOSE)
    opens = _part(start, start + len(TURN_OPEN + ROLE_OPEN)) == TURN_OPEN + ROLE_OPEN
    target = F.when(ends & opens, _part(F.col("loss_start"), F.col("loss_end"))).when(start.isNotNull(), F.raise_error(F.lit("a context ends inside a turn")))
    context = [_part(F.lit(0), start).alias("context")] if materialize else []
    return out.select("conv_id", *keep, "seq", "context_chars", "loss_start", "loss_end", target.alias("target"), *context)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns read from the formatted text: conv_id, turns (role, text), formatted, examples."""
    pieces = F.split(F.col("formatted"), TURN_CLOSE)
    inner = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, len(TURN_OPEN + ROLE_OPEN) + 1, F.length(p)))
    parts = F.transform(inner, lambda p: F.split(p, r"\[/ROLE\]", 2))
    turn = lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text"))
    return formatted.select("conv_id", "formatted", "examples", F.transform(parts, turn).alias("turns"))


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of format_conversations' rows: the turns read back, and the targets of the expanded examples."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = [F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars")]
    keep = ["n_turns", "turns_sha256", "formatted_chars"]
    examples = expand_targets(read_back(formatted).select("conv_id", "formatted", "examples", *whole), keep=keep)
    # Spark leaves nulls out of the list, so a conversation without examples has an empty one.
    target = F.when(F.col("seq").isNotNull(), F.struct("seq", unescape(F.col("target")).alias("text")))
    told = examples.groupBy("conv_id", *keep).agg(F.array_sort(F.collect_list(target)).alias("targets"))
    loss = F.array_join(F.col("targets.text"), "")
    return told.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
