"""Conversations as training text with a loss mask, in Spark expressions only.

Turns are collected and sorted by ``turn``; neighbouring turns of one role become one block. A block is

    <|im_start|>role <line end> text <|part|> text ... <|im_end|> <line end>

Control strings inside roles and texts are escaped by a backslash after their first character, one more if some are there
already, so that no text can end a turn, and reading back gives every text as it was. This holds for the control strings above
(all begin with ``<|``) and for those of other common templates (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``).

The loss mask is a list of spans (first character, number of characters) of the formatted text: the texts of the assistant,
without the marks around and between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
START, PART, END = "<|im_start|>", "<|part|>", "<|im_end|>\n"
PLAIN = r"(<|\[)(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"(<|\[)\\(\\*)(\||/?s>|/?INST\])"
TRAINED = "assistant"
SPANS = "array<struct<first:bigint,length:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role ends with its line, so its line ends and backslashes are escaped first."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    halves = F.transform(F.split(unescape(role), r"\\\\", -1), lambda half: F.replace(half, F.lit("\\n"), F.lit("\n")))
    return F.array_join(halves, "\\")


def merge_turns(turns: Column) -> Column:
    """Sorted turns (``role``, ``text``) to blocks: places where the role changes, then the turns between two such places.

    Both steps look at each turn once, so a long conversation costs no more per turn than a short one.
    """
    places = F.sequence(F.lit(0), F.size(turns) - 1)
    begins = F.filter(places, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(F.size(turns)))
    block = lambda begin, end: F.struct(
        F.get(turns, begin)["role"].alias("role"),
        F.transform(F.slice(turns, begin + 1, end - begin), lambda t: t["text"]).alias("texts"),
    )
    return F.when(F.size(turns) > 0, F.zip_with(begins, ends, block))


def formatted(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and the loss mask ``spans``.

    NULL texts and roles are empty. Turns with the same number go by role, then text; a NULL turn comes first; repeated rows
    are turns of their own. Rows without a ``conv_id`` are one conversation.
    """
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("row"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    escaped = F.transform(
        "turns", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"))
    )
    blocks = turns.select("conv_id", escaped.alias("turns")).select("conv_id", merge_turns(F.col("turns")).alias("blocks"))
    head = lambda b: F.concat(F.lit(START), b["role"], F.lit("\n"))
    whole = F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], PART), F.lit(END)))
    # The pieces of the formatted text in order: marks without, assistant texts with loss.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(F.struct(F.length(head(b)).alias("length"), F.lit(False).alias("loss"))),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t, i: F.array(
                            F.struct(F.when(i > 0, len(PART)).otherwise(0).alias("length"), F.lit(False).alias("loss")),
                            F.struct(F.length(t).alias("length"), (b["role"] == TRAINED).alias("loss")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(len(END)).alias("length"), F.lit(False).alias("loss"))),
            ),
        )
    )
    return blocks.select("conv_id", F.array_join(whole, "").alias("formatted"), pieces.alias("pieces")).select(
        "conv_id", "formatted", _spans(F.col("pieces")).alias("spans")
    )


def _spans(pieces: Column) -> Column:
    """Pieces in order to the spans of those with loss."""
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("spans"))

    def add(so_far: Column, piece: Column) -> Column:
        span = F.struct(so_far["at"].alias("first"), piece["length"].cast("bigint").alias("length"))
        spans = F.when(piece["loss"], F.concat(so_far["spans"], F.array(span))).otherwise(so_far["spans"])
        return F.struct((so_far["at"] + piece["length"]).alias("at"), spans.alias("spans"))

    return F.aggregate(pieces, state, add, lambda end: end["spans"])


def read_turns(text: str | Column) -> Column:
    """A formatted text back to its turns: an array of ``role`` and ``text``."""
    text = F.col(text) if isinstance(text, str) else text
    blocks = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        line_end = F.locate("\n", block)
        role = unescape_role(F.substring(block, F.lit(len(START) + 1), line_end - len(START) - 1))
        texts = F.split(F.substring(block, line_end + 1, F.length(block)), r"<\|part\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(text: str, spans: str) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(
        spans,
        lambda s: unescape(F.substring(F.col(text), (s["first"] + 1).cast("int"), s["length"].cast("int"))),
    )
