"""Chat formatting with Spark expressions only.

A conversation becomes one string: ``<s>`` and a block for each run of turns of one role. A block is
``<|turn:ROLE|>\\n``, the texts of its turns with ``\\n<|next|>\\n`` between them, and ``\\n<|end|>\\n``. Inside texts,
every control string (the marks above, and ``<s> </s> [INST] [/INST]``) gets a backslash before it and before the
backslashes that already stand there; taking one away restores the text. In roles, ``% | < >`` and line ends are
percent-encoded. So the marks of the template never occur in a text, and formatting is reversible.

Turns are sorted by (turn, role, text), which also orders ties; repeated rows stay. A null text or role counts as
empty, a null conv_id is a conversation of its own. Adjacent turns of one role share a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(\\*)(</?s>|\[/?INST\]|<\|[^|<>]*\|>)"
BOS, OPEN, OPENED, NEXT, END = "<s>", "<|turn:", "|>\n", "\n<|next|>\n", "\n<|end|>\n"
ROLE_CODES = (("%", "%25"), ("|", "%7C"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A"), ("\r", "%0D"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1$2")


def role_code(role: Column) -> Column:
    for raw, code in ROLE_CODES:
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def role_text(code: Column) -> Column:
    for raw, c in reversed(ROLE_CODES):
        code = F.replace(code, F.lit(c), F.lit(raw))
    return code


def format_chats(turns: DataFrame, learned_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """From rows (conv_id, turn, role, text) to one row (conv_id, formatted, segments) per conversation.

    ``segments``: array of (text, loss), whose texts joined are ``formatted``; loss marks the texts of ``learned_roles``
    and nothing of the template. Columns besides the four are ignored. Rows without conv_id are one conversation, repeated rows
    stay, and an empty table gives an empty table.
    """
    sorted_turns = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns")
    )
    # turns are merged into blocks as slices between the places where the role changes: nothing is copied twice
    firsts = F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 or turns[i].role != turns[i - 1].role)")
    blocks = F.expr(
        "transform(firsts, (f, k) -> struct(turns[f].role as role, slice(turns, f + 1, (case when k + 1 < size(firsts) then firsts[k + 1] else size(turns) end) - f) as run))"
    )

    def segment(text, loss) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_block(b: Column) -> Column:
        learned = b["role"].isin(*learned_roles)
        texts = F.transform(
            b["run"],
            lambda t, i: F.array(segment(F.when(i > 0, F.lit(NEXT)).otherwise(F.concat(F.lit(OPEN), role_code(b["role"]), F.lit(OPENED))), F.lit(False)), segment(escaped(t["text"]), learned)),
        )
        return F.concat(F.flatten(texts), F.array(segment(F.lit(END), F.lit(False))))

    made = sorted_turns.withColumn("firsts", firsts).withColumn("blocks", blocks)
    made = made.withColumn("segments", F.concat(F.array(segment(F.lit(BOS), F.lit(False))), F.flatten(F.transform("blocks", of_block))))
    return made.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text), one per row that went in."""
    body = F.substring(formatted, F.lit(len(BOS) + 1), F.length(formatted))
    blocks = F.split(body, r"\Q" + END + r"\E", -1)
    blocks = F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0)))

    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = role_text(F.substring(head, F.lit(len(OPEN) + 1), F.length(head) - F.lit(len(OPEN) + 2)))
        rest = F.substring(block, F.length(head) + 2, F.length(block))
        return F.transform(F.split(rest, r"\Q" + NEXT + r"\E", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))
