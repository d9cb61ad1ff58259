r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Each assistant turn becomes an example: all turns before it are its context, and only its reply
is trainable. Turns after the last assistant turn make one more example without a target, so
nothing is lost. A turn is rendered as

    assistant   <s> text </s>
    user        [INST] text [/INST]
    system      <<SYS>> text <</SYS>>
    any other   [TURN] role\ntext [/TURN]

and turns follow each other without a separator. Inside texts and roles a backslash becomes
``\s`` and the first character of a control string becomes ``\l`` (for <) or ``\b`` (for [), so
no control string is left, and the reverse replacements restore every text; a line end inside a
role becomes ``\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
CONTROLS = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[TURN]", "[/TURN]"]
OPEN = {"assistant": "<s> ", "user": "[INST] ", "system": "<<SYS>> ", None: "[TURN] "}
CLOSE = {"assistant": " </s>", "user": " [/INST]", "system": " <</SYS>>", None: " [/TURN]"}
_TURN = r"(?s)<s> .*? </s>|\[INST\] .*? \[/INST\]|<<SYS>> .*? <</SYS>>|\[TURN\] .*? \[/TURN\]"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(("\\l" if control[0] == "<" else "\\b") + control[1:]))
    return out


def unescape(text: Column) -> Column:
    for mark, plain in (("\\l", "<"), ("\\b", "["), ("\\s", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def _by_role(role: Column, parts: dict) -> Column:
    out = None
    for name in ("assistant", "user", "system"):
        out = F.when(role == name, F.lit(parts[name])) if out is None else out.when(role == name, F.lit(parts[name]))
    return out.otherwise(F.lit(parts[None]))


def render(role: Column, text: Column) -> Column:
    """One turn in the template; null roles and texts are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    named = F.when(role.isin("assistant", "user", "system"), F.lit("")).otherwise(F.concat(F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n")))
    return F.concat(_by_role(role, OPEN), named, escape(text), _by_role(role, CLOSE))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Training examples: (conv, example, formatted, loss_start, loss_length, last).

    example counts from 0 within a conversation; loss_start and loss_length give the trainable
    characters of formatted (code points, from 0; length 0: nothing is trainable); last marks the
    example that holds every turn of its conversation. Rows of one conversation are ordered by
    turn, then role, then text, nulls first; repeated rows are turns of their own; null texts and
    roles are empty; a null conversation id is a conversation; an empty table gives no rows;
    other columns are not read. A conversation must fit one row, as its examples do.
    """
    one = F.struct(F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.col(text_col).alias("x"))
    chats = turns.groupBy(F.col(conv_col).alias("_c")).agg(F.sort_array(F.collect_list(one)).alias("_turns"))
    chats = chats.select("_c", F.transform("_turns", lambda t: F.struct((F.coalesce(t["r"], F.lit("")) == "assistant").alias("a"), render(t["r"], t["x"]).alias("x"))).alias("_turns"))
    n = F.size("_turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("_turns", i)["a"] | (i == n))
    examples = chats.select("_c", "_turns", F.posexplode(ends).alias("example", "_end"))
    body = F.array_join(F.transform(F.slice("_turns", F.lit(1), F.col("_end")), lambda t: t["x"]), "")
    examples = examples.select("_c", "example", body.alias("formatted"), F.element_at("_turns", F.col("_end")).alias("_target"), (F.col("_end") == n).alias("last"))
    opening, closing = len(OPEN["assistant"]), len(CLOSE["assistant"])
    start = F.length("formatted") - F.length("_target.x") + opening
    return examples.select(
        F.col("_c").alias(conv_col), "example", "formatted",
        F.when(F.col("_target.a"), start).otherwise(F.length("formatted")).alias("loss_start"),
        F.when(F.col("_target.a"), F.length("_target.x") - opening - closing).otherwise(0).alias("loss_length"),
        "last",
    )


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(formatted, start + 1, length))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>."""
    found = F.regexp_extract_all(formatted, F.lit(_TURN), 0)

    def turn(x: Column) -> Column:
        kinds = [(name, OPEN[name], CLOSE[name]) for name in ("assistant", "user", "system")]
        out = None
        for name, opening, closing in kinds:
            one = F.struct(F.lit(name).alias("role"), unescape(F.substring(x, F.lit(len(opening) + 1), F.length(x) - len(opening) - len(closing))).alias("text"))
            out = F.when(F.startswith(x, F.lit(opening)), one) if out is None else out.when(F.startswith(x, F.lit(opening)), one)
        inner = F.substring(x, F.lit(len(OPEN[None]) + 1), F.length(x) - len(OPEN[None]) - len(CLOSE[None]))
        cut = F.instr(inner, "\n")
        return out.otherwise(F.struct(unescape(F.replace(F.substring(inner, F.lit(1), cut - 1), F.lit("\\n"), F.lit("\n"))).alias("role"), unescape(F.substring(inner, cut + 1, F.length(inner))).alias("text")))

    return F.transform(found, turn)


def chat_digests(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its examples: (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    turns = F.when(F.col("last"), read_back(F.col("formatted")))
    each = examples.select(
        F.col(conv_col).alias("_c"), "example",
        F.length("formatted").cast("long").alias("_chars"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("_loss"),
        turns.alias("_turns"),
    )
    each = each.select("_c", "example", "_chars", "_loss", F.size("_turns").alias("_n"), F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("_sha"))
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "_loss"))), lambda x: x["_loss"]), "")
    out = each.groupBy("_c").agg(F.max("_n").alias("n_turns"), F.max("_sha").alias("turns_sha256"), loss.alias("_loss"), F.sum("_chars").alias("formatted_chars"))
    return out.select(F.col("_c").alias(conv_col), F.col("n_turns").cast("long").alias("n_turns"), "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
