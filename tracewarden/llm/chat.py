"""Chat formatting that is proven by parsing the rendered text back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The template: fixed control strings.
START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = "<|"


def escape(text: Column) -> Column:
    """Reversible: a backslash is doubled, and a control opening is broken by one."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(CONTROL), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Between doubled backslashes, the two short forms; then the doubled ones."""
    parts = F.transform(F.split(text, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def parse(rendered: Column) -> Column:
    """The turns (role, body, text) of a rendered conversation; null where the grammar is broken.

    conversation = turn*; turn = START role newline body END; neither role nor body holds a control
    opening, and the role holds no newline.
    """
    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - F.lit(len(END)))
        good = piece.endswith(END) & (F.instr(piece, "\n") < F.length(piece)) & ~F.contains(role, F.lit(CONTROL)) & ~F.contains(body, F.lit(CONTROL))
        return F.when(good, F.struct(unescape(role).alias("role"), body.alias("body"), unescape(body).alias("text")))

    pieces = F.split(rendered, r"<\|im_start\|>")
    return F.when(pieces[0] == "", F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn))


def format_chats(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One rendered text per conversation, with the spans a trainer takes its loss on.

    The project has no dialogues of its own, so this works on any table of turns. A turn is first
    rendered as it is and parsed; where the parser does not return the same turn, its text is escaped,
    which always parses back. The whole conversation is then parsed once more, and a difference from
    the source turns fails the job instead of writing it.

    Returns ``conv_id``, ``formatted`` and ``loss_spans`` (array of start, length in code points: the
    bodies of ``trained_role``). Turns are ordered by ``turn``, then role and text; null turns come
    first. Null role or text: empty. Rows with a null conversation are one conversation. Repeated rows
    are repeated turns. Other columns are ignored; an empty table gives no rows. A conversation is one
    value of the result and so is rendered in one task.
    """
    rows = turns.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def rendered(some_role: Column, body: Column) -> Column:
        return F.concat(F.lit(START), some_role, F.lit("\n"), body, F.lit(END))

    again = F.col("_parsed")
    same = (F.size(again) == 1) & again[0].isNotNull() & (again[0]["role"] == F.col("role")) & (again[0]["text"] == F.col("text"))
    rows = rows.withColumn("_parsed", parse(rendered(F.col("role"), F.col("text"))))
    rows = rows.withColumn("_plain", F.coalesce(same, F.lit(False))).drop("_parsed")
    rows = rows.withColumns({
        "_role": F.when(F.col("_plain"), F.col("role")).otherwise(escape_role(F.col("role"))),
        "_body": F.when(F.col("_plain"), F.col("text")).otherwise(escape(F.col("text"))),
    })
    order = W.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "role", "text")
    fixed = len(START) + 1 + len(END)
    length = F.length("_role") + F.length("_body") + fixed
    rows = rows.withColumns({"_i": F.row_number().over(order), "_end": F.sum(length).over(order.rowsBetween(W.unboundedPreceding, 0))})
    begin = F.col("_end") - len(END) - F.length("_body")
    one = F.struct(
        "_i", "role", "text", rendered(F.col("_role"), F.col("_body")).alias("rendered"),
        F.when(F.col("role") == trained_role, F.struct(begin.cast("long").alias("start"), F.length("_body").cast("long").alias("length"))).alias("span"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["rendered"]), ""))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    back = F.transform(parse(F.col("formatted")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    proven = F.when(F.coalesce(source == back, F.lit(False)), F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return whole.select("conv_id", proven.alias("formatted"), F.array_compact(F.transform("turns", lambda t: t["span"])).alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Digests of what the parser and the loss mask give back: ``n_turns``, ``turns_sha256`` (role,
    newline, text, newline of every turn), ``loss_chars`` and ``loss_sha256`` (the unescaped texts under
    the mask, one after the other), ``formatted_chars``."""
    read = formatted.withColumn("_turns", parse(F.col("formatted")))
    lines = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    read = read.withColumns({"_lines": lines, "_loss": F.array_join(masked, "")})
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2("_lines", 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
