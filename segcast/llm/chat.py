"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns are written with control strings around role and text; control strings inside a role
or text are broken by a backslash, and backslashes doubled, so texts can be restored and a
marker in the output is always one of the template's.

Prefix sums of turn tokens cut a conversation into turn-aligned spans of the budget that
the system turn and the history leave: turns wholly between two multiples of that room form a
span, and a turn across a multiple is a span of its own.  A window holds a span; it begins with the system turn, if
the span does not hold it itself, and with the turns just before the span that fit into
``history_tokens``.  Repeated turns have a marker of their own and stand outside the loss mask, so each
assistant text is under the mask exactly once.  The mask is a list of character spans.

Tokens are estimated as a quarter of the UTF-8 bytes written, markers and escapes included.  Turns
are never cut: a window passes the budget only when its system turn or the one turn of its span is
longer than the room there is for it.

Defined cases: null text or role counts as empty; turns are ordered by turn, role and text, a
null turn first, so repeated rows are turns of their own; a null conv_id is a conversation
of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET_TOKENS, HISTORY_TOKENS, BYTES_PER_TOKEN = 1024, 256, 4
BEGIN, TURN, REPEATED, TEXT, END = "<s>", "<|im_start|>", "<|im_repeat|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of common templates, this one's among them, without their first character.
_AFTER_ANGLE = r"/?s>|/?</?SYS>>|</?SYS>>|/?unk>|/?pad>|\|(?:im_start|im_repeat|im_sep|im_end|endoftext|startoftext|system|user|assistant|end)\|>"
_AFTER_SQUARE = r"/?INST\]"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"(<(?={_AFTER_ANGLE})|\[(?={_AFTER_SQUARE}))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def turn_tokens(role: Column, text: Column) -> Column:
    """An estimate without a tokenizer: four bytes a token of all that is written for the turn."""
    written = F.octet_length(escape(role)) + F.octet_length(escape(text)) + len(REPEATED + TEXT + END)
    return F.ceil(written / BYTES_PER_TOKEN).cast("long")


def _turns(conversations: DataFrame, budget: int, history: int) -> DataFrame:
    """Each turn with its place, its prefix sum of tokens and its span."""
    base = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    whole = Window.partitionBy("conv_id")
    base = base.withColumn("place", F.row_number().over(order)).withColumn("tokens", turn_tokens(F.col("role"), F.col("text")))
    base = base.withColumn("is_system", (F.col("place") == 1) & (F.col("role") == "system"))
    counted = F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("tokens"))  # the system turn is in every window
    placed = Window.partitionBy("conv_id").orderBy("place")
    reserved = F.max(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(whole)
    base = base.withColumn("before", F.sum(counted).over(placed) - counted)
    begin = math.ceil(len(BEGIN) / BYTES_PER_TOKEN)
    room = F.greatest(F.lit(1), F.lit(budget - history - begin) - reserved)
    cell = F.floor(F.col("before") / room)
    across = (F.col("before") % room != 0) & (F.floor((F.col("before") + counted - 1) / room) > cell)
    return base.withColumn("span", 2 * cell + across.cast("long"))


def format_conversations(conversations: DataFrame, budget: int = BUDGET_TOKENS, history: int = HISTORY_TOKENS) -> DataFrame:
    """(conv_id, window, formatted, loss_spans): loss_spans are structs (start, length) of characters, from 0."""
    turns = _turns(conversations, budget, history)
    # a turn also goes to the later spans that start within the history's reach of it, the system turn to all
    ahead = Window.partitionBy("conv_id").orderBy("before").rangeBetween(0, history)
    later = F.collect_set("span").over(ahead)
    every = F.collect_set("span").over(Window.partitionBy("conv_id"))
    spans = F.when(F.col("is_system"), F.filter(every, lambda s: s != F.col("span"))).otherwise(
        F.filter(later, lambda s: s > F.col("span")))
    placed = turns.withColumn("spans", spans).withColumn("window", F.explode(F.concat(F.array("span"), "spans")))

    own = F.col("window") == F.col("span")
    head = F.concat(F.when(own, TURN).otherwise(REPEATED), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    pieces = placed.select("conv_id", "window", "place", head.alias("head"), body.alias("body"),
                           (own & (F.col("role") == "assistant")).alias("target"))
    written = F.length("head") + F.length("body") + len(END)
    in_window = Window.partitionBy("conv_id", "window").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(written).over(in_window), F.lit(0)) + F.length("head") + len(BEGIN)
    pieces = pieces.withColumn("start", start.cast("int"))
    row = F.struct("place", F.concat("head", "body", F.lit(END)).alias("piece"), "target", "start", F.length("body").alias("length"))
    windows = pieces.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    spans = F.transform(F.filter("rows", lambda r: r["target"]), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length")))
    return windows.select("conv_id", "window", F.concat(F.lit(BEGIN), F.array_join("rows.piece", "")).alias("formatted"),
                          spans.alias("loss_spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations restored from formatted windows: turns, their text, and the text under the loss mask."""
    def parsed(piece: Column) -> Column:
        parts = F.split(piece, rf"\Q{TEXT}\E")
        return F.concat(unescape(parts[0]), F.lit("\n"), unescape(parts[1]), F.lit("\n"))

    pieces = F.split(F.substr(F.col("formatted"), F.lit(len(BEGIN) + 1)), rf"\Q{END}\E")
    new = F.transform(F.filter(pieces, lambda p: p.startswith(TURN)), lambda p: F.substr(p, F.lit(len(TURN) + 1)))
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    per_window = windows.select("conv_id", "window", F.size(new).alias("n"), F.array_join(F.transform(new, parsed), "").alias("turns"),
                                F.array_join(masked, "").alias("loss"), F.length("formatted").alias("chars"))
    rows = F.array_sort(F.collect_list(F.struct("window", "turns", "loss")))
    found = per_window.groupBy("conv_id").agg(rows.alias("rows"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    return found.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.array_join("rows.turns", "").alias("turns"),
                        F.array_join("rows.loss", "").alias("loss"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
