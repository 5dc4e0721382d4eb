r"""Operator 10: chat formatting from event logs, in DataFrame functions only.

A conversation is a log of events with a sequence number.  Events name a message
and either ``start`` it (role, text), add a ``delta`` of text, ``edit`` it (the
text so far is replaced), ``regenerate`` it (the same, and every later message
goes), or ``delete`` it.  Folding keeps, for every message, the texts since its
last reset in order of sequence.

Rendering: ``<|im_start|>role\ntext<|im_end|>\n`` per message.  In texts and roles
a backslash goes into every ``<\...\|``, so no control string can appear in them
and the backslash can be taken out again; in roles ``%`` and line ends are
percent-coded as well, since the first line end closes the role.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def fold(events: DataFrame) -> DataFrame:
    """Events (conv_id, message, seq, kind, role, text) to messages (conv_id, message, role, text).

    Null texts and roles count as empty; an unknown or null kind counts as
    ``delta``.  Events of a message with the same seq apply in order of kind,
    then text.  A message whose first event is no ``start`` has an empty role.
    """
    e = events.select("conv_id", "message", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = e.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))).alias("log"),
        F.max(F.when(F.col("kind").isin("start", "edit", "regenerate", "delete"), F.struct("seq", "kind", "text"))).alias("reset"),
        F.min(F.when(F.col("kind") == "start", F.struct("seq", "role"))).alias("started"),
        F.min("seq").alias("begun"),
    )
    kept = F.filter("log", lambda x: F.col("reset").isNull() | (x >= F.col("reset")))
    text = F.array_join(F.transform(kept, lambda x: x.text), "")
    messages = log.select("conv_id", "message", F.coalesce("started.role", F.lit("")).alias("role"), text.alias("text"), F.col("reset.kind").alias("last"), "begun")
    # a message goes if an earlier one was regenerated after it began
    cuts = e.where("kind = 'regenerate'").groupBy(F.col("conv_id").alias("cut_id")).agg(F.collect_list(F.struct("message", "seq")).alias("cuts"))
    live = messages.join(cuts, F.col("conv_id").eqNullSafe(F.col("cut_id")), "left")
    gone = F.exists("cuts", lambda c: (c.message < F.col("message")) & (c.seq > F.col("begun")))
    return live.where((F.coalesce("last", F.lit("")) != "delete") & ~F.coalesce(gone, F.lit(False))).select("conv_id", "message", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted) from (conv_id, message, role, text), messages in order."""
    one = F.struct("message", F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END + "\n")).alias("turn"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t.turn), "").alias("formatted"))


def parse(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text, at, length>>) read back from the output.

    ``at`` and ``length`` are the characters of the escaped text inside the
    output, so they are the spans that a loss mask covers for trained roles.
    """
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    lengths = F.transform(parts, lambda p: F.length(p) + F.lit(len(START)))

    def turn(p: Column, before: Column) -> Column:
        head = F.length(F.substring_index(p, "\n", 1))
        size = F.length(p) - head - 1 - len(END) - 1
        return F.struct(_role_in(F.substring(p, F.lit(1), head)).alias("role"), unescaped(F.substring(p, head + 2, size)).alias("text"), (before + len(START) + head + 1).cast("int").alias("at"), size.alias("length"))

    return formatted.withColumn("turns", F.zip_with(parts, sums_before(lengths), turn))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, not once for each element that looks at it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sums_before(lengths: Column, block: int = 256) -> Column:
    """For every element the sum of all before it, by blocks: no array grows element by element."""
    plus = lambda a, x: a + x
    total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), plus)

    def spread(own: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(own) - 1, F.lit(0)) / block).cast("int"))
        sums = F.transform(blocks, lambda b: total(F.slice(own, b * block + 1, F.lit(block))))
        before = lambda s: F.transform(blocks, lambda b: total(F.slice(s, F.lit(1), b)))
        place = lambda i: F.floor(i / block).cast("int")
        return _let(_let(sums, before), lambda s: F.transform(own, lambda x, i: F.element_at(s, place(i) + 1) + total(F.slice(own, place(i) * block + 1, F.pmod(i, F.lit(block))))))

    return _let(lengths, spread)


def with_loss_mask(parsed: DataFrame, role: str = TRAINED_ROLE) -> DataFrame:
    """Adds ``loss_spans``: (at, length) of the texts that are trained on."""
    trained = F.filter("turns", lambda t: t.role == role)
    return parsed.withColumn("loss_spans", F.transform(trained, lambda t: F.struct(t.at.alias("at"), t.length.alias("length"))))


def events_of_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a streamed log: a start and a delta per row.

    Rows of a conversation are numbered by turn, then role, then text, so rows
    that repeat a turn remain messages of their own.
    """
    from pyspark.sql import Window

    text = F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), text)
    rows = turns.select("conv_id", F.row_number().over(order).alias("message"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    first = F.struct((2 * F.col("message")).alias("seq"), F.lit("start").alias("kind"), F.col("text").substr(F.lit(1), half).alias("part"))
    rest = F.struct((2 * F.col("message") + 1).alias("seq"), F.lit("delta").alias("kind"), F.col("text").substr(half + 1, F.length("text")).alias("part"))
    events = rows.select("conv_id", "message", "role", F.explode(F.array(first, rest)).alias("e"))
    return events.select("conv_id", "message", "e.seq", "e.kind", "role", F.col("e.part").alias("text"))
