"""Chat formatting with budgeted windows, in SQL functions only.

A conversation's turns are written in a template and cut into windows of at most
`budget` tokens. Prefix sums of the turns' tokens choose where windows end,
always between turns. Each window begins with the system turn, repeats up to
`history` tokens of the turns before, and goes on with new turns; the loss mask
covers the assistant's texts among the new turns only, so that each is a target
once.

The template marks a turn as `<s>role`, a line feed, the text, `</s>` and a line
feed. Control strings inside texts get a backslash after their opening sign, one
more for each that is there already, which unescape() takes away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window

from .common import F, quoted, whole_text

# The control strings of the template and of other common ones:
# <s> </s> [INST] [/INST] <<SYS>> <</SYS>>
_OPEN, _CLOSE = r"<</?|</?|\[/?", r"(?:s>|INST\]|SYS>>)"
_ESCAPE = rf"({_OPEN})(?=\\*{_CLOSE})"
_UNESCAPE = rf"({_OPEN})\\(?=\\*{_CLOSE})"
BEGIN, END = "<s>", "</s>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"$1\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit("$1"))


def _escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_read(role: Column) -> Column:
    parts = F.split(role, F.lit(r"\\\\"))
    return unescape(F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\"))


def pieces(text: Column) -> Column:
    """Tokens of a text, counted as runs of letters, digits or other signs; long runs count once for each 6 characters begun."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]{1,6}|\p{N}{1,3}|[^\s\p{L}\p{M}\p{N}]{1,3}")).cast("long") + 4


def windows(conversations: DataFrame, budget: int = 512, history: int = 128, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", tokens: Column | None = None) -> DataFrame:
    """One row per window: conv, window, text, loss (spans of code points in text, end exclusive), repeated (turns that are no new ones) and tokens.

    A conversation is the unit here, as where a window ends decides where the next
    begins: its turns are gathered in one row, and windows take slices of it. Turns stand in the order of turn, role and text,
    nulls first; null role and text are empty; rows that repeat a turn are turns
    of their own; rows with a null conversation form one conversation. A turn
    that alone is over the budget makes a window of its own, whole. Only a
    system turn that comes first is retained. An empty table gives no rows.
    """
    role = F.coalesce(F.col(quoted(role_column)).cast("string"), F.lit(""))
    rows = conversations.select(F.col(quoted(conv_column)).alias("conv"), F.col(quoted(turn_column)).alias("turn"), role.alias("role"), whole_text(text_column).alias("text"))
    count = tokens if tokens is not None else pieces(F.col("text"))
    shown = F.concat(F.lit(BEGIN), _escaped_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END))
    head = F.length(_escaped_role(F.col("role"))) + len(BEGIN) + 1
    rows = rows.select("conv", "turn", "role", "text", shown.alias("shown"), count.cast("long").alias("n"), head.cast("long").alias("head"))
    # prefix sums: s before a turn, and how much of the turns right before it the history holds
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumns({"s": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "place": F.row_number().over(order)})
    back = Window.partitionBy("conv").orderBy("s").rangeBetween(-int(history), 0)
    can = (F.col("place") > 1) | (F.col("role") != "system")
    earliest = F.min(F.when(can, F.struct("s", "place"))).over(back)
    rows = rows.withColumns({"old": F.col("s") - F.coalesce(earliest["s"], F.col("s")), "back": F.coalesce(earliest["place"], F.col("place")) - 1})
    talk = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "role", "shown", "n", "head", "s", "old", "back"))).alias("t"))
    talk = talk.withColumn("kept", F.expr("if(t[0].role = 'system', 1, 0)"))
    talk = talk.withColumn("room", F.expr(f"{int(budget)}L - if(kept = 1, t[0].n, 0L)"))
    # where new turns begin: the first after the system turn, then each at which the budget is used up, history included
    step = """
        aggregate(
            sequence(kept, greatest(kept, size(t) - 1)),
            named_struct('starts', array(kept), 'from', if(kept = 1, t[0].n, 0L), 'held', 0L),
            (a, i) -> if(i > element_at(a.starts, -1) and get(t, i).s + get(t, i).n - a.from + a.held > room,
                named_struct('starts', array_append(a.starts, i), 'from', get(t, i).s, 'held', if(get(t, i).old + get(t, i).n <= room, get(t, i).old, 0L)),
                a),
            a -> a.starts)"""
    # each window takes its own turns only, so that a conversation is not copied for each of its windows
    held = "if(w > 0 and get(t, first).old + get(t, first).n <= room, get(t, first).old, 0L)"
    begin = f"if({held} = 0, first, get(t, first).back)"
    own = f"concat(slice(t, 1, kept), slice(t, {begin} + 1, coalesce(get(starts, w + 1), size(t)) - {begin}))"
    each = f"transform(starts, (first, w) -> named_struct('window', w, 'repeated', if(w > 0, kept + first - {begin}, 0), 'turns', {own}))"
    # outer, though never empty: else the optimizer repeats all that is above in a filter of its own
    cut = talk.withColumn("starts", F.expr(f"if(size(t) > kept, {step}, array(kept))")).withColumn("cut", F.expr(each))
    cut = cut.select("conv", F.expr("inline_outer(cut)"))
    cut = cut.withColumn("ends", F.expr("aggregate(turns, array(0L), (a, x) -> array_append(a, element_at(a, -1) + length(x.shown)))"))
    loss = f"""
        transform(
            filter(sequence(0, size(turns)), i -> i < size(turns) and i >= repeated and get(turns, i).role = 'assistant'),
            i -> named_struct('start', ends[i] + get(turns, i).head, 'end', ends[i + 1] - {len(END)}))"""
    return cut.select(
        "conv", F.col("window").cast("long").alias("window"), F.expr("array_join(transform(turns, x -> x.shown), '')").alias("text"), F.expr(loss).alias("loss"),
        F.col("repeated").cast("long").alias("repeated"), F.expr("aggregate(turns, 0L, (a, x) -> a + x.n)").alias("tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the windows' texts and masks alone: conv, turns (role and text, in order), targets (texts under the loss mask, in order) and chars."""
    shown = F.expr(f"split(text, '{_literal(END)}')")
    new = formatted.withColumn("parts", shown).withColumn("parts", F.expr("slice(parts, cast(repeated as int) + 1, greatest(size(parts) - 1 - cast(repeated as int), 0))"))
    bare = F.transform("parts", lambda x: F.substring(x, F.lit(len(BEGIN) + 1), F.length(x)))
    turn = F.transform(bare, lambda x: F.struct(_role_read(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring(x, F.instr(x, "\n") + 1, F.length(x))).alias("text")))
    target = F.expr("transform(loss, s -> substring(text, cast(s.start as int) + 1, cast(s.end - s.start as int)))")
    new = new.select("conv", "window", turn.alias("turns"), F.transform(target, unescape).alias("targets"), F.length("text").cast("long").alias("chars"))
    whole = new.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").alias("chars"))
    return whole.select("conv", F.expr("flatten(transform(w, x -> x.turns))").alias("turns"), F.expr("flatten(transform(w, x -> x.targets))").alias("targets"), "chars")


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n")
