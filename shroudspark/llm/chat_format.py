"""Chat formatting: budgeted windows of whole turns, with loss spans for training."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Plan(NamedTuple):
    """Parameters; the defaults are the production values."""

    budget: int = 512  # tokens of a window
    history: int = 128  # tokens of turns that a window repeats from the one before
    history_turns: int = 4  # and how many of them
    overhead: int = 4  # tokens that the markers of a turn cost
    system: str = "system"
    target: str = "assistant"  # the role whose turns are learnt


def token_count(text: Column) -> Column:
    """Words and single punctuation marks, a stand-in for a tokenizer's count."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0)))


def windows(
    turns: DataFrame,
    plan: Plan = Plan(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    count: Callable[[Column], Column] = token_count,
) -> DataFrame:
    """One row for each window: ``window`` (from 0), ``first_turn`` and ``last_turn`` (of its new
    turns), ``n_history``, ``n_tokens``, ``text`` and ``targets``.

    A conversation's system turns open each of its windows.  The other turns are
    ordered by number; a window begins at the first turn that no window before it has
    as new, repeats as history the longest run of turns just before it that fits
    ``history`` and ``history_turns``, and takes as many new turns as fit ``budget``,
    one at least.  Prefix sums of turn tokens give both ends.  ``targets`` are the
    character spans (start, end exclusive) of the new target turns' texts: repeated
    turns are masked, so each target is learnt once.

    Defined cases: a turn longer than the budget is a window of its own, whole, and
    over budget; turns with a null conversation, turn number, role or text, and rows
    that repeat a turn exactly, are left out; differing turns of one number stay, by
    role and then text; a conversation of system turns alone has no window.
    """
    cost = count(F.col("x")) + plan.overhead
    rows = (
        turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.col(text_col).alias("x"))
        .dropna()
        .distinct()
        .withColumn("n", cost)
    )
    order = Window.partitionBy("c", F.col("r") == plan.system).orderBy("t", "r", "x")
    rows = rows.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    talk = F.array_sort(F.collect_list(F.when(F.col("r") != plan.system, F.struct("t", "r", "x", "n", "upto"))))
    head = F.array_sort(F.collect_list(F.when(F.col("r") == plan.system, F.struct("t", "r", "x", "n"))))
    total = lambda turns: F.aggregate(turns, F.lit(0), lambda s, y: s + y["n"])
    grouped = rows.groupBy("c").agg(talk.alias("talk"), head.alias("head")).filter(F.size("talk") > 0)
    # sums[i] is the tokens of the turns before i; get, for rows without turns may be looked at before they are filtered.
    sums = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("talk", lambda y: y["upto"]))
    grouped = grouped.select("c", "talk", "head", sums.alias("sums"), total(F.col("head")).alias("fixed"))

    def begin(i: Column) -> Column:
        """First turn of the history before turn i."""
        least = F.greatest(i - plan.history_turns, F.lit(0))
        return least + F.size(F.filter(F.slice("sums", least + 1, i - least), lambda s: s < F.get("sums", i) - plan.history))

    def end(i: Column, h: Column) -> Column:
        """Turn after the last new one of the window that begins with turn i, and its history with turn h."""
        room = F.get("sums", h) + plan.budget - F.col("fixed")
        # Each turn costs its markers at least, which bounds the turns to look at.
        near = F.slice("sums", i + 2, plan.budget // plan.overhead + 1) if plan.overhead > 0 else F.slice("sums", i + 2, F.size("sums"))
        return i + F.greatest(F.size(F.filter(near, lambda s: s <= room)), F.lit(1))

    state = F.struct(F.lit(0).alias("next"), F.expr("CAST(array() AS array<struct<a:int,h:int,b:int>>)").alias("found"))
    window = lambda i: F.transform(F.array(begin(i)), lambda h: F.struct(i.alias("a"), h.alias("h"), end(i, h).alias("b")))
    grow = lambda s, w: F.struct(w[0]["b"].alias("next"), F.concat(s["found"], w).alias("found"))
    step = lambda s, i: F.when(i == s["next"], F.transform(F.array(window(i)), lambda w: grow(s, w))[0]).otherwise(s)
    walked = F.aggregate(F.sequence(F.lit(0), F.size("talk") - 1), state, step)["found"]
    # Each window takes its own turns before windows become rows, so no row holds the whole conversation.
    part = lambda a, b: F.slice("talk", a + 1, b - a)
    cut = F.transform(
        walked,
        lambda w: F.struct(
            part(w["h"], w["a"]).alias("old"),
            part(w["a"], w["b"]).alias("new"),
            (F.col("fixed") + F.get("sums", w["b"]) - F.get("sums", w["h"])).alias("n"),
        ),
    )
    each = grouped.select("c", "head", cut.alias("cut")).select("c", "head", F.posexplode_outer("cut").alias("window", "w"))  # outer: no filter is inferred that would do all this twice
    turn = lambda new: lambda y: F.struct(y["r"].alias("r"), y["x"].alias("x"), F.lit(new).alias("new"))
    each = each.withColumn("shown", F.concat(F.transform("head", turn(False)), F.transform("w.old", turn(False)), F.transform("w.new", turn(True))))
    mark = lambda y: F.concat(F.lit("<|"), y["r"], F.lit("|>\n"))
    close = "\n<|end|>\n"
    spot = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("found"))
    walk = lambda s, y: F.struct(
        (s["at"] + F.length(mark(y)) + F.length(y["x"]) + len(close)).alias("at"),
        F.when(
            y["new"] & (y["r"] == plan.target),
            F.concat(s["found"], F.array(F.struct((s["at"] + F.length(mark(y))).alias("start"), (s["at"] + F.length(mark(y)) + F.length(y["x"])).alias("end")))),
        )
        .otherwise(s["found"])
        .alias("found"),
    )
    return each.select(
        F.col("c").alias(conv_col),
        "window",
        F.get("w.new", F.lit(0))["t"].alias("first_turn"),
        F.element_at("w.new", -1)["t"].alias("last_turn"),
        F.size("w.old").alias("n_history"),
        F.col("w.n").cast("int").alias("n_tokens"),
        F.array_join(F.transform("shown", lambda y: F.concat(mark(y), y["x"], F.lit(close))), "").alias("text"),
        F.aggregate("shown", spot, walk)["found"].alias("targets"),
    )
