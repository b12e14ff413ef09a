"""Quotation linking: messages to the messages that they quote, and conversations in reply order without quotes.

A line's quote level is the number of `>` before it. The lines of one level are a message's passage of that level. Passages are
normalised (case, white space, empty lines) and hashed: whole, and in runs of 1, 2 and 4 lines, so that a passage that was cut or
mixed still links. Hashes of quoted passages are joined to those of messages' own text: to the latest message before in the same
conversation; failing that, to the latest in any other that is earlier by (turn, conversation), so that no cycle can arise. These are
as-of look-ups over ranges (order.latest_before): a line that very many messages share makes no pairs, and its rows are split over tasks.

Of several originals of a passage the one that holds all of it comes first, then that with the longest run, with most lines, of the
same conversation, and the latest. Level 1 names the parent. Depth and root follow by pointer doubling. Replies come after what
they reply to when rows are ordered by root and depth; a thread is never gathered in one place.

Defined cases: a null text has a null own text and no quotes; empty lines (of fewer than MIN_CHARS normalised characters) link to
nothing; a message with a null conversation or turn is returned and neither quoted nor linked; repeated rows are each
returned; very long texts are hashed whole and by runs, in proportion to their lines; an empty table gives no rows; extra columns are
ignored. conv_id may be of any type that has an order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlens.llm.common import materialise
from meetlens.operators.order import latest_before

#: Least characters of a normalised line, the marks before a quoted line, and lines of the runs that are hashed.
MIN_CHARS, MARKS, RUNS = 1, r"^(?: ?>)+ ?", (1, 2, 4)


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^((?: ?>)+)", 1), " ", ""))


def own_text(text: Column) -> Column:
    """The unquoted lines, without the empty lines about them."""
    kept = F.filter(F.split(text, "\n"), lambda line: level(line) == 0)
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\n+|\n+$", "")


def quoted(text: Column, levels: int = 1) -> Column:
    """The text as a quotation: each line one level deeper (or more)."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.concat(F.lit(">" * levels + " "), line)), "\n")


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, h, n, whole: the hashes of each message's passage of each level, whole (n: its lines) and by runs of n."""
    norm = lambda line: F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"\s+", " ")))
    split = F.transform(F.split("text", "\n"), lambda line: F.struct(level(line).alias("level"), norm(line).alias("norm")))
    kept = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.filter(split, lambda x: F.length(x["norm"]) >= MIN_CHARS).alias("ls"))
    by_level = kept.select("conv_id", "turn", "ls", F.explode(F.array_distinct(F.transform("ls", lambda x: x["level"]))).alias("level"))
    one = by_level.select("conv_id", "turn", "level", F.transform(F.filter("ls", lambda x: x["level"] == F.col("level")), lambda x: x["norm"]).alias("ls"))

    def item(i: Column | int, n: Column, whole: bool) -> Column:
        return F.struct(F.xxhash64(F.lit(-1) if whole else n, F.array_join(F.slice("ls", i, n), "\n")).alias("h"), n.cast("int").alias("n"), F.lit(whole).alias("whole"))

    def runs_of(n: int) -> Column:
        return F.when(F.size("ls") >= n, F.transform(F.sequence(F.lit(1), F.size("ls") - (n - 1)), lambda i: item(i, F.lit(n), False)))

    every = F.array(item(1, F.size("ls"), True))
    return one.select("conv_id", "turn", "level", F.inline(F.array_distinct(F.concat(every, *(F.coalesce(runs_of(n), F.slice(every, 1, 0)) for n in RUNS)))))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, to_conv, to_turn, n_lines: for each quote level, the message quoted."""
    parsed = materialise(passages(messages), "passages")
    own = parsed.where("level = 0").select("conv_id", "turn", "h", F.struct("turn", "conv_id").alias("at"))
    asked = parsed.where("level > 0").select("conv_id", "turn", "level", "h", "n", "whole")
    once = asked.select("conv_id", "h", "turn").distinct()
    here = materialise(latest_before(once, own, ["conv_id", "h"], "turn", "to_turn"), "here")
    rest = here.where("to_turn IS NULL").select("conv_id", "turn", "h", F.struct("turn", "conv_id").alias("at"))
    there = latest_before(rest, own, ["h"], "at", "x").where("x IS NOT NULL AND x.conv_id <> conv_id")
    found = here.where("to_turn IS NOT NULL").select("conv_id", "turn", "h", F.col("conv_id").alias("to_conv"), "to_turn").union(there.select("conv_id", "turn", "h", "x.conv_id", "x.turn"))
    votes = asked.join(found, ["conv_id", "turn", "h"]).groupBy("conv_id", "turn", "level", "to_conv", "to_turn").agg(F.max("whole").alias("whole"), F.max("n").alias("longest"), F.sum(F.when(~F.col("whole") & (F.col("n") == 1), 1).otherwise(0)).alias("lines"))
    best = F.max(F.struct("whole", "longest", "lines", (F.col("to_conv") == F.col("conv_id")).alias("same"), "to_turn", "to_conv"))
    lines = F.when(F.col("x.whole"), F.col("x.longest")).otherwise(F.greatest("x.lines", "x.longest")).cast("long")
    return votes.groupBy("conv_id", "turn", "level").agg(best.alias("x")).select("conv_id", "turn", "level", "x.to_conv", "x.to_turn", lines.alias("n_lines"))


def threads(parents: DataFrame) -> DataFrame:
    """conv_id, turn, root_conv, root_turn, depth of every message with a parent (conv_id, turn, to_conv, to_turn).

    Only messages that have not reached their root take part in a round; a round doubles the distance.
    """
    names = ["conv_id", "turn", "root_conv", "root_turn", "depth"]
    moving = materialise(parents.select("conv_id", "turn", F.col("to_conv").alias("root_conv"), F.col("to_turn").alias("root_turn"), F.lit(1).alias("depth")), "threads")
    done: list[DataFrame] = []
    while moving.limit(1).count():
        all_now = reduce(DataFrame.union, done, moving)
        up = all_now.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("up_conv"), F.col("root_turn").alias("up_turn"), F.col("depth").alias("more"))
        step = materialise(moving.join(up, ["root_conv", "root_turn"], "left"), "threads")
        done.append(step.where("more IS NULL").select(names))
        moving = step.where("more IS NOT NULL").select("conv_id", "turn", F.col("up_conv").alias("root_conv"), F.col("up_turn").alias("root_turn"), (F.col("depth") + F.col("more")).alias("depth"))
    return reduce(DataFrame.union, done) if done else moving


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own_text, levels, to_conv, to_turn, n_lines, root_conv, root_turn, depth, in reply order."""
    parents = materialise(link(messages).where("level = 1"), "parents")
    own = messages.select("conv_id", "turn", "role", own_text(F.col("text")).alias("own_text"), F.array_max(F.transform(F.split("text", "\n"), level)).alias("levels"))
    out = own.join(parents.drop("level"), ["conv_id", "turn"], "left").join(threads(parents), ["conv_id", "turn"], "left")
    out = out.withColumns({"root_conv": F.coalesce("root_conv", "conv_id"), "root_turn": F.coalesce("root_turn", "turn"), "depth": F.coalesce("depth", F.lit(0)), "n_lines": F.coalesce("n_lines", F.lit(0))})
    return out.orderBy("root_conv", "root_turn", "depth", "conv_id", "turn")


def as_mail(messages: DataFrame) -> DataFrame:
    """The table as mail: a reply holds its own text, the previous turn's as a quotation and, nested, the one before."""
    messages = messages.select("conv_id", "turn", "role", "text")
    ids = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    before = [ids.select("conv_id", (F.col("turn") + k).alias("turn"), quoted(F.col("text"), k).alias(f"q{k}")) for k in (1, 2)]
    joined = messages.join(before[0], ["conv_id", "turn"], "left").join(before[1], ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", "role", F.concat_ws("\n\n", "text", F.concat_ws("\n", "q1", "q2")).alias("text"))
