"""Chat formatting in budgeted windows.

A turn is written as ``### role: text</turn>\\n``. Inside roles and texts ``\\``, ``<``, ``#``, ``:`` (roles only) become
``\\b``, ``\\l``, ``\\h``, ``\\c``, so no text can hold a control string, and reading back is exact.

Windows are turn-aligned. With the running token count ``start`` of a turn, turns whose start lies in one stretch of
half the budget share a window; its last turn starts a window of its own where it would overrun the budget. So a window of
several turns never exceeds the budget for new turns, and a single longer turn stays whole. Every window but
the first repeats the conversation's first system turn and the turns that start at most ``history`` tokens before it;
repeated turns are outside the loss mask, which covers each assistant text once.

Tokens are counted as words plus the marks of a turn. Running counts are taken in blocks of turn numbers first and then
over a conversation's block totals, so that one very long conversation is spread over tasks.

Defined cases: null texts and roles are empty; turns are ordered by number (null first), then role, then text;
rows without conv_id are one conversation; equal rows are turns of their own; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kith.llm.common import WORD
from kith.sources.workspace import materialize

END = "</turn>\n"


@dataclass(frozen=True)
class ChatOptions:
    budget: int = 1024       # tokens of new turns in a window
    history: int = 128       # tokens of repeated turns before it
    overhead: int = 4        # tokens of a turn's marks
    block: int = 256         # turn numbers in one block of the running count
    target: str = "assistant"


def escape(text: Column) -> Column:
    for raw, mark in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    for raw, mark in (("<", "\\l"), ("#", "\\h"), (":", "\\c"), ("\\", "\\b")):
        text = F.replace(text, F.lit(mark), F.lit(raw))
    return text


def numbered(turns: DataFrame, opts: ChatOptions) -> DataFrame:
    """``(conv_id, role, text, i, start, tokens)``: a turn's place and the tokens before it in its conversation."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("tokens", (F.regexp_count("text", F.lit(WORD)) + opts.overhead).cast("long")) \
        .withColumn("part", F.floor(F.coalesce("turn", F.lit(-1 << 62)) / opts.block))
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    within = W.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return (
        rows.withColumns({"i": F.row_number().over(within) - 1,
                          "start": F.sum("tokens").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens")})
        .join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
        .select("conv_id", "role", "text", (F.col("i") + F.col("n0")).alias("i"), (F.col("start") + F.col("t0")).alias("start"), "tokens"))


def windows(turns: DataFrame, opts: ChatOptions = ChatOptions()) -> DataFrame:
    """``(conv_id, window, first_new, formatted, loss)``.

    ``first_new`` counts the repeated turns in front; ``loss`` lists (start, length) in code points of ``formatted``.
    """
    stride = max(1, opts.budget // 2)
    rows = numbered(turns, opts).withColumn("stretch", F.floor(F.col("start") / stride))
    rows = rows.withColumn("first", F.min("start").over(W.partitionBy("conv_id", "stretch")))
    alone = (F.col("start") > F.col("first")) & (F.col("start") + F.col("tokens") - F.col("first") > opts.budget)
    rows = rows.withColumn("window", F.when(alone, F.col("start")).otherwise(F.col("first"))).drop("first")
    rows = materialize(rows, "chat")
    new = rows.withColumn("kind", F.lit(2))
    heads = rows.select("conv_id", "window").distinct().filter("window > 0") \
        .select(F.col("conv_id").alias("c"), F.col("window").alias("w"))
    # A turn may be repeated in windows that start in its own stretch or the next ones the history reaches.
    reach = F.sequence(F.col("stretch"), F.floor((F.col("start") + opts.history) / stride))
    past = rows.withColumn("near", F.explode(reach)).drop("window")
    keyed = heads.withColumn("k", F.floor(F.col("w") / stride))
    history = past.join(keyed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("near") == F.col("k"))
                        & (F.col("start") < F.col("w")) & (F.col("w") <= F.col("start") + opts.history))
    system = rows.filter("role = 'system'").groupBy("conv_id").agg(F.min_by(F.struct("i", "text"), "i").alias("s"))
    system = system.select(F.col("conv_id").alias("sc"), "s.i", "s.text")
    kept = heads.join(system, F.col("c").eqNullSafe(F.col("sc"))).filter(F.col("w").isNotNull())
    columns = ["conv_id", "window", "kind", "i", "role", "text"]
    everything = (
        new.select(columns)
        .unionByName(history.select("conv_id", F.col("w").alias("window"), F.lit(1).alias("kind"), "i", "role", "text"))
        .unionByName(kept.select(F.col("c").alias("conv_id"), F.col("w").alias("window"), F.lit(0).alias("kind"), "i", F.lit("system").alias("role"), "text")))
    # A turn comes once in a window: as new, else as the system turn, else as history.
    turn = F.struct("i", (F.col("kind") == 2).alias("new"), "role", "text")
    grouped = everything.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"),
        F.max(F.when(F.col("kind") == 0, F.col("i"))).alias("system"),
        F.min(F.when(F.col("kind") == 2, F.col("i"))).alias("from"))
    # Copies of a turn are neighbours when sorted by place, and a new one is the last of them.
    once = F.filter("turns", lambda t, k: (k == F.size("turns") - 1) | (F.get(F.col("turns"), k + 1)["i"] != t["i"]))
    placed = grouped.withColumn("turns", once)
    ordered = F.concat(F.filter("turns", lambda t: (t["i"] == F.col("system")) & ~t["new"]),
                       F.filter("turns", lambda t: (F.col("system").isNull() | (t["i"] != F.col("system"))) & ~t["new"]),
                       F.filter("turns", lambda t: t["new"]))
    head = lambda t: F.concat(F.lit("### "), F.replace(escape(t["role"]), F.lit(":"), F.lit("\\c")), F.lit(": "))
    written = F.transform(ordered, lambda t: F.struct(
        head(t).alias("head"), escape(t["text"]).alias("body"), (t["new"] & (t["role"] == opts.target)).alias("loss")))
    out = placed.withColumn("first_new", F.size(F.filter("turns", lambda t: ~t["new"]))).withColumn("written", written)
    out = out.withColumn("lengths", F.transform("written", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END)))
    ends = F.transform("written", lambda t, k: F.aggregate(F.slice(F.col("lengths"), F.lit(1), k), F.lit(0), lambda a, x: a + x))
    out = out.withColumn("offsets", ends)
    loss = F.filter(F.transform("written", lambda t, k: F.when(t["loss"], F.struct(
        (F.get(F.col("offsets"), k) + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length")))), F.isnotnull)
    return out.select(
        "conv_id", "window", "first_new",
        F.array_join(F.transform("written", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, window, turns, targets, n_chars)`` of each window: its new turns (role, text) and the masked texts, unescaped."""
    pieces = F.split("formatted", END)
    new = F.slice(pieces, F.col("first_new") + 1, F.size(pieces) - 1 - F.col("first_new"))
    parts = F.transform(new, lambda p: F.struct(
        unescape(F.substring(p, F.lit(5), F.instr(p, F.lit(": ")) - 5)).alias("role"),
        unescape(F.substring(p, F.instr(p, F.lit(": ")) + 2, F.length(p))).alias("text")))
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "window", parts.alias("turns"), targets.alias("targets"), F.length("formatted").alias("n_chars"))


def digest(read: DataFrame) -> DataFrame:
    """One row a conversation. Its text is hashed as a whole, so the hashed strings of one conversation meet in one row."""
    each = read.select(
        "conv_id", "window", "n_chars", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("loss"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", c))), lambda x: x[c]), "")
    return (
        each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), joined("turns").alias("turns"), joined("loss").alias("loss"),
                                    F.sum("n_chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
        .select("conv_id", F.col("n_turns").cast("long"), F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
                F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                F.col("formatted_chars").cast("long"), "n_windows"))
