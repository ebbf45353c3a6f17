"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Each source is cut into ``blocks`` by a hash of its documents. Targets fix how many whole passes and which
blocks of a further pass are drawn; the last block is drawn in part, document by document. The draws of all
sources are then dealt to ``shards``: a binary tree splits the exact quotas of every source between its two halves by a
multivariate-hypergeometric draw (selection sampling without replacement), level by level; each shard takes
its quota from the permuted draws of a source, so shards are disjoint, and is shuffled locally by a hash.

Only (source, block) totals meet in small tables: their rows are sources x blocks, not documents. Documents meet
their block's plan by (source, block), so a source with a third of all rows is spread over ``blocks`` keys.

Defined cases: a null text has size 0; null sources are one source, last in order; a source without words
has target 0 and its documents are taken as often as a share of 0 says (never); equal rows are drawn alike; an empty table
gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kith.llm.common import WORD, hash60
from kith.sources.workspace import materialize


SHARD_BYTES = 64 << 20  # of text in a shard, about


@dataclass(frozen=True)
class MixOptions:
    weights: tuple = (5, 2, 1)   # by the order of the sources, repeating
    cap: int = 3                 # a source is repeated so often at most
    blocks: int = 512            # blocks of a source
    levels: int = 4              # 2 ** levels output shards
    seed: int = 17


def sized(df: DataFrame, opts: MixOptions) -> DataFrame:
    """``(doc_id, source, size, h, block)`` of every row."""
    h = hash60(opts.seed, F.col("doc_id"))
    return (df.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                      F.coalesce(h, F.lit(0)).alias("h"))
            .withColumn("block", (F.col("h") % opts.blocks).cast("int")))


def targets(sources: DataFrame, opts: MixOptions) -> DataFrame:
    """Add ``weight`` and ``target`` to ``(source, source_size)``: shares by weight, filled up to the cap.

    In ascending order of cap / weight, a source is capped as long as its share of what is left exceeds its cap.
    """
    weights = F.array(*map(F.lit, opts.weights))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    order = W.orderBy("ratio", "rank")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    return (
        sources.withColumn("rank", rank)
        .withColumn("weight", F.get(weights, F.col("rank") % len(opts.weights)).cast("long"))
        .withColumn("cap", F.col("source_size") * opts.cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumns({
            "left": F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weights": F.sum("weight").over(after)})
        .withColumn("level", F.when(F.col("left") * F.col("weight") <= F.col("cap") * F.col("weights"),
                                    F.struct("ratio", "rank", "left", "weights")))
        .withColumn("level", F.min("level").over(W.partitionBy()))
        .withColumn("target", F.when(F.struct("ratio", "rank") < F.struct("level.ratio", "level.rank"), F.col("cap").cast("double"))
                    .otherwise((F.col("weight") * F.col("level.left")).cast("double") / F.col("level.weights")))
        .select("source", "source_size", "weight", F.coalesce("target", F.lit(0.0)).alias("target")))


def block_plan(blocks: DataFrame, goals: DataFrame, opts: MixOptions) -> DataFrame:
    """``passes`` of every block, and for the pass that is drawn in part ``room``, the words it may still give."""
    order = W.partitionBy("source").orderBy("place", "block")
    return (
        blocks.withColumn("place", hash60(opts.seed, "block", F.coalesce("source", F.lit("")), F.col("block")))
        .withColumn("before", F.sum("words").over(order) - F.col("words"))
        .join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("room", F.col("target") - F.col("passes") * F.col("source_size") - F.col("before"))
        .withColumn("extra", F.when(F.col("room") <= 0, "none").when(F.col("room") >= F.col("words"), "whole").otherwise("part"))
        .drop("before"))


def _split(levels: int, seed: int):
    """One level of the tree: the quotas of a node, in the order of the sources, become those of its two halves."""
    state = "struct<need bigint, rest bigint, left array<bigint>>"

    def half(node, quotas):
        total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)

        def source(acc, q, j):
            # Selection sampling: each of the source's draws goes left with probability need / rest.
            drawn = F.aggregate(
                F.when(q > 0, F.sequence(F.lit(1).cast("long"), q)).otherwise(F.array().cast("array<bigint>")),
                F.struct(acc["need"].alias("need"), acc["rest"].alias("rest")),
                lambda s, i: F.struct(
                    (s["need"] - F.when(F.pmod(F.xxhash64(F.lit(seed), node, j, i), s["rest"]) < s["need"], F.lit(1)).otherwise(F.lit(0))).alias("need"),
                    (s["rest"] - 1).alias("rest")))
            return F.transform(F.array(drawn), lambda d: F.struct(
                d["need"].alias("need"), d["rest"].alias("rest"),
                F.concat(acc["left"], F.array(acc["need"] - d["need"])).alias("left")).cast(state))[0]

        numbered = F.transform(quotas, lambda q, j: F.struct(q.alias("q"), j.alias("j")))
        start = F.struct(F.floor(total / 2).cast("long").alias("need"), total.alias("rest"),
                         F.array().cast("array<bigint>").alias("left")).cast(state)
        return F.aggregate(numbered, start, lambda acc, x: source(acc, x["q"], x["j"]))["left"]

    return half


def shard_quotas(quotas: DataFrame, opts: MixOptions) -> DataFrame:
    """``(source, shard, start, n)``: how many of a source's permuted draws a shard takes, and from which one on."""
    half = _split(opts.levels, opts.seed)
    root = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "draws"))).alias("x"))
    tree = root.select(F.lit(1).cast("long").alias("node"), F.col("x.source").alias("sources"), F.col("x.draws").alias("q"))
    for _ in range(opts.levels):
        tree = (tree.withColumn("left", half(F.col("node"), F.col("q")))
                .select("sources", F.explode(F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")),
                    F.struct((F.col("node") * 2 + 1).alias("node"),
                             F.zip_with("q", "left", lambda a, b: a - b).alias("q")))).alias("c"))
                .select("sources", "c.node", "c.q"))
    dealt = tree.select((F.col("node") - (1 << opts.levels)).cast("int").alias("shard"), F.posexplode("q").alias("j", "n"), "sources") \
        .select(F.get("sources", F.col("j")).alias("source"), "shard", "n")
    return dealt.withColumn("start", F.sum("n").over(W.partitionBy("source").orderBy("shard")) - F.col("n"))


def mix(df: DataFrame, opts: MixOptions = MixOptions()) -> DataFrame:
    """``(doc_id, source, size, source_size, target, draws)``; ``draws`` lists (pass, shard, place) of each time a row is taken.

    Exploding ``draws``, writing by shard and sorting by place gives the mixed, shuffled stream (``emit``).
    """
    rows = materialize(sized(df, opts), "mix")
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), opts)
    plan = materialize(block_plan(blocks, goals, opts), "mix-plan")
    draws = (plan.withColumn("n", F.col("passes") + F.when(F.col("extra") == "none", 0).otherwise(1)).filter("n > 0")
             .select("source", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pass")))
    draws = draws.withColumn("at", F.row_number().over(W.partitionBy("source").orderBy(
        hash60(opts.seed, "draw", F.coalesce("source", F.lit("")), F.col("block"), F.col("pass")), "block", "pass")) - 1)
    draws = materialize(draws, "mix-draws")
    quotas = shard_quotas(draws.groupBy("source").agg(F.count("*").alias("draws")), opts)
    taken = quotas.filter("n > 0").select(
        F.col("source").alias("s"), "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("place"))
    dealt = (draws.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("place")))
             .groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("deals")))
    full = (plan.join(dealt.withColumnsRenamed({"source": "s", "block": "b"}),
                      F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
            .select(F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target", "passes", "room", "extra", "deals"))
    met = rows.join(full, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    # Only the one block of a source that is drawn in part needs the order of its documents.
    part = met.filter(F.col("extra") == "part")
    place = W.partitionBy("source", "block").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    part = part.withColumn("more", F.sum("size").over(place) - F.col("size") / 2 <= F.col("room"))
    rest = met.filter(F.col("extra") != "part").withColumn("more", F.col("extra") == "whole")
    both = rest.unionByName(part)
    return both.select(
        "doc_id", "source", "size", "source_size", "target",
        F.transform(F.filter(F.coalesce("deals", F.array()), lambda d: (d["pass"] < F.col("passes")) | F.col("more")),
                    lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"),
                                       F.xxhash64(F.lit(opts.seed), F.col("h"), d["pass"]).alias("place"))).alias("draws"))


def emit(mixed: DataFrame, columns: tuple | list = ("doc_id", "source", "size")) -> DataFrame:
    """One row for each time a document is taken, dealt by shard and shuffled within it."""
    rows = mixed.select(*columns, F.explode("draws").alias("d")) \
        .select(*columns, F.col("d.pass").alias("pass"), F.col("d.shard").alias("shard"), F.col("d.place").alias("place"))
    return rows.repartition("shard").sortWithinPartitions("shard", "place")


def sized_options(total_bytes: int, opts: MixOptions = MixOptions()) -> MixOptions:
    """Options with as many shards as ``total_bytes`` need, at least those of ``opts``, and blocks enough to fill them."""
    levels = max(opts.levels, math.ceil(math.log2(max(1, total_bytes / SHARD_BYTES))))
    return replace(opts, levels=levels, blocks=max(opts.blocks, 16 << levels))
