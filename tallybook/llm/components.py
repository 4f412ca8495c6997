"""Distributed union-find over an edge list (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import keep, let_go


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; ``component`` is its smallest reachable node.

    Each round joins every node to the neighbour that a hash of this round puts first, then
    contracts the edges; random order makes the number of rounds logarithmic, on
    chains too.  Each round's tables are written to the shared folder, and shrink from round to round.
    Loops and repeated edges are allowed; edges with a null end are ignored; no edges give an empty result.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return (e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    live = keep(tidy(edges.select("a", "b")), "edges")
    joined, nodes = None, 0
    turn = 0
    while size := live.count():
        first = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            live.select(F.col("b").alias("u"), F.col("a").alias("v")))
        moves = keep(both.select("u", first("v").alias("f")).groupBy("u").agg(F.min("f").alias("f"))
                     .select("u", F.least("f", first("u"))["to"].alias("r")), "moves", 2 * size)
        step = lambda side: moves.select(F.col("u").alias(f"u_{side}"), F.col("r").alias(f"r_{side}"))  # noqa: B023, E731
        before = live
        live = keep(tidy(live.join(step("a"), F.col("a") == F.col("u_a")).join(step("b"), F.col("b") == F.col("u_b"))
                         .select(F.col("r_a").alias("a"), F.col("r_b").alias("b"))), "edges", size)
        let_go(before)
        if joined is None:
            joined, nodes, used = moves.select(F.col("u").alias("node"), F.col("r").alias("root")), 2 * size, moves
        else:
            joined = keep(joined.join(moves, F.col("root") == F.col("u"), "left")
                          .select("node", F.coalesce("r", "root").alias("root")), "roots", nodes)
            let_go(used, moves)
            used = joined
        turn += 1
    if joined is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = keep(joined.groupBy("root").agg(F.min("node").alias("component")).withColumnRenamed("root", "_r"), "least", nodes)
    return joined.join(least, F.col("root") == F.col("_r")).select("node", "component")
