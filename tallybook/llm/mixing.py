"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

The i-th block of a source with weight w is released at floor(i / w) and due at
ceil((i + 1) / w); earliest deadline first then keeps every source within one block
of its target share at every place of the mixed order.  Releases and deadlines are taken from the weights
themselves, as whole numbers without any rounding, so nothing adds up over a long phase.  The driver makes one step
per block (``block_rows`` rows) and holds one piece of the plan at a time; the plan is a stored table, and
rows find their places by a join on source and block number.
When a source runs out, the rest go on with their weights scaled up: no row is left out.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import keep_pieces, keep_placed, literal_table, number_rows

#: Blocks of a source in one row of the plan, slots in one written piece of it, and slots up to which it is broadcast.
CHUNK, PIECE, BROADCAST_SLOTS = 1024, 1 << 18, 1 << 22


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    ratios = [float(w).as_integer_ratio() for w in weights]
    most = max(d for _, d in ratios)
    share = [n * (most // d) for n, d in ratios]
    common = gcd(*share)
    return [n // common for n in share]


def calls(share: list[int]) -> Iterator[int]:
    """Source of each slot, without end: earliest deadline first among released blocks."""
    total = sum(share)
    done = [0] * len(share)
    opens: dict[int, list[int]] = defaultdict(list)
    ready = [(-(-total // n), s) for s, n in enumerate(share)]
    heapq.heapify(ready)
    t = 0
    while True:
        for s in opens.pop(t, ()):
            heapq.heappush(ready, (-(-(done[s] + 1) * total // share[s]), s))
        _, s = heapq.heappop(ready)
        yield s
        done[s] += 1
        t += 1
        opens[max(t, done[s] * total // share[s])].append(s)


def cycle(share: list[int]) -> list[int]:
    """Source of each of ``sum(share)`` slots; after them the order repeats."""
    return list(islice(calls(share), sum(share)))


def schedule(blocks: list[int], weights: list[float]) -> Iterator[dict]:
    """Rows of the plan: blocks ``first`` to ``last`` (excluded) of source ``s``, all in its ``chunk`` of CHUNK blocks, go to ``slots``.

    A phase lasts until a source would be called once more than it has blocks.
    """
    used = [0] * len(blocks)
    slot, phase = 0, 0
    live = list(range(len(blocks)))
    while live := [s for s in live if used[s] < blocks[s]]:
        slots: list[list[int]] = [[] for _ in live]

        def row(k: int) -> dict:
            s, at = live[k], slots[k]
            slots[k] = []
            return {"s": s, "phase": phase, "chunk": (used[s] - 1) // CHUNK, "first": used[s] - len(at), "last": used[s], "slots": at}

        for k in calls(whole([weights[s] for s in live])):
            s = live[k]
            if used[s] == blocks[s]:
                break
            slots[k].append(slot)
            slot += 1
            used[s] += 1
            if used[s] % CHUNK == 0:
                yield row(k)
        yield from [row(k) for k in range(len(live)) if slots[k]]
        phase += 1


def plan(blocks: list[int], weights: list[float]) -> list[dict]:
    """The whole schedule, one dict per phase and source: its blocks ``first`` to ``last`` (excluded)
    go to slots ``start + slots[b]`` with b counted from ``first``; ``total`` slots are in the phase."""
    out: dict[tuple, dict] = {}
    for r in schedule(blocks, weights):
        p = out.setdefault((r["phase"], r["s"]), {"s": r["s"], "phase": r["phase"], "first": r["first"], "slots": []})
        p["last"] = r["last"]
        p["slots"] += r["slots"]
    for phase in {p["phase"] for p in out.values()}:
        mine = [p for p in out.values() if p["phase"] == phase]
        start, total = min(p["slots"][0] for p in mine), sum(len(p["slots"]) for p in mine)
        for p in mine:
            p.update(start=start, total=total, slots=[t - start for t in p["slots"]])
    return list(out.values())


def pieces(rows: Iterator[dict], size: int) -> Iterator[list[dict]]:
    """Lists of rows with about ``size`` slots in all."""
    out, n = [], 0
    for r in rows:
        out.append(r)
        n += len(r["slots"])
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


def mixed(df: DataFrame, weights: dict[str, float] | None = None, *, source_col: str = "source", temper: float = 0.5,
          block_rows: int = 16) -> DataFrame:
    """Every row of ``df`` (its columns in the struct ``row``) with its place in the mixed order.

    Columns: ``row, source, source_rank, block, phase, slot, position, piece``.  Targets are ``weights`` by source
    (each above 0), or row counts to the power ``temper``.  A null source is a source of its own, named
    by the key None.  ``position`` is unique and orders the rows; the last block of a source
    may be short, so positions may have gaps.  Rows of a source keep their input order;
    repeated rows get places of their own; columns of any name pass through inside
    ``row``; an empty table gives an empty result.  The number of sources has no bound; the driver
    holds a count for each.
    """
    spark = df.sparkSession
    kept = keep_placed(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                                 F.col(source_col).cast("string").alias("source")), ["source"], "mixing")
    counted = [(r["source"], r["n"]) for r in kept.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()]
    counted.sort(key=lambda c: (c[0] is not None, c[0] or ""))
    target = [float(n) ** temper if weights is None else float(weights[s]) for s, n in counted]
    if any(w <= 0 for w in target):
        raise ValueError("weights must be above 0")
    blocks = [-(-n // block_rows) for _, n in counted]
    ddl = "source string, phase int, chunk bigint, first bigint, last bigint, slots array<bigint>"
    named = ({**r, "source": counted[r["s"]][0]} for r in schedule(blocks, target))
    table = keep_pieces(spark, (literal_table(spark, rows, ddl) for rows in pieces(named, PIECE)), ddl, "mix-plan")
    steps = table.select(F.col("source").alias("_s"), *table.columns[1:])
    if sum(blocks) <= BROADCAST_SLOTS:
        steps = F.broadcast(steps)
    ranked = number_rows(kept, ["source"], "source_rank").withColumn("block", F.floor(F.col("source_rank") / block_rows))
    here = (F.col("source").eqNullSafe(F.col("_s")) & (F.floor(F.col("block") / CHUNK) == F.col("chunk"))
            & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("last")))
    slot = F.element_at("slots", (F.col("block") - F.col("first") + 1).cast("int"))
    return (ranked.join(steps, here).withColumn("slot", slot.cast("long"))
            .select("row", "source", "source_rank", "block", "phase", "slot",
                    (F.col("slot") * block_rows + F.col("source_rank") % block_rows).alias("position"), "piece"))


def in_mixed_order(df: DataFrame, weights: dict[str, float] | None = None, *, source_col: str = "source",
                   temper: float = 0.5, block_rows: int = 16) -> DataFrame:
    """The rows of ``df`` in the mixed order: partition i holds the i-th stretch of it, sorted.

    Stretches are cut at equal positions, as many as the input had splits, without a sampling pass.
    """
    placed = mixed(df, weights, source_col=source_col, temper=temper, block_rows=block_rows)
    got = placed.agg(F.max("position").alias("top"), F.max("piece").alias("piece")).first()
    if got["top"] is None:
        return df
    n = got["piece"] + 1
    target = F.floor(F.col("position") * n / (got["top"] + 1)).cast("int")
    return placed.repartitionById(n, target).sortWithinPartitions("position").select("row.*")
