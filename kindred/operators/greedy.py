"""The greedy walk over a graph of any size: nodes in their order, each gathering its free neighbours.

Nodes stand in blocks of the order, each with a bounded number of links. In a round every block
walks on by itself as far as it can know: a node is decided if no node of an earlier block, still
open, could yet reach it or a neighbour of it, and no node before it in the block that stays open
can. So what takes many steps inside a block takes one round, and rounds end with the blocks that
hang on each other one by one; open nodes of the first open block are all decided. A node with more
links than a block holds is a block of its own and is decided by sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.ranking import placed
from kindred.plans.tables import discard, materialize

#: Links of a block, in all.
BLOCK = 400_000


def _in_blocks(nodes: DataFrame, pairs: DataFrame, many: int | None) -> DataFrame:
    """nodes (id, first, n) with pos, their place, block and hub. Blocks go up with the places."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    degrees = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    rows = placed(nodes.join(degrees, "id"), ["first", "id"], "pos", many).withColumn("hub", F.col("degree") > BLOCK)
    # Running sums in two steps: over the sums of ranges of places, then inside each.
    rows = rows.withColumn("_range", F.shiftright("pos", 18)).withColumn("_links", F.when(F.col("hub"), 0).otherwise(F.col("degree") + 1)).withColumn("_hub", F.col("hub").cast("long"))
    sums = rows.groupBy("_range").agg(F.sum("_links").alias("links"), F.sum("_hub").alias("hubs"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 262,144 nodes
    zero = F.lit(0).cast("long")
    sums = sums.select(F.col("_range").alias("_r"), F.coalesce(F.sum("links").over(upto), zero).alias("links"), F.coalesce(F.sum("hubs").over(upto), zero).alias("hubs"))
    inside = Window.partitionBy("_range").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(inside), zero)
    rows = rows.withColumn("_l", before("_links")).withColumn("_h", before("_hub")).join(sums, F.col("_range") == F.col("_r"))
    block = F.floor((F.col("links") + F.col("_l")) / BLOCK) + 2 * (F.col("hubs") + F.col("_h")) + F.col("_hub")
    return rows.select("id", "n", "hub", F.col("pos").cast("long").alias("pos"), block.alias("block"))


def _walked(least: int):
    """One block: rows (pos, k, n, free, ready), a row for each node and neighbour or itself."""
    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["pos", "k"], kind="stable")
        pos, k, n, free, ready = (part[c].to_numpy() for c in ("pos", "k", "n", "free", "ready"))
        starts = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
        known = ready.astype(bool)
        taken, barred, out = set(), set(), []
        k, n, free = k.tolist(), n.tolist(), free.tolist()
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(pos)]):
            node, near = int(pos[start]), k[start:end]
            own = near.index(node)
            if free[start + own] and node not in taken:
                if not known[start:end].all() or not barred.isdisjoint(near):
                    barred.update(near)
                    continue
                at = [i for i in range(start, end) if free[i] and k[i] not in taken]
                if sum(n[i] for i in at) >= least:
                    out += [(k[i], node) for i in at]
                    taken.update(k[i] for i in at)
            out.append((node, None))
        return pd.DataFrame({"pos": np.array([p for p, _ in out], np.int64), "leader": pd.array([v for _, v in out], "Int64")})

    return walk


def greedy(nodes: DataFrame, pairs: DataFrame, least: int, rounds: list[int] | None = None, many: int | None = None) -> DataFrame:
    """(id, leader) of the nodes that are gathered: nodes (id, first, n) of links (a, b), each once,
    by (first, id); a free node leads if it and its free neighbours count ``least`` or more by their
    n. Nodes without a link are left out. ``rounds`` is told how many nodes were open, round by
    round; ``many``: about how many nodes there are, if that is known."""
    placed_nodes = materialize(_in_blocks(nodes, pairs, many), "walk_nodes")
    at = placed_nodes.select("id", "pos", "block", "hub")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    arcs = both.join(at.withColumnRenamed("id", "a"), "a").join(at.select(F.col("id").alias("b"), F.col("pos").alias("k")), "b").select("pos", "block", "hub", "k")
    open_ = materialize(arcs.unionByName(at.select("pos", "block", "hub", F.col("pos").alias("k"))), "walk_links")
    state = placed_nodes.select("pos", "n", F.lit(None).cast("long").alias("leader"))
    left = open_.filter("pos = k").count()
    while left:
        if rounds is not None:
            rounds.append(left)
        nearest = open_.groupBy("k").agg(F.min("block").alias("least_block"))
        seen = nearest.join(state.select(F.col("pos").alias("k"), "n", F.col("leader").isNull().alias("free")), "k")
        rows = open_.join(seen, "k").select("pos", "block", "hub", "k", "n", "free", (F.col("least_block") == F.col("block")).alias("ready"))
        told = rows.filter("NOT hub").select("pos", "block", "k", "n", "free", "ready").groupBy("block").applyInPandas(_walked(least), "pos long, leader long")
        found = [told]
        if any(r["hub"] for r in open_.select("hub").distinct().collect()):  # true, false
            hubs = rows.filter("hub")
            sums = hubs.groupBy("pos").agg(F.min("ready").alias("ready"), F.sum(F.when(F.col("free"), F.col("n"))).alias("total"), F.max((F.col("k") == F.col("pos")) & F.col("free")).alias("free"))
            sums = materialize(sums.filter("ready OR NOT free"), "walk_hubs")
            leads = F.broadcast(sums.filter((F.col("total") >= least) & F.col("free")).select("pos"))  # a hub has BLOCK links or more: few do
            found += [sums.select("pos", F.lit(None).cast("long").alias("leader")), hubs.filter("free").join(leads, "pos").select(F.col("k").alias("pos"), F.col("pos").alias("leader"))]
        step = found[0]
        for more in found[1:]:
            step = step.unionByName(more)
        step = materialize(step, "walk_step")
        took = step.filter("leader IS NOT NULL").select("pos", F.col("leader").alias("_leader"))
        after = materialize(state.join(took, "pos", "left").select("pos", "n", F.coalesce("leader", "_leader").alias("leader")), "walk_states")
        decided = step.filter("leader IS NULL").select("pos")
        left -= decided.count()
        still = materialize(open_.join(decided, "pos", "left_anti"), "walk_links") if left else open_
        discard(state, step, *[open_] * (still is not open_))
        state, open_ = after, still
    led = state.filter("leader IS NOT NULL").join(at.select("pos", "id"), "pos")
    out = materialize(led.join(at.select(F.col("pos").alias("leader"), F.col("id").alias("leader_id")), "leader").select("id", F.col("leader_id").alias("leader")), "walk_leaders")
    discard(placed_nodes, state, open_)
    return out
