"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that isn't that smallest one.

    edges: two columns of one orderable type, in any direction. Loops, repeats and edges with a null
    end are dropped; no edges give no rows. Each round groups by node with partial aggregation and
    joins the minima back, so a node with very many neighbours is split by the skew join.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    cur = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(cur)
    for _ in range(max_rounds if state[0] else 0):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialize(near.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = _state(nxt)
        discard(large)
        discard(cur)
        cur, same, state = nxt, after == state, after
        if same:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
