"""Sharding by a k-d tree over document metadata. DataFrame operations only.

Each node is cut at the weighted median along its widest dimension; the tree ends at the wanted
number of leaves. Medians come from histograms that are refined around the crossing, so a round sends
at most 1024 sums a node to the driver, whatever the number of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.common import materialize

#: Bits of a dimension's value, of the text's checksum and of the id's hash in a coordinate, high to low.
BITS = 20
ROUND_BITS = 10
#: A cut this near, as a share of a leaf, is not refined further; nor is one between groups of equal texts that is this near.
NEAR, NEAR_GROUPS = 0.001, 0.01
OVERHEAD = 16


def metadata(docs: DataFrame, dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32 and raw dimensions d0, d1, ...: log size and a hash of each column of dims.

    Copies of a text take the metadata of the least of them, so that no cut of a dimension parts them.
    Null texts have no bytes, null metadata is the empty string.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + OVERHEAD).cast("long")
    named = [F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) for c in dims if c in docs.columns]
    one = materialize(docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"), F.struct(F.lit(0), *named).alias("said")))
    copies = one.groupBy("group").agg(F.min("said").alias("least"), F.max("said").alias("most")).where("least <> most").select("group", "least")
    both = one.join(materialize(copies), "group", "left").withColumn("said", F.coalesce("least", "said"))
    raw = [F.log2("size"), *(F.col("said")[f"col{i + 2}"].cast("double") for i in range(len(named)))]
    return both.select("doc_id", "size", "text_crc32", *(r.alias(f"d{i}") for i, r in enumerate(raw)))


def _coordinates(meta: DataFrame) -> tuple[DataFrame, int]:
    """c0, c1, ... instead of d0, d1, ...: value, checksum and id hash in one whole number, so ties are cut between groups of equal texts first."""
    n = sum(c[0] == "d" and c[1:].isdigit() for c in meta.columns)
    low, high = F.min, F.max
    ends = meta.agg(*(f(f"d{i}").alias(f"{k}{i}") for i in range(n) for k, f in (("a", low), ("z", high)))).first()
    tie = F.shiftleft(F.shiftright("text_crc32", 32 - BITS), BITS) + F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS)
    top = (1 << BITS) - 1
    cols = []
    for i in range(n):
        a, z = ends[f"a{i}"] or 0.0, ends[f"z{i}"] or 0.0
        scaled = F.least(F.lit(top), F.floor((F.col(f"d{i}") - a) / (z - a) * top).cast("long")) if z > a else F.lit(0)
        cols.append((F.shiftleft(scaled.cast("long"), 2 * BITS) + tie).alias(f"c{i}"))
    return meta.select("doc_id", "size", "text_crc32", *cols), n


class Tree:
    """Nodes by number: leaves wanted below, dimension, cut, and the numbers of both sides, -1 for a leaf."""

    def __init__(self, leaves: int, n_dims: int):
        self.n_dims, self.k, self.dim, self.cut, self.left, self.right, self.depth = n_dims, [leaves], [0], [0], [-1], [-1], 0

    def coordinates(self) -> Column:
        return F.array(*(f"c{i}" for i in range(self.n_dims)))

    def node(self) -> Column:
        """The number of the leaf that a row falls to."""

        def step(node: Column, _: Column) -> Column:
            left = F.get(F.lit(self.left), node)
            value = F.get(self.coordinates(), F.get(F.lit(self.dim), node))
            return F.when(left < 0, node).when(value < F.get(F.lit(self.cut).cast("array<long>"), node), left).otherwise(F.get(F.lit(self.right), node))

        return F.aggregate(F.lit([0] * self.depth).cast("array<int>"), F.lit(0), step) if self.depth else F.lit(0)

    def split(self, node: int, dim: int, cut: int) -> None:
        k = self.k[node]
        self.dim[node], self.cut[node], self.left[node], self.right[node] = dim, cut, len(self.k), len(self.k) + 1
        self.k += [k // 2, k - k // 2]
        for x, v in ((self.dim, 0), (self.cut, 0), (self.left, -1), (self.right, -1)):
            x += [v, v]

    def shards(self, node: int = 0) -> list[int]:
        """The leaves from left to right."""
        return [node] if self.left[node] < 0 else self.shards(self.left[node]) + self.shards(self.right[node])


def build_tree(points: DataFrame, n_dims: int, leaves: int) -> Tree:
    tree = Tree(leaves, n_dims)
    going = [0] if leaves > 1 else []
    while going:
        at = points.withColumn("node", tree.node()).where(F.col("node").isin(going))
        ends = [x for i in range(n_dims) for x in (F.min(f"c{i}").alias(f"a{i}"), F.max(f"c{i}").alias(f"z{i}"))]
        spread = {r["node"]: r for r in at.groupBy("node").agg(F.sum("size").alias("size"), *ends).collect()}
        state = {}
        for i in going:
            r = spread.get(i)
            dim = max(range(n_dims), key=lambda d: (r[f"z{d}"] >> 2 * BITS) - (r[f"a{d}"] >> 2 * BITS)) if r else 0
            state[i] = {"dim": dim, "lo": 0, "below": 0, "target": (r["size"] if r else 0) * (tree.k[i] // 2) / tree.k[i], "leaf": (r["size"] if r else 0) / tree.k[i], "cut": None if r else 0}
        for shift in range(3 * BITS - ROUND_BITS, -1, -ROUND_BITS):
            rest = [i for i in going if state[i]["cut"] is None]
            if not rest:
                break
            dims, lows = [0] * len(tree.k), [0] * len(tree.k)
            for i in rest:
                dims[i], lows[i] = state[i]["dim"], state[i]["lo"]
            x = F.get(tree.coordinates(), F.get(F.lit(dims), F.col("node"))) - F.get(F.lit(lows).cast("array<long>"), F.col("node"))
            binned = at.where(F.col("node").isin(rest)).select("node", "size", x.alias("x")).where(f"x >= 0 and x < {1 << (shift + ROUND_BITS)}")
            sums: dict = {i: {} for i in rest}
            for node, b, v in binned.groupBy("node", F.shiftright("x", shift).alias("b")).agg(F.sum("size")).collect():
                sums[node][b] = v
            for i in rest:
                s, v, b = state[i], 0, 0
                for b, v in sorted(sums[i].items()):
                    if s["below"] + v > s["target"] or b == max(sums[i]):
                        break
                    s["below"] += v
                over, under = s["below"] + v - s["target"], s["target"] - s["below"]
                lo, hi = s["lo"] + (b << shift), s["lo"] + (b + 1 << shift)
                s["lo"] = lo
                if shift == 0 or min(abs(over), under) <= s["leaf"] * (NEAR_GROUPS if shift == BITS else NEAR):
                    s["cut"] = hi if abs(over) < under else lo
        first = len(tree.k)
        for i in going:
            tree.split(i, state[i]["dim"], state[i]["cut"])
        tree.depth += 1
        going = [i for i in range(first, len(tree.k)) if tree.k[i] > 1]
    return tree


def shard_documents(docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None, dims: tuple[str, ...] = ("lang", "source"), slot_rows: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Give the number of shards, or the bytes of a leaf. Sizes are near equal (law `bytes`): off by part
    of a document at each cut. Groups of equal texts part only where a cut must pass through them to keep
    sizes within NEAR_GROUPS of a leaf. Rows that agree in all columns stay together, nulls too. slot
    counts each shard's rows from 0; ties go by doc_id and checksum. A text larger than a leaf fills one
    of its own; repeated rows count each; other columns are ignored; no rows give none. The tree itself,
    a few numbers a leaf, is built on the driver: meant for thousands of leaves.
    """
    meta = materialize(metadata(docs, dims))
    n_rows, total = meta.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    leaves = shards or max(1, math.ceil(total / target_bytes))
    points, n_dims = _coordinates(meta)
    tree = build_tree(points, n_dims, leaves)
    order = tree.shards()
    place = {node: k for k, node in enumerate(order)}
    number = [place.get(i, -1) for i in range(len(tree.k))]
    # Slots: rows are dealt to parts of a shard by a hash, numbered there, and moved by the rows of the parts before.
    parts = max(1, math.ceil(n_rows / leaves / slot_rows))
    put = points.select("doc_id", "size", "text_crc32", F.get(F.lit(number), tree.node()).cast("int").alias("shard")).withColumn("part", F.col("shard") * F.lit(parts) + F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int"))
    counts = put.groupBy("shard", "part").agg(F.count("*").alias("n"))
    every = docs.sparkSession.range(leaves * parts).select(F.col("id").cast("int").alias("part")).join(counts, "part", "left").select("part", (F.floor(F.col("part") / parts)).cast("int").alias("s"), F.coalesce("n", F.lit(0)).alias("n"))
    ahead = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = every.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "text_crc32")) - 1
    return put.withColumn("own", own).join(start, "part").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("own") + F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
