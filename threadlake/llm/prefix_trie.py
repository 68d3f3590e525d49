"""The prefix trie of conversations, built by cutting sequences at half depth (the recursion of van Emde Boas).

A piece is a sequence of turns below a named node of the trie, in which `weight` conversations agree.
Pieces are cut at half their depth: the prefixes at the cut get names (the smallest conversation that
has them), the distinct ones go on as the pieces of the upper trie, and what follows goes on as the
lower forests, keyed by those names. All pieces of a level are cut in one pass, upper and lower ones
alike, so after log2(depth) passes a piece is one turn below a named node: a node of the trie.

Totals of subtrees go back the same way: forests of depth d hang off the last nodes of tries of depth d,
and are added to all of these nodes' ancestors within the trie, doubling d.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.common import discard, materialize

HEADS, GROUP = 6, 100
#: Ids of one text row on their way to a digest.
PACK = 4096


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): an array of (digest, chars) in order of turn, null first; turns of one number by digest.

    A turn's digest is of role and text, null counting as empty; texts themselves aren't shuffled.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    each = conversations.where("conv_id is not null").select("conv_id", F.struct(F.col("turn").isNotNull().alias("o"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).alias("t"))
    return each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(F.unhex(x["digest"]).alias("digest"), x["chars"].alias("chars"))).alias("turns"))


def with_shared_heads(convs: DataFrame, heads: int = HEADS, group: int = GROUP) -> DataFrame:
    """(conv_id, turns): the first h turns of the first conversation of its group of ids, then its own after its first h.

    h is the CRC-32 of the id in decimal, modulo `heads`; where the group's first is absent its part is empty.
    """
    c = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")).withColumn("g", F.col("conv_id") - F.col("conv_id") % group)
    first = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("g"), F.slice("turns", 1, heads).alias("head"))
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(F.slice("turns", 1, 0))
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.slice("turns", 1, 0)), 1, F.greatest("h", F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    return c.join(first, "g", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _cut(pieces: DataFrame, half: int) -> DataFrame:
    """Pieces of up to 2 * half turns into pieces of up to `half`.

    A piece that is `own` ends where its conversation does; without turns it says that the conversation ends at its node.
    Prefixes that conversations have in common are pieces that aren't.
    """
    p = pieces.withColumn("key", F.when(F.size("turns") >= half, F.sha2(F.aggregate(F.slice("turns", 1, half), F.lit(b""), lambda a, x: F.concat(a, x["digest"])), 256)))
    whole = ["depth", "forest", "key"]
    named = p.where("key is not null").groupBy(*whole).agg(F.min("conv_id").alias("name"), F.sum("weight").alias("all_"), F.first(F.slice("turns", 1, half)).alias("upper"))
    upper = named.select("depth", "forest", F.col("name").alias("conv_id"), F.col("all_").alias("weight"), F.lit(False).alias("own"), F.col("upper").alias("turns"))
    longer = p.where((F.size("turns") > half) | (F.size("turns") == half) & F.col("own")).join(named.select(*whole, "name"), whole)
    lower = longer.select((F.col("depth") + half).cast("int").alias("depth"), F.col("name").alias("forest"), "conv_id", "weight", "own", F.slice("turns", half + 1, half).alias("turns"))
    return p.where("key is null").select(*upper.columns).unionByName(upper).unionByName(lower)


def _totals(nodes: DataFrame, half: int) -> DataFrame:
    """(depth, conv_id, leaves, saved) of whole subtrees, by ever deeper tries, from nodes with their own leaves and saved."""
    at = ["depth", "conv_id"]
    path = nodes.select("depth", "conv_id", F.col("parent").alias("above"), F.array("conv_id").alias("path"))
    total = nodes.select("depth", "conv_id", "parent", "leaves", "saved")
    step = 1
    while step <= half:
        # the forests below depth d, an odd multiple of step, and the last `step` nodes on the way to each
        hung = total.where((F.col("depth") - 1) % (2 * step) == step).groupBy((F.col("depth") - 1).cast("int").alias("depth"), F.col("parent").alias("conv_id")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        ends = path.where(F.col("depth") % (2 * step) == step)
        grafts = hung.join(ends, at).select((F.col("depth") - step + 1).alias("top"), "leaves", "saved", F.posexplode("path").alias("i", "conv_id")).select((F.col("top") + F.col("i")).cast("int").alias("depth"), "conv_id", "leaves", "saved")
        more = grafts.groupBy(*at).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        new = total.join(more, at, "left").select(*at, "parent", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        upper = ends.select((F.col("depth") + step).cast("int").alias("depth"), F.col("conv_id").alias("above"), F.col("above").alias("higher"), F.col("path").alias("front"))
        longer = path.where(F.col("depth") % (2 * step) == 0).join(upper, ["depth", "above"]).select("depth", "conv_id", F.col("higher").alias("above"), F.concat("front", "path").alias("path"))
        old, total, path = (total, path), materialize(new), materialize(longer)
        if step > 1:
            for df in old:
                discard(df)
        step *= 2
    return total


def _digests(ends: DataFrame, pack: int = PACK) -> DataFrame:
    """(depth, node, ends_sha256) of (depth, node, conv_id): the digest of a node's ids in ascending order, comma-joined.

    Ids are sorted over all tasks and packed into texts of up to `pack`; a node's texts then pass through its digest one
    after the other, so a node with much of all ids is neither gathered nor one row.
    """
    dealt = ends.repartitionByRange("depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id").select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    packed = dealt.groupBy("depth", "node", "p", F.floor(F.col("i") / pack).alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"), F.min("conv_id").alias("least"))

    def run(batches):
        key, h = None, None
        for batch in batches:
            depth, node = [], []
            out = []
            for d, n, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (d, n) != key:
                    if key:
                        depth, node, out = [*depth, key[0]], [*node, key[1]], [*out, h.hexdigest()]
                    key, h = (d, n), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"depth": pa.array(depth, pa.int32()), "node": pa.array(node, pa.int64()), "ends_sha256": pa.array(out, pa.string())})
        if key:
            yield pa.RecordBatch.from_pydict({"depth": pa.array([key[0]], pa.int32()), "node": pa.array([key[1]], pa.int64()), "ends_sha256": [h.hexdigest()]})

    ordered = packed.select("depth", "node", "ids", "least").repartition("depth", "node").sortWithinPartitions("depth", "node", "least")
    return ordered.mapInArrow(run, "depth int, node long, ends_sha256 string")


def prefix_trie(convs: DataFrame, pack: int = PACK) -> DataFrame:
    """The trie of (conv_id long, turns array of (digest, chars)), a row a node: (conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256).

    A node is named by the smallest conversation that starts with it, and its depth. Conversations without turns end
    at the root. conv_id must be unique and not null; no rows give no nodes, not even a root. A conversation of any
    number of turns is one row of 24 bytes a turn.
    """
    pieces = materialize(convs.select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("forest"), "conv_id", F.lit(1).cast("long").alias("weight"), F.lit(True).alias("own"), "turns"))
    least = convs.sparkSession.createDataFrame([pieces.agg(F.min("conv_id"), F.count("*")).first()], "least long, n long").where("n > 0")
    longest = pieces.agg(F.max(F.size("turns"))).first()[0] or 0
    half = 1
    while 2 * half < longest:
        half *= 2
    cuts = [half >> i for i in range(half.bit_length())]
    for at in [*cuts, 1]:  # the last names the single turns
        new = materialize(_cut(pieces, at))
        discard(pieces)
        pieces = new
    turn = F.col("turns")[0]
    found = materialize(pieces.where(F.size("turns") > 0).select((F.col("depth") + 1).alias("depth"), "conv_id", F.col("forest").alias("parent"), F.col("weight").alias("n"), turn["chars"].alias("chars")))
    # a conversation's last piece names the node where it ends; the root has no name of its own before
    ends = pieces.where(F.size("turns") == 0).join(F.broadcast(least.select("least"))).select("depth", F.when(F.col("depth") == 0, F.col("least")).otherwise(F.col("forest")).alias("node"), "conv_id")
    digests = materialize(_digests(ends, pack))
    discard(pieces)
    children = found.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv_id")).agg(F.count("*").alias("children"))
    nodes = found.join(children, ["depth", "conv_id"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    nodes = materialize(nodes.withColumns({"leaves": (F.col("children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("chars")}))
    total = _totals(nodes, half).select("depth", "conv_id", "leaves", "saved")
    below = total.where("depth = 1").agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    root = F.broadcast(least).join(below).select(F.lit(0).alias("depth"), F.col("least").alias("conv_id"), F.lit(None).cast("long").alias("parent"), "n", "children", F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
    # nodes of depth 1 have the root above them, whatever stands for its name while it isn't known
    whole = nodes.drop("leaves", "saved", "chars").join(total, ["depth", "conv_id"]).join(F.broadcast(least.select("least"))).withColumn("parent", F.when(F.col("depth") == 1, F.col("least")).otherwise(F.col("parent"))).select(*root.columns)
    empty = hashlib.sha256(b"").hexdigest()
    all_ = whole.unionByName(root).join(digests.select("depth", F.col("node").alias("conv_id"), "ends_sha256"), ["depth", "conv_id"], "left")
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return all_.select("conv_id", long("depth", "depth"), long("parent", "parent_conv_id"), long("n", "n_convs"), long("children", "n_children"), long("leaves", "n_leaves"), long("saved", "saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
