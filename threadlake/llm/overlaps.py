"""Near copies by word overlap: components of documents whose shingle sets have a Jaccard similarity of LEAST or more.

Exact, by prefix filtering: under one order of all shingles (common ones last), two sets that are similar
enough share a shingle within their first n - ceil(LEAST * n) + 1 ones. At 0.8 the SimHashes of such pairs
differ in some ten of 64 bits, give or take three, so a search by few bits would lose most of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from threadlake.llm.common import discard, held, materialize, small_batches
from threadlake.llm.components import connected_components
from threadlake.llm.simhash import _LOW, keep_least, near_pairs, simhash

WORDS, LEAST = 5, 0.8
#: Shingles found this often in a sample of the documents (one of SHARE) come last in the order, COMMON at most.
SHARE, OFTEN, COMMON = 16, 4, 1 << 16
#: The members of a larger key are first compared with its hubs, and pairs that this connects are left out: in the first
#: round with the member of most such keys (the least edited copy), then each time with the first such one not connected to it.
#: Those still apart are joined by how they differ from the first hub, not by what they share. Only members near the hub take
#: part: its crowded keys that they have are one in NEAR of either prefix or more. In prose a run of common words is in
#: ever more texts as the corpus grows, and texts that have no more than that in common would differ in all of both.
CROWD, ROUNDS, NEAR = 64, 3, 8
#: Bits of the map that spares most texts without a candidate the shuffle; 16 MB. An exact join follows it.
MAP_BITS = 27
BATCH_BYTES = 2 << 20


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words (ASCII lower case); a text of fewer words is one run."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOW).split()
    if not w:
        return np.zeros(0, np.uint64)
    flat, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(flat)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(w) - words + 1].tolist()
    return np.unique(np.fromiter((h(flat[a:b]) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts)))


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def _beyond(n: Column, least: float) -> Column:
    """How many shingles of a set of n lie beyond its prefix."""
    return F.ceil(n * least - 1e-9) - 1


def _longs(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))


def _common(docs: DataFrame, text: str, words: int) -> np.ndarray:
    def all_of(batches):
        held(("overlaps",), list)  # drops another stage's model
        for batch in small_batches(batches, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([_longs([shingles(t, words) for t in batch.column(0).to_pylist()])], ["s"])

    some = docs.where(F.pmod(F.xxhash64(text), F.lit(SHARE)) == 0).select(text).mapInArrow(all_of, "s array<long>")
    often = some.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "s").limit(COMMON)
    return np.sort(often.toPandas()["s"].to_numpy(dtype=np.int64).view(np.uint64))


def _bit_map(nodes: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """Which low bits the nodes have: 2**bits bits whatever the number of nodes."""
    low = nodes.select((F.col("node").bitwiseAND(F.lit((1 << bits) - 1)) + 1).alias("p"))  # positions of a bucket count from 1
    rows = low.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    out = np.zeros((1 << bits) >> 3, np.uint8)
    for k, m in rows:
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bytes(m), np.uint8)
    return out


def _sets(docs: DataFrame, text: str, words: int, nodes: DataFrame) -> DataFrame:
    """(node, set) of the wanted nodes, each once."""
    shared = docs.sparkSession.sparkContext.broadcast(_bit_map(nodes))

    def sets_of(batches):
        held(("overlaps",), list)
        wanted = shared.value
        for batch in small_batches(batches, BATCH_BYTES):
            got = [(_node(s), s) for s in (shingles(t, words) for t in batch.column(0).to_pylist())]
            got = [(k, s) for k, s in got if wanted[(k & ((1 << MAP_BITS) - 1)) >> 3] >> (k & 7) & 1]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), _longs([s for _, s in got])], ["node", "set"])

    every = docs.select(text).mapInArrow(sets_of, "node long, set array<long>")
    return every.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one, two = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    enough = both >= least * (F.size("set_a") + F.size("set_b") - both) - 1e-9
    return materialize(pairs.join(one, "a").join(two, "b").where(enough).select("a", "b"))


def _apart(rows: DataFrame) -> DataFrame:
    """Of rows (hub, node, c, n, t, s), with `df`, `most` and `need`: what of a node's shingles another node of its hub has, where that may be enough.

    need is how many of them it must share with any node of another component at least. The rows given are deleted.
    """
    shared = rows.drop("df", "most", "need").withColumn("df", F.count("*").over(Window.partitionBy("hub", "s"))).where("df > 1")
    shared = materialize(shared.withColumn("most", F.count("*").over(Window.partitionBy("hub", "node"))))
    least_t = shared.groupBy("hub", "c").agg(F.min("t").alias("t"))
    one = least_t.groupBy("hub").agg(F.min(F.struct("t", "c")).alias("one"))
    two = least_t.join(one, "hub").groupBy("hub", "one").agg(F.min(F.when(F.col("c") != F.col("one.c"), F.col("t"))).alias("two"))
    other = F.when(F.col("c") == F.col("one.c"), F.col("two")).otherwise(F.col("one.t"))
    need = F.greatest(F.lit(1), F.ceil((F.col("t") + other) / 2 - 1e-9))
    out = materialize(shared.join(two, "hub").withColumn("need", need).where("most >= need").drop("one", "two"))
    for done in (rows, shared):
        discard(done)
    return out


def _apart_links(groups: DataFrame, links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links between nodes of one hub that are not in one component, by what tells them from the hub.

    Let D be the shingles that a set has and the hub has not, or the other way round, and t its size less the set's
    by (1 - least) / (1 + least). Sets x and y are similar enough just where they share (t(x) + t(y)) / 2 of their D or more.
    So what all copies of one text have in common is no key, and an edit that no other copy has finds nothing. One of
    two nodes in different components is not linked to the hub, so its t is large and (t(x) + t(y)) / 2 above 0.
    """
    found = materialize(connected_components(links))
    placed = groups.join(found, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("c"))
    own, hubs = sets.select("node", "set"), sets.select(F.col("node").alias("hub"), F.col("set").alias("_hub"))
    apart = F.concat(F.array_except("set", "_hub"), F.array_except("_hub", "set"))
    rows = placed.join(own, "node").join(hubs, "hub").select("hub", "node", "c", F.size("set").alias("n"), apart.alias("d"))
    rows = materialize(rows.select("hub", "node", "c", "n", (F.size("d") - F.col("n") * ((1 - least) / (1 + least))).alias("t"), F.explode("d").alias("s")))
    some = _apart(_apart(rows))  # again, without the nodes that went
    at = F.row_number().over(Window.partitionBy("hub", "node").orderBy("df", "s"))
    keyed = materialize(some.withColumn("at", at).where(F.col("at") <= F.col("most") - F.col("need") + 1))
    one, two = (keyed.select("hub", "s", F.struct("node", "c", "n", "t", "most", "at").alias(name)) for name in "xy")
    x, y = F.col("x"), F.col("y")
    need = F.ceil((x["t"] + y["t"]) / 2 - 1e-9)
    near = (F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * least - 1e-9) & (x["most"] - x["at"] + 1 >= need) & (y["most"] - y["at"] + 1 >= need)
    pairs = materialize(one.join(two, ["hub", "s"]).where((x["c"] < y["c"]) & near).select(x["node"].alias("a"), y["node"].alias("b")).distinct())
    out = _verified(pairs, sets, least)
    for done in (found, some, keyed, pairs):
        discard(done)
    return out


def _star_links(members: DataFrame, docs: DataFrame, text: str, words: int, least: float) -> tuple[DataFrame, DataFrame | None] | None:
    """(rows, links): the rows of crowded keys, and all links that join components between those near one hub; None without such keys.

    Found with their hubs, over ROUNDS rounds, then among those left. Rows have the hub of their key and whether their node is near it.
    """
    same, alike = Window.partitionBy("key"), Window.partitionBy(F.col("hub.node"), "node")
    crowd = members.where(F.col("m") > CROWD).select("key", "before", "at", "own", *SET)
    crowd = crowd.withColumn("hub", F.max(F.struct("own", *SET)).over(same))
    prefix = F.greatest(*(n - _beyond(n, least) for n in (F.col("n"), F.col("hub.n"))))
    sizes = 2 * F.least("n", F.col("hub.n")) >= F.greatest("n", F.col("hub.n"))
    near = (F.col("hub.node") == F.col("node")) | (sizes & (NEAR * F.count("*").over(alike) >= prefix))
    crowd = materialize(crowd.withColumn("near", near))
    if crowd.isEmpty():
        discard(crowd)
        return None
    may = _possible(F.struct(*SET), F.col("hub"), least)
    groups = materialize(crowd.where(F.col("near") & (F.col("hub.node") != F.col("node"))).select(F.col("hub.node").alias("hub"), "node", may.alias("may")).distinct())
    if groups.isEmpty():
        discard(groups)
        return crowd, None
    nodes = materialize(groups.select(F.explode(F.array("hub", "node")).alias("node")).distinct())
    sets = materialize(_sets(docs, text, words, nodes))
    links = _verified(groups.where("may").select(F.col("hub").alias("a"), F.col("node").alias("b")), sets, least)
    close = materialize(crowd.join(nodes, "node", "left_semi").select("key", "own", *SET))
    for _ in range(ROUNDS - 1):
        found = materialize(connected_components(links))
        placed = close.join(found, "node", "left").withColumn("c", F.coalesce("component", "node"))
        seat = F.struct("own", *SET, "c")
        placed = placed.withColumn("hub", F.max(seat).over(same))
        placed = placed.withColumn("hub", F.max(F.when(F.col("c") != F.col("hub.c"), seat)).over(same))
        pairs = placed.where((F.col("c") != F.col("hub.c")) & _possible(F.struct(*SET), F.col("hub"), least)).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
        pairs = materialize(pairs)
        links = links.unionByName(_verified(pairs, sets, least))
        for done in (found, pairs):
            discard(done)
    links = links.unionByName(_apart_links(groups, links, sets, least))
    for done in (nodes, groups, sets, close):
        discard(done)
    return crowd, links


#: Of a set: its hash, its size, where its prefix ends in the order, and how many shingles of its prefix are keys that others have.
SET = ["node", "n", "end", "keys"]


def _of_first(a: Column, b: Column, value) -> Column:
    """value of the set whose prefix ends first in the order; the larger value where they end together."""
    x, y = value(a), value(b)
    return F.when(a["end"] < b["end"], x).when(a["end"] > b["end"], y).otherwise(F.greatest(x, y))


def _needed(a: Column, b: Column, least: float) -> Column:
    """How many shingles the sets must share to be similar enough."""
    return F.ceil((a["n"] + b["n"]) * (least / (1 + least)) - 1e-9)


def _possible(a: Column, b: Column, least: float) -> Column:
    """Whether the sets may be similar enough, by their sizes and by what the one whose prefix ends first can share.

    What of that prefix lies in the other set lies in the other's prefix, so it is no more than the keys of either.
    """
    sizes = F.least(a["n"], b["n"]) >= F.greatest(a["n"], b["n"]) * least - 1e-9
    return sizes & (_of_first(a, b, lambda s: _beyond(s["n"], least)) + F.least(a["keys"], b["keys"]) >= _needed(a, b, least))


def _met(one: DataFrame, two: DataFrame, least: float) -> DataFrame:
    """(a, b, few) of sets of different components that meet at the first key they share: a of `one` is the larger, and few is how many shingles their prefixes must share.

    From that key on each set has n - at shingles, and `past` of those before it may be shared too. The smaller one
    meets larger ones only, so its key must come early.
    """
    n, names = F.col("n"), [*SET, "c", "before", "at", "past"]
    early = F.col("past") + n - F.col("at") >= F.ceil(n * (2 * least / (1 + least)) - 1e-9)
    x, y = F.col("x"), F.col("y")
    first = x["before"].isNull() | y["before"].isNull() | (x["before"] != y["before"])
    rest = F.least(x["past"], y["past"]) + F.least(x["n"] - x["at"], y["n"] - y["at"]) >= _needed(x, y, least)
    larger = (y["n"] < x["n"]) | ((y["n"] == x["n"]) & (y["node"] < x["node"]))
    met = one.select("key", F.struct(*names).alias("x")).join(two.where(early).select("key", F.struct(*names).alias("y")), "key")
    beyond = _of_first(x, y, lambda s: _beyond(s["n"], least))
    met = met.where(larger & (x["c"] != y["c"]) & first & rest & _possible(x, y, least))
    return met.select(x["node"].alias("a"), y["node"].alias("b"), (_needed(x, y, least) - beyond).alias("few"))


def _print_links(prints: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) between sets whose texts' SimHashes are linked: each set with the least one of its fingerprints' component."""
    pairs = near_pairs(prints.select("fp").distinct(), bits)
    found = materialize(connected_components(pairs).select(F.col("node").alias("fp"), "component"))
    placed = materialize(prints.select("fp", "node").distinct().join(found, "fp", "left").select("node", F.coalesce("component", "fp").alias("root")))
    first = placed.groupBy("root").agg(F.min("node").alias("a"))
    return materialize(placed.join(first, "root").where("a <> node").select("a", F.col("node").alias("b")).distinct())


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST, bits: int | None = None) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id reachable over links of `least` or more.

    With bits, SimHashes that differ in so many bits or fewer are links too, found by simhash.near_pairs.

    Null, empty and wordless texts are alike. Rows with a null doc_id get the component's smallest id that
    isn't null; repeated rows are in one component; no rows give none. Texts of any length are taken
    whole: a set grows with its text, and no more than a slice of a batch is cut into shingles at once.
    """
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, text, words))

    def prints_of(batches):
        held(("overlaps",), list)
        last = common.value
        for batch in small_batches(batches, BATCH_BYTES):
            nodes, counts, ends, prefixes, prints = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t, words)
                late = np.isin(s, last, assume_unique=True)
                n = len(s)
                nodes.append(_node(s))
                counts.append(n)
                prefix = np.concatenate((s[~late], s[late]))[: n - int(np.ceil(n * least - 1e-9)) + 1 if n else 0]
                prefixes.append(prefix)
                prints.append(None if bits is None else simhash(t))
                ends.append(int(len(prefix) > n - late.sum()) << 62 | int(prefix[-1]) >> 2 if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(counts, pa.int32()), pa.array(ends, pa.int64()), _longs(prefixes), pa.array([p if p is None or p < 1 << 63 else p - (1 << 64) for p in prints], pa.int64())], ["doc_id", "node", "n", "end", "prefix", "fp"])

    kind = StructType([StructField("doc_id", docs.schema[key].dataType), StructField("node", LongType()), StructField("n", IntegerType()), StructField("end", LongType()), StructField("prefix", ArrayType(LongType())), StructField("fp", LongType())])
    prints = materialize(docs.select(key, text).mapInArrow(prints_of, kind))
    nodes = prints.select("node", "n", "end", "prefix").dropDuplicates(["node"])
    same, own = Window.partitionBy("key"), Window.partitionBy("node")
    keyed = nodes.select("node", "n", "end", F.posexplode("prefix").alias("at", "key"))
    twice = keyed.select("key", "node", "n", "end", "at", F.count("*").over(same).alias("m")).where("m > 1")
    crowded, order = F.when(F.col("m") > CROWD, 1), own.orderBy("at")
    # the key before in a set's prefix: two sets that have one key before met there, but those of a key of few only at another such
    before = F.when((F.col("m") > CROWD) | (F.lag("m").over(order) <= CROWD), F.lag("key").over(order))
    past = F.when(F.col("m") <= CROWD, F.count(crowded).over(order)).otherwise(0)
    members = materialize(twice.select("key", "m", "node", "n", "end", "at", F.count("*").over(own).alias("keys"), F.count(crowded).over(own).alias("own"), before.alias("before"), past.alias("past")))
    # sets with a key of few in common meet at the first of these; others share crowded keys only, and those near the hub of one are linked already
    crowd, links = _star_links(members, docs, text, words, least) or (None, None)
    rows = [members.where(F.col("m") <= CROWD).select("key", "before", "at", "past", *SET, F.lit(True).alias("near"))]
    if crowd is not None:
        rows.append(crowd.select("key", "before", "at", F.lit(0).cast("long").alias("past"), *(F.col("own").alias("keys") if c == "keys" else c for c in SET), "near"))
    if links is not None:
        found = materialize(connected_components(links))
    tables = []
    for part in rows:
        part = part.withColumn("c", F.col("node")) if links is None else part.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        tables.append(materialize(part.withColumn("mixed", F.min("c").over(same) != F.max("c").over(same)).where("mixed").drop("mixed")))
    met = _met(tables[0], tables[0], least)
    if crowd is not None:
        far = tables[1].where(~F.col("near"))
        met = met.unionByName(_met(tables[1], far, least)).unionByName(_met(far, tables[1].where("near"), least))
    few = materialize(met.distinct())
    # shared shingles lie in both prefixes, or beyond the prefix that ends first
    ahead = [nodes.select(F.col("node").alias(c), F.col("prefix").alias(f"prefix_{c}")) for c in "ab"]
    may = F.size(F.array_intersect("prefix_a", "prefix_b")) >= F.col("few")
    pairs = materialize(few.join(ahead[0], "a").join(ahead[1], "b").where(may).select("a", "b"))
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = materialize(_sets(docs, text, words, nodes))
    more = _verified(pairs, sets, least)
    links = more if links is None else links.unionByName(more)
    if bits is not None:
        links = links.unionByName(_print_links(prints, bits))
    for done in (members, *tables, few, pairs, nodes, sets, *(() if crowd is None else (crowd,))):
        discard(done)
    linked = connected_components(links)
    first = materialize(prints.groupBy("node").agg(F.min("doc_id").alias("first")))
    roots = first.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("root"), "first")
    smallest = materialize(roots.groupBy("root").agg(F.min("first").alias("component_id")))
    named = materialize(roots.join(smallest, "root").select("node", "component_id"))
    return prints.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST, bits: int | None = None) -> DataFrame:
    """As simhash.drop_near_duplicates, over the components of near_copies."""
    return keep_least(docs, near_copies(docs, key, text, words, least, bits), key, text)
