"""SimHash near-duplicates: fingerprints, links found over pivot distance tables, and components.

Fingerprints within `bits` differing bits are linked. Reference fingerprints (pivots) differ from one
another in one band of bits each, so the distances to them, taken band by band, say what lies in the
band up to its distances. Two fingerprints within `bits` bits agree in all but `bits` of the bands, so
they meet under the distances of some choice of the other bands: these distance tuples are join keys.
A pair that meets is dropped when its distances to any of PIVOTS references differ by more than
`bits` (the triangle inequality), and what survives is verified.
"""

from __future__ import annotations

from itertools import combinations
from random import Random

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.common import discard, free_name, held, materialize
from threadlake.llm.components import connected_components

WORDS, SEED, BITS = 3, 42, 2
BANDS, PIVOTS = 6, 16
#: A key with more fingerprints than this is searched through one-bit neighbours instead of pairs.
BUCKET = 256
_LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M64 = (1 << 64) - 1


def simhash(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half the hashes of the shingles; 0 for no words."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOW).split()
    if not w:
        return 0
    flat, h = b" ".join(w), xxhash.xxh64_intdigest
    total, n, some = np.zeros(64, dtype=np.int64), max(1, len(w) - words + 1), 200_000
    if len(w) <= words:
        hashes = [[h(flat, seed)]]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
        ends = ends[words - 1 :].tolist()
        hashes = ([h(flat[a:b], seed) for a, b in zip(starts[i : i + some], ends[i : i + some])] for i in range(0, n, some))
    for part in hashes:
        total += np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def simhash_of(text: Column) -> Column:
    """The fingerprint's bits as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        held(("simhash",), list)  # drops another stage's model
        return pd.Series(np.array([simhash(t) for t in texts], dtype=np.uint64).view(np.int64))

    return prints(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bands(n: int = BANDS) -> list[int]:
    """n masks that part the 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def pivots(n: int = PIVOTS, seed: int = SEED) -> list[int]:
    """Reference fingerprints."""
    rng = Random(seed)
    return [rng.getrandbits(64) for _ in range(n)]


def band_references(mask: int) -> list[int]:
    """References that differ in one bit of the band each, besides the first: with the distances to all
    of them a band's content is known, d(x, r0) - d(x, r0 ^ bit) being 1 where x and r0 differ in the bit."""
    return [0, *(1 << i for i in range(64) if mask >> i & 1)]


def _distance(fp: Column, reference: int, mask: int = _M64) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(reference))).bitwiseAND(F.lit(_signed(mask))))


def _table(fp: Column, references: list[int]) -> list[Column]:
    """Distances to the references in longs of eight, a byte each."""
    longs = []
    for at in range(0, len(references), 8):
        packed = F.lit(0).cast("long")
        for i, r in enumerate(references[at : at + 8]):
            packed = packed.bitwiseOR(F.shiftleft(_distance(fp, r).cast("long"), 8 * i))
        longs.append(packed)
    return longs


def _band_table(fp: Column, mask: int) -> Column:
    """The distances to the band's references: the first, and a bit for each other telling which way it differs from it."""
    first, *rest = band_references(mask)
    d0 = _distance(fp, first, mask)
    steps = F.lit(0).cast("long")
    for i, r in enumerate(rest):
        steps = steps.bitwiseOR(F.shiftleft(((d0 - _distance(fp, r, mask) + 1) / 2).cast("long"), i))
    return F.xxhash64(d0, steps)


def near_pairs(prints: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between the distinct fingerprints fp that make the components of all links within `bits`.

    Keys with more than `bucket` fingerprints give, instead of their pairs, an edge from each to the
    least of those that share a one-bit neighbour, of which each has at most 65: exact for two bits.
    """
    if bits != 2:
        raise ValueError("the one-bit neighbours of crowded keys are exact for two bits")
    masks = _bands()
    fp = F.col("fp")
    tables = prints.select("fp", *(_band_table(fp, m).alias(f"band{i}") for i, m in enumerate(masks)))
    keys = [F.xxhash64(F.lit(n), *(F.col(f"band{i}") for i in c)) for n, c in enumerate(combinations(range(BANDS), BANDS - bits))]
    keyed = materialize(tables.select("fp", F.explode(F.array(*keys)).alias("key")))
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = materialize(full.where(F.col("n") > bucket).select("key"))
    few = materialize(full.where(F.col("n") <= bucket).select("key"))
    refs = pivots()
    side = keyed.join(few, "key", "left_semi").select("key", "fp", *(c.alias(f"t{i}") for i, c in enumerate(_table(fp, refs))))
    a, b = side.alias("a"), side.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
    near = F.lit(True)
    for t in range(-(-len(refs) // 8)):
        for i in range(min(8, len(refs) - 8 * t)):
            apart = F.shiftright(F.col(f"a.t{t}"), 8 * i).bitwiseAND(F.lit(255)) - F.shiftright(F.col(f"b.t{t}"), 8 * i).bitwiseAND(F.lit(255))
            near = near & (F.abs(apart) <= bits)
    pairs = met.where(near).where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    many = keyed.join(crowded, "key", "left_semi").select("fp").distinct()
    hubs = many.select("fp", F.explode(F.array(fp, *(fp.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))).alias("hub"))
    least = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    out = materialize(pairs.unionByName(hubs.join(least, "hub").where("a <> fp").select("a", F.col("fp").alias("b"))))
    for done in (keyed, crowded, few):
        discard(done)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id reachable over links of two bits or fewer.

    Null, empty and wordless texts have fingerprint 0 and are linked like any other. Equal texts and
    repeated rows are in one component. Rows with a null doc_id get the component's smallest id that
    isn't null. A text of any length is hashed whole, 200,000 shingles at a time; no rows give none;
    other columns are ignored.
    """
    prints = materialize(docs.select(F.col(key).alias("doc_id"), simhash_of(F.col(text)).alias("fp")))
    first = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = connected_components(near_pairs(first.select("fp")))
    roots = first.join(linked, first["fp"] == linked["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"), "first")
    least = materialize(roots.groupBy("root").agg(F.min("first").alias("component_id")))
    named = materialize(roots.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_least(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document of smallest doc_id of each component in found; of rows that share that id, one. Columns as they were.

    Rows without a doc_id stay: nothing tells which of a group they are.
    """
    name = free_name(docs, "component")
    kept = materialize(found.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct())
    nth = free_name(docs, "nth")
    one = Window.partitionBy(key).orderBy(F.xxhash64(text))
    stay = docs.join(kept, docs[key] == F.col(name), "left_semi").withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).drop(nth)
    return stay.unionByName(docs.where(F.col(key).isNull()))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document of smallest doc_id of each component of near_duplicates stays."""
    return keep_least(docs, near_duplicates(docs, key, text), key, text)
