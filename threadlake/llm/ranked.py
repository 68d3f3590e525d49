"""Ranked lexical search: Block-Max MaxScore over shards of an inverted index, in whole-number scores.

Documents are read once for what of them the queries' terms match; lengths and document frequencies
of all documents follow from that. Each task then builds indexes of some documents after another:
lists of a term's documents in compressed blocks, each with its least and greatest document and its
greatest score. A query's lists stand in order of their greatest scores. Those whose documents could
still reach the k-th best score known are essential and give candidates; of the other lists a block
is decompressed only for candidates that may get there with the block's greatest score. The best k
of a task's shards are kept in one heap a query, and the heaps of all tasks are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.common import discard, held, materialize, small_batches

K = 10
#: Postings of one shard's index, and of one block of a list.
SHARD_POSTINGS, BLOCK = 1 << 21, 128
#: Bytes of query texts that one pass searches for.
PASS_BYTES = 64 << 20
#: Bytes of texts handled at once.
SLICE = 8 << 20
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_NONE = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z as a-z."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEPT).split()


def _gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Lists:
    """The inverted index of one shard: for each term its documents (ordinals, ascending) and counts, in compressed blocks."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, m: np.ndarray):
        order = np.argsort(term, kind="stable")  # documents come in ascending order
        term, doc, tf = term[order], doc[order].astype(np.int64), tf[order].astype(np.int64)
        gain = _gain(tf, m[doc])
        self.m, self.docs = m, len(m)
        names, starts = np.unique(term, return_index=True)
        ends = np.append(starts[1:], len(term))[: len(starts)]
        n_blocks = -(-(ends - starts) // BLOCK)
        at = np.repeat(starts, n_blocks) + BLOCK * (np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks))
        until = np.minimum(at + BLOCK, np.repeat(ends, n_blocks))
        self.best = np.maximum.reduceat(gain, at) if len(at) else gain
        self.last = doc[until - 1] if len(at) else doc
        self.blocks = [_packed(doc[a:z], tf[a:z]) for a, z in zip(at.tolist(), until.tolist())]
        first = np.cumsum(n_blocks) - n_blocks
        self.of = {t: (a, a + n) for t, a, n in zip(names.tolist(), first.tolist(), n_blocks.tolist())}

    def bound(self, t: int) -> int:
        return int(self.best[slice(*self.of[t])].max())

    def read(self, blocks: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Documents and gains of some blocks, in order."""
        some = [_unpacked(self.blocks[b]) for b in blocks]
        doc, tf = (np.concatenate([x[i] for x in some]) for i in (0, 1))
        return doc, _gain(tf, self.m[doc])


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(x.max())
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def _packed(doc: np.ndarray, tf: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """First document, gaps and counts, in as many bytes each as the block's largest needs."""
    return int(doc[0]), _narrow(np.diff(doc, prepend=doc[0])), _narrow(tf)


def _unpacked(block) -> tuple[np.ndarray, np.ndarray]:
    first, gaps, tf = block
    return first + np.cumsum(gaps, dtype=np.int64), tf.astype(np.int64)


def best_of(lists: Lists, query: list[tuple[int, int]], k: int, least: int, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of all that may be among the best k of (term, weight) pairs, where a score below `least` isn't.

    Scores are whole. Documents of lower scores than the k-th best of those returned may be missing.
    """
    known = sorted(((w * lists.bound(t), t, w) for t, w in query if w > 0 and t in lists.of), reverse=True)
    rest = np.append(np.cumsum([b for b, _, _ in known][::-1])[::-1], 0).tolist()
    score, j = np.zeros(lists.docs, np.int64), 0
    while j < len(known) and rest[j] >= max(1, least):  # an essential list: a document that only this and later ones have may do
        _, t, w = known[j]
        a, z = lists.of[t]
        use = w * lists.best[a:z] + rest[j + 1] >= least
        if j and not use.all():
            use[np.searchsorted(lists.last[a:z], np.flatnonzero(score), side="left").clip(max=z - a - 1)] = True
        doc, gain = lists.read((a + np.flatnonzero(use)).tolist()) if use.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        score[doc] += w * gain
        j += 1
        least = max(least, _kth(score, k))
    found = np.flatnonzero(score)
    for i in range(j, len(known)):
        _, t, w = known[i]
        a, z = lists.of[t]
        found = found[score[found] + rest[i] >= least]
        block = np.searchsorted(lists.last[a:z], found, side="left")
        beyond = block == z - a
        most = np.where(beyond, 0, w * lists.best[a:z][block.clip(max=z - a - 1)])
        stay = score[found] + most + rest[i + 1] >= least  # the others go before anything is decompressed
        found, block, beyond = found[stay], block[stay], beyond[stay]
        need = np.unique(block[~beyond])
        if stats is not None:
            stats["skipped"] = stats.get("skipped", 0) + z - a - len(need)
        if len(need):
            doc, gain = lists.read((a + need).tolist())
            at = np.searchsorted(doc, found).clip(max=len(doc) - 1)
            score[found] += np.where(doc[at] == found, w * gain[at], 0)
        least = max(least, _kth(score[found], k))
    return found, score[found]


def _kth(score: np.ndarray, k: int) -> int:
    some = score[score > 0]
    return int(np.partition(some, len(some) - k)[len(some) - k]) if len(some) >= k else 0


class Heap:
    """The best k of one query: greatest scores, of equal ones the least documents."""

    def __init__(self, k: int):
        self.k, self.doc, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, doc: np.ndarray, score: np.ndarray) -> None:
        doc, score = np.concatenate((self.doc, doc)), np.concatenate((self.score, score))
        order = np.lexsort((doc, -score))[: self.k]
        self.doc, self.score = doc[order], score[order]


def _matches(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with any term: how many they have, which of the vocabulary, and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def match(batches):
        held(("ranked",), list)
        ids = shared.value
        for batch in small_batches(batches, SLICE):
            key, n, terms, tfs = [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = terms_of(text)
                if w:
                    seen: dict[int, int] = {}
                    for t in w:
                        i = ids.get(t)
                        if i is not None:
                            seen[i] = seen.get(i, 0) + 1
                    key.append(d), n.append(len(w)), terms.append(list(seen)), tfs.append(list(seen.values()))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(match, "doc_id long, n long, terms array<int>, tfs array<int>")


def _search_pass(docs: DataFrame, items: DataFrame, k: int, postings: int) -> DataFrame:
    terms: dict = {}
    for r in items.select("item_id", "text").where("text is not null").collect():
        terms.setdefault(r["item_id"], set()).update(terms_of(r["text"]))
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*terms.values())))} if terms else {}
    names = sorted(i for i, t in terms.items() if t)
    found = materialize(_matches(docs, vocabulary))
    n_docs, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r[0]: r[1] for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    weight = {i: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for i, c in df.items()}
    queries = [sorted((vocabulary[t], weight[vocabulary[t]]) for t in terms[name] if vocabulary[t] in weight) for name in names]
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def search(batches):
        held(("ranked",), list)
        heaps, rows, size = [Heap(k) for _ in shared.value], [], 0

        def flush():
            table = pa.Table.from_batches(rows)
            key = table["doc_id"].fill_null(int(_NONE)).to_numpy()
            order = np.argsort(key, kind="stable")
            table, key = table.take(order), key[order]
            m = 10 + (90 * table["n"].to_numpy() * n_docs) // length
            t = table["terms"].combine_chunks()
            doc = np.repeat(np.arange(len(key)), np.diff(t.offsets.to_numpy()))
            lists = Lists(t.flatten().to_numpy(), doc, table["tfs"].combine_chunks().flatten().to_numpy(), m)
            for heap, query in zip(heaps, shared.value):
                d, s = best_of(lists, query, k, heap.least())
                heap.add(key[d], s)

        for batch in batches:
            rows.append(batch)
            size += len(batch.column(2).flatten()) + len(batch)
            if size >= postings:
                flush()
                rows, size = [], 0
        if rows:
            flush()
        item = np.repeat(np.arange(len(heaps), dtype=np.int32), [len(h.doc) for h in heaps])
        doc, score = (np.concatenate([getattr(h, x) for h in heaps]) if heaps else np.zeros(0, np.int64) for x in ("doc", "score"))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=doc == _NONE), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    each = materialize(found.mapInArrow(search, "item int, doc_id long, score long"))
    discard(found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    spark = docs.sparkSession
    keys = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {dict(items.dtypes)['item_id']}")
    return top.join(F.broadcast(keys), "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, pass_bytes: int = PASS_BYTES, postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, equal ones by doc_id.

    Items are searched for in passes of about `pass_bytes` of their text. Rows of one item_id are one item; an item
    without a term, or with null for an id, has no rows. Each row of docs is a document of its own; those without a
    doc_id come last among equals. Null and empty texts have no terms and count for nothing; texts of any length count
    whole. No documents give no rows. Other columns are ignored.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text").where("item_id is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // pass_bytes))
    out = None
    for i in range(n):
        part = _search_pass(docs, items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) if n > 1 else items, k, postings)
        out = out.unionByName(part) if out is not None else part
    return out
