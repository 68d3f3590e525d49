"""Language-model scores: an n-gram trie in Elias-Fano coded levels, learned from the corpus and dealt over shards.

A level k holds, for each (k-1)-gram of the training text (its context, a node of the level before), the words
that follow it. A word is named by its rank among the successors of the context without its first word, so
names are small; with each context's names moved up by those before it, a whole level is one monotone
sequence, coded by Elias-Fano, with monotone pointers to where contexts begin. A node has its count, as
a coded running sum, and its smoothed probability in eight bits. A text's n-grams are looked up by a
search for the context and one among its successors.

No worker needs the whole trie: blocks of documents ask each level's shards for the distinct n-grams that
they have, in packed form. Shards count what training documents ask for, write their part of the level,
map it into memory and answer from it. Questions and answers are files, deleted once they are no longer read; what is
shuffled is where each shard's and block's part of them lies. A context that is itself frequent is dealt over several shards by successor.

The probability of a word: (count + PRIOR * shorter) / (context's count + PRIOR), where `shorter` is the
one given the context without its first word, down to (count + 0.1) / (N + 0.1 * (V + 1)).
"""

from __future__ import annotations

import io
import json
import uuid
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import delete_folder, discard, held, materialize, open_fs, read_file, shared_dir, small_batches, write_file

ORDER, PRIOR = 3, 4.0
#: Probabilities are stored as this many steps a factor of ten, from 0 to 255.
STEPS = 25
#: Tokens of a block of documents, and tokens a shard.
BLOCK_TOKENS, SHARD_TOKENS = 1 << 21, 1 << 20
#: Bytes of texts handled at once.
SLICE = 8 << 20
END, BOS = 0, 1
_LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: An answer is a stretch of a file that the shard has written for all blocks.
_ANSWER = "block string, shard int, file string, start long, size long, tokens long, words long"
#: A question is a stretch of the file that the block has written for all shards.
_ASKED = "shard int, block string, file string, start long, size long"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOW).split()


# Packed arrays


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the fewest bytes."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as planes of bytes, all lowest ones first, so that what is alike stands together."""
    out = io.BytesIO()
    np.savez(out, **{f"{k}:{x.dtype.str}": np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.copy() for k, x in arrays.items()})
    return zstandard.ZstdCompressor(level=3).compress(out.getvalue())


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data))) as z:
        return {k.split(":")[0]: np.ascontiguousarray(z[k].T).view(k.split(":")[1]).ravel() for k in z.files}


def steps(x: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Distinct whole numbers from 0, each as what it is beyond the one before: twice that, an odd number where it is less; 0 where none is there."""
    d = np.diff(x[there].astype(np.int64), prepend=-1)
    out = np.zeros(len(x), np.int64)
    out[there] = (d << 1) ^ (d >> 63)
    return out


def unstepped(z: np.ndarray) -> np.ndarray:
    """What steps was given, and -1 where none was there."""
    z = z.astype(np.int64)
    there = z > 0
    out = np.full(len(z), -1, np.int64)
    out[there] = np.cumsum((z[there] >> 1) ^ -(z[there] & 1)) - 1
    return out


def encode_monotone(v: np.ndarray) -> tuple[dict, bytes]:
    """Elias-Fano: (what to decode it with, bytes) of whole numbers in ascending order."""
    v = v.astype(np.uint64)
    n = len(v)
    low = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
    kind = ">u8" if low > 32 else ">u4" if low > 16 else ">u2" if low > 8 else ">u1"
    bits = np.unpackbits((v & np.uint64((1 << low) - 1)).astype(kind).view(np.uint8).reshape(n, -1), axis=1)[:, 8 * int(kind[2]) - low :] if low else np.zeros((n, 0), np.uint8)
    at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    upper[at] = 1
    lows, highs = np.packbits(bits.ravel()).tobytes(), np.packbits(upper).tobytes()
    return {"n": n, "low": low, "cut": len(lows), "size": len(lows) + len(highs)}, lows + highs


def decode_monotone(head: dict, data) -> np.ndarray:
    n, low = head["n"], head["low"]
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(np.unpackbits(raw[head["cut"] :]))[:n] - np.arange(n)
    v = at.astype(np.uint64) << np.uint64(low)
    if low:
        size = 8 if low > 32 else 4 if low > 16 else 2 if low > 8 else 1
        bits = np.zeros((n, 8 * size), np.uint8)
        bits[:, 8 * size - low :] = np.unpackbits(raw[: head["cut"]], count=n * low).reshape(n, low)
        v |= np.packbits(bits, axis=1).view(f">u{size}").ravel().astype(np.uint64)
    return v


# A shard of a level


def write_level(uri: str, context: np.ndarray, name: np.ndarray, counts: np.ndarray, code: np.ndarray) -> None:
    """Write nodes in order of (context, name)."""
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
    last = name[np.append(first[1:], len(name)) - 1] if len(first) else name
    base = np.cumsum(np.append(np.uint64(0), last[:-1] + np.uint64(1)), dtype=np.uint64) if len(first) else last
    if len(first) and float(last.astype(np.float64).sum() + len(last)) >= 2.0**63:
        raise ValueError("the names of a level's shard don't fit 63 bits; use more shards")
    size = np.diff(np.append(first, len(name)))
    parts = [encode_monotone(x) for x in (context[first], np.append(first, len(name)), name + np.repeat(base, size), np.cumsum(counts))]
    head = json.dumps([h for h, _ in parts]).encode()
    write_file(uri, len(head).to_bytes(4, "little") + head + b"".join(x for _, x in parts) + code.astype(np.uint8).tobytes())


def _mapped(uri: str):
    """The file's bytes, mapped into memory where it lies in a file system of this machine's."""
    fs, path = open_fs(uri)
    return pa.memory_map(path).read_buffer() if fs.type_name == "local" else pa.py_buffer(read_file(uri))


class Level:
    """One shard of a level, from its file."""

    def __init__(self, uri: str):
        data = memoryview(_mapped(uri))
        n = int.from_bytes(data[:4], "little")
        at, parts = 4 + n, []
        for head in json.loads(bytes(data[4 : 4 + n])):
            parts.append(decode_monotone(head, data[at : at + head["size"]]))
            at += head["size"]
        self.context, pointer, self.name, total = parts
        self.pointer, self.counts = pointer.astype(np.int64), np.diff(total, prepend=np.uint64(0)).astype(np.int64)
        self.code = np.frombuffer(data[at:], np.uint8)

    def find(self, context: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, or -1 where there is none; the context's first node) of each pair, in order of context."""
        if not len(self.context):
            return np.full(len(name), -1, np.int64), np.zeros(len(name), np.int64)
        c = np.searchsorted(self.context, context).clip(max=len(self.context) - 1)
        start, end = self.pointer[c], self.pointer[c + 1]
        base = np.where(start > 0, self.name[start - 1] + np.uint64(1), np.uint64(0))
        at = np.searchsorted(self.name, base + name).clip(max=len(self.name) - 1)
        there = (self.context[c] == context) & (at >= start) & (at < end) & (self.name[at] == base + name)
        return np.where(there, at, -1), start


@dataclass(frozen=True)
class Model:
    """Where the levels are, and what scoring needs besides: shards a level, how often a context occurs for each shard
    that its successors are dealt over, tokens and distinct words of the training text."""

    folder: str
    order: int
    shards: int
    part: int
    tokens: int = 0
    words: int = 0

    def level(self, k: int, shard: int) -> str:
        return f"{self.folder}/level-{k}-{shard}"


def quantised(lp: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-STEPS * lp), 0, 255).astype(np.uint8)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


# A block of documents


def _write_blocks(docs: DataFrame, folder: str, size: int) -> DataFrame:
    """(block, tokens, words) of blocks of documents (doc_id, text, train), written with their words as numbers."""

    def run(batches):
        held(("ngrams",), list)
        name = (f"{folder}/block-{uuid.uuid4().hex}" for _ in count())

        def new():
            return defaultdict(count(2).__next__), [], [], [], []

        def flush():
            at = next(name)
            keys = np.array([0, 1, *(x if (x := xxhash.xxh64_intdigest(w) >> 2) > BOS else x + 2 for w in known)], np.uint64)
            order = np.argsort(keys, kind="stable")  # a word's number is its key's place, so numbers stand in the order of the first level
            place = np.empty(len(keys), np.int64)
            place[order] = np.arange(len(keys))
            write_file(f"{at}.base", pack(keys=keys[order], ids=narrow(place[np.concatenate(parts)]), lengths=narrow(np.array(lengths)), train=np.array(train, bool), doc=np.array([d or 0 for d in doc], np.int64), null=np.array([d is None for d in doc], bool)))
            return {"block": at, "tokens": sum(lengths), "words": len(known)}

        out, (known, parts, lengths, train, doc) = [], new()
        for batch in small_batches(batches, SLICE):
            for d, text, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                w = words_of(text)
                ids = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
                parts.append(np.append(ids, END)), lengths.append(len(w) + 1), train.append(bool(t)), doc.append(d)
                if sum(lengths[-1:]) >= size or len(lengths) % 64 == 0 and sum(lengths) >= size:
                    out.append(flush())
                    known, parts, lengths, train, doc = new()
        if lengths:
            out.append(flush())
        yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.string()), ("tokens", pa.int64()), ("words", pa.int64())]))

    return docs.mapInArrow(run, "block string, tokens long, words long")


class Block:
    """A block's tokens and what the levels have answered so far, by token.

    Before each document stands BOS, which has no probability. `seen`, `node` and so on are of the n-gram of
    the level reached that ends at a token; -1 stands for an n-gram that the training text doesn't have.
    """

    def __init__(self, at: str, model: Model):
        base, self.model = unpack(read_file(f"{at}.base")), model
        lengths = base["lengths"].astype(np.int64)
        self.ends = np.cumsum(lengths + 1)
        self.first = self.ends - lengths - 1
        n = int(self.ends[-1])
        self.ids = np.full(n, END, np.int32)
        self.real = np.ones(n, bool)
        self.real[self.first] = False
        self.ids[self.real] = base["ids"]
        self.ids[self.first] = BOS
        self.train = np.repeat(base["train"], lengths + 1)
        self.lengths, self.doc, self.null, self.held = lengths, base["doc"], base["null"], ~base["train"]
        self.keys = base["keys"]
        self.k, self.local = 0, np.zeros(n, np.int32)

    def ask(self) -> dict[str, np.ndarray]:
        """The distinct n-grams of the next level that may be there: in order of (shard, context, name), with training counts."""
        s = np.uint64(self.model.shards)
        if self.k == 0:
            which, ones = np.arange(len(self.keys)), np.zeros(len(self.keys), np.uint64)
            context, name, of = ones, self.keys, ones
            counts = np.bincount(self.ids, self.train, len(self.keys)).astype(np.int64)
            total, prior, self.at, self.of = ones, np.zeros(len(which), np.uint8), None, self.ids
            shard = ((name >> np.uint64(30)) * s >> np.uint64(32)).astype(np.int64)  # by ranges of the 62 bits
        else:
            use = np.flatnonzero(self.real[1:] & (self.node[1:] >= 0) & (self.node[:-1] >= 0)) + 1
            code = self.local[use - 1].astype(np.int64) * len(self.keys) + self.ids[use]
            _, first, of = np.unique(code, return_index=True, return_inverse=True)
            del code
            self.at, self.of, first = use.astype(np.int32), of.astype(np.int32), use[first]
            context, name = self.node[first - 1].astype(np.uint64), self.name[first].astype(np.uint64)
            counts = np.bincount(self.of, self.train[use], len(first)).astype(np.int64)
            total, prior = self.counts[first - 1].astype(np.uint64), quantised(self.lp[first])
            of = _mixed(name) % self.split(total)
            shard = (_mixed(context, of) % s).astype(np.int64)
        # n-grams stand in order of context and name already: local numbers follow the order of nodes
        self.order = np.argsort(narrow(shard), kind="stable")
        self.salt = of
        self.asked = {"shard": shard, "context": context, "name": name, "count": counts, "total": total, "prior": prior}
        return {k: v[self.order] for k, v in self.asked.items()}

    def split(self, total: np.ndarray) -> np.ndarray:
        """Over how many shards a context's successors are dealt."""
        return np.uint64(1) + total.astype(np.uint64) // np.uint64(self.model.part)

    def take(self, got: dict[str, np.ndarray]) -> None:
        """Answers to what was asked, in its order."""
        back = np.empty(len(self.order), np.int64)
        back[self.order] = np.arange(len(self.order))
        node, first, counts, code = (got[c].astype(np.int64)[back] for c in ("node", "first", "count", "code"))
        node -= 1
        shard, a, n = self.asked["shard"], self.asked, len(self.ids)
        if self.k == 0:
            there, m = node >= 0, self.model
            lp = np.log10((np.where(there, counts, 0) + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
            self.base, self.known, self.lp = lp, there, lp[self.ids]
            name = np.where(there, shard << m.part.bit_length() + 5 | node, -1)
            self.name, self.node, self.counts = name[self.ids], name[self.ids], np.where(there, counts, 0)[self.ids]
            self.local = self.ids
        else:
            there = node >= 0
            seen = np.where(there, code / -STEPS, np.nan)
            at, of = self.at, self.of
            # a context of the training text: what its successors leave for others
            has = np.append(False, self.real[1:] & (self.node[:-1] >= 0))
            less = np.where(has, np.log10(PRIOR / (np.append(0, self.counts[:-1]) + PRIOR)), 0.0)
            self.lp += less
            del has, less
            self.lp[at] = np.where(there[of], seen[of], self.lp[at])
            if self.k + 1 == self.model.order:
                self.k += 1
                return
            number = shard << 40 | node
            local, (fresh, name, counts_) = np.full(n, -1, np.int32), (np.full(n, -1, np.int64) for _ in range(3))
            local[at], fresh[at] = back[of], np.where(there, number, -1)[of]
            parts = self.split(a["total"]).astype(np.int64)
            name[at] = np.where(there, (node - first) * parts + self.salt.astype(np.int64), -1)[of]
            counts_[at] = np.where(there, counts, 0)[of]
            self.node, self.name, self.counts, self.local = fresh, name, counts_, local
        self.k += 1

    def scores(self) -> pa.RecordBatch:
        total = lambda x: np.add.reduceat(np.where(self.real, x, 0), self.first)
        cols = {"doc_id": pa.array(self.doc, pa.int64(), mask=self.null), "held_out": self.held, "n_tokens": self.lengths, "n_known": total(self.known[self.ids]).astype(np.int64), "train_tokens": np.full(len(self.doc), self.model.tokens), "base_score": total(self.base[self.ids]), "score": total(self.lp)}
        return pa.RecordBatch.from_pydict(cols, schema=pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _requests(block: Block, at: str, folder: str):
    """A row for each shard that the block asks, one at least; what it asks is written below the folder."""
    a = block.ask()
    cuts = np.flatnonzero(np.append(True, a["shard"][1:] != a["shard"][:-1])) if len(a["shard"]) else np.zeros(0, np.int64)
    rows, said, file, from_byte = [], [], f"{folder}/{at.rsplit('/', 1)[-1]}", 0

    def ask(shard: int, **arrays: np.ndarray) -> None:
        nonlocal from_byte
        said.append(pack(**arrays))
        rows.append({"shard": shard, "block": at, "file": file, "start": from_byte, "size": len(said[-1])})
        from_byte += len(said[-1])

    for x, z in zip(cuts, np.append(cuts[1:], len(a["shard"]))):
        c = a["context"][x:z]
        start = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        ask(int(a["shard"][x]), context=narrow(np.diff(c[start], prepend=np.uint64(0))), run=narrow(np.diff(np.append(start, z - x))), total=narrow(a["total"][x:z][start]), name=narrow(a["name"][x:z]), count=narrow(a["count"][x:z]), prior=a["prior"][x:z])
    none = np.zeros(0, np.uint64)
    if not rows:
        ask(0, context=none, run=none, total=none, name=none, count=none, prior=none)
    write_file(file, b"".join(said))
    return pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int32()), ("block", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64())]))


def _climbed(at: str, model: Model, k: int) -> Block:
    """The block with the answers of the levels below k."""
    block = Block(at, model)
    for i in range(1, k):
        block.ask()
        block.take(_answers(json.loads(read_file(f"{at}.{i}"))))
    return block


def _places(table: pa.Table) -> list:
    """Where a block's answers of a level lie, in the order of what it asked."""
    order = np.argsort(table["shard"].to_numpy(), kind="stable")
    return [[r["file"], r["start"], r["size"]] for r in table.select(["file", "start", "size"]).take(order).to_pylist()]


def _answers(places: list) -> dict[str, np.ndarray]:
    parts = [unpack(read_file(*place)) for place in places]
    for p in parts:
        if "step" in p:
            node = unstepped(p["step"])
            p |= {"node": node + 1, "first": np.where(node >= 0, node - p["rank"].astype(np.int64), 0)}
    return {c: narrow(np.concatenate([p[c].astype(np.uint64) for p in parts])) for c in ("node", "first", "count", "code")}


def _answer(table: pa.Table, model: Model, k: int, learn: bool, folder: str) -> pa.Table:
    """What a shard answers to all blocks, after it has counted and written its part of the level if it is to learn."""
    shard = table["shard"][0].as_py()
    parts = [unpack(read_file(r["file"], r["start"], r["size"])) for r in table.select(["file", "start", "size"]).to_pylist()]
    sizes = [len(p["name"]) for p in parts]
    run = [p["run"].astype(np.int64) for p in parts]
    context = np.concatenate([np.repeat(np.cumsum(p["context"].astype(np.uint64), dtype=np.uint64), r) for p, r in zip(parts, run)])
    name, counts = (np.concatenate([p[c].astype(t) for p in parts]) for c, t in (("name", np.uint64), ("count", np.int64)))
    tokens = words = 0
    if learn:
        total = np.concatenate([np.repeat(p["total"].astype(np.int64), r) for p, r in zip(parts, run)])
        prior = np.concatenate([p["prior"] for p in parts])
        order = np.lexsort((name, context))
        c, w = context[order], name[order]
        first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1]))) if len(c) else np.zeros(0, np.int64)
        n = np.add.reduceat(counts[order], first) if len(c) else counts
        keep, rep = n > 0, order[first]
        n, rep = n[keep], rep[keep]
        p = (n + PRIOR * 10.0 ** (prior[rep] / -STEPS)) / (total[rep] + PRIOR) if k > 1 else np.ones(len(n))
        write_level(model.level(k, shard), context[rep], name[rep], n, quantised(np.log10(p)))
        own = name[rep] != BOS
        tokens, words = (int(n[own].sum()), int(own.sum())) if k == 1 else (0, 0)
    level = Level(model.level(k, shard))
    node, start = level.find(context, name)
    there = node >= 0
    code, n = (np.where(there, x[node.clip(min=0)] if len(x) else 0, 0) for x in (level.code, level.counts))
    rows, said, at_byte, file = [{"block": "", "shard": shard, "file": "", "start": 0, "size": 0, "tokens": tokens, "words": words}], [], 0, f"{folder}/shard-{shard}"
    for at, a, z in zip(table["block"].to_pylist(), np.cumsum(sizes) - sizes, np.cumsum(sizes)):
        if k < model.order:
            rank = np.where(there[a:z], node[a:z] - start[a:z], 0)
            one = pack(step=narrow(steps(node[a:z], there[a:z])), rank=narrow(rank), count=narrow(n[a:z]), code=code[a:z].astype(np.uint8))
        else:  # whether it is there, and its probability
            none = np.zeros(z - a, np.uint8)
            one = pack(node=there[a:z].astype(np.uint8), first=none, count=none, code=code[a:z].astype(np.uint8))
        rows.append({"block": at, "shard": shard, "file": file, "start": at_byte, "size": len(one), "tokens": 0, "words": 0})
        said.append(one)
        at_byte += len(one)
    write_file(file, b"".join(said))
    return pa.Table.from_pylist(rows, pa.schema([("block", pa.string()), ("shard", pa.int32()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("tokens", pa.int64()), ("words", pa.int64())]))


def _answering(model: Model, k: int, learn: bool, folder: str):
    def answer(table: pa.Table) -> pa.Table:
        held(("ngrams",), list)
        return _answer(table, model, k, learn, folder)

    return answer


def _climbing(model: Model, k: int, folder: str):
    def climb(table: pa.Table) -> pa.Table:
        held(("ngrams",), list)
        at, places = table["block"][0].as_py(), _places(table)
        block = _climbed(at, model, k)
        if k < model.order:  # later levels read these answers again, from where they lie
            write_file(f"{at}.{k}", json.dumps(places).encode())
        block.ask()
        block.take(_answers(places))
        return pa.Table.from_batches([_requests(block, at, folder) if k < model.order else block.scores()])

    return climb


def _rounds(docs: DataFrame, model: Model, learn: bool, block_tokens: int, shard_tokens: int) -> tuple[Model, DataFrame]:
    spark = docs.sparkSession
    folder = shared_dir(spark)
    blocks = materialize(_write_blocks(docs, folder, block_tokens))
    if learn:
        total = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        if total > shard_tokens << 22:
            raise ValueError("more than 2^22 shards; take larger ones")
        model = Model(model.folder, model.order, max(1, -(-total // shard_tokens)), max(1, shard_tokens // 4))

    first = model

    def begin(batches):
        held(("ngrams",), list)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                yield _requests(Block(at, first), at, questions)

    questions, said = shared_dir(spark), []
    # questions and answers are rows of a few bytes, which Spark would else gather in one task
    wide = max(spark.sparkContext.defaultParallelism, min(model.shards, 100_000))
    asked = materialize(blocks.select("block").repartition(wide, "block").mapInArrow(begin, _ASKED))
    for k in range(1, model.order + 1):
        said.append(shared_dir(spark))
        answers = materialize(asked.repartition(wide, "shard").groupBy("shard").applyInArrow(_answering(model, k, learn, said[-1]), _ANSWER))
        discard(asked)
        delete_folder(spark, questions)
        if k == 1 and learn:
            n, v = answers.where("block = ''").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
            model = Model(model.folder, model.order, model.shards, model.part, n, v)
        questions = shared_dir(spark)
        asked = materialize(answers.where("block <> ''").repartition(wide, "block").groupBy("block").applyInArrow(_climbing(model, k, questions), _ASKED if k < model.order else _SCORES))
        discard(answers)
    discard(blocks)
    for done in (folder, *said):
        delete_folder(spark, done)
    return model, asked


def learn_and_score(docs: DataFrame, train: Column, order: int = ORDER, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> tuple[Model, DataFrame]:
    """The trie of the rows of docs (doc_id, text) for which `train` holds, and the scores of all rows.

    Scores: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). A text's tokens are its words, A-Z as
    a-z, and an end. Null and empty texts have the end alone; texts of any length count whole; repeated rows count
    each and score alike; rows without a doc_id keep null for it. Without training rows every word is unknown.
    No rows give none. Words are told apart by 62-bit hashes. The model's files stay until delete_model.
    """
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    return _rounds(rows, Model(shared_dir(docs.sparkSession), order, 1, 1), True, block_tokens, shard_tokens)


def score(docs: DataFrame, model: Model, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The same columns for other documents (doc_id, text); all of them count as held out."""
    return _rounds(docs.select("doc_id", "text", F.lit(False).alias("train")), model, False, block_tokens, 1)[1]


def delete_model(docs: DataFrame, model: Model) -> None:
    delete_folder(docs.sparkSession, model.folder)
