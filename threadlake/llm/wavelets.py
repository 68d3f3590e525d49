"""Token-id output as one wavelet matrix a file: compressed bit planes with rank directories.

A file holds the ids of some documents in order. Plane 0 has the highest bit of every id; each next
plane has the ids stably parted by the bit before. With the counts of ones before each block, one id
can be read, counted or found by opening one block a plane.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import materialize, prefix_sum, read_file, shared_dir, small_batches, write_file
from threadlake.llm.tokens import tokenizer_words

MAGIC = b"WVM1"
#: Bits of a block: to read one id, so many are unpacked of each plane.
BLOCK = 1 << 15
#: About so many bytes of text go to one file.
FILE_TEXT_BYTES = 8 << 20
#: Tasks at most; beyond that many files' worth of text a task writes several files.
MAX_TASKS = 20_000


def pack(ids: np.ndarray, lengths: list[int] | np.ndarray, keys: list[int | None]) -> bytes:
    """The file of these ids (unsigned), cut into documents by lengths. keys: their doc_ids."""
    n, levels = len(ids), max(1, int(ids.max(initial=0)).bit_length())
    squeeze = zstandard.ZstdCompressor(level=1).compress
    blocks, sizes, ones, zeros = [], [], [], []
    cur = ids
    for level in range(levels - 1, -1, -1):
        bit = (cur & cur.dtype.type(1 << level)) != 0
        bits = np.packbits(bit)
        total = 0
        for at in range(0, n, BLOCK):
            ones.append(total)
            total += int(np.count_nonzero(bit[at : at + BLOCK]))
            blocks.append(squeeze(bits[at // 8 : (at + BLOCK) // 8].tobytes()))
            sizes.append(len(blocks[-1]))
        zeros.append(n - total)
        cur = np.concatenate((cur.compress(~bit), cur.compress(bit)))
    index = squeeze(b"".join((np.array(ones, "<i8").tobytes(), np.array(sizes, "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), json.dumps(keys).encode())))
    head = json.dumps({"n": n, "levels": levels, "block": BLOCK, "zeros": zeros, "documents": len(lengths), "index": len(index)}).encode()
    return b"".join((MAGIC, struct.pack("<I", len(head)), head, index, *blocks))


class WaveletMatrix:
    """Reads what pack wrote. Positions count ids from the file's begin."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet file")
        (size,) = struct.unpack("<I", data[4:8])
        head = json.loads(data[8 : 8 + size])
        self.n, self.levels, self.block, self.zeros = head["n"], head["levels"], head["block"], head["zeros"]
        raw = zstandard.ZstdDecompressor().decompress(data[8 + size : 8 + size + head["index"]])
        self.per = -(-self.n // self.block)
        k, d = self.levels * self.per, head["documents"]
        numbers = np.frombuffer(raw, "<i8", count=2 * k + d)
        self.ones, sizes, self.lengths = numbers[:k], numbers[k : 2 * k], numbers[2 * k :]
        self.keys = json.loads(raw[8 * (2 * k + d) :])
        self.at = 8 + size + head["index"] + np.concatenate(([0], np.cumsum(sizes)))
        self.data = data
        self.kept: dict[int, np.ndarray] = {}

    def _bits(self, level: int, b: int) -> np.ndarray:
        i = level * self.per + b
        if i not in self.kept:
            if len(self.kept) >= 64:
                self.kept.clear()
            self.kept[i] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data[self.at[i] : self.at[i + 1]]), np.uint8))
        return self.kept[i]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[level]
        b = i // self.block
        return int(self.ones[level * self.per + b]) + int(np.count_nonzero(self._bits(level, b)[: i - b * self.block]))

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = int(self._bits(level, i // self.block)[i % self.block])
            ones = self._ones(level, i)
            value, i = value << 1 | bit, self.zeros[level] + ones if bit else i - ones
        return value

    def rank(self, token: int, i: int) -> int:
        """How often token is among the first i ids."""
        return self._range(token, 0, min(max(i, 0), self.n))[1]

    def count(self, token: int, start: int, end: int) -> int:
        return self.rank(token, end) - self.rank(token, start)

    def _range(self, token: int, a: int, z: int) -> tuple[int, int]:
        if token < 0 or token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            oa, oz = self._ones(level, a), self._ones(level, z)
            a, z = (self.zeros[level] + oa, self.zeros[level] + oz) if token >> (self.levels - 1 - level) & 1 else (a - oa, z - oz)
        return a, z - a

    def select(self, token: int, k: int) -> int:
        """The position of the occurrence k (from 0) of token, or -1."""
        start, n = self._range(token, 0, self.n)
        if not 0 <= k < n:
            return -1
        i = start + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._find(level, bit, i - self.zeros[level] if bit else i)
        return i

    def _find(self, level: int, bit: int, k: int) -> int:
        """The position of the bit's occurrence k in a plane."""
        row = self.ones[level * self.per : (level + 1) * self.per]
        before = row if bit else np.arange(self.per) * self.block - row
        b = int(np.searchsorted(before, k, side="right")) - 1
        found = np.flatnonzero(self._bits(level, b)[: self.n - b * self.block] == bit)
        return b * self.block + int(found[k - int(before[b])])

    def decode(self) -> np.ndarray:
        """All ids."""
        cur = np.zeros(self.n, dtype=np.uint32 if self.levels > 16 else np.uint16)
        one = zstandard.ZstdDecompressor()
        for level in range(self.levels - 1, -1, -1):
            first = level * self.per
            packed = b"".join(one.decompress(self.data[self.at[i] : self.at[i + 1]]) for i in range(first, first + self.per))
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n).view(bool)
            out = np.empty_like(cur)
            out[np.flatnonzero(~bit)] = cur[: self.zeros[level]]
            out[np.flatnonzero(bit)] = cur[self.zeros[level] :] | cur.dtype.type(1 << (self.levels - 1 - level))
            cur = out
        return cur


FILES = "file string, shard long, n_tokens long, n_documents long"


def write_wavelet_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, file_bytes: int = FILE_TEXT_BYTES, max_tasks: int = MAX_TASKS) -> DataFrame:
    """Encode all texts, end_id after each, into files in order of doc_id. Returns (file, shard, n_tokens, n_documents, start).

    shard counts the files, start the ids of all files before. A text that names a special token gets
    that token, as by the library's default. Null texts are empty documents; rows of one doc_id stand in
    order of their texts; repeated rows are documents of their own; a null doc_id comes first. No rows
    make no files. A text longer than file_bytes is a file of its own; other columns are ignored.
    """
    spark, base = docs.sparkSession, shared_dir(docs.sparkSession)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    tasks = max(1, min(max_tasks, -(-total // file_bytes)))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        words, part, k = tokenizer_words(tokenizer_path, "<u4"), TaskContext.get().partitionId(), 0

        def row(keys: list[pa.Array], texts: list[pa.Array]):
            ids, lengths = words.encode_flat(pa.concat_arrays(texts), end_id)
            uri, keys = f"{base}/{part:08d}-{k:06d}.wvm", pa.concat_arrays(keys).to_pylist()
            write_file(uri, pack(ids.astype(np.uint16) if ids.max() < 1 << 16 else ids, lengths, keys))
            return pa.RecordBatch.from_pydict({"file": [uri], "shard": [part << 20 | k], "n_tokens": [len(ids)], "n_documents": [len(keys)]}, schema=schema)

        keys, texts, size = [], [], 0
        for some in small_batches(batches, file_bytes // 4):
            keys.append(some.column(0))
            texts.append(some.column(1).cast(pa.large_string()))
            size += some.column(1).nbytes
            if size >= file_bytes:
                yield row(keys, texts)
                keys, texts, size, k = [], [], 0, k + 1
        if keys:
            yield row(keys, texts)

    schema = pa.schema([("file", pa.string()), ("shard", pa.int64()), ("n_tokens", pa.int64()), ("n_documents", pa.int64())])
    files = materialize(ordered.mapInArrow(write, FILES))
    return prefix_sum(files, "shard", "n_tokens", "start", group=1 << 30)


def read_wavelet_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files (file, start); ids as little-endian 32-bit bytes."""

    def read(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = WaveletMatrix(read_file(file))
                ids = w.decode().astype("<u4")
                ends = np.cumsum(w.lengths)
                for at in range(0, len(ends), 1000):
                    z = ends[at : at + 1000]
                    a = z - w.lengths[at : at + 1000]
                    yield pa.RecordBatch.from_pydict({"doc_id": w.keys[at : at + 1000], "start": start + a, "n_tokens": w.lengths[at : at + 1000], "ids": [ids[i:j].tobytes() for i, j in zip(a, z)]}, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    spread = files.select("file", "start").repartition(max(1, min(MAX_TASKS, files.count())), "file")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def document_checksums(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    return read_wavelet_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
