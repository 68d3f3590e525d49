"""Token counts by a separator scan: flat token files without an index, searched block by block for the
end-of-document id; a prefix scan over the blocks' summaries stitches documents that cross blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.common import delete_folder, discard, materialize, read_file, running, shared_dir, small_batches, write_file
from threadlake.llm.tokens import tiktoken_words

#: Bytes of one block, a multiple of the id width; and about so many bytes of text go to one file.
BLOCK_BYTES = 1 << 20
FILE_TEXT_BYTES = 8 << 20
#: Blocks of one task, about.
TASK_BLOCKS = 16


def write_token_files(docs: DataFrame, vocabulary: str, eod: int, file_bytes: int = FILE_TEXT_BYTES, width: int = 2) -> DataFrame:
    """Write the ids of all texts, eod after each, in the order the rows are read, to flat little-endian files.

    Returns (file, n_bytes, doc_ids): the listing, which the scan doesn't need. Null texts are empty
    documents. Nothing is shuffled: each task writes the rows of its own part of docs, in files of about
    file_bytes of text. Sort docs first where the files themselves shall follow a key.
    """
    base, dtype = shared_dir(docs.sparkSession), f"<u{width}"

    def write(batches):
        words, part, k = tiktoken_words(vocabulary, dtype), TaskContext.get().partitionId(), 0

        def row(keys: list[pa.Array], texts: list[pa.Array]):
            ids, _ = words.encode_flat(pa.concat_arrays(texts), eod)
            uri = f"{base}/{part:08d}-{k:06d}.bin"
            write_file(uri, ids.tobytes())
            return pa.RecordBatch.from_pydict({"file": [uri], "n_bytes": [ids.nbytes], "doc_ids": [pa.concat_arrays(keys)]}, schema=schema)

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

    schema = pa.schema([("file", pa.string()), ("n_bytes", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "file string, n_bytes long, doc_ids array<long>"))


def scan_separators(files: DataFrame, eod: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, doc_index, start, n_tokens, terminated) of every document in the flat files (file, n_bytes).

    start counts ids from the file's begin; n_tokens includes the end id. Ids after the last separator
    are one more document, not terminated. Empty files have no documents.
    """
    if block_bytes % width:
        raise ValueError("a block must hold whole ids")
    blocks = files.where("n_bytes > 0").select("file", "n_bytes", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_bytes") - 1) / block_bytes))).alias("block"))

    def search(batches):
        for batch in batches:
            rows = {"file": [], "block": [], "n": [], "at": []}
            for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(read_file(file, block * block_bytes, block_bytes), dtype=f"<u{width}")
                rows["file"].append(file)
                rows["block"].append(block)
                rows["n"].append(len(ids))
                rows["at"].append(np.flatnonzero(ids == eod) + block * (block_bytes // width))
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("at", pa.list_(pa.int64()))])
    spread = blocks.select("file", "block").repartition(max(1, min(100_000, blocks.count() // TASK_BLOCKS)), "file", "block")
    found = materialize(spread.mapInArrow(search, "file string, block long, n long, at array<long>"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("at") > 0, F.element_at("at", -1))
    summary = found.select("file", "block", "n", F.size("at").alias("k"), last.alias("last"))
    before = summary.select("file", "block", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("docs_before"), F.coalesce(F.max("last").over(ahead), F.lit(-1)).alias("last_before"))
    stitched = found.join(before, ["file", "block"]).where("size(at) > 0")
    starts = F.transform(F.concat(F.array("last_before"), F.slice("at", 1, F.size("at") - 1)), lambda x: x + 1)
    each = stitched.select("file", "docs_before", F.posexplode(F.arrays_zip(F.col("at").alias("end"), starts.alias("start"))).alias("i", "d"))
    ended = each.select("file", (F.col("docs_before") + F.col("i")).cast("long").alias("doc_index"), F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start") + 1).alias("n_tokens"), F.lit(True).alias("terminated"))
    whole = summary.groupBy("file").agg(F.sum("n").alias("n"), F.sum("k").cast("long").alias("doc_index"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    tail = whole.where("n > last + 1").select("file", "doc_index", (F.col("last") + 1).alias("start"), (F.col("n") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("terminated"))
    return ended.unionByName(tail)


def count_tokens(docs: DataFrame, vocabulary: str, eod: int, file_bytes: int = FILE_TEXT_BYTES, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, doc_index, start, n_tokens): documents written flat, then found again by their separators alone.

    doc_index and start, the documents and the ids before a document, go by ascending doc_id over all
    documents (nulls first; documents of one id by their counts), however they were read and wherever
    they lay in the files, which are deleted. Null and empty texts have the end id alone, a repeated row
    is a document of its own, no rows give none, other columns of docs are ignored, and a text of any
    length is one document: it may cross any number of blocks.
    """
    files = write_token_files(docs, vocabulary, eod, file_bytes, width)
    listed = files.select("file", F.posexplode("doc_ids").alias("at", "doc_id")).select("file", F.col("at").cast("long").alias("doc_index"), "doc_id")
    found = scan_separators(files.select("file", "n_bytes"), eod, width, block_bytes)
    counted = materialize(found.join(listed, ["file", "doc_index"]).select("doc_id", "n_tokens"))
    one = files.select("file").first()
    if one:
        delete_folder(docs.sparkSession, one["file"].rsplit("/", 1)[0])
    discard(files)
    return running(counted, ["doc_id", "n_tokens"], "n_tokens", "doc_index", "start").select("doc_id", "doc_index", "start", "n_tokens")
