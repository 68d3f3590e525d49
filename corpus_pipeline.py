"""A training corpus from raw documents: toxicity, near copies, benchmark passages and secrets, then token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of documents.

In every stage repeated rows count each (the near-copy stage keeps one), an empty table gives an empty one, and
columns beyond those of documents pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import decontamination, overlaps, secrets, sentencepieces, simhash, toxicity
from threadlake.llm.common import materialize, table
from threadlake.llm.tokens import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go. Null and wordless texts score 0 and stay; long texts count whole."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id stays of each group linked by op10's SimHashes (two bits or fewer, found over its pivots) or by a 5-word Jaccard similarity of 0.8 or more.

    Null, empty and wordless texts are one group. Of rows that share the smallest id one stays; rows without an id stay.
    """
    return overlaps.drop_near_copies(docs, bits=simhash.BITS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go. Null and empty texts have none and stay; long texts are scanned whole."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; n_chars follows. All rows stay; null stays null; overlapping secrets are cut as one."""
    clean = secrets.redact_secrets(docs, vocabulary_path("byte_bpe_50k.tiktoken"))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_ids and the ids (16-bit) of every text; null and empty texts have none."""
    coded = sentencepieces.encode_documents(docs.select("doc_id", "source", "text"), vocabulary_path("piece_bpe_32k.model"))
    return coded.select("doc_id", "source", F.col("pieces.n_ids").alias("n_ids"), F.col("pieces.ids").alias("ids"))


STAGES = [("toxicity", drop_toxic), ("near copies", drop_copies), ("benchmark", drop_benchmark), ("secrets", redact), ("token ids", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
