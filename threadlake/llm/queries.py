"""Registered queries of the subpackage: each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import decontamination, fingerprints, ngrams, prefix_trie, ranked, secrets, sentencepieces, separators, sharding, simhash, toxicity, url_filters, wavelets
from threadlake.llm.common import table
from threadlake.llm.tokens import vocabulary_path


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    h = F.col("hits")
    return found.select("doc_id", h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"), decontamination.digest(h).alias("items_sha256"), (h["n_hit"] > 0).alias("contaminated"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("secrets")
    found = secrets.find_secrets(docs, vocabulary_path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", s["n_assign"].alias("n_assign"), s["n_access"].alias("n_access"), s["n_hex"].alias("n_hex"), F.sha2(secrets.joined("secrets", True), 256).alias("base_sha256"), secrets.joined("secrets", False).alias("spans"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = separators.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"), eod=50256)
    return found.select("doc_id", "doc_index", "start", "n_tokens")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = F.col("pieces")
    found = sentencepieces.encode_documents(docs, vocabulary_path("piece_bpe_32k.model"))
    return found.select("doc_id", p["n_ids"].alias("n_ids"), p["ids_crc32"].alias("ids_crc32"), p["exact"].alias("exact"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = wavelets.write_wavelet_files(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=0)
    return wavelets.document_checksums(files)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, machine)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, scored = ngrams.learn_and_score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0)
    ngrams.delete_model(docs, model)
    return scored


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns))


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_url_filters, op3_secret_scans, op4_token_counts, op5_document_fingerprints, op6_sentencepiece, op7_sharding, op8_token_ids, op9_toxicity, op10_simhash, op11_lm_scoring, op12_ranked_search, op13_conversation_trie)}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: One byte of a CRC-32, bit by bit.
_CRC_BYTE = "xor(x, ascii(substr(c::VARCHAR, i + 1, 1)))"
for _ in range(8):
    _CRC_BYTE = f"(SELECT CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END FROM (SELECT {_CRC_BYTE} AS y))"

ORACLES = {
    "op1_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, len(w[i:i+9]) AS k, array_to_string(w[i:i+9], ' ') AS s
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS s
       FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT doc_id, pos.k, i, item FROM pos JOIN win USING (k, s)),
per AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents WHERE len({_WORDS}) > 0),
i AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS t FROM benchmark),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
x AS (SELECT row, doc_id, t, n, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM x, c GROUP BY t, n_docs),
s AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total)))) AS BIGINT) AS score FROM x JOIN f USING (t) JOIN i USING (t), c GROUP BY item_id, row, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op13_conversation_trie": f"""
WITH RECURSIVE crc(c, x, i) AS (SELECT DISTINCT conv_id, 4294967295::BIGINT, 0 FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT c, {_CRC_BYTE}, i + 1 FROM crc WHERE i < length(c::VARCHAR)),
h AS (SELECT c, xor(x, 4294967295) % 6 AS h FROM crc WHERE i = length(c::VARCHAR)),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(d, 1, 32)) AS i, substr(d, 1, 32) AS d, chars
  FROM (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL)),
r AS (SELECT h.c, t.i, d, chars FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.i <= h UNION ALL SELECT h.c, 1000000 + t.i, d, chars FROM h JOIN t ON t.c = h.c AND t.i > h),
s AS (SELECT h.c, coalesce(list(d ORDER BY i) FILTER (i IS NOT NULL), []) AS ds, coalesce(list(chars ORDER BY i) FILTER (i IS NOT NULL), []) AS cs FROM h LEFT JOIN r USING (c) GROUP BY h.c),
p AS (SELECT c, unnest(range(0, len(ds) + 1)) AS depth, ds, cs FROM s),
n AS (SELECT depth, ds[1:depth] AS path, min(c) AS conv_id, count(*) AS n_convs, max(cs[depth]) AS chars, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(ds) = depth), '')) AS ends_sha256 FROM p GROUP BY ALL),
k AS (SELECT a.*, count(b.depth) AS n_children FROM n a LEFT JOIN n b ON b.depth = a.depth + 1 AND b.path[1:a.depth] = a.path GROUP BY ALL),
up AS (SELECT path[1:d] AS path, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum((n_convs - 1) * coalesce(chars, 0)) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM k) GROUP BY ALL)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, f.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN up USING (path) LEFT JOIN n f ON f.depth = k.depth - 1 AND f.path = k.path[1:k.depth - 1]""",
}
