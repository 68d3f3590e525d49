"""Registered queries that count broken rules of the tables that other queries give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.plans import chunked  # noqa: F401  (its queries are read here)
from threadlake.plans import queries as Q
from threadlake.sources import rules as V

#: The tables of each query.
GROUPS = {
    "validate_counts": ["participants", "participant_overview", "frequency_summary", "daily_counts", "heatmap_bins", "phrase_motifs"],
    "validate_chunks": ["chunk_manifest", "chunk_hashes", "chunk_annotations"],
    "validate_sessions": ["session_summaries", "session_senders", "segment_summary", "emotion_timeline"],
    "validate_story": ["segment_annotations", "chapter_texts", "chapter_summary"],
    "validate_moments": ["highlights", "milestones", "milestone_display", "topic_clusters", "topic_quotes", "motif_hints", "inside_jokes"],
}
#: table, keys, where they must be found, under which names.
REFERENCES = [
    ("highlights", ["archive_id", "seq"], "gap_minutes", None), ("milestones", ["archive_id", "segment_no"], "segment_summary", None), ("narrative_segments", ["archive_id", "session_no"], "sessionize", None),
    ("chunk_windows", ["archive_id", "seq"], "sessionize", None), ("session_senders", ["archive_id", "sender_id"], "participants", ["archive_id", "label"]),
]


def lists(table: str) -> list[str]:
    """Lists that a registered query gives as one text."""
    return [c for c, r in V.TABLES[table].items() if r.each]


def _sql(name: str) -> str:
    return f"({Q.ORACLES[name]})"


def _checked(table: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Q.QUERIES[table](spark, sf_dir)
        return V.count_broken(df.withColumns({c: F.split(c, ",") for c in lists(table)}), table)

    return build


def _checked_sql(table: str) -> str:
    rules = V.TABLES[table]
    made = "".join(f", string_split({c}, ',') AS {c}" for c in lists(table))
    sums = ", ".join(f"coalesce(sum(CAST({r.sql(c)} AS INT)), 0) AS v{i}" for i, (c, r) in enumerate(rules.items()))
    rows = ", ".join(f"{{'rule': {Q.quoted(f'{c} {r}')}, 'violations': CAST(v{i} AS BIGINT)}}" for i, (c, r) in enumerate(rules.items()))
    source = f"SELECT * EXCLUDE ({', '.join(lists(table))}){made} FROM {_sql(table)}" if made else f"SELECT * FROM {_sql(table)}"
    return f"SELECT '{table}' AS table_name, e.rule AS rule, checked, e.violations AS violations FROM (SELECT checked, unnest([{rows}]) AS e FROM (SELECT CAST(count(*) AS BIGINT) AS checked, {sums} FROM ({source})))"


def _orphans(table: str, keys: list[str], other: str, names: list[str] | None):
    return lambda spark, sf: V.count_orphans(Q.QUERIES[table](spark, sf), table, keys, Q.QUERIES[other](spark, sf), other, names)


def _orphans_sql(table: str, keys: list[str], other: str, names: list[str] | None) -> str:
    match, given = " AND ".join(f"a.{k} = b.{n}" for k, n in zip(keys, names or keys)), " AND ".join(f"a.{k} IS NOT NULL" for k in keys)
    return f"SELECT '{table}' AS table_name, '{', '.join(keys)} in {other}' AS rule, count(*) AS checked, count(*) FILTER (NOT EXISTS (SELECT 1 FROM {_sql(other)} b WHERE {match})) AS violations FROM {_sql(table)} a WHERE {given}"


def _add(name: str, parts: list, sql: list[str]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        with Q.shared(spark, sf_dir):
            return reduce(DataFrame.unionByName, [p(spark, sf_dir) for p in parts])

    Q.QUERIES[name] = query
    Q.ORACLES[name] = " UNION ALL ".join(sql)


for _name, _tables in GROUPS.items():
    _add(_name, [_checked(t) for t in _tables], [_checked_sql(t) for t in _tables])
_add("validate_references", [_orphans(*r) for r in REFERENCES], [_orphans_sql(*r) for r in REFERENCES])
