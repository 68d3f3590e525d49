"""Secret scans: assignments, access keys and hex strings, and random strings told by their token efficiency."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.common import free_name
from threadlake.llm.tokens import tiktoken_encoding

KINDS = ("assign", "access", "hex", "random")
RESULT = "n_assign long, n_access long, n_hex long, n_random long, kinds array<string>, starts array<long>, ends array<long>"
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Digests by their usual lengths, UUIDs, and numbers: known kinds of identifier.
_KNOWN = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+)\Z")
_LETTERS = re.compile(r"[A-Za-z]{16,}")
#: A run of 16 characters or more is random at this many characters a token or fewer; prose has four or so.
MAX_RATIO = 2.2
#: The same for runs without a digit, which are tested letter by letter run: 98 of 100 random ones lie below
#: it, and 3 of 100 long words of the synthetic prose.
LETTERS_RATIO = 2.0


def _random(text: str, a: int, b: int, encoding, max_ratio: float) -> list[tuple[int, int]]:
    """The random spans of a run of at least 16 characters: the run, or the parts between its signs if it has no digit."""
    run = text[a:b]
    if _KNOWN.match(run):
        return []
    if any(c in "0123456789" for c in run):
        return [(a, b)] if b - a <= max_ratio * len(encoding.encode_ordinary(run)) else []
    parts = [m.span() for m in _LETTERS.finditer(text, a, b)]
    return [(x, y) for x, y in parts if not _KNOWN.match(text[x:y]) and y - x <= min(max_ratio, LETTERS_RATIO) * len(encoding.encode_ordinary(text[x:y]))]


def scan(text: str | None, encoding, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret, in order; offsets in code points, ends exclusive.

    Base kinds keep their matches whatever overlaps them; random strings are added from what base matches
    leave of each run, at least 16 characters at a stretch.
    """
    if not text:
        return []
    found = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    runs = list(_RUN.finditer(text))
    for r in runs:  # every access key of 16 characters and hex string of 32 lies within a run
        if "AKIA" in r[0]:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text, r.start(), r.end()) if m.end() - m.start() >= 16]
        if r.end() - r.start() >= 32:
            found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, r.start(), r.end())]
    base = sorted(found)
    for r in runs:
        a, b = r.span()
        for s, _, e in [*(x for x in base if x[0] < b and a < x[2]), (b, 0, b)]:  # base is in order
            if s - a >= 16:
                found += [(x, 3, y) for x, y in _random(text, a, min(s, b), encoding, max_ratio)]
            a = max(a, e)
    return sorted(found)


def secret_spans(spark: SparkSession, vocabulary: str, max_ratio: float = MAX_RATIO):
    """A pandas UDF: text -> counts and spans. vocabulary: the path of a tiktoken file, the same on every executor."""

    @F.pandas_udf(RESULT)
    def spans(texts: pd.Series) -> pd.DataFrame:
        encoding = tiktoken_encoding(vocabulary)
        rows = []
        for t in texts:
            f = scan(t, encoding, max_ratio)
            rows.append((*(sum(x[1] == k for x in f) for k in range(4)), [KINDS[k] for _, k, _ in f], [s for s, _, _ in f], [e for _, _, e in f]))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_random", "kinds", "starts", "ends"])

    return spans


def find_secrets(docs: DataFrame, vocabulary: str, text: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """docs with a struct column, named secrets unless docs has that name.

    Null and empty texts hold none; a text of any length is scanned whole and gives all its spans;
    spans of several kinds may start together, and stand in the order of KINDS; repeated rows give
    repeated results; no rows give none; other columns pass through.
    """
    return docs.withColumn(free_name(docs, "secrets"), secret_spans(docs.sparkSession, vocabulary, max_ratio)(F.col(text)))


def redact_secrets(docs: DataFrame, vocabulary: str, text: str = "text", mark: str = "[SECRET]", max_ratio: float = MAX_RATIO) -> DataFrame:
    """docs with every secret in the text replaced by mark; overlapping spans are one. Rows and other columns stay; null stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        encoding = tiktoken_encoding(vocabulary)
        out = []
        for t in texts:
            parts, at = [], 0
            for s, _, e in scan(t, encoding, max_ratio):
                if s >= at:
                    parts += [t[at:s], mark]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]) if parts else t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, clean(F.col(text))).select(*docs.columns)


def joined(spans: str, base_only: bool) -> Column:
    """kind:start:end of the spans of the struct column, comma-joined."""
    s = F.col(spans)
    each = F.arrays_zip(s["kinds"].alias("k"), s["starts"].alias("s"), s["ends"].alias("e"))
    if base_only:
        each = F.filter(each, lambda x: x["k"] != KINDS[3])
    return F.array_join(F.transform(each, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")
