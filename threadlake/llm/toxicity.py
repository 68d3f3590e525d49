"""Toxicity: a support vector machine on a gap-weighted subsequence string kernel with Nystroem landmarks.

The kernel of two strings sums, over the subsequences of ORDER symbols that both have within SPAN
symbols, DECAY to the power of the two spans (Lodhi et al., 2002, with gaps bounded). So an insult
still matches with a letter put in or left out; punctuation within a word is dropped before. Strings
are compared with LANDMARKS strings learned from the training rows; a linear machine on their
whitened kernel values (Nystroem) is linear in the subsequences, so a text is scored by one table
look-up a subsequence. Word scores are pooled to a document's probability by a logistic regression.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.common import discard, free_name, held, materialize

ORDER, SPAN, DECAY, LANDMARKS = 4, 6, 0.7, 192
#: The bounded sample of labelled rows that the machine learns from, by a hash of the id; and of their sentences.
TRAIN_ROWS, TRAIN_SENTENCES = 12_000, 30_000
#: A document's sentences beyond these, by hash, are taken only where there is room after all documents' first ones.
DOCUMENT_SENTENCES = 100
#: Clean documents of the sample whose words give the neutral score.
NEUTRAL_ROWS = 1000
THRESHOLD = 0.3
#: Symbols: 0 dropped, 1 between words, 2 end of sentence, then letters; 39 is any other letter or digit.
SYMBOLS = 40
LETTERS = "abcdefghijklmnopqrstuvwxyzéèêçüöäßñóí"
#: Signs that are written for letters, within words that have half as many letters as digits and such signs at least.
MEANT = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: In the symbol table such a sign has the code of its letter plus this.
SIGN = 64
OFFSETS = list(combinations(range(1, SPAN), ORDER - 1))
#: Characters handled at once.
CHUNK = 1 << 19
POOLED = 8
#: Signs of MEANT that are dropped as punctuation where they aren't read as letters.
_DROPPED = [ord(c) for c in MEANT if not c.isdigit()]


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    t = np.full(0x110000, SYMBOLS - 1, dtype=np.uint8)
    t[:128] = 0
    for c in "0123456789":
        t[ord(c)] = SYMBOLS - 1
    for i, c in enumerate(LETTERS):
        t[ord(c)] = t[ord(c.upper()) if len(c.upper()) == 1 else ord(c)] = 3 + i % (SYMBOLS - 4)
    for c in "   　 \t\r\f\v":
        t[ord(c)] = 1
    for c, letter in MEANT.items():
        t[ord(c)] = SIGN + t[ord(letter)]
    for c in ".!?\n":
        t[ord(c)] = 2
    t[0x2010:0x2060] = 0
    return t


def symbols(text: str) -> np.ndarray:
    """Codes of the text's symbols between two word ends, dropped ones left out.

    So is a stop before a letter, and a blank between two letters that stand alone, as in a word spelled out.
    A sign of MEANT is its letter where its word has half as many letters as signs and digits at least, else what it is.
    """
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    code = _symbol_table()[raw]
    code[:-1][(code[:-1] == 2) & (raw[:-1] != 10) & (code[1:] > 2)] = 0
    s = np.concatenate((np.array([1], np.uint8), code[code > 0], np.array([1], np.uint8)))
    sign = s >= SIGN
    if sign.any():
        word = np.cumsum(s <= 2)
        other = sign | (s == SYMBOLS - 1)
        meant = sign & (2 * np.bincount(word, (s > 2) & ~other) >= np.bincount(word, other))[word]
        plain = np.isin(raw[code > 0], _DROPPED)
        s = np.where(meant, s - SIGN, np.where(sign, SYMBOLS - 1, s)).astype(np.uint8)
        s = s[np.concatenate(([True], ~plain, [True])) | meant]
    letter, alone, spelled = s > 2, np.zeros(len(s), bool), np.zeros(len(s), bool)
    alone[1:-1] = letter[1:-1] & ~letter[:-2] & ~letter[2:]
    spelled[1:-1] = (s[1:-1] == 1) & alone[:-2] & alone[2:]
    return s[~spelled]


def _codes(s: np.ndarray):
    """For each choice of offsets: (weight, code of the subsequence at each start); word and sentence ends count alike."""
    x = np.where(s == 2, 1, s).astype(np.int32)
    padded = np.concatenate((x, np.zeros(SPAN, np.int32)))
    n = len(x)
    parts = [padded * SYMBOLS**k for k in range(ORDER)]
    for o in OFFSETS:
        code = parts[ORDER - 1][:n].copy()
        for k, d in enumerate(o):
            code += parts[ORDER - 2 - k][d : d + n]
        yield DECAY ** (o[-1] + 1), code


def features(text: str) -> dict[int, float]:
    """The subsequences of a short string with their weights; none that would need symbols past its end."""
    out: dict[int, float] = {}
    s = symbols(text)
    for (weight, code), o in zip(_codes(s), OFFSETS):
        for c in code[: max(0, len(s) - o[-1])].tolist():
            out[c] = out.get(c, 0.0) + weight
    return out


def kernel(a: str, b: str) -> float:
    fa, fb = features(a), features(b)
    return sum(v * fb.get(k, 0.0) for k, v in fa.items())


class Machine:
    """What scoring needs: the table of subsequence weights, the pooling regression and a clean word's mean score."""

    def __init__(self, table: np.ndarray, pool: np.ndarray, mean: np.ndarray, scale: np.ndarray, neutral: float = 0.0):
        self.table, self.pool, self.mean, self.scale, self.neutral = table, pool, mean, scale, neutral

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Of each text: best word scores, means, best sentence scores. All parts of long texts count."""
        out = np.zeros((len(texts), POOLED))
        for i, t in enumerate(texts):
            out[i] = _pool(self.table, t, self.neutral)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Of each text; 0 without any word."""
        raw = self.pooled([t or "" for t in texts])
        x = (raw - self.mean) / self.scale
        return np.where(raw[:, -1] > 0, 1 / (1 + np.exp(-np.clip(x @ self.pool[:-1] + self.pool[-1], -30, 30))), 0.0)


def _pieces(text: str):
    """The text in parts of about CHUNK characters, cut at white space where there is any near."""
    at = 0
    while at < len(text):
        z = at + CHUNK
        if z < len(text):
            z = max(text.rfind(" ", at + 1, z), text.rfind("\n", at + 1, z)) + 1 or z
        yield text[at:z]
        at = z


def _pool(table: np.ndarray, text: str, neutral: float = 0.0) -> np.ndarray:
    """A word gets the neutral score for the share of its subsequences that the table doesn't know, so strings never seen say nothing."""
    words = [np.zeros(0)]
    best_sentence, n_words = [0.0, 0.0], 0
    total = 0.0
    for part in _pieces(text):
        s = symbols(part)
        v, known, most = np.zeros(len(s), dtype=np.float32), np.zeros(len(s), dtype=np.float32), np.float32(sum(DECAY ** (o[-1] + 1) for o in OFFSETS))
        for weight, code in _codes(s):
            found = table[code]
            v += np.float32(weight) * found
            if neutral:
                known += np.float32(weight) * (found != 0)
        starts = np.flatnonzero((s <= 2) & np.concatenate((s[1:] > 2, [False])))
        if not len(starts):
            continue
        w = np.add.reduceat(v, starts)
        if neutral:
            w += np.float32(neutral) * (1 - np.add.reduceat(known, starts) / (most * np.diff(np.append(starts, len(s)))))
        n_words += len(w)
        total += float(w.sum())
        some = np.partition(w, -10)[-10:] if len(w) > 10 else w
        words.append(some)
        ends = np.concatenate(([0], np.flatnonzero(s[1:] == 2) + 1))
        which = np.unique(np.searchsorted(starts, ends), return_index=False)
        which = which[which < len(starts)]
        per = np.add.reduceat(w, which) / np.sqrt(np.diff(np.concatenate((which, [len(w)]))))
        best_sentence = sorted([*best_sentence, *np.partition(per, -2)[-2:].tolist()] if len(per) > 2 else [*best_sentence, *per.tolist()])[-2:]
    top = np.sort(np.concatenate(words))[::-1][:10]
    top = np.concatenate((top, np.zeros(10 - len(top))))
    n = max(1, n_words)
    return np.array([top[0], top[1], top[:3].mean(), top[:5].mean(), top.mean(), total / n, best_sentence[1], np.log1p(n_words)])


def held_out(key: Column) -> Column:
    """Rows kept from learning: the CRC-32 of the id as text, modulo 4, is 2. Rows without an id aren't; they have no label either."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of the labelled rows to learn from: `rows` ids with the least hashes, at most one row each."""
    ids = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return materialize(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")))


def _sentences(sample: DataFrame, bound: int, each: int = DOCUMENT_SENTENCES) -> tuple[DataFrame, int, int]:
    """(s, toxic) of at most `bound` sentences, by hash, and how many are of toxic and of other documents.

    Each class gets half of the bound, and what the other leaves of its half.
    """
    cut = F.posexplode(F.split("text", r"[.!?\n]+")).alias("i", "s")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("h", "i"))
    all_ = sample.select("doc_id", "toxic", cut).where("trim(s) <> ''").withColumn("h", F.xxhash64("doc_id", "i"))
    # another hash for the choice among documents: a long one's first sentences have the least of h
    all_ = materialize(all_.withColumn("late", nth > each).select("s", "toxic", "late", F.xxhash64("h", F.lit(1)).alias("h")))
    n = {r["toxic"]: r["count"] for r in all_.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    take1 = min(n1, max(bound // 2, bound - n0))
    take0 = min(n0, bound - take1)
    some = [all_.where(F.col("toxic") == y).orderBy("late", "h", "s").limit(k).select("s", "toxic") for y, k in ((1, take1), (0, take0))]
    return some[0].unionByName(some[1]), take1, take0


def _left_out(sentences: DataFrame) -> DataFrame:
    """The sentences, in half of them each word of five letters or more without one: its third, or its third from the end."""
    which = F.pmod(F.xxhash64("s"), F.lit(4))
    early, late = F.regexp_replace("s", r"(\p{L}{2})\p{L}(\p{L}{2,})", "$1$2"), F.regexp_replace("s", r"(\p{L}{2,})\p{L}(\p{L}{2})", "$1$2")
    return sentences.select(F.when(which == 0, early).when(which == 1, late).otherwise(F.col("s")).alias("s"), "toxic")


def _landmarks(sample: DataFrame, count: int) -> list[str]:
    """Words and word beginnings that tell the classes apart, and the commonest words as background.

    A candidate's rank is its log odds between toxic and other documents times the root of its count.
    """
    word = F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace("text", r"[\p{Punct}&&[^.!?]]", "")), r"[\s.!?]+")))
    w = sample.select("toxic", word.alias("w"), "doc_id").where("length(w) between 3 and 24")
    cut = F.array_distinct(F.array(F.concat(F.lit(" "), "w", F.lit(" ")), *(F.concat(F.lit(" "), F.substring("w", 1, n)) for n in (4, 5, 6))))
    each = w.select("doc_id", "toxic", F.explode(cut).alias("l")).distinct()
    n1, n0 = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    odds = F.log((F.col("p") + 0.5) / (n1 + 1.0)) - F.log((F.col("q") + 0.5) / (n0 + 1.0))
    ranked = each.groupBy("l").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).where("p + q >= 4").withColumn("r", odds * F.sqrt("p"))
    most = [r[0] for r in ranked.orderBy(F.desc("r"), "l").limit(count * 3 // 4).collect()]
    rest = [r[0] for r in ranked.where(F.col("l").endswith(" ")).orderBy(F.desc(F.col("p") + F.col("q")), "l").limit(count).collect()]
    return most + [x for x in rest if x not in set(most)][: count - len(most)]


def _svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, classes weighted equally, by Newton steps.

    It has no bias: a sentence of strings never seen scores 0, and a toxic one must have something that speaks for it.
    """
    a = x
    s = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y) * c / 100
    w, ridge = np.zeros(a.shape[1]), np.eye(a.shape[1])
    for _ in range(rounds):
        active = s * (a @ w) < 1
        some = a[active]
        b = some * weight[active, None]
        new = np.linalg.solve(ridge + b.T @ some, b.T @ s[active])
        if np.abs(new - w).max() < 1e-4:
            break
        w = new
    return w


def _logistic_upward(x: np.ndarray, y: np.ndarray, upward: int) -> np.ndarray:
    """A logistic regression in which none of the first `upward` weights is negative: the most negative one goes until none is."""
    used = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1] + 1)
        w[np.append(used, True)] = _logistic(x[:, used], y)
        if w[:upward].min() >= 0:
            return w
        used[w[:upward].argmin()] = False


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, rounds: int = 50) -> np.ndarray:
    a = np.hstack((x, np.ones((len(x), 1))))
    w, r = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    r[-1, -1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + r + 1e-9 * np.eye(len(w)), a.T @ (y - p) - r @ w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, sentences: int = TRAIN_SENTENCES, landmarks: int = LANDMARKS) -> Machine:
    """Learn from at most `rows` labelled documents and `sentences` of their sentences.

    Kernel values are computed in tasks; the driver gets one vector a sentence and one row of POOLED
    numbers a document, both bounded. Without rows or sentences of both classes every score is the share
    of toxic ones, or 0 without any.
    """
    sample = _sample(docs, labels, rows)
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    flat = np.zeros(POOLED)
    if not 0 < positive < n:
        bias = 30.0 if n and positive else -30.0
        return Machine(np.zeros(SYMBOLS**ORDER, np.float32), np.append(flat, bias), flat, np.ones(POOLED))
    chosen, toxic, clean = _sentences(sample, sentences)
    if not toxic or not clean:
        return Machine(np.zeros(SYMBOLS**ORDER, np.float32), np.append(flat, 30.0 if toxic else -30.0), flat, np.ones(POOLED))
    marks = _landmarks(sample, landmarks)
    f = [features(m) for m in marks]
    dims = {k: i for i, k in enumerate(sorted(set().union(*f)))}
    mat = np.zeros((len(dims), len(marks)), dtype=np.float32)
    for j, x in enumerate(f):
        norm = sum(v * v for v in x.values()) ** 0.5
        for k, v in x.items():
            mat[dims[k], j] = v / norm
    keys = np.array(list(dims), dtype=np.int64)

    def vectors(batches):
        held(("toxicity",), list)
        where = np.zeros(SYMBOLS**ORDER, dtype=np.int32)
        where[keys] = np.arange(1, len(keys) + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for s in part.column(0).to_pylist():
                    k, n = np.zeros(mat.shape[1], dtype=np.float32), 0
                    for piece in _pieces(s):
                        x = symbols(piece)
                        n += int((x <= 2).sum())
                        for weight, code in _codes(x):
                            found = where[code]
                            bag = np.bincount(found[found > 0] - 1)
                            at_least = np.flatnonzero(bag)
                            k += np.float32(weight) * (bag[at_least].astype(np.float32) @ mat[at_least])
                    out.append((k / np.float32(np.sqrt(n))).tobytes())
                yield pa.RecordBatch.from_pydict({"v": out, "toxic": part.column(1)}, schema=pa.schema([("v", pa.binary()), ("toxic", pa.int32())]))

    picked = materialize(_left_out(chosen))
    got = picked.repartition(24).mapInArrow(vectors, "v binary, toxic int").toPandas()
    k = np.frombuffer(b"".join(got["v"]), dtype=np.float32).reshape(len(got), -1)
    y = got["toxic"].to_numpy(dtype=np.float64)
    del got
    assert 0 < y.sum() < len(y), "the machine needs sentences of both classes"
    gram = (mat.T @ mat).astype(np.float64)
    values, vecs = np.linalg.eigh(gram)
    keep = values > 1e-4 * values.max()
    white = vecs[:, keep] / np.sqrt(values[keep])
    z = (k @ white.astype(np.float32)).astype(np.float64)
    del k
    spread = z.std(axis=0).mean() or 1.0
    z /= spread
    w = _svm(z, y)
    del z
    table = np.zeros(SYMBOLS**ORDER, dtype=np.float32)
    table[keys] = mat @ (white @ (w / spread))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def pooled(neutral: float):
        @F.pandas_udf("array<double>")
        def pool(texts: pd.Series) -> pd.Series:
            held(("toxicity",), list)
            return pd.Series([_pool(shared.value, t, neutral).tolist() for t in texts])

        return pool("text").alias("x")

    some = [r["x"][5] for r in sample.where("toxic = 0").limit(NEUTRAL_ROWS).select(pooled(0.0)).collect()]
    neutral = float(np.mean(some)) if some else 0.0
    got = sample.select(pooled(neutral), "toxic").toPandas()
    x, y = np.array(got["x"].tolist()), got["toxic"].to_numpy(dtype=np.float64)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    scale[-1] = max(scale[-1], 1.0)  # where lengths hardly differ, a text of another length is no surprise
    discard(sample)
    discard(picked)
    # a worse word never lowers a score
    return Machine(table, _logistic_upward((x - mean) / scale, y, POOLED - 1), mean, scale, neutral)


def scorer(docs: DataFrame, machine: Machine):
    """A pandas UDF: text -> score. Null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        held(("toxicity",), list)  # drops another stage's model
        return pd.Series(shared.value.score(list(texts)))

    return score


def score_documents(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """docs with the probability of being toxic, named score unless docs has that name.

    Null, empty and wordless texts score 0. All of a long text counts, a part of CHUNK characters at a time.
    Equal texts, repeated rows too, score alike; no rows give none; other columns pass through.
    """
    return docs.withColumn(free_name(docs, "score"), scorer(docs, machine)(F.col(text)))


def drop_toxic(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, null and empty texts among them; columns as they were."""
    name = free_name(docs, "score")
    return score_documents(docs, machine, text).where(F.col(name) < threshold).select(*docs.columns)
