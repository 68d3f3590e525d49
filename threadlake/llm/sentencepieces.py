"""SentencePiece encoding and decoding by a shared-prefix forward pass.

The distinct marked words of a batch are sorted, which is a depth-first walk of their trie, and the
forward states of a common prefix are kept from word to word. An automaton of the pieces names those
that end at a character, so that no other is tried.

For models of unigram type the pass is Viterbi's: a prefix's forward score is the highest summed score of
the pieces that make it. For models of BPE type, such as the public one, the path of highest sum isn't
the library's: a path is right if each two neighbouring pieces would be merged into nothing else. There
a prefix keeps the one last piece whose pair with the piece before it stands the merges.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import free_name, held

RESULT = "n_ids long, ids binary, ids_crc32 long, exact boolean"
SPACE = "\u2581"
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
CACHE_WORDS, CACHE_PAIRS, SOME_WORDS = 150_000, 200_000, 500_000


class Model:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        plain = [i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        self.pieces = [self.sp.id_to_piece(i) for i in range(n)]
        self.ids = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: -self.sp.get_score(i) for i in plain}
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [p.encode() for p in self.pieces]
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces of this model span words")
        self.start = len(self.pieces) + 0x110000  # stands before the first piece; a character that is no piece is n + its code point
        self.coded = [np.array([i], dtype=self.dtype).tobytes() for i in range(n)]
        self._trie({p: i for p, i in self.ids.items()})
        self.scores = [self.sp.get_score(i) for i in range(n)]
        #: BPE models score their pieces by rank, in whole numbers; unigram models by log probability.
        self.unigram = any(self.scores[i] != int(self.scores[i]) for i in plain)
        self.courses: dict[int, list | None] = {}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _trie(self, ids: dict[str, int]) -> None:
        """States of an automaton of all pieces: children, the state to fall back to, and the pieces that end there, longest first."""
        self.go: list[dict[str, int]] = [{}]
        ends = [-1]
        for piece, i in ids.items():
            s = 0
            for ch in piece:
                t = self.go[s].get(ch)
                if t is None:
                    t = self.go[s][ch] = len(self.go)
                    self.go.append({})
                    ends.append(-1)
                s = t
            ends[s] = i
        self.fail = [0] * len(self.go)
        self.outs: list[tuple[tuple[int, int], ...]] = [()] * len(self.go)
        level = [0]
        while level:
            after = []
            for s in level:
                for ch, t in self.go[s].items():
                    f = self.fail[s]
                    while f and ch not in self.go[f]:
                        f = self.fail[f]
                    self.fail[t] = self.go[f].get(ch, 0) if s else 0
                    i = ends[t]
                    self.outs[t] = (((len(self.pieces[i]), i),) if i >= 0 else ()) + self.outs[self.fail[t]]
                    after.append(t)
            level = after

    def course(self, piece: int) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its characters, as (rank, first part, last part) after each; None if merging makes something else."""
        if piece >= len(self.pieces):
            ch = chr(piece - len(self.pieces))
            return [(0.0, ch, ch)]
        if piece not in self.courses:
            parts, rank = list(self.pieces[piece]), self.rank
            steps = [(0.0, parts[0], parts[-1])]
            while len(parts) > 1:
                best, i = min((rank.get(a + b, 1e18), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best == 1e18:
                    steps = None
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                steps.append((best, parts[0], parts[-1]))
            self.courses[piece] = steps
        return self.courses[piece]

    def stands(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b as neighbours: no step of the two courses, taken by rank, lets the parts at their border merge first."""
        key = a << 22 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self._stands(a, b)
        return ok

    def _stands(self, a: int, b: int) -> bool:
        right = self.course(b)
        if a == self.start or right is None:
            return right is not None
        left, rank = self.course(a), self.rank
        i = j = 0
        while True:
            border = rank.get(left[i][2] + right[j][1], 1e18)
            x = left[i + 1][0] if i + 1 < len(left) else 1e18
            y = right[j + 1][0] if j + 1 < len(right) else 1e18
            if border < x and border <= y:  # among equal ranks the leftmost merges first
                return False
            if x == y == 1e18:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def encode_sorted(self, words: list[str]) -> list[bytes]:
        """Ids of sorted distinct marked words as little-endian 16- or 32-bit numbers."""
        if self.unigram:
            least = min(self.scores[i] for i in self.ids.values()) - 10.0  # the library's score of an unknown character
            spell = lambda p: [p] if p >= 0 else [self.bytes[b] for b in chr(-1 - p).encode("utf-8", "surrogatepass")]
            return [np.array([i for p in path for i in spell(p)], dtype=self.dtype).tobytes() for path in best_paths(words, self.go, self.fail, self.outs, self.scores, least)]
        go, fail, outs, pairs, stands = self.go, self.fail, self.outs, self.pairs, self.stands
        n, pieces, coded = len(self.pieces), self.pieces, self.coded
        states, last = [0], [self.start]  # of each prefix: its state, and the last piece of its path
        before, out = "", []
        for w in words:
            common = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                common += 1
            del last[common + 1 :], states[common + 1 :]
            s, d = states[common], common
            for ch in w[common:]:
                d += 1
                t = go[s].get(ch)
                while t is None and s:
                    s = fail[s]
                    t = go[s].get(ch)
                s = t or 0
                states.append(s)
                for k, p in outs[s]:
                    q = last[d - k]
                    ok = pairs.get(q << 22 | p)
                    if ok or (ok is None and stands(q, p)):
                        last.append(p)
                        break
                else:
                    p = n + ord(ch)
                    if ch in self.ids or not stands(last[d - 1], p):
                        raise ValueError("no path to a prefix of a word")
                    last.append(p)
            path, d = [], len(w)
            while d:
                p = last[d]
                if p < n:
                    path.append(coded[p])
                    d -= len(pieces[p])
                else:
                    path.append(b"".join(coded[self.bytes[x]] for x in chr(p - n).encode("utf-8", "surrogatepass")))
                    d -= 1
            path.reverse()
            out.append(b"".join(path))
            before = w
        return out

    @property
    def dtype(self) -> str:
        return "<u2" if len(self.pieces) <= 1 << 16 else "<u4"

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        some, size = [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            marked = self.sp.normalize(t)
            if SPACE * 2 in marked or not marked.startswith(SPACE):
                words = _WORD.findall(marked) if marked.startswith(SPACE) else [re.match(f"[^{SPACE}]*", marked)[0], *_WORD.findall(marked)]
                words = [w for w in words if w]
            else:
                words = [SPACE + w for w in marked[1:].split(SPACE)]
            some.append((i, words))
            size += len(words)
            if size >= SOME_WORDS:
                self._some(some, out)
                some, size = [], 0
        self._some(some, out)
        return out

    def _some(self, some: list[tuple[int, list[str]]], out: list[bytes]) -> None:
        if not some:
            return
        new = set().union(*(w for _, w in some)).difference(self.words)
        if len(self.words) + len(new) > CACHE_WORDS:
            self.older, self.words = self.words, {}
            new = set().union(*(w for _, w in some))
        again = new.intersection(self.older)
        self.words.update((w, self.older[w]) for w in again)
        new = sorted(new - again)
        self.words.update(zip(new, self.encode_sorted(new)))
        get = self.words.__getitem__
        for i, words in some:
            out[i] = b"".join(map(get, words))

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in np.frombuffer(ids, dtype=self.dtype).tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def best_paths(words: list[str], go: list[dict[str, int]], fail: list[int], outs: list[tuple[tuple[int, int], ...]], scores, unknown: float) -> list[list[int]]:
    """The pieces of highest summed score of each of the sorted words; -1 - c for a character c that no piece covers.

    Forward scores of the prefix that a word shares with the one before it aren't computed again. Of
    equal sums the path with the longest last piece is taken.
    """
    states, best, back = [0], [0.0], [(0, 0)]  # of each prefix: its state, forward score, and last piece with its length
    before, out = "", []
    for w in words:
        common = 0
        for x, y in zip(before, w):
            if x != y:
                break
            common += 1
        for some in (states, best, back):
            del some[common + 1 :]
        s, d = states[common], common
        for ch in w[common:]:
            d += 1
            t = go[s].get(ch)
            while t is None and s:
                s = fail[s]
                t = go[s].get(ch)
            s = t or 0
            states.append(s)
            top, last = best[d - 1] + unknown, (-1 - ord(ch), 1)
            for k, p in reversed(outs[s]):  # longest first, so that the longest of equal sums comes last
                if best[d - k] + scores[p] >= top:
                    top, last = best[d - k] + scores[p], (p, k)
            best.append(top)
            back.append(last)
        path, d = [], len(w)
        while d:
            p, k = back[d]
            path.append(p)
            d -= k
        out.append(path[::-1])
        before = w
    return out


def model(path: str) -> Model:
    return held(("pieces", path), lambda: Model(path))


def piece_ids(path: str):
    """A pandas UDF: text -> its ids, their number and CRC-32 (as 32-bit), and whether decoding gives the text back.

    A null or empty text has no ids. `exact` is false for texts that the model's normalisation changes.
    """

    @F.pandas_udf(RESULT)
    def encode(texts: pd.Series) -> pd.DataFrame:
        import zlib

        m, rows = model(path), []
        width = np.dtype(m.dtype).itemsize
        for t, ids in zip(texts, m.encode(list(texts))):
            rows.append((len(ids) // width, ids, zlib.crc32(np.frombuffer(ids, dtype=m.dtype).astype("<u4").tobytes()), m.decode(ids) == (t or "")))
        return pd.DataFrame(rows, columns=["n_ids", "ids", "ids_crc32", "exact"])

    return encode


def decode_ids(path: str):
    """A pandas UDF: ids as piece_ids gives them -> text; null gives null."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        m = model(path)
        return pd.Series([None if x is None else m.decode(bytes(x)) for x in ids], dtype=object)

    return decode


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with a struct column, named pieces unless docs has that name: n_ids, ids, ids_crc32, exact.

    Null and empty texts have no ids. A text of any length is encoded whole; a batch's texts are
    taken some SOME_WORDS words at a time. Equal texts, repeated rows too, have equal ids; no rows give none;
    other columns pass through.
    """
    return docs.withColumn(free_name(docs, "pieces"), piece_ids(path)(F.col(text)))
