"""Tokenizers in tasks: loaded once a worker, with a bounded cache of words already encoded."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from threadlake.llm.common import held

#: Words that a worker remembers before it keeps but those of the last batch.
CACHE_WORDS = 600_000
#: The key of a line feed.
LINE = "\0\n"
#: Characters whose classes no Unicode version has changed, so that the pattern cuts them here as in the library.
_PLAIN = re.compile("[\n\x20-\x7e\xa1-\u024f]+")


def tiktoken_encoding(path: str):
    return held(("tiktoken", path), lambda: _tiktoken(path))


def _tiktoken(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer(path: str, special_as_text: bool = False):
    """special_as_text: whether a special token's name in a text is ordinary text; by the library's default it is that token."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = special_as_text
    return t


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _pieces() -> Callable[[str], list[str]]:
    """Cuts a text into the pieces of the byte-level pattern."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


class WordEncoder:
    """Exact ids of whole texts from the ids of their words, for vocabularies of up to 65,536 ids.

    The byte-level pattern always starts a new piece at a space that follows a visible character, so a
    text cut there has the ids of its parts. So has one cut around a single line feed between visible
    characters. Texts with other white space, and texts that name a special token, are encoded whole.
    A batch is cut into words, made distinct and looked up among the words met before by Arrow; Python
    sees only new words. A word that begins with NUL stands for one without a space before it.

    whole maps a text to a list of ids; pieces maps a list of pieces of the pattern to a list of such lists.
    """

    def __init__(self, whole: Callable[[str], list], dtype: str, pieces: Callable[[list[str]], list[list]], specials: tuple[str, ...] = ()):
        self.whole, self.pieces, self.dtype, self.specials = whole, pieces, np.dtype(dtype), specials
        self.cut = _pieces()
        self.words, self.pool = pa.array([], pa.large_string()), np.zeros(0, self.dtype)
        #: Of each word: where its ids start in the pool, and how many there are; -1 for a word with white space inside, or nothing.
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _flat(self, ids: list[list]) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(chain.from_iterable(ids), self.dtype), np.fromiter(map(len, ids), np.int64, len(ids))

    def _cut_ids(self, words: list[str], gap: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without white space and how many each has, from one cut of all words with gap before each."""
        if not words:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        parts = self.cut(gap + gap.join(words))
        begins = np.flatnonzero(np.fromiter((p[0] == gap for p in parts), bool, len(parts)))
        place = {p: i for i, p in enumerate(dict.fromkeys(parts))}
        at = np.fromiter(map(place.__getitem__, parts), np.int64, len(parts))
        bare = gap != " "  # then the gap is the first piece, which is no part of a word
        flat, size = self._flat([[]] * bare + self.pieces([*place][bare:]))
        start = np.cumsum(size) - size
        return flat[_spread(start[at], size[at])], np.add.reduceat(size[at], begins)

    def _learn(self, words: list[str], gap: str) -> None:
        """Append the ids of new words, without their NUL, to the vocabulary's arrays."""
        joined = " ".join(words)
        odd = {}
        if joined.split() != words or not (joined.isascii() or _PLAIN.fullmatch(joined)):
            for i, w in enumerate(words):
                if w.split() != [w]:
                    odd[i] = self.whole(w) if w == "\n" else None
                elif not (w.isascii() or _PLAIN.fullmatch(w)):
                    odd[i] = self.whole(w if gap == "\n" else " " + w)
        flat, n = self._cut_ids([w for i, w in enumerate(words) if i not in odd] if odd else words, gap)
        size, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        plain = np.ones(len(words), bool)
        plain[list(odd)] = False
        size[plain], start[plain] = n, len(self.pool) + np.cumsum(n) - n
        more = [x or [] for x in odd.values()]
        flat2, n2 = self._flat(more)
        size[list(odd)] = np.where([x is None for x in odd.values()], -1, n2) if odd else n2
        start[list(odd)] = len(self.pool) + len(flat) + np.cumsum(n2) - n2
        self.start, self.size = np.concatenate((self.start, start)), np.concatenate((self.size, size))
        self.pool = np.concatenate((self.pool, flat, flat2))

    def _slots(self, words: pa.Array) -> np.ndarray:
        """The place of each distinct word in the vocabulary."""
        at = pc.index_in(words, value_set=self.words)
        slots = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        bare = pc.starts_with(words, "\0").to_numpy(zero_copy_only=False)
        for some, gap in ((~bare & (slots < 0), " "), (bare & (slots < 0), "\n")):
            if some.any():
                slots[some] = len(self.words) + np.arange(some.sum())
                new = words.filter(pa.array(some))
                got = pc.binary_join(pa.ListArray.from_arrays([0, len(new)], new), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
                self._learn([w[1:] for w in got] if gap == "\n" else got, gap)
                self.words = pa.concat_arrays([self.words, new])
        return slots

    def _keep(self, slots: np.ndarray) -> None:
        """Forget all words but those in these places."""
        n = np.maximum(self.size[slots], 0)
        self.pool = self.pool[_spread(self.start[slots], n)]
        self.words, self.start, self.size = self.words.take(pa.array(slots)), np.cumsum(n) - n, self.size[slots]

    def encode_flat(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and how many each has; nothing for null. end follows each text."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole, raw = np.zeros(len(texts), bool), memoryview(texts.buffers()[2] or b"").tobytes()
        for mark in ("\0", *self.specials):
            if mark.encode() in raw:
                whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        nul, nothing = pa.scalar("\0", pa.large_string()), pa.scalar("", pa.large_string())
        cut = pc.split_pattern(pc.binary_join_element_wise(nul, pc.replace_substring(texts, "\n", " \0\n \0"), nothing), " ")
        first, coded = cut.offsets.to_numpy().astype(np.int64), cut.values.dictionary_encode()
        slots = self._slots(coded.dictionary)[coded.indices.to_numpy()[first[0] : first[-1]]]
        first, n = first[:-1] - first[0], np.diff(first)
        size = self.size[slots]
        empty = (n == 1) & (size[first] < 0) & (pc.utf8_length(texts).to_numpy() == 0)
        whole |= np.logical_or.reduceat(size < 0, first) & ~empty
        each = np.maximum(size, 0)
        lengths = np.add.reduceat(each, first)
        ids = self.pool[_spread(self.start[slots], each)]
        if len(self.words) > CACHE_WORDS:
            self._keep(np.unique(slots))
        if whole.any():
            parts, at, ends = [], 0, np.cumsum(lengths)
            for i in np.flatnonzero(whole).tolist():
                own = np.array(self.whole(texts[i].as_py()), dtype=self.dtype)
                parts += [ids[at : ends[i] - lengths[i]], own]
                at, lengths[i] = ends[i], len(own)
            ids = np.concatenate([*parts, ids[at:]])
        if end is not None:
            ids = np.insert(ids, np.cumsum(lengths), end)
            lengths = lengths + 1
        return ids, lengths

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian bytes; none for null."""
        ids, n = self.encode_flat(pa.array(texts, pa.large_string()))
        raw, n = ids.tobytes(), n * self.dtype.itemsize
        return [raw[z - k : z] for z, k in zip(np.cumsum(n).tolist(), n.tolist())]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, size numbers each."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 and (not len(start) or int(start.max()) < 1 << 30) else np.int64
    return np.repeat((start - (ends - size)).astype(kind), size) + np.arange(total, dtype=kind)


def tiktoken_words(path: str, dtype: str = "<u4") -> WordEncoder:
    def build() -> WordEncoder:
        e = _tiktoken(path)
        return WordEncoder(e.encode_ordinary, dtype, lambda parts: [e.encode_ordinary(p) for p in parts])

    return held(("tiktoken words", path, dtype), build)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + others.index(b)) for b in range(256)}


def tokenizer_words(path: str, dtype: str = "<u4", special_as_text: bool = False) -> WordEncoder:
    """A byte-level tokenizer's encoder: the library's model gets the words' pieces, each once while it is cached."""

    def build() -> WordEncoder:
        t = tokenizer(path, special_as_text)
        specials = () if special_as_text else tuple(x.content for x in t.get_added_tokens_decoder().values())
        model, letters = t.model.tokenize, _byte_letters()

        def pieces(parts: list[str]) -> list[list[int]]:
            # all to the byte-level alphabet at once: a line feed stands in no piece of a word
            shown = "\n".join(parts).encode().decode("latin-1").translate(letters).split(letters[10])
            return [[k.id for k in model(x)] for x in shown] if parts else []

        return WordEncoder(lambda x: t.encode(x, add_special_tokens=False).ids, dtype, pieces, specials)

    return held(("tokenizers", path, dtype, special_as_text), build)
