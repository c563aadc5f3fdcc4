"""A bounded table of words and their token ids, for encoders that work word by word."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np

LIMIT = 200_000


class _Index(dict):
    """Numbers words in order of first sight; new ones are listed."""

    def __init__(self, known: Iterable[tuple[bytes, int]] = ()) -> None:
        super().__init__(known)
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordTable:
    """Encodes texts given as lists of words; each distinct word is encoded once while the table holds it.

    encode: gives the ids of each word as the bytes of 32-bit integers.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], limit: int = LIMIT) -> None:
        self.encode, self.limit = encode, limit
        self.index, self.used = _Index(), 0
        self.ids, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def _learn(self) -> None:
        """Encode the words that are new since the last call, all at once."""
        new, self.index.new = self.index.new, []
        own = self.encode(new) if new else []
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        total, first = int(sizes.sum()), len(self.index) - len(new)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.index) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used : self.used + total] = np.frombuffer(b"".join(own), np.int32)
        self.ends[first : first + len(new)] = self.used + np.cumsum(sizes)
        self.used += total

    def start(self) -> None:
        """Before new texts: if the table is full, keep the half that was learnt first, which holds the most frequent words."""
        if len(self.index) > self.limit:
            kept = list(islice(self.index, self.limit // 2))
            self.index = _Index(zip(kept, range(len(kept))))
            self.used = int(self.ends[len(kept) - 1])

    def tokens(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The token ids of each text."""
        flat, cuts = self.joined([word for words in texts for word in words], np.cumsum([0, *map(len, texts)]))
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def joined(self, words: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all words, and where those of words[at[0]], words[at[1]], ... begin."""
        self.start()
        every = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        self._learn()
        ends = self.ends[every]
        starts = np.where(every > 0, self.ends[every - 1], 0)
        size = ends - starts
        behind = np.cumsum(size)
        flat = self.ids[np.repeat(starts - (behind - size), size) + np.arange(behind[-1] if len(behind) else 0)]
        return flat, np.concatenate([[0], behind])[at]
