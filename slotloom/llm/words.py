"""From texts to token ids by way of distinct words.

The vocabulary's pre-tokenizer drops white space and none of its steps looks across it, so the ids of a text are
the ids of its words in turn. A worker encodes each distinct word once and gathers the ids of all words with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Unicode's White_Space characters. str.split() also splits at U+001C to U+001F, which are not among them.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEPARATORS = re.compile("[\x1c-\x1f]")
_RUN = re.compile(f"[^{WHITE}]+")


def split_words(text: str) -> list[str]:
    return _RUN.findall(text) if _SEPARATORS.search(text) else text.split()


class _Codes(dict):
    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.fresh.append(word)
        return code


#: Characters of all words that are kept, at most; a word of more than ``LONG`` is forgotten with the batch that holds it.
KEPT, LONG = 8 << 20, 256


class WordEncoder:
    """Encodes texts with ``encode_words`` (from distinct words to all their ids and how many each has), which it asks once for each word it keeps."""

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep: int = 400_000):
        self.encode_words, self.keep = encode_words, keep
        self._clear()

    def _clear(self) -> None:
        self.codes, self.held = _Codes(), 0
        self.pool, self.starts, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and, for each text, how many there are."""
        words: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                words += split_words(text)
            ends.append(len(words))
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if self.codes.fresh:
            flat, lengths = self.encode_words(self.codes.fresh)
            sizes = list(map(len, self.codes.fresh))
            self.held += sum(sizes)
            long = max(sizes) > LONG
            self.codes.fresh = []
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
            self.pool, self.lengths = np.concatenate([self.pool, flat]), np.concatenate([self.lengths, lengths])
        else:
            long = False
        lengths = self.lengths[codes]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.repeat(self.starts[codes] - upto[:-1], lengths) + np.arange(upto[-1])]
        if long or len(self.codes) > self.keep or self.held > KEPT:
            self._clear()
        return ids, np.diff(upto[ends])
