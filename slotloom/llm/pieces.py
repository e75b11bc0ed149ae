"""From texts to the tokenizers library's ids by way of distinct words and distinct pieces.

The library takes most of its time to normalise a word and to cut it into pieces; its merges are the smaller part. The pieces of plain
words (characters below U+0250 that no composition changes, and no special token) are known without it: lower case, then runs of letters,
single numbers, contractions and runs of the rest. Each distinct piece is merged once by the library's model of the same file; every
other word goes through the whole library, and so do all words of a file whose steps are not the ones known here.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from codecs import charmap_decode
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from slotloom.llm.bpe import byte_characters
from slotloom.llm.words import KEPT, LONG

#: Words, or pieces, that the library gets as one text.
GROUP, MERGED = 64, 512
#: The steps of a file whose pieces are known here.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRE_TOKENIZER = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Plain characters. U+00AD has no width, and U+0130 is two characters in lower case.
_PLAIN = "!-~\xa1-\xac\xae-įı-ɏ"


def _class(kind: str) -> str:
    """The characters of one general category that plain ones are or become in lower case, for a regular expression."""
    lower = {c for i in range(0x21, 0x250) if re.match(f"[{_PLAIN}]", chr(i)) for c in chr(i).lower()}
    return "".join(sorted(c for c in lower if unicodedata.category(c)[0] == kind))


_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_class('L')}]+|[{_class('N')}]|\n|[^\n{_class('L')}{_class('N')}]+")
#: The vocabulary's character of each byte; pieces hold no space, which stands between them.
_BYTES = "".join(" " if b == 0x20 else c for b, c in enumerate(byte_characters()))


def _joined(strings: pa.Array, between: str) -> str:
    whole = pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings)
    return pc.binary_join(whole, between)[0].as_py()


def _taken(flat: np.ndarray, lengths: np.ndarray, codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``flat`` holds runs of ids of these ``lengths``: the runs ``codes`` in turn, and how long each is."""
    ends = np.concatenate([[0], np.cumsum(lengths * 4)])
    runs = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    taken = runs.take(codes)
    if not len(taken):
        return flat[:0], lengths[:0]
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) // 4
    return np.frombuffer(taken.buffers()[2], np.int32, ends[-1]) if ends[-1] else flat[:0], np.diff(ends)


class PieceEncoder:
    """Encodes texts with the tokenizer of ``path``; pieces are kept up to ``keep`` of them and ``KEPT`` characters, long ones not beyond their batch."""

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.merges, self.keep = Tokenizer.from_file(path), Tokenizer.from_file(path), keep
        for tokenizer in (self.whole, self.merges):
            tokenizer.no_truncation()
            tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.special_at = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.merges.normalizer, self.merges.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        end, vocabulary = spec["model"].get("end_of_word_suffix"), spec["model"]["vocab"]
        known = (spec["normalizer"] or {}).get("normalizers") == _NORMALIZER and (spec["pre_tokenizer"] or {}).get("pretokenizers") == _PRE_TOKENIZER
        # a piece's last id, and no other, then bears the end of a word
        known = known and bool(end) and all(c in vocabulary and c + end in vocabulary for c in byte_characters()) and not any("\n" in s for s in self.special)
        self.plain, self.all_plain = (re.compile(f"[{_PLAIN}{more}]*" if known else "(?!)").fullmatch for more in ("", "\n"))
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for s, i in vocabulary.items() if end and s.endswith(end)]] = True
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array(["\n"])  # what stands between words has no ids
        self.pool, self.lengths = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.sizes, self.times = np.ones(1, np.int64), np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Forgets long pieces and, if there are too many, those that one batch alone held since the last time."""
        full = len(self.known) > self.keep or self.sizes[self.sizes <= LONG].sum() > KEPT
        stay = (self.sizes <= LONG) & (self.times > full)
        stay[0] = True
        if stay.sum() > self.keep // 2 and full or self.sizes[stay].sum() > KEPT:
            self._clear()
            return
        self.known = self.known.filter(pa.array(stay))
        self.pool, self.lengths = _taken(self.pool, self.lengths, pa.array(np.flatnonzero(stay)))
        self.sizes, self.times = self.sizes[stay], self.times[stay]
        if full:
            self.times[:] = 0

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none) and, for each text, how many there are. Words end at ASCII's white space; other white space stays in them and is the library's."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        flat, lengths = self._words(_joined(words.dictionary, "\n")) if len(words.dictionary) else (np.empty(0, np.int32), np.empty(0, np.int64))
        ids, own = _taken(flat, lengths, words.indices)
        return ids, np.diff(np.concatenate([[0], np.cumsum(own)])[split.offsets.to_numpy() - split.offsets[0].as_py()])

    def _words(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in turn, and how many each has; a line feed stands between words."""
        special = self.special_at.search(joined)
        if self.all_plain(joined) and not special:
            return self._pieces(joined)
        words = joined.split("\n")
        plain = np.fromiter((bool(self.plain(w)) and not (special and self.special_at.search(w)) for w in words), bool, len(words))
        odd = self._library([w for w, p in zip(words, plain.tolist()) if not p])
        if not plain.any():
            return odd
        (flat, lengths), (more, others) = self._pieces("\n".join(w for w, p in zip(words, plain.tolist()) if p)), odd
        at = np.where(plain, np.cumsum(plain) - 1, plain.sum() + np.cumsum(~plain) - 1)
        return _taken(np.concatenate([flat, more]), np.concatenate([lengths, others]), pa.array(at))

    def _pieces(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        pieces = pa.array(_PIECE.findall(joined.lower() + "\n"), pa.string()).dictionary_encode()
        distinct = pieces.dictionary
        at = pc.index_in(distinct, value_set=self.known)
        own, fresh = at.fill_null(-1).to_numpy().astype(np.int64), distinct.filter(at.is_null())
        if len(fresh):
            flat, lengths = self._merged(fresh)
            own[own < 0] = len(self.known) + np.arange(len(fresh))
            self.known = pa.concat_arrays([self.known, fresh])
            self.pool, self.lengths = np.concatenate([self.pool, flat]), np.concatenate([self.lengths, lengths])
            self.sizes, self.times = np.concatenate([self.sizes, pc.utf8_length(fresh).to_numpy()]), np.concatenate([self.times, np.zeros(len(fresh), np.int64)])
        self.times[own] += 1
        codes = own[pieces.indices.to_numpy()]
        ids, lengths = _taken(self.pool, self.lengths, pa.array(codes))
        upto = np.cumsum(lengths)[codes == 0]
        if len(fresh) and (len(self.known) > self.keep or self.sizes.sum() > KEPT or self.sizes.max() > LONG):
            self._forget()
        return ids, np.diff(upto, prepend=0)

    def _merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The library's merges of pieces, whose bytes are put as its vocabulary's characters."""
        texts = [charmap_decode(_joined(pieces.slice(i, MERGED), " ").encode(), "strict", _BYTES)[0] for i in range(0, len(pieces), MERGED)]
        found = self.merges.encode_batch_fast(texts, add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.int32) for e in found])
        lengths = np.diff(np.flatnonzero(self.last[flat]), prepend=-1)
        if len(lengths) != len(pieces) or not self.last[flat[-1]]:
            raise ValueError("the tokenizer's ids do not end where its pieces do")
        return flat, lengths

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The whole library: words go to it ``GROUP`` at a time, with a special token between them, at which it cuts texts before anything else; words that hold one go by themselves."""
        marker, mark = next(iter(self.special.items())) if self.special else (None, -1)
        odd = [bool(self.special_at.search(w)) for w in words]
        groups, start = [], 0
        while start < len(words):
            stop = start + 1
            while marker and not odd[start] and stop < min(len(words), start + GROUP) and not odd[stop]:
                stop += 1
            groups.append(words[start:stop])
            start = stop
        found = self.whole.encode_batch_fast([g[0] if len(g) == 1 else marker.join(g) for g in groups], add_special_tokens=False)
        flat, lengths = [], []
        for group, e in zip(groups, found):
            ids = np.array(e.ids, np.int32)
            cuts = np.flatnonzero(ids == mark) if len(group) > 1 else []
            lengths.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])).astype(np.int64) - 1)
            flat.append(np.delete(ids, cuts) if len(group) > 1 else ids)
        return np.concatenate([np.empty(0, np.int32), *flat]), np.concatenate([np.empty(0, np.int64), *lengths])


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """Made once in each worker."""
    return PieceEncoder(path)
