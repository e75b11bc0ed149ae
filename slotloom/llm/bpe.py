"""Operator 8: BPE encoding and decoding.

Merges run over a doubly linked list of symbols with a priority queue of merge ranks; an entry whose pair has changed
since it was queued is stale and skipped. Decoding concatenates the vocabulary's strings.

Defined results: a null or empty text has no ids and decodes to the empty string; ids outside the vocabulary decode to
nothing; other columns stay as they are, whatever their names; repeated rows are encoded each by itself.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.llm.common import documents, slices
from slotloom.llm.words import LONG, WordEncoder

_SHIFT = 40
_PLACE = (1 << _SHIFT) - 1


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Bpe:
    """A vocabulary of merges with word ends, read from a file in the tokenizers library's JSON format."""

    def __init__(self, path: str, keep: int = 200_000):
        self.keep = keep
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        chars = byte_characters()
        self.inner = [self.vocab.get(c, -1) for c in chars]
        self.last = [self.vocab.get(c + self.end, -1) for c in chars]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made = [-1]
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[self.vocab[a], self.vocab[b]] = len(self.made) << _SHIFT
            self.made.append(self.vocab[a + b])
        self.kept: dict[str, list[int]] = {}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))

    def merge(self, ids: list[int]) -> list[int]:
        """Merges a list of symbols: the lowest rank first, of equal ranks the leftmost. An entry of the queue is its rank, then its place."""
        n, rank_of, made = len(ids), self.ranks.get, self.made
        queue = [rank | i for i, pair in enumerate(zip(ids, ids[1:])) if (rank := rank_of(pair))]
        if not queue:
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & _PLACE
            j = after[i]
            if j >= n or rank_of((ids[i], ids[j])) != entry - i:  # stale; symbols merged away are -1, which no rank has
                continue
            a = ids[i] = made[entry >> _SHIFT]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if rank := rank_of((a, ids[k])):
                    heappush(queue, rank | i)
            h = before[i]
            if h >= 0 and (rank := rank_of((ids[h], a))):
                heappush(queue, rank | h)
        return [i for i in ids if i >= 0]

    def encode_piece(self, piece: str) -> list[int]:
        ids = self.kept.get(piece)
        if ids is None:
            raw = piece.encode()
            inner = self.inner
            ids = [inner[b] for b in raw]
            ids[-1] = self.last[raw[-1]]
            ids = self.merge(ids if min(ids) >= 0 else [i for i in ids if i >= 0])
            if len(piece) <= LONG:
                if len(self.kept) >= self.keep:
                    self.kept.clear()
                self.kept[piece] = ids
        return ids

    def encode_plain(self, word: str) -> list[int]:
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
        # character by character: a capital sigma at a word's end has no other form
        word = "".join(map(str.lower, word)) if "Σ" in word else word.lower()
        if word.isalpha():
            return self.encode_piece(word)
        return [i for piece in self.pieces.findall(word) for i in self.encode_piece(piece)]

    def encode_word(self, word: str) -> list[int]:
        """The ids of a text without white space."""
        if self.specials is None or not self.specials.search(word):
            return self.encode_plain(word)
        return [i for part in self.specials.split(word) if part for i in ([self.special[part]] if part in self.special else self.encode_plain(part))]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``words`` in turn, and how many each has."""
        lists = [self.encode_word(w) for w in words]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for ids in lists for i in ids), np.int32, int(lengths.sum())), lengths


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Bpe:
    """Read once in each worker."""
    return Bpe(path)


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(vocabulary(path).encode_words)


def _with(batch: pa.RecordBatch, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "added"])


def bpe_encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``: each text's token ids as little-endian unsigned 32-bit integers (binary). ``tokenizer`` is a path on every executor."""
    at = df.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, at):
                flat, counts = encoder(batch.column(at).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts * 4)]).astype(np.int32)
                yield _with(batch, pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype("<u4"))]))

    return _mapped(df, encode, ids, "binary")


def bpe_decode(df: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the vocabulary's strings of ``ids``, special ones included, joined as a tokenizer without a decoder joins them (a space between tokens)."""
    at = df.columns.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = vocabulary(tokenizer).strings
        for whole in batches:
            for batch in slices(whole, at):
                texts = [" ".join(filter(None, map(strings.get, np.frombuffer(raw or b"", "<u4").tolist()))) for raw in batch.column(at).to_pylist()]
                yield _with(batch, pa.array(texts, pa.string()))

    return _mapped(df, decode, decoded, "string")


def _mapped(df: DataFrame, run, name: str, kind: str) -> DataFrame:
    """Columns are passed by place and get their names back, so clashing names do no harm."""
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = ", ".join([*(f"c{i} {t}" for i, (_, t) in enumerate(inner.dtypes)), f"added {kind}"])
    return inner.mapInArrow(run, schema).toDF(*df.columns, name)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number of ids, and digests of the ids and of the text decoded from them."""
    tokenizer = default_tokenizer()
    out = bpe_decode(bpe_encode(documents(spark, sf_dir, "doc_id", "text"), tokenizer).select("doc_id", "ids"), tokenizer)
    return out.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
