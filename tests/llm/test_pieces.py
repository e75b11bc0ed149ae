"""Pieces known without the library give the library's ids, and the library is asked for few of them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from slotloom.llm import bpe, pieces

public_tokenizers = pytest.importorskip("public_tokenizers")


def texts():
    some = random.Random(1)
    odd = "aAbTK'sS12½ª²é ÉßẞİıǅÀ́\n\t\xa0\xad\x85\x1c<|endoftext|>.,_-ÿŸſ日Σσ"
    yield from (None, "", " \t\n", "a" * 3000, "don't'x 's's'RE'Ve'lL'd x<|endoftext|>y'll")
    yield from (f"{chr(i)}A{chr(i)}1'{chr(i)} {chr(i)}'s" for i in range(1, 0x3400))
    yield from ("".join(some.choice(odd) for _ in range(some.randint(0, 30))) for _ in range(5000))


def test_pieces_equal_the_library():
    from tokenizers import Tokenizer

    every = list(texts())
    encode = pieces.PieceEncoder(bpe.default_tokenizer(), keep=500)
    found = [encode(pa.array(every[a : a + 900], pa.string())) for a in range(0, len(every), 900)]  # pieces are forgotten again and again
    assert len(encode.known) == len(encode.lengths) == len(encode.sizes) == len(encode.times) and encode.pool.size == encode.lengths.sum()
    ids, counts = (np.concatenate(part) for part in zip(*found))
    expected = [e.ids for e in Tokenizer.from_file(bpe.default_tokenizer()).encode_batch([t or "" for t in every], add_special_tokens=False)]
    assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]
    none, counts = pieces.PieceEncoder(bpe.default_tokenizer())(pa.array([], pa.string()))
    assert not len(none) and not len(counts)


def test_plain_words_share_their_pieces():
    """Words that differ in case and marks were each put through the whole library; now a piece is merged once, over batches too."""
    encode, asked = pieces.PieceEncoder(bpe.default_tokenizer()), []
    merged, encode._library = encode._merged, lambda words: pytest.fail(f"the whole library was asked for {words}") if words else None
    encode._merged = lambda fresh: asked.extend(fresh.to_pylist()) or merged(fresh)
    for text in ("Élan élan, ÉLAN.", "(élan) Élan!"):
        encode(pa.array([text]))
    assert sorted(asked) == ["!", "(", ")", ",", ".", "élan"]
