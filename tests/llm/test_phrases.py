"""Phrases stand for the ids that they were made of, make a chunk smaller, and are checked when files are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotloom.llm import bpe, coder, phrases, tokenbin

pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("n,most", [(0, 1), (1, 5), (2, 1), (500, 1), (501, 2), (5000, 3), (5000, 49408), (100_000, 70_000), (300_000, 90_000)])
def test_phrases_round_trip(n, most):
    ids = np.random.default_rng(n).integers(0, most, n).astype(np.int32)
    symbols, different, pairs = phrases.shorten(ids)
    assert (phrases.restore(symbols, different, pairs) == ids).all() and len(symbols) <= n
    assert len(different) == len(set(ids.tolist())) and (len(different) + len(pairs) <= 1 << 16 or not len(pairs))


def test_a_chunk_has_fewer_symbols_and_bytes_than_without_phrases():
    """The coder was given every id before: its time follows their number."""
    some = np.random.default_rng(3)
    words = [some.integers(0, 49408, some.integers(1, 6)) for _ in range(300)]
    ids = np.concatenate([words[i] for i in some.zipf(1.3, 20_000) % 300]).astype(np.int32)
    symbols, different, pairs = phrases.shorten(ids)
    assert len(symbols) < 0.7 * len(ids)
    size = len(b"".join(coder.encode(symbols, len(different) + len(pairs), 2048))) + 4 * (len(different) + 2 * len(pairs))
    assert size < len(b"".join(coder.encode(ids, 49408, 2048)))


@pytest.mark.parametrize("broken", ["transform(ids, i -> i + 1)", "transform(phrases, i -> if(i = element_at(phrases, 1), i + 1, i))", "transform(phrases, i -> i + 60000)"])
def test_damaged_tables_are_refused(spark, broken):
    docs = spark.createDataFrame([(i, "the quick brown fox jumps over the lazy dog") for i in range(40)], "doc_id bigint, text string")
    files = tokenbin.write_tokens(docs.coalesce(1), bpe.default_tokenizer())
    assert tokenbin.read_tokens(files).count() == 40 and files.where(F.size("phrases") > 0).count()
    with pytest.raises(Exception, match="ValueError"):
        tokenbin.read_tokens(files.withColumn(broken.split("(")[1].split(",")[0], F.expr(broken))).collect()
