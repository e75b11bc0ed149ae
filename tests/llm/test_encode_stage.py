import hashlib

import corpus_pipeline
import numpy as np
from slotloom.llm import bpe


def test_ids_are_decoded(spark):
    texts = ["Some words, and 12 more.", "", None, "naïve Größe\nline"]
    docs = spark.createDataFrame([(i, t, "xx", "s", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = corpus_pipeline.encode(spark, docs, "").collect()
    strings = bpe.vocabulary(bpe.default_tokenizer()).strings
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 3]
    for r in rows:
        ids = np.frombuffer(r.ids or b"", "<u4").tolist()
        assert r.n_tokens in (len(ids), None) and r.decoded_sha256 == hashlib.sha256(" ".join(filter(None, map(strings.get, ids))).encode()).hexdigest()
