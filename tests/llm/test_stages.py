"""Stages of the pipeline against plain versions, with nulls, empty and odd texts, ties, repeated rows and extra columns. Near duplicates and encoding have files of their own."""

import collections
import hashlib
import math
import random
import re

import corpus_pipeline
from slotloom.llm import langid, mixing

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, replica int"
WORDS = {"en": "the of and to in is that for it with as was on be by this are or".split(), "fr": "le la les des et en un une du que qui dans pour pas sur par au est".split()}
JUNK = [None, "", "!!! 12 --", "Привет мир как дела сегодня", "これは日本語の文章です", "zxqv kjwq xzzq qqjx vvwk pqzx"]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), 0.5, 1) for i, t, lang, src in rows], KIND)


def test_language(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(WORDS[lang]) for _ in range(40)), lang, "s") for i in range(60) for lang in [rnd.choice(["en", "fr"])]]
    rows += [(100 + i, t, None, "s") for i, t in enumerate(JUNK)] + [rows[0], (None, rows[1][1], None, "s")]
    profiles = {}
    for lang in WORDS:
        codes = collections.Counter()
        for _, t, own, _ in rows:
            if own == lang:
                codes.update(dict(zip(*(x.tolist() for x in langid.grams(t)))))
        profiles[lang] = [c for c, _ in sorted(codes.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]]
    ranks = langid.Ranks(profiles)
    least = langid.SLACK * min(ranks.predict(t)[1] for _, t, lang, _ in rows if lang)
    want = [i for i, t, _, _ in rows if (p := ranks.predict(t))[0] != "und" and p[1] >= least]
    out = corpus_pipeline.language(spark, docs_of(spark, rows), "")
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in out.collect()) and out.columns == docs_of(spark, rows).columns
    assert not {100 + i for i in range(len(JUNK))} & set(want) and len(want) == 62


def test_personal_data(spark):
    texts = [None, "", "é👍 write to me@x.io or 10.0.0.1, twice 10.0.0.1", "card 4111 1111 1111 1111!", "+49 (30) 1234567.", "nothing here", "a@b.cd" * 2]
    patterns = {"EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "IP": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "CARD": r"[0-9]([\x20-]?[0-9]){12,}", "PHONE": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def plain(text):
        for kind, p in patterns.items():
            text = re.sub(p, f"[{kind}]", text)
        return text

    rows = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), "").collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i].text == (t if t is None else plain(t)) and rows[i].n_chars == len(rows[i].text or "")


def test_mix(spark):
    rnd = random.Random(3)
    rows = [(i, "x" * rnd.randrange(80), "en", rnd.choice(["big", "big", "big", "small", None])) for i in range(300)] + [(7, None, "en", "tiny"), (None, "y", "en", "big")]
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len(t or "") + 1
    weight = {s: math.sqrt(n) for s, n in size.items()}
    want = collections.Counter()
    for i, t, _, s in rows:
        rate = weight[s] / sum(weight.values()) * sum(size.values()) / size[s]
        parts = max(1, math.ceil(rate / mixing.STEP))
        for part in range(1, parts + 1):
            u = (int(hashlib.md5(f"{mixing.SEED}:{'null' if i is None else i}:{part}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = upto = math.exp(-rate / parts)
            k = 0
            while upto < u:
                k += 1
                p *= rate / parts / k
                upto += p
            want[i, s] += k
    out = corpus_pipeline.mix(spark, docs_of(spark, rows), "")
    assert collections.Counter((r.doc_id, r.source) for r in out.collect()) == +want and out.columns == docs_of(spark, rows).columns
