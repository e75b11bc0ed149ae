"""The text operators against plain versions, with nulls, empty and odd texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotloom.llm import ann, boosting, bpe, coder, components, langid, media, mixing, pii, quality, simhash, tokenbin, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [
    None, "", " \t\n", "a", "A b", "it's   a Test!! <|endoftext|> é 12 é日本 \n 日本語\x1cfoo\x85bar ΣΑΣ x<|endoftext|>y'll 'S can'T İstanbul ½ ⅷ ̈a ﬁ 👍🏽", "a" * 3000,
    "mail a@b.c_x@d.e or 1.2.3.4.5.6.7.8 é👍 me@x.io 256.1.1.1 01.002.3.0255 +1 (23) 456-78901 4785380592391139", "call (212) 555-1234 token = \"" + "0a1b2c3d4e" * 4 + '"', "the the the the", "the the the the",
]
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids int, media int, score string, base int"


def table(spark, texts, lang=lambda i: "en", source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, lang(i), source(i), len(t or ""), 1, 2, "x", 3) for i, t in enumerate(texts)], KIND)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_equals_the_library(spark, tokenizer):
    out = bpe.bpe_decode(bpe.bpe_encode(table(spark, ODD), bpe.default_tokenizer(), ids="own"), bpe.default_tokenizer(), ids="own").collect()
    assert len(out) == len(ODD) and out[0]["ids"] == 1
    for r in out:
        ids = tokenizer.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.own, "<u4").tolist() == ids and r.decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.bpe_encode(table(spark, []), bpe.default_tokenizer(), ids="own").count() == 0


@pytest.mark.parametrize("n,block,most", [(0, 16, 9), (1, 16, 9), (5, 4, 9), (300, 128, 49408), (3000, 1024, 20), (65, 64, 3)])
def test_coder_round_trip(n, block, most):
    ids = np.random.default_rng(n).integers(0, most, n).astype(np.int32)
    blocks = coder.encode(ids, 49408, block)
    assert (coder.decode(b"".join(blocks), 49408) == ids).all()
    for i, b in enumerate(blocks):  # each alone
        assert (coder.decode(b, 49408) == ids[i * block : (i + 1) * block]).all()
    if n:
        broken = bytearray(b"".join(blocks))
        broken[8] ^= 1
        with pytest.raises(ValueError):
            coder.decode(bytes(broken), 49408)
        with pytest.raises(ValueError):
            coder.decode(bytes(blocks[0][:-1]), 49408)


def test_coder_shrinks_repeats():
    ids = np.tile(np.arange(50, dtype=np.int32), 100)
    assert len(b"".join(coder.encode(ids, 49408, 5000))) < len(ids) * 2 / 4


def test_token_files(spark, tokenizer):
    files = tokenbin.write_tokens(table(spark, ODD).select("doc_id", "text"), bpe.default_tokenizer(), block=64, chunk=200)
    rows = {(r.part, r.chunk, r.before): r for r in tokenbin.read_tokens(files).collect()}
    starts = {(r.part, r.chunk): r["first"] for r in tokenbin.chunk_starts(files).collect()}
    at = 0
    for (_, r), (i, t) in zip(sorted(rows.items()), enumerate(ODD)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert r.doc_id == i and np.frombuffer(r.ids, "<u4").tolist() == ids and starts[r.part, r.chunk] + r.before == at
        at += len(ids)
    assert len(rows) == len(ODD) and tokenbin.read_tokens(tokenbin.write_tokens(table(spark, []).select("doc_id", "text"), bpe.default_tokenizer())).count() == 0


def test_media(spark):
    out = media.probe(media.with_media(table(spark, ODD)).withColumnRenamed("_media", "own"), "own", digests=True).collect()
    for r in out:
        payload = media.padded(ODD[r.doc_id])
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:]) and r.codec == "raw " and r.n_samples * media.FRAME == len(payload)
        assert b"".join(r.own[k.start : k.end] for k in r.keyframes) == b"".join(payload[i : i + media.FRAME] for i in range(0, len(payload), media.FRAME * media.KEY_EVERY))
    good = media.pack(b"x" * 192 * 130)
    bad = [None, b"", b"\0" * 40, good[:300], good[:-1], good.replace(b"stsz", b"free")]
    rows = media.probe(spark.createDataFrame([(i, None if m is None else bytearray(m)) for i, m in enumerate(bad)], "i int, media binary")).orderBy("i").collect()
    assert [r.codec for r in rows] == [None] * 6 and rows[0].error is None and all(r.error for r in rows[1:])


def brute_components(prints):
    label = {i: i for i, _ in prints}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if i < j and ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return {i: find(i) for i, _ in prints}


@pytest.mark.parametrize("cap", [512, 3])
def test_near_duplicates(spark, cap, monkeypatch):
    """With a small cap, crowded buckets go through all three levels."""
    rnd, prints = random.Random(cap), []
    for group in range(12):
        fp = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 3, 25])):
            prints.append((len(prints), fp))
            for _ in range(rnd.randint(0, 3)):
                fp ^= 1 << rnd.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(f)) for i, f in prints], "id bigint, fp bigint")
    monkeypatch.setattr(simhash.links, "__defaults__", (3, cap))
    assert {r.id: r.component_id for r in simhash.near_duplicates(df).collect()} == brute_components(prints)


def test_covering_is_one():
    rnd = random.Random(1)
    for level in range(3):
        masks = simhash.covering(level)
        for _ in range(500):
            d = sum(1 << b for b in rnd.sample(range(64), 3))
            assert any(not d & m for m in masks)
    free = [64 - (a | b | c).bit_count() for a in simhash.covering(0) for b in simhash.covering(1) for c in simhash.covering(2)]
    assert max(free) <= 12


def test_first_of_each(spark):
    docs = table(spark, ODD)
    again = docs.where("doc_id = 4").withColumn("text", F.lit("another text altogether here"))
    none = docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("bigint"))
    kept = sorted((r.doc_id is not None, r.doc_id or 0) for r in simhash.first_of_each(docs.unionByName(again).unionByName(none)).collect())
    assert [i for ok, i in kept if ok] == [0, 3, 4, 5, 6, 7, 8, 9] and kept[0] == (False, 0)
    assert simhash.first_of_each(table(spark, [])).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 202), (201, 202), (200, 202)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


#: The base formats as plain patterns.
PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    def fits(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m.split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in PLAIN for m in re.finditer(p, text or "") if fits(k, m.group())]


def test_personal_data(spark):
    rnd = random.Random(5)
    odd = ODD + ["".join(rnd.choice("a1.@+-() 2") for _ in range(80)) for _ in range(150)] + [" ".join(["127.0.0.1"] * 700)]
    rows = pii.find_spans(table(spark, odd)).collect()
    assert len(rows) == len(odd)
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r["_base"]] == plain_spans(odd[r.doc_id])
    added = {r.doc_id: [(s.kind, odd[r.doc_id][s.start : s.end]) for s in r["added"]] for r in rows}
    assert added[8] == [("phone", "(212) 555-1234"), ("secret", "0a1b2c3d4e" * 4)]
    clean = pii.redact(table(spark, odd)).collect()
    assert next(r for r in clean if r.doc_id == 8).text == 'call [PHONE] token = "[SECRET]"' and next(r for r in clean if r.doc_id == 0).text is None
    assert not any(plain_spans(r.text) for r in clean if r.doc_id in (7, 8))
    assert pii.redact(table(spark, [])).count() == 0


def test_boosting_sql(spark):
    x = np.random.default_rng(0).normal(size=(400, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(int)
    model = boosting.fit(x, y)
    assert ((boosting.predict(model, x) > 0) == y).mean() > 0.97
    got = spark.createDataFrame(x.tolist(), "a double, b double, c double").selectExpr(boosting.as_sql(model, ["a", "b", "c"])).collect()
    assert np.allclose([r[0] for r in got], boosting.predict(model, x))


def test_mixing(spark):
    docs = table(spark, ["x" * 99] * 3000, source=lambda i: None if i % 10 == 0 else "big" if i % 3 else "small")
    out = mixing.poisson_mix(docs, {"big": 1.0, "small": 3.0}).groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in out}
    assert None not in counts and abs(counts["big"] - 750) < 120 and abs(counts["small"] - 2250) < 200
    many = mixing.poisson_mix(docs.where("doc_id < 30"), {"big": 1.0}, total=30 * 100 * 40).groupBy("doc_id").count()
    assert 40 < many.agg(F.avg("count")).first()[0] < 80
    rows = mixing.poisson_mix(docs).collect()
    assert [r.mix_key for r in rows] == sorted(r.mix_key for r in rows) and {tuple(r) for r in rows} == {tuple(r) for r in mixing.poisson_mix(docs.repartition(7)).collect()}
    assert mixing.poisson_mix(table(spark, [])).count() == 0
    assert mixing.poisson_mix(table(spark, ODD)).count() > 0


WORDS = {"en": "the of and to in is that for it with as was on be by this are or".split(), "fr": "le la les des et en un une du que qui dans pour pas sur par au est".split()}


def made(lang, rnd, more=()):
    words = [rnd.choice(WORDS[lang]) for _ in range(40)] + list(more)
    rnd.shuffle(words)
    return " ".join(words)


def test_language(spark):
    rnd = random.Random(2)
    langs = [rnd.choice(["en", "fr"]) for _ in range(200)]
    texts = [made(x, rnd) for x in langs]
    docs = table(spark, texts + ODD, lang=lambda i: langs[i] if i < 100 else None)
    out = langid.identify(docs, langid.learn(docs)).collect()
    assert all(r.lang_pred == langs[r.doc_id] and 0 < r["_score"] <= 1 for r in out if r.doc_id < 200)
    odd = {r.doc_id - 200: (r.lang_pred, r["_score"]) for r in out if r.doc_id >= 200}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and odd[9] == odd[10]
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"} and langid.learn(table(spark, [])) == {}


def test_grams_by_counting():
    from collections import Counter

    for text in ("Ab c", "a1b", "été où", "日本 日本", "x" * 50, ("ab" * 40 + " ") * 3):
        seq = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        want = Counter(g for n in (1, 2, 3) for g in (seq[i : i + n] for i in range(len(seq) - n + 1)) if g != " ")
        codes, counts = langid.grams(text)
        name = lambda c: "".join(chr(x) for x in (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF) if x)
        assert {name(int(c)): int(n) for c, n in zip(codes, counts)} == dict(want)


@pytest.mark.parametrize("operator,bad", [(toxicity.toxicity, "idiot"), (quality.quality, "###")])
def test_classifiers(spark, operator, bad):
    rnd = random.Random(4)
    label = [rnd.randrange(2) for _ in range(400)]
    texts = [made("en", rnd, [bad] * 2 if y else []) for y in label]
    docs = table(spark, texts + ODD)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(label[:250])] + [(1, label[1]), (2, 0), (2, 1), (None, 1), (3, None), (9999, 1)], "doc_id bigint, y int")
    out = operator(docs, docs, labels, label="y").collect()
    assert len(out) == len(texts) + len(ODD) and all(0 <= r["_score"] <= 1 for r in out)
    assert np.mean([r.predicted == label[r.doc_id] for r in out if 250 <= r.doc_id < 400]) > 0.97
    empty = {r["_score"] for r in out if r.doc_id - 400 in (0, 1)}
    assert len(empty) == 1
    one = operator(docs, docs, labels.where("y = 1"), label="y").select("_score").distinct().collect()
    assert [r[0] for r in one] == [1.0]
    assert {r[0] for r in operator(docs, docs, labels.limit(0), label="y").select("_score").collect()} == {0.5} and operator(table(spark, []), docs, labels, label="y").count() == 0


def test_counterfactuals_level_identity_terms():
    rnd = random.Random(6)
    texts, label = [], []
    for i in range(300):  # the labels hold more insults beside one group than beside the other
        y = i % 2
        texts.append(made("en", rnd, (["idiot"] if y else []) + (["muslim"] if (y if rnd.random() < 0.8 else not y) else ["christian"])))
        label.append(y)
    gap = []
    for fair in (0.0, 1.0):
        toxicity.FAIR, old = fair, toxicity.FAIR
        of = toxicity.features()
        w, b = toxicity.fit([of(t) for t in texts], np.array(label), 0.5)
        toxicity.FAIR = old
        score = toxicity.scorer(w, b)
        x, z = score(["the muslim was in the", "the christian was in the"])
        gap.append(abs(np.log(x / (1 - x)) - np.log(z / (1 - z))))
    assert gap[1] < gap[0] / 3


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(900, 16)) + 4 * (np.arange(900) % 3)[:, None], np.tile(rng.normal(size=16), (60, 1))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [None] + [1.0] * 15), (None, x[1].tolist()), (2080, [1.0, 2.0])]
    table_ = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.neighbours(table_, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    d, hit, n = x.astype(np.float64), 0, 0
    assert sorted(got) == list(range(0, 960, 20))
    for q, found in got.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 21)) and all(abs(d[q] @ d[v] - s) < 1e-9 for _, v, s in found)
        order = sorted((-(d[q] * d[v]).sum(), v) for v in range(960) if v != q)[:20]
        hit, n = hit + len({v for _, v in order} & {v for _, v, _ in found}), n + 20
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
    assert hit / n >= 0.9
    assert ann.neighbours(table_.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_classifiers_on_few_labels(spark, operator):
    """None to ten labelled rows, of one class or both, with or without texts: scores stay within 0 and 1, and are the share of label 1 where a class has no text."""
    docs = table(spark, ["the of and", "to in is bad", "on be by", None, "", "are or bad", "as was", "that it", "for bad", "with on"])
    kind = "doc_id bigint, y int"
    cases = [[], [(0, 0), (1, 1)], [(0, 0), (1, 1), (2, 0), (5, 1)], [(i, int(i == 1)) for i in range(6)], [(i, i % 2) for i in range(10)], [(90, 0), (91, 1)], [(3, 0), (4, 1)], [(0, 0), (91, 1)]]
    for rows in cases:
        scores = [r["_score"] for r in operator(docs, docs, spark.createDataFrame(rows, kind), label="y").collect()]
        assert len(scores) == 10 and all(0 <= s <= 1 for s in scores), rows
        if not rows or rows[-1][0] >= 90:
            assert set(scores) == {0.5}
    none = docs.limit(0)
    assert {r["_score"] for r in operator(docs, none, spark.createDataFrame(cases[4], kind), label="y").collect()} == {0.5}


def test_fit_of_the_hinge_loss():
    """Dual coordinate descent against plain subgradient steps on the same loss."""
    rng = np.random.default_rng(2)
    x = rng.random((60, 12)) < 0.4
    y = (x[:, 0] | x[:, 1]).astype(int)
    rows = [[np.flatnonzero(r)] for r in x]
    held, kept = quality.split(y, 5)
    t = y[kept] * 2.0 - 1
    p, q = (1 + x[kept][t == c].sum(0) for c in (1, -1))
    p, q = (np.concatenate([v, np.ones(4)]) for v in (p, q))
    z = np.concatenate([np.pad(x[kept], ((0, 0), (0, 4))) * (np.log(p / p.sum()) - np.log(q / q.sum())), np.ones((len(kept), 1))], 1)
    loss = lambda w: 0.5 * w @ w + quality.COST * np.maximum(0, 1 - t * (z @ w)).sum()
    w = best = np.zeros(17)
    for k in range(20_000):
        w = w - (w - quality.COST * z.T @ (t * (t * (z @ w) < 1))) / (k + 10)
        best = min(best, w, key=loss)
    old, quality.MIX = quality.MIX, 1.0
    weights, bias = quality.fit(rows, y, 0.5, bits=4)
    quality.MIX = old
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    slope, _ = quality.calibrated(z_margin := (np.pad(x[held], ((0, 0), (0, 4))) * ratio) @ best[:16] + best[16], y[held], y, 0.5)
    found = (np.pad(x, ((0, 0), (0, 4))) @ weights) + bias
    plain = (np.pad(x, ((0, 0), (0, 4))) * ratio) @ best[:16] + best[16]
    assert len(z_margin) and np.isfinite(slope) and np.corrcoef(found, plain)[0, 1] > 0.99


def test_fingerprints_by_counting():
    import xxhash

    rnd = random.Random(8)
    texts = [None, "", " ", "One", "one two", "A b C d", "İ ß\u00a0x y\x1cz \x0bw"] + [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(1, 60))) for _ in range(50)]
    for words in (3, 5):
        for text, fp in zip(texts, simhash.fingerprints(texts, words).tolist()):
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            own = re.findall("[^\x20\x09-\x0d]+", lower)
            grams = [" ".join(own[i : i + words]) for i in range(len(own) - words + 1)] or ([" ".join(own)] if own else [])
            h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
            assert fp == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_out_of_place_distance():
    rnd = random.Random(9)
    texts = {lang: " ".join(made(lang, rnd) for _ in range(30)) for lang in WORDS}
    profiles = {lang: langid.ranked(*langid.grams(t)).tolist() for lang, t in texts.items()}
    ranks = langid.Ranks(profiles)
    for text in ("the of un une", "that le les pour it", "zzz", "a"):
        own = langid.ranked(*langid.grams(text)).tolist()
        far = {k: sum(abs(i - p.index(g)) if g in p else langid.PROFILE for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert ranks.predict(text) == (best, pytest.approx(1 - far[best] / (langid.PROFILE * len(own))))


def test_neighbours_across_shards(spark):
    """Several shards and more than one batch of queries, doubles, and columns with clashing names."""
    x = np.random.default_rng(3).normal(size=(1500, 8))
    rows = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, qid int, shard int")
    hit = n = 0
    found = {}
    for r in ann.neighbours(rows, F.col("vec_id") % 5 == 0, shard_rows=200).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(found) == list(range(0, 1500, 5))
    for q, own in found.items():
        own.sort()
        assert [k for k, _, _ in own] == list(range(1, 21)) and all(abs(x[q] @ x[v] - s) < 1e-12 for _, v, s in own)
        best = [v for _, v in sorted((-(x[q] @ x[v]), v) for v in range(1500) if v != q)[:20]]
        hit, n = hit + len(set(best) & {v for _, v, _ in own}), n + 20
    assert hit / n >= 0.95


def test_media_of_two_tracks(spark):
    one = media.pack(b"x" * 192 * 30)
    trak = next(one[a - 8 : b] for path, a, b in media.walk(memoryview(one)) if path[-1] == b"trak")
    at = one.index(b"moov") - 4
    size = int.from_bytes(one[at : at + 4], "big")
    two = one[:at] + (size + len(trak)).to_bytes(4, "big") + one[at + 4 : at + size] + trak + one[at + size :]
    split = one + media.box(b"moof", media.box(b"mfhd", b"\0" * 8))
    rows = media.probe(spark.createDataFrame([(1, bytearray(one)), (2, bytearray(two)), (3, bytearray(split))], "i int, media binary")).orderBy("i").collect()
    assert [len(r.tracks or []) for r in rows] == [1, 2, 0] and rows[2].error and rows[0].tracks[0].keyframes == rows[0].keyframes


def test_added_spans_on_labelled_texts(spark):
    """Personal data and look-alikes in sentences unlike those the trees are fitted on: precision and recall of what is added."""
    rnd = random.Random(12)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    hx = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    good = [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"], ["Ring me on phone ", "Her cell is "]
    ids = [lambda: f"{d(3)}-{d(2)}-{d(4)}"], ["social security no. ", "SSN: "]
    accounts = [lambda: f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"], ["transfer to IBAN ", "to bank account "]
    secrets = [lambda: f'"{hx(40)}"'], ["api_token = ", "the secret_key: "]
    bad = [lambda: f"{d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"20{d(2)}-{d(2)}-{d(2)} {d(2)}", lambda: "-" * 30, lambda: f"978-{d(3)}-{d(2)}-{d(4)}", lambda: hx(40)], ["ISBN ", "version ", "see pages ", "commit "]
    texts, want = [], []
    for _ in range(60):
        for (spans, before), label in ((good, 1), (ids, 1), (accounts, 1), (secrets, 1), (bad, 0), (bad, 0)):
            span, lead = rnd.choice(spans)(), rnd.choice(["Yesterday ", "Bonjour, ", "", "He wrote that "]) + rnd.choice(before)
            at = len(lead) + (span[0] == '"')
            texts.append(f"{lead}{span}, and so on")
            want.append((at, at + len(span.strip('"'))) if label else None)
    found = {r.doc_id: {(s.start, s.end) for s in r["added"]} for r in pii.find_spans(table(spark, texts)).collect()}
    n = sum(map(len, found.values()))
    hit = sum(w in found[i] for i, w in enumerate(want) if w)
    assert hit / n >= 0.95 and hit / sum(map(bool, want)) >= 0.6, (hit, n, sum(map(bool, want)))


def test_best_spans_are_taken_in_turn(spark):
    text = "call (212) 555-1234 or fax 212.555.1234 now; to IBAN DE44 5001 0517 5407 3249 31 please"
    row = pii.find_spans(table(spark, [text])).first()
    assert not any(a.start < b.end and b.start < a.end for a in row["added"] for b in row["added"] if a != b) and row["added"]
