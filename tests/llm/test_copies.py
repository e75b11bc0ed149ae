import random

import corpus_pipeline
from slotloom.llm import copies


def jaccard(a: str, b: str) -> float:
    x, y = (set(zip(*(t.split()[k:] for k in range(5)))) for t in (a, b))
    return len(x & y) / len(x | y)


def test_copies_at_the_threshold(spark):
    """Chains of copies, each of a Jaccard index of 0.7 to 1 to the one before, against components of all pairs of at least 0.8."""
    rnd, texts = random.Random(5), []
    for _ in range(60):
        w = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([60, 150, 250]))]
        for _ in range(rnd.choice([1, 2, 5])):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(rnd.randrange(1, 1 + len(w) // 25)):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(3000)}"
    rnd.shuffle(texts)
    group = list(range(len(texts)))
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    for i, j in linked * 10:
        group[i] = group[j] = min(group[i], group[j])
    expected = {i for i, g in enumerate(group) if i == g}
    rows = [(i, t, "xx", "s", len(t)) for i, t in enumerate(texts)] + [(1000, texts[0].upper(), "xx", "s", 1), (1001, None, "xx", "s", 0), (1002, " ", "xx", "s", 1), (1003, "only three words", "xx", "s", 1), (None, texts[0], "xx", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(linked) > 50 and len(expected) > 60
    assert sorted(kept, key=str) == sorted(expected | {1001, 1003, None}, key=str)


def test_members_that_do_not_resemble_the_hub(spark):
    """One bucket holds everything; the links are between members of which at most one resembles the smallest."""
    base = [f"w{i}" for i in range(104)]
    off = lambda n: " ".join([f"y{i}" for i in range(n)] + base[n:])
    texts = {1: off(0), 2: off(9), 3: off(17), 4: off(25), 5: off(80), 6: off(82)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    nodes = spark.createDataFrame([(i, 100, [7]) for i in texts], "v bigint, n bigint, keys array<bigint>")
    found = {(r.u, r.v) for r in copies.links(nodes, docs).collect()}
    expected = {(i, j) for i in texts for j in texts if i < j and jaccard(texts[i], texts[j]) >= 0.8}
    parts = lambda pairs: {frozenset(k for k in texts if _reach(pairs, i, k)) for i in texts}
    assert found <= expected and parts(found) == parts(expected) and (5, 6) in found and len(parts(found)) < len(texts)


def _reach(pairs, a, b) -> bool:
    seen, todo = {a}, [a]
    while todo:
        x = todo.pop()
        for y in [v for u, v in pairs if u == x] + [u for u, v in pairs if v == x]:
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return b in seen
