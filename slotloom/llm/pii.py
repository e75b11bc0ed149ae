"""Operator 4: personal data, by candidate gradient boosting, in DataFrame functions alone.

Base spans follow fixed formats and checks and always stay. Beside them, generators with high recall propose overlapping
candidate spans (other phone formats, disguised e-mail addresses, identity numbers, bank accounts, credentials). Boosted
trees score each candidate from features of its format and of the characters around it; of those whose score reaches its
kind's threshold, and which touch no base span but such as they hold whole, the best are added one after another, each unless it meets
one that was added before.

The trees are fitted on the driver on ``TRAIN_ROWS`` candidates that SQL makes up from templates of personal data and of
its look-alikes (no table holds such labels); the features come from the same expressions as those of real candidates.
Thresholds are calibrated per kind to a precision of ``PRECISION`` on templates that the trees which score them have not seen: the templates are
divided into ``FOLDS``, and each fold is scored by trees fitted on the others.

Spans count code points, the end exclusive. Patterns are possessive where giving back could not help, so their time is linear
in the text. Defined results: a null or empty text has no spans; equal texts have equal spans; other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.llm import boosting
from slotloom.llm.common import documents, free_name, written

TRAIN_ROWS = 4000
PRECISION = 0.98
FOLDS = 7
CONTEXT = 32
#: Blocks of the prefix sums over one text's matches.
BLOCK = 256

#: The kinds in order, base formats first. A text is searched only if it holds what every match must have.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains({t}, '@')"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "{digits}"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "{digits}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains({t}, '+')"),
}
#: The generators of further candidates.
PROPOSED = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]++)++", "({t} ilike '%(at)%' or {t} ilike '%[at]%')"),
    "phone": (r"(?<![0-9+])\(?[0-9]{2,4}\)?(?:[ ./-][0-9]{2,4}){2,5}(?![0-9])", "{digits}"),
    "id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "{digits}"),
    "account": (r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])", "{digits}"),
    "secret": (r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{16,}+", "{digits}"),
}
KINDS = ["email", "ip", "card", "phone", "id", "account", "secret"]
#: Words near a span that speak for a kind.
NEAR = {
    "near_phone": "phone|tel|call|fax|mobil|cell|appel|llama|anruf",
    "near_id": "ssn|social|security|passport|identity|dni|ausweis",
    "near_account": "iban|account|bank|konto|cuenta|compte",
    "near_secret": "token|secret|key|password|passwd|bearer|credential|auth",
    "near_other": "page|part|version|date|year|isbn|score|section|chapter|figure|order|commit|release|table",
}
FEATURES = ["kind", "length", "digits", "letters", "uppers", "seps", "longest", "paren", "dots", "hex", "quoted", "assigned", *NEAR, "mixed"]
_SPAN = "array<struct<start:int,end:int,text:string>>"


def _text(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _running(lengths: Column) -> Column:
    """Running sums of an array of integers, in blocks: appending to one long array would take quadratic time."""
    empty = F.array().cast("array<int>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    add = lambda a, v: F.concat(a, F.array(last(a) + v))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda x: F.aggregate(x, empty, add))
    before = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(last(a) + last(x))))
    whole = F.flatten(F.zip_with(sums, before, lambda x, o: F.transform(F.coalesce(x, empty), lambda v: v + o)))
    return F.when(F.size(lengths) > 0, whole).otherwise(empty)


def _guarded(text: str, guard: str, value: Column, kind: str) -> Column:
    return F.when(F.expr(guard.format(t=text, digits="has_digits")), value).otherwise(F.array().cast(kind))


def _found(df: DataFrame, text: str, patterns: dict[str, tuple[str, str]], prefix: str) -> DataFrame:
    """Adds per kind the leftmost non-overlapping matches as spans: the gaps between matches and their lengths give the places."""
    keep = [c for c in df.columns]
    t = F.col(text)
    df = df.select(*keep, *[c for k, (p, g) in patterns.items() for c in (
        _guarded(text, g, F.regexp_extract_all(t, F.lit(p), F.lit(0)), "array<string>").alias(f"{prefix}{k}_m"),
        _guarded(text, g, F.transform(F.split(t, p, -1), lambda x: F.length(x)), "array<int>").alias(f"{prefix}{k}_g"),
    )])
    df = df.select(*keep, *[f"{prefix}{k}_m" for k in patterns], *[
        _running(F.zip_with(F.slice(F.col(f"{prefix}{k}_g"), F.lit(1), F.size(f"{prefix}{k}_m")), f"{prefix}{k}_m", lambda g, m: g + F.length(m))).alias(f"{prefix}{k}_e") for k in patterns
    ])
    span = lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("text"))
    return df.select(*keep, *[F.zip_with(f"{prefix}{k}_m", f"{prefix}{k}_e", span).alias(f"{prefix}{k}") for k in patterns])


def _checked(kind: str, m: Column) -> Column:
    digits = _text(m)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: F.coalesce(x.try_cast("decimal(38,0)") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _features(span: Column, text: Column, kind: int) -> list[Column]:
    m, flag = span["text"], lambda c: c.cast("double")
    before = F.lower(F.substring(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(span["start"], F.lit(CONTEXT))))
    count = lambda pattern: F.length(F.regexp_replace(m, pattern, "")).cast("double")
    values = [
        F.lit(float(kind)),
        F.length(m).cast("double"),
        count("[^0-9]"),
        count("[^A-Za-z]"),
        count("[^A-Z]"),
        count("[A-Za-z0-9]"),
        F.array_max(F.transform(F.split(m, "[^A-Za-z0-9]+"), lambda x: F.length(x))).cast("double"),
        flag(F.contains(m, F.lit("("))),
        count("[^./]"),
        flag(m.rlike("^[0-9a-fA-F]+$")),
        flag(before.rlike("[\"'`]$")),
        flag(before.rlike("[:=] ?[\"'`]?$|bearer $")),
        *[flag(before.rlike(words)) for words in NEAR.values()],
        flag(m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")),
    ]
    return [v.alias(n) for v, n in zip(values, FEATURES)]


def _training_rows(spark: SparkSession) -> DataFrame:
    """Texts made up from templates, with the kind of the personal data they hold, or an empty text, as ``label``."""
    d = lambda n, k: f"substr(lpad(abs(xxhash64(id, {k})) % 1000000000000, 12, '7'), 1, {n})"
    hx = lambda n, k: f"substr(sha2(cast(id * 31 + {k} as string), 256), 1, {n})"
    # Words and openings of sentences around the span.
    words = "the and with sur para mit from pour near then about une ein los under again while report garden window".split()
    opens = ["", "Onder the ", "We said: ", "Note. ", "Please look, ", "Er sagte ", "Il a dit ", "Ayer "]
    pick = lambda texts, k: f"element_at(array({', '.join(repr(x) for x in texts)}), cast(abs(xxhash64(id, {k})) % {len(texts)} as int) + 1)"
    word, opening = pick(words, 99), pick(opens, 98)
    # Of personal data the kind, what comes before the span, and the span; of look-alikes the latter two.
    good = [
        ("phone", "'call '", f"concat('(', {d(3, 1)}, ') ', {d(3, 2)}, '-', {d(4, 3)})"),
        ("phone", "'tel: '", f"concat({d(3, 1)}, '-', {d(3, 2)}, '-', {d(4, 3)})"),
        ("phone", f"concat({word}, ' ')", f"concat('(', {d(3, 1)}, ') ', {d(3, 2)}, '-', {d(4, 3)})"),
        ("phone", "'phone '", f"concat('0', {d(1, 1)}, ' ', {d(2, 2)}, ' ', {d(2, 3)}, ' ', {d(2, 4)}, ' ', {d(2, 5)})"),
        ("phone", "'fax '", f"concat({d(3, 1)}, '.', {d(3, 2)}, '.', {d(4, 3)})"),
        ("id", "'SSN '", f"concat({d(3, 1)}, '-', {d(2, 2)}, '-', {d(4, 3)})"),
        ("id", "'social security number '", f"concat({d(3, 1)}, '-', {d(2, 2)}, '-', {d(4, 3)})"),
        ("account", "'IBAN '", f"concat('DE', {d(2, 1)}, ' ', {d(4, 2)}, ' ', {d(4, 3)}, ' ', {d(4, 4)}, ' ', {d(4, 5)}, ' ', {d(2, 6)})"),
        ("account", "'bank account '", f"concat('FR', {d(2, 1)}, {d(4, 2)}, {d(4, 3)}, {d(4, 4)}, {d(4, 5)}, {d(4, 6)}, {d(3, 7)})"),
        ("secret", "'token = \"'", hx(40, 1)),
        ("secret", "'api_key: '", hx(32, 2)),
        ("secret", "'password='", f"concat('Ab', {hx(18, 3)})"),
        ("secret", "'Authorization: Bearer '", f"concat('eyJ', {hx(40, 4)})"),
        ("email", f"concat({word}, ' ')", f"concat({word}, {d(2, 1)}, ' (at) mail', {d(1, 2)}, ' (dot) com')"),
        ("email", "'write to '", f"concat({word}, '.x [at] host.org')"),
        ("phone", "'mobile '", f"concat({d(3, 1)}, ' ', {d(3, 2)}, ' ', {d(4, 3)})"),
        ("phone", "'anruf '", f"concat('0', {d(3, 1)}, '/', {d(3, 2)}, '-', {d(3, 3)})"),
        ("id", "'my passport is '", f"concat({d(3, 1)}, '-', {d(2, 2)}, '-', {d(4, 3)})"),
        ("account", "'konto '", f"concat('NL', {d(2, 1)}, 'ABNA', {d(4, 2)}, {d(4, 3)}, {d(2, 4)})"),
        ("account", "'cuenta '", f"concat('ES', {d(2, 1)}, ' ', {d(4, 2)}, ' ', {d(4, 3)}, ' ', {d(4, 4)}, ' ', {d(4, 5)}, ' ', {d(4, 6)})"),
        ("secret", "'secret: '", f"concat('sk_', {hx(24, 5)})"),
        ("secret", "'client_secret=\"'", hx(32, 6)),
        ("email", "'mail me: '", f"concat('j', {d(3, 1)}, '(at)post(dot)net')"),
    ]
    bad = [
        ("'dates '", f"concat('20', {d(2, 1)}, '-', {d(2, 2)}, '-', {d(2, 3)}, ' ', {d(2, 4)})"),
        ("'scores '", f"concat({d(2, 1)}, ' ', {d(2, 2)}, ' ', {d(2, 3)}, ' ', {d(2, 4)})"),
        ("'see pages '", f"concat({d(3, 1)}, '-', {d(3, 2)}, '-', {d(3, 3)})"),
        ("'version '", f"concat({d(2, 1)}, '.', {d(2, 2)}, '.', {d(3, 3)}, '.', {d(4, 4)})"),
        ("'section '", f"concat({d(2, 1)}, '.', {d(2, 2)}, '.', {d(2, 3)})"),
        ("'isbn '", f"concat('978-', {d(3, 1)}, '-', {d(2, 2)}, '-', {d(4, 3)})"),
        (f"concat({word}, ' ')", f"concat({d(3, 1)}, ' ', {d(3, 2)}, ' ', {d(3, 3)})"),
        ("'table of '", f"concat({d(4, 1)}, ' ', {d(4, 2)}, ' ', {d(4, 3)}, ' ', {d(4, 4)})"),
        ("'part number '", f"concat({d(3, 1)}, '-', {d(2, 2)}, '-', {d(4, 3)})"),
        ("'commit '", hx(40, 1)),
        (f"concat({word}, ' ')", hx(32, 2)),
        ("'blob '", hx(40, 7)),
        (f"concat({word}, ' of ')", hx(64, 8)),
        ("'md5 '", hx(32, 9)),
        ("'see '", f"concat('articles/20', {d(2, 1)}, '/', {d(2, 2)}, '/some-long-title-here')"),
        (f"concat({word}, ' ')", "repeat('=', 20 + cast(id % 30 as int))"),
        (f"concat({word}, ' ')", f"concat('inter', {word}, '-', {word}, {word}, '-related', {word})"),
        ("'order '", f"concat('AB', {d(2, 1)}, ' ', {d(4, 2)}, ' ', {d(4, 3)}, ' ', {d(4, 4)})"),
        (f"concat({word}, ' ')", "repeat('ha', 8 + cast(id % 9 as int))"),
    ]
    rows = [*[(a, b, repr(k)) for k, a, b in good], *[(a, b, "''") for a, b in bad]]
    case = lambda at: "case cast(id % {} as int) {} end".format(len(rows), " ".join(f"when {i} then {r[at]}" for i, r in enumerate(rows)))
    return spark.range(TRAIN_ROWS).selectExpr("id", f"cast(id % {len(rows)} as int) family", f"concat({opening}, {word}, ' ', {case(0)}, {case(1)}, ' ', {word}, '.') text", f"{case(2)} label")


_MODELS: dict[str, tuple] = {}


def model(spark: SparkSession) -> tuple[tuple[float, list], dict[str, float]]:
    """The trees and each kind's threshold of log-odds; fitted once in a process."""
    if "pii" not in _MODELS:
        made = written(_training_rows(spark), "pii_training").withColumn("has_digits", F.lit(True))
        rows = _candidates(made, "text").select("label", "family", F.explode("cand").alias("c")).select("label", "family", "c.*").collect()
        x = np.array([[r[n] for n in FEATURES] for r in rows])
        y, fold = np.array([int(r["label"] == r["name"]) for r in rows]), np.array([r["family"] for r in rows]) % FOLDS
        score, limit = np.zeros(len(y)), {}
        for f in range(FOLDS):
            score[fold == f] = boosting.predict(boosting.fit(x[fold != f], y[fold != f]), x[fold == f])
        for kind in PROPOSED:
            own = x[:, 0] == KINDS.index(kind)
            order = np.argsort(-score[own], kind="stable")
            s, right = score[own][order], np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            last = np.append(s[1:] != s[:-1], True)[: len(s)]  # equal scores stand or fall together
            good = np.flatnonzero(last & (right >= PRECISION) & (s > 0))
            limit[kind] = float(s[good[-1]]) if len(good) else float("inf")
        trees = boosting.fit(x, y)
        _MODELS["pii"] = trees, limit
    return _MODELS["pii"]


def _candidates(df: DataFrame, text: str) -> DataFrame:
    """Adds ``cand``: all proposed spans with their features."""
    keep = df.columns
    df = _found(df, text, PROPOSED, "p_")
    form = lambda k: lambda s: F.struct(F.lit(k).alias("name"), s["start"].alias("start"), s["end"].alias("end"), *_features(s, F.col(text), KINDS.index(k)))
    each = [F.transform(f"p_{k}", form(k)) for k in PROPOSED]
    return df.select(*keep, F.concat(*each).alias("cand"))


def find_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``added``: arrays of (order, start, end, kind), ordered by the kinds' order, then start."""
    spark = df.sparkSession
    (trees, limits), keep = model(spark), df.columns
    names = [f"c{i}" for i in range(len(keep))]
    t = f"c{keep.index(text)}"
    base_name, added_name = free_name(df, "base"), free_name(df, "added")
    rows = df.toDF(*names).withColumn("has_digits", F.col(t).rlike("[0-9]"))
    rows = _found(rows, t, BASE, "b_")
    passes = lambda kind: lambda s: _checked(kind, s["text"])
    form = lambda kind: lambda s: F.struct(F.lit(KINDS.index(kind)).alias("order"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    base = F.concat(*[F.transform(F.filter(f"b_{k}", passes(k)), form(k)) for k in BASE])
    rows = rows.select(*names, "has_digits", base.alias("base"))
    rows = _candidates(rows, t)
    scored = F.expr(f"transform(cand, c -> struct({boosting.as_sql(trees, [f'c.{n}' for n in FEATURES])} as score, c.name as name, c.start as start, c.end as end))")
    rows = rows.select(*names, "base", scored.alias("scored"))
    limit = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    holds = lambda a, b: (a["start"] <= b["start"]) & (b["end"] <= a["end"]) & (a["end"] - a["start"] > b["end"] - b["start"])
    chosen = F.filter("scored", lambda c: (c["score"] >= limit[c["name"]]) & ~F.exists("base", lambda b: meets(b, c) & ~holds(c, b)))
    ranked = F.array_sort(F.transform(chosen, lambda c: F.struct((-c["score"]).alias("worse"), c["start"].alias("start"), c["end"].alias("end"), c["name"].alias("name"))))
    rows = rows.select(*names, "base", ranked.alias("chosen"))
    empty = F.filter("chosen", lambda c: F.lit(False))
    best = F.when(F.size("chosen") < 2, F.col("chosen")).otherwise(F.aggregate("chosen", empty, lambda a, c: F.when(F.exists(a, lambda o: meets(o, c)), a).otherwise(F.concat(a, F.array(c)))))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    added = F.array_sort(F.transform(best, lambda c: F.struct(order[c["name"]].alias("order"), c["start"].alias("start"), c["end"].alias("end"), c["name"].alias("kind"))))
    return rows.select(*names, "base", added.alias("added")).toDF(*keep, base_name, added_name)


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one, of the kind that starts first."""
    keep, names = df.columns, [f"c{i}" for i in range(len(df.columns))]
    t = F.col(f"c{keep.index(text)}")
    rows = find_spans(df.toDF(*names), f"c{keep.index(text)}")
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("before"), s["kind"].alias("kind"))))
    rows = rows.select(*names, spans.alias("spans"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], -s["before"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct((-s["before"]).alias("at"), F.concat(a["out"], F.array(F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("spans", zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))))
    return rows.select(*[F.when(F.size("spans") > 0, done).otherwise(t).alias(n) if keep[i] == text else F.col(n) for i, n in enumerate(names)]).toDF(*keep)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_spans(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "base", "added")
    is_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", is_kind(k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
