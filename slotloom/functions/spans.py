"""Column expressions on half-open spans and on the values that requests carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX = 9_223_372_036_854_775_807


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    """Whether two spans share an instant; spans that only touch do not."""
    return (_c(a_start) < _c(b_end)) & (_c(b_start) < _c(a_end))


def contains_instant(start, end, t) -> Column:
    return (_c(start) <= _c(t)) & (_c(t) < _c(end))


def contains_span(a_start, a_end, b_start, b_end) -> Column:
    return (_c(a_start) <= _c(b_start)) & (_c(b_end) <= _c(a_end))


def duration(start="start", end="end") -> Column:
    return _c(end) - _c(start)


def plus(a, b) -> Column:
    """a + b, at most the largest long."""
    return F.coalesce(F.try_add(_c(a), _c(b)), F.lit(MAX))


def minus(a, b) -> Column:
    """a - b, at least 0."""
    return F.greatest(F.coalesce(F.try_subtract(_c(a), _c(b)), F.lit(0)), F.lit(0))


def is_live(now: int, expires_at="expires_at") -> Column:
    """A hold that expires at ``now`` has expired."""
    return _c(expires_at) > F.lit(now)


def is_rule(kind="kind") -> Column:
    return _c(kind).isin("open", "blocked")


def is_allocation(kind="kind") -> Column:
    return _c(kind).isin("hold", "booking")


def is_ulid(text) -> Column:
    return F.upper(_c(text)).rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$")


def parse_ulid(text) -> Column:
    """The id in capitals, or null."""
    return F.when(is_ulid(text), F.upper(_c(text)))


def parse_long(text) -> Column:
    """A number or quoted number, with an optional minus; anything else is null."""
    t = F.trim(_c(text).cast("string"))
    return F.when(t.rlike("^-?[0-9]+$"), t.try_cast("bigint"))


def parse_u32(text) -> Column:
    n = parse_long(text)
    return F.when(n.between(0, 2**32 - 1), n)


def parse_bool(text) -> Column:
    """true/t/1 and other numbers but zero; false/f/0 and zero in any form; anything else is null."""
    t = F.lower(F.trim(_c(text).cast("string")))
    number = F.when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), t.try_cast("double"))
    return F.when(t.isin("true", "t"), F.lit(True)).when(t.isin("false", "f"), F.lit(False)).otherwise(number != 0)


def channel_resource(channel) -> Column:
    """The resource that a channel ``resource_<id>`` follows, or null."""
    return F.when(F.startswith(_c(channel), F.lit("resource_")), parse_ulid(F.substring(_c(channel), 10, 1000)))


def tenant_name(name) -> Column:
    """The name with all but letters, digits, ``_`` and ``-`` left out; null if nothing is left or it is over 256 bytes."""
    kept = F.regexp_replace(_c(name), "[^A-Za-z0-9_-]", "")
    return F.when((kept != "") & (F.octet_length(_c(name)) <= 256), kept)


def span_error(start, end, limits) -> Column:
    """Why a span is refused, or null."""
    s, e = _c(start), _c(end)
    return (
        F.when(s >= e, "InvalidSpan").when((s < 0) | (e > limits.last_ms), "LimitExceeded: timestamp out of range").when(e - s > limits.span_ms, "LimitExceeded: span too wide")
    )


def buffer_error(buffer, limits) -> Column:
    return F.when(~_c(buffer).between(0, limits.span_ms), "LimitExceeded: buffer out of range")
