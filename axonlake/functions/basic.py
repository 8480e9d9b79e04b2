"""Ratios that may be undefined, quantile rules, thresholds, predicates and string rules. Undefined is never zero."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = (">=", ">", "<=", "<")


def ratio(numerator: Column, denominator: Column, basis: str = "") -> Column:
    """struct(numerator, denominator, value, defined, basis); a zero or null denominator leaves value null and defined false."""
    n, d = numerator.cast("double"), denominator.cast("double")
    defined = F.coalesce(d != 0, F.lit(False)) & n.isNotNull()
    return F.struct(n.alias("numerator"), d.alias("denominator"), F.when(defined, n / d).alias("value"), defined.alias("defined"), F.lit(basis).alias("basis"))


def divided(numerator: Column, denominator: Column) -> Column:
    """The quotient in double, null where it is undefined."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))


def nearest_rank(column: str, q: float) -> Column:
    """Element number ceil(q * n) of the sorted values that are not null; q = 0 gives the least."""
    return F.min(column) if q == 0 else F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def mid_rank(value: Column, reference: Column) -> Column:
    """Share of the values that are below the reference, equal ones as half; null without values or reference."""
    known = F.count(F.when(value.isNotNull() & reference.isNotNull(), 1))
    return F.when(known > 0, (F.count_if(value < reference) + 0.5 * F.count_if(value == reference)) / known)


def passes(value: Column, op: str, limit: Column) -> Column:
    """Whether a metric meets its limit; an undefined metric fails."""
    if op not in COMPARISONS:
        raise ValueError(f"comparison must be one of {COMPARISONS}")
    test = {">=": value >= limit, ">": value > limit, "<=": value <= limit, "<": value < limit}[op]
    return F.coalesce(test & ~F.isnan(value.cast("double")), F.lit(False))


def is_unknown(label: Column) -> Column:
    """Null, blank or `unclear` in any case."""
    return label.isNull() | F.lower(F.trim(label)).isin("", "unclear")


def equals(column: str, value) -> Column:
    """column = value; null never matches."""
    return F.coalesce(F.col(column) == F.lit(value), F.lit(False))


def any_of(column: str, values: Iterable) -> Column:
    """column is one of at least two distinct values; null never matches."""
    values = list(values)
    if len(set(values)) != len(values) or len(values) < 2:
        raise ValueError("any needs two or more distinct values")
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def hex_patch(d1: Column, d2: Column, radius: int) -> Column:
    """Within `radius` steps of the origin of a hexagonal grid; null or NaN is outside, a fraction is an error."""
    d1, d2 = d1.cast("double"), d2.cast("double")
    missing = d1.isNull() | d2.isNull() | F.isnan(d1) | F.isnan(d2)
    whole = (d1 == F.floor(d1)) & (d2 == F.floor(d2))
    inside = F.greatest(F.abs(d1), F.abs(d2), F.abs(d1 - d2)) <= radius
    return F.when(missing, F.lit(False)).when(~whole, F.raise_error(F.lit("hex coordinates must be whole")).cast("boolean")).otherwise(inside)


def canonical_predicate(kind: str, column: str, values: Iterable[str]) -> tuple[str, str]:
    """A text of the predicate that doesn't depend on the order of its values, and its SHA-256."""
    text = f"{kind} {json.dumps(column)} [{', '.join(json.dumps(v) for v in sorted(values))}]"
    return text, hashlib.sha256(text.encode()).hexdigest()


def in_order(values: str, order: list[str]) -> Column:
    """Aggregate: the sum of a column in a declared order of its rows, the same to the last bit in any partitioning."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(values).cast("double").alias("v"))))
    return F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["v"])


def ordered_digest(columns: list[str], order: list[str]) -> Column:
    """Aggregate: SHA-256 over the rows of a group in a declared order; groups must be of bounded size."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns))
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("text"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").cast("binary"), 256)


def _divided(tick: Column, source_ticks: int, steps: int) -> tuple[Column, Column]:
    """(tick * steps div source_ticks, cut towards zero, as a long; the remainder, with the sign of the ticks); source_ticks are positive."""
    ticks, by = tick.cast("decimal(19,0)") * F.lit(steps).cast("decimal(19,0)"), F.lit(source_ticks).cast("decimal(19,0)")
    rest = ticks % by
    return F.call_function("div", ticks - rest, by).cast("long"), rest


def floor_steps(tick: Column, source_ticks: int, steps: int) -> Column:
    """floor(tick * steps / source_ticks) without overflow: by whole numbers, for a quotient of decimals is rounded to a few digits."""
    whole, rest = _divided(tick, source_ticks, steps)
    return whole - F.when(rest < 0, 1).otherwise(0)


def ceil_steps(tick: Column, source_ticks: int, steps: int) -> Column:
    """ceil(tick * steps / source_ticks) without overflow, by whole numbers like floor_steps."""
    whole, rest = _divided(tick, source_ticks, steps)
    return whole + F.when(rest > 0, 1).otherwise(0)


#: What is masked in a line, and what stands in its place.
REDACTIONS = [
    (r"sk-[A-Za-z0-9_-]{8,}", "sk-[redacted]"),
    (r"Bearer [^\t\n\f\r ]+", "Bearer [redacted]"),
    (r"(?i)(token|api_key|apikey)=[^&\t\n\f\r \"]+", "$1=[redacted]"),
]
_MEMBER = r'("(?:token|api_key|secret|password|raw_text|audio|image)"[\t\n\f\r ]*:[\t\n\f\r ]*)"((?:[^"\\]++|\\[^\n])*+)"'
#: An escape of a quoted text: a sign, a byte in hexadecimal or octal, a code point that is no surrogate.
_ESCAPE = r'\\(?:[abfnrtv\\"]|x[0-9A-Fa-f]{2}|[0-3][0-7]{2}|u(?![Dd][89A-Fa-f])[0-9A-Fa-f]{4}|U(?:0000(?![Dd][89A-Fa-f])|000[1-9A-Fa-f]|0010)[0-9A-Fa-f]{4})'


def _utf8_hex(point: Column) -> Column:
    """The UTF-8 bytes of a code point, in hexadecimal."""
    byte = lambda n: F.lpad(F.hex(n), 2, "0")
    rest = lambda shift: byte(F.shiftright(point, shift).bitwiseAND(63).bitwiseOR(128))
    return (
        F.when(point < 0x80, byte(point))
        .when(point < 0x800, F.concat(byte(F.shiftright(point, 6).bitwiseOR(192)), rest(0)))
        .when(point < 0x10000, F.concat(byte(F.shiftright(point, 12).bitwiseOR(224)), rest(6), rest(0)))
        .otherwise(F.concat(byte(F.shiftright(point, 18).bitwiseOR(240)), rest(12), rest(6), rest(0)))
    )


def unquoted(value: Column) -> Column:
    """The bytes that stand between the quotes of a quoted text, escapes resolved; a text with an escape that isn't one is taken as it is."""
    signs = F.create_map(*(F.lit(x) for pair in {"a": "07", "b": "08", "f": "0C", "n": "0A", "r": "0D", "t": "09", "v": "0B", "\\": "5C", '"': "22"}.items() for x in pair))

    def resolved(x: Column) -> Column:
        kind = F.substring(x, 2, 1)
        number = lambda at, base: F.conv(F.substr(x, F.lit(at)), base, 10).cast("int")
        return F.when(~x.startswith("\\"), F.hex(F.encode(x, "UTF-8"))).when(kind == "x", F.upper(F.substr(x, F.lit(3)))).when(kind.isin("u", "U"), _utf8_hex(number(3, 16))).when(kind.rlike("[0-3]"), F.lpad(F.hex(number(2, 8)), 2, "0")).otherwise(F.try_element_at(signs, kind))

    good = value.rlike(rf"^(?:[^\\\n]++|{_ESCAPE})*+$") & value.contains("\\")
    parts = F.regexp_extract_all(value, F.lit(rf"{_ESCAPE}|[^\\]+"), F.lit(0))
    return F.when(good, F.unhex(F.array_join(F.transform(parts, resolved), ""))).otherwise(F.encode(value, "UTF-8"))


def redact(text: Column) -> Column:
    """The text with secrets masked: keys, bearer tokens, key=value pairs and JSON members; of raw texts, audio and images only the number of bytes and the
    beginning of their digest are left. All else stays as it is, whatever its length.
    """
    out = text
    for pattern, put in REDACTIONS:
        out = F.regexp_replace(out, pattern, put)

    def masked(name: Column, value: Column) -> Column:
        data = unquoted(value)
        raw = F.concat(F.lit("[len="), F.octet_length(data).cast("string"), F.lit(" sha256="), F.substring(F.sha2(data, 256), 1, 8), F.lit("]"))
        return F.concat(name, F.lit('"'), F.when(name.rlike("^\"(?:raw_text|audio|image)\""), raw).otherwise("[redacted]"), F.lit('"'))

    names, values = (F.regexp_extract_all(out, F.lit(_MEMBER), F.lit(k)) for k in (1, 2))
    masks = F.concat(F.array(F.lit("")), F.zip_with(names, values, masked))
    return F.when(F.size(names) > 0, F.array_join(F.zip_with(masks, F.split(out, _MEMBER, -1), lambda m, rest: F.concat(m, rest)), "")).otherwise(out)


def body_between(text: Column, start: str, end: str) -> Column:
    """What lies between a marker and the first end marker after it, trimmed; null if one is missing."""
    at = F.instr(text, F.lit(start))
    stop = F.call_function("locate", F.lit(end), text, at + len(start))
    inside = F.substr(text, at + len(start), stop - at - len(start))
    return F.when((at > 0) & (stop >= at + len(start)), F.trim(inside))


def utf8_cut(text: Column, most: int) -> Column:
    """The longest prefix of whole characters in at most so many UTF-8 bytes."""
    data = F.encode(text, "UTF-8")
    fits = lambda n: F.try_validate_utf8(F.substring(data, 1, n).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*(fits(n) for n in range(most, max(most - 4, -1), -1))))


def byte_tokens(text: Column) -> Column:
    """The UTF-8 bytes of a text as token ids 0 to 255; specials begin at 256."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def learning_rate(step: Column, base: float, kind: str = "constant", warm: int = 0, total: int = 0, every: int = 1, factor: float = 0.1) -> Column:
    """Constant, step or cosine schedule with linear warm-up; steps count from 0."""
    s = step.cast("double")
    after = {
        "constant": F.lit(float(base)),
        "step": F.lit(float(base)) * F.pow(F.lit(factor), F.floor((s - warm) / every)),
        "cosine": F.lit(base / 2) * (1 + F.cos(F.lit(3.141592653589793) * F.least(F.lit(1.0), (s - warm) / max(1, total - warm)))),
    }[kind]
    return F.when(s < warm, base * (s + 1) / max(1, warm)).otherwise(after)


def window_start(position: Column, size: int) -> Column:
    """First position of the window of that size."""
    return F.floor(position / size).cast("long") * size
