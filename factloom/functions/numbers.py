"""Printed numbers as Column expressions. A number stays text until it is compared; nil marks are null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# How a number is printed, and what stands for none.
NUMBER = r"-?\d[\d,]*\.?\d*"
NIL = ("", "not disclosed", "na", "n/a", "nil", "none", "-", "–", "—", "--")


def _first(s: Column) -> Column:
    found = F.regexp_extract(F.regexp_replace(s, " ", ""), NUMBER, 0)
    return F.regexp_replace(found, ",", "").try_cast("double")


def _bracketed(s: Column) -> Column:
    return s.contains("(") & s.contains(")")


def parse_number(s: Column) -> Column:
    """Brackets negate what was read, so that "(-5)" is 5; currency marks are dropped first."""
    t = F.trim(s)
    v = _first(F.regexp_replace(t, "₹|`|Rs|rs", ""))
    return F.when(F.lower(t).isin(*NIL), None).otherwise(F.when(_bracketed(t), -v).otherwise(v))


def statement_number(s: Column) -> Column:
    """Brackets make negative, so that "(-5)" is -5; Unicode minus signs and dashes count as a minus."""
    t = F.translate(s, "−–—", "---")
    v = _first(t)
    return F.when(_bracketed(t), -F.abs(v)).otherwise(v)


def plain_statement_number(s: Column) -> Column:
    """As statement_number, but an em dash is no minus."""
    t = F.translate(s, "−–", "--")
    v = _first(t)
    return F.when(_bracketed(t), -F.abs(v)).otherwise(v)


def vote_number(s: Column) -> Column:
    """Brackets negate what was read; nil words and dashes are no numbers because they have no digit, and no mark is dropped."""
    v = _first(s)
    return F.when(_bracketed(s), -v).otherwise(v)


def whole_cell_number(s: Column) -> Column:
    """A number only if the cell holds nothing else (footnote marks at its ends, commas and the rupee sign aside)."""
    t = F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"^[*^]+|[*^]+$", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(t, r"^[()]+|[()]+$", ""), "[,₹]", ""))
    v = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), bare.try_cast("double"))
    return F.when(t.startswith("(") & t.endswith(")"), -v).otherwise(v)


def row_numbers(s: Column) -> Column:
    """All numbers of a line in order; a lone dash is a zero."""
    tokens = F.regexp_extract_all(s, F.lit(r"\(?-?[\d,]*\.?\d+\)?|(?<=\s)-(?=\s)"), F.lit(0))
    value = lambda t: F.when(t == "-", 0.0).otherwise(F.regexp_replace(t, r"[(),]", "").try_cast("double") * F.when(t.startswith("("), -1.0).otherwise(1.0))
    return F.filter(F.transform(tokens, value), lambda v: v.isNotNull())


def digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def money_token(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"[^\d.]", ""), r"^\.+|\.+$", "")


def is_money(s: Column) -> Column:
    # Fixed value: the form of a money token
    return s.rlike(r"^\(?-?\d{1,3}(,\d{2,3})+(\.\d+)?\)?$|^\(?-?\d+\.\d+\)?$")


def format_number(v: Column) -> Column:
    """Thousands separated, as few decimals (0, 1, 2) as the value needs, brackets for negative."""
    a = F.abs(v)
    body = F.when(F.abs(a - F.bround(a)) < 0.005, F.format_number(F.bround(a), 0)).when(F.abs(a * 10 - F.bround(a * 10)) < 0.05, F.format_number(a, 1)).otherwise(F.format_number(a, 2))
    return F.when(v < 0, F.concat(F.lit("("), body, F.lit(")"))).otherwise(body)


def close(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Relative to the larger of both and 1; so the tolerance is absolute below 1."""
    return (a == b) | (F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= tolerance)


def scale_factor(a: Column, b: Column) -> Column:
    """The power of ten that a is of b, or null."""
    ratio = F.abs(a) / F.abs(b)
    out = F.when((a == 0) | (b == 0), F.lit(None).cast("double"))
    for f in (10.0, 100.0, 1000.0, 0.1, 0.01, 0.001):
        out = out.when(close(ratio, F.lit(f), 0.02), F.lit(f))
    return out


def within(a: Column, b: Column, share: float, floor: float) -> Column:
    """|a - b| below a share of |b|, or below the floor."""
    return F.abs(a - b) < F.greatest(F.abs(b) * share, F.lit(float(floor)))
