"""Printed values as Column expressions: cleaning, signs, sums of addends, cells of tables, labels and rows of a statement's face."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import numbers as N
from .text import let

# Currency and footnote marks that a value may carry.
MARKS = r"₹|`|(?i:\bRs\.?)|(?i:\bINR\b)|[*#†‡]"
# Dashes and words that stand for no figure.
DASHES = ("-", "–", "—", "nil", "Nil", "NIL", "")
# Definitions that ask for a total.
TOTAL_WORDS = ("the total", "aggregate figure", "note's total", "total line", "single aggregate")
# Characters of old fonts read as Latin.
ODD = "{}$©§¶‘’ñÕ«‹>|~ˆ†›"
VALUE = r"\(?-?[\d,]+\.?\d*\)?"


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def clean_value(s: Column) -> Column:
    """Without currency and footnote marks; what has no digit then stays as it was."""
    return let(strip(F.regexp_replace(s, MARKS, "")), lambda out: F.when(out.rlike(r"\d"), out).otherwise(s))


def restore_sign(value: Column, evidence: Column) -> Column:
    """In brackets if every place of the number in the evidence is; a value with a sign stays as it is."""
    def restored(v: Column, number: Column) -> Column:
        quoted = F.regexp_replace(number, r"\.", r"\\.")
        found = lambda before, after: F.size(F.regexp_extract_all(evidence, F.concat(F.lit(before), quoted, F.lit(after)), F.lit(0)))
        signed = v.startswith("(") | v.startswith("-") | (number == "")
        places = F.when(~signed & evidence.contains(number), found(r"(?<![\d.])", r"(?![\d.])"))  # patterns of a row are dear: only where the number stands
        return let(places, lambda n: F.when((n > 0) & (n == found(r"\(\s*", r"\s*\)")), F.concat(F.lit("("), v, F.lit(")"))).otherwise(value))

    return let(strip(value), lambda v: let(F.regexp_extract(v, r"\d[\d,]*\.?\d*", 0), lambda number: restored(v, number)))


def hygiene(value: Column, evidence: Column, is_count: Column) -> Column:
    """Cleaned, then signed; brackets around counts are typography."""
    return let(clean_value(value), lambda cleaned: F.when(is_count, cleaned).otherwise(restore_sign(cleaned, evidence)))


def acceptable(s: Column) -> Column:
    v = strip(F.coalesce(s, F.lit("")))
    return v.rlike(r"\d") | v.isin(*DASHES)


def numericish(cell: Column) -> Column:
    """Some word has a digit, and digits are half of its letters and digits."""

    def test(word: Column) -> Column:
        signs, ds = F.length(F.regexp_replace(word, r"[^\p{L}\p{N}]", "")), F.length(F.regexp_replace(word, "[^0-9]", ""))
        return (ds >= 1) & (ds >= 0.5 * signs)

    return F.coalesce(F.exists(F.split(cell, r"\s+"), test), F.lit(False))


def odd_share(s: Column) -> Column:
    """Share of characters that old fonts leave when they are read as Latin."""
    return F.when(F.length(s) > 0, 1.0 - F.length(F.regexp_replace(s, f"[{ODD}]|[^\\x{{0}}-\\x{{C0}}]", "")) / F.length(s)).otherwise(0.0)


def wants_total(meaning: Column, selector: Column) -> Column:
    """The definition asks for a total; a sub-total does not count."""
    m, s = F.lower(F.coalesce(meaning, F.lit(""))), F.lower(F.coalesce(selector, F.lit("")))
    out = s.rlike(r"^\s*total\b") | m.rlike(r"(^|\s)[—–-]\s*total\b")
    for w in TOTAL_WORDS:
        out = out | m.contains(w) | s.contains(w)
    return out


def composite(addends: Column, source: Column) -> Column:
    """struct(value, grounded): sum of 2 to 12 printed addends; grounded if each has three digits and stands in the source."""
    cleaned = lambda a: N.statement_number(clean_value(a))
    kept = F.filter(addends, lambda a: cleaned(a).isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda t, a: t + cleaned(a))
    page = N.digits(source)
    held = F.forall(kept, lambda a: (F.length(N.digits(a)) >= 3) & page.contains(N.digits(a)))
    return F.when(F.size(kept).between(2, 12), F.struct(N.format_number(total).alias("value"), F.coalesce(held, F.lit(False)).alias("grounded")))


def category_sum(lines: Column) -> Column:
    """Sum of the member lines' values, printed whole; null without any."""
    numbers = F.filter(F.transform(lines, lambda x: N.statement_number(clean_value(x))), lambda v: v.isNotNull())
    total = F.aggregate(numbers, F.lit(0.0), lambda t, v: t + v)
    whole = F.abs(total - F.bround(total)) < 0.5
    body = F.when(whole, F.format_number(F.bround(F.abs(total)), 0)).otherwise(F.format_number(F.abs(total), 2))
    return F.when(F.size(numbers) > 0, F.when(total < 0, F.concat(F.lit("("), body, F.lit(")"))).otherwise(body))


def face_label(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"\([^)]*\)", ""), "[^a-z]", "")


def is_face_total(label: Column, names: tuple[str, ...]) -> Column:
    """The label is one of the names, with at most four letters before it (a numeral, not `sub`)."""
    l, out = face_label(label), F.lit(False)
    for n in names:
        lead = F.substring(l, F.lit(1), F.length(l) - len(n))
        out = out | (l.endswith(n) & (F.length(l) - len(n) <= 4) & ~lead.endswith("sub"))
    return out


def face_row(line: Column) -> Column:
    """struct(label, ref, value) of a row of a statement's face, or null: a label, perhaps a note's number, this year's and last year's value.

    Label and values part at two spaces, or at one if the line ends in two values or more; a numeral alone is taken
    together with the words after it; values left at the label's end belong to the values.
    """
    shapes = (r"^\s*([^\s\d(].*?)\s{2,}(\S.*)$", r"^\s*(\(\w+\)\s+[^\d]+?)\s{2,}(\S.*)$", rf"^\s*([^\s\d(].*?[A-Za-z)%])\s+((?:{VALUE}|-)(?:\s+(?:{VALUE}|-))+)\s*$")
    trim_ = lambda s: F.regexp_replace(s, r"^[ .:]+|[ .:]+$", "")
    words = r"^([^\d]*[A-Za-z)%])\s+(\(?-?[\d,].*)$"
    tail = r"(?:\s\(?-?,*\d[\d,]*\.?\d*\)?[ .:]*)+$"
    pair = lambda label, rest: F.struct(label.alias("label"), rest.alias("rest"))

    def folded(p: Column) -> Column:
        more = F.regexp_extract(p.rest, words, 1)
        fold = p.label.rlike(r"^([IVXLC]+|[ivxlc]+|\d{1,2})$") & p.rest.rlike(words) & more.rlike("[A-Za-z]{3}")
        return F.when(fold, pair(trim_(F.concat_ws(" ", p.label, more)), F.regexp_extract(p.rest, words, 2))).otherwise(p)

    def parted(p: Column) -> Column:
        stranded = F.regexp_extract_all(F.regexp_extract(p.label, tail, 0), F.lit(r"\(?-?,*\d[\d,]*\.?\d*\)?"), F.lit(0))
        values = F.concat(stranded, F.transform(F.regexp_extract_all(p.rest, F.lit(rf"{VALUE}|(?<=\s)-(?=\s|$)"), F.lit(0)), lambda t: F.trim(t)))
        return F.struct(trim_(F.regexp_replace(p.label, tail, "")).alias("label"), values.alias("values"))

    def row(p: Column) -> Column:
        values, n = p["values"], F.size(p["values"])
        note = F.get(values, 0).rlike(r"^(\d{1,3}[A-Za-z]?|\d{1,2}\.\d{1,2})$")
        ref = F.when(note & ((n >= 3) | (n == 1)), F.get(values, 0))
        left = F.when(note & (n >= 3), F.slice(values, F.lit(2), n)).otherwise(values)
        value = let(left, lambda left: F.when(F.size(left) >= 2, F.element_at(left, F.when(F.size(left) >= 2, -2).otherwise(-1))).otherwise(F.get(left, 0)))
        return let(F.when(~F.coalesce(note & (n == 1), F.lit(False)), value), lambda value: F.when(p.label.rlike("[A-Za-z]{3}") & (n >= 1), F.struct(p.label.alias("label"), ref.alias("ref"), F.when(value != "-", value).alias("value"))))

    at = lambda p: pair(trim_(F.regexp_extract(line, p, 1)), F.regexp_extract(line, p, 2))
    first = F.coalesce(*[F.when(line.rlike(p), at(p)) for p in shapes])
    likely = line.rlike("[A-Za-z]{3}") & line.rlike(r"[\d,-]")  # a label's letters, and something that may be a value
    return F.when(likely, let(first, lambda p: let(folded(p), lambda p: let(parted(p), row))))
