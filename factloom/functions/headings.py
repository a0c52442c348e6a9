"""Tests of a printed line or row: titles, note headings, running banners, rows of totals, detached columns of values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values as X

# Boilerplate, lines of units, headings of notes and schedules, roles of signatories, printed values without digits.
BOILERPLATE = r"(?i)annual report|in (millions?|crores?|lakhs?)|unless otherwise"
UNITS = r"(?i)(?:\bin\s+|\brupees\s+|\brs\.?\s+in\s+|^`?\s*)(millions?|crores?|lakhs?|thousands?|['‘’`]?000s?)\b"
NOTE_HEAD = r"^\s*(?:\d{1,3}|[A-Z])\s*[.)]\s+(.{3,70})$"
ROMAN = r"^\s*[IVX]\s*[.)]"
SCHEDULE_HEAD = r"(?i)^\s*SCHEDULE\s+\d+"
ROLES = r"(?i)secretary|director|officer|chairman|chairperson|partner|accountant|chief|executive|president|membership"
VALUE_TOKENS = ("-", "–", "—", "nil", "*", "^")


def _count(s: Column, what: str) -> Column:
    return F.length(F.regexp_replace(s, f"[^{what}]", ""))


def _words(s: Column) -> Column:
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def shouts(t: Column) -> Column:
    """Over 70 % of the letters are capitals; without letters: no."""
    return _count(t, r"\p{Lu}") > 0.7 * F.when(t.rlike(r"\p{L}"), _count(t, r"\p{L}")).otherwise(F.length(t) + 1)


def good_title(s: Column) -> Column:
    """At least 4 characters with a letter, neither boilerplate nor a shouting banner that begins with a page number."""
    t = X.strip(s)
    banner = t.rlike(r"^\d") & (F.size(_words(t)) >= 5) & shouts(t)
    return (F.length(t) >= 4) & t.rlike(r"\p{L}") & ~t.rlike(BOILERPLATE) & ~banner


def note_heading(s: Column) -> Column:
    """A numbered note's or schedule's heading. One led by a letter is short and names no signatory's role."""
    t = X.strip(s)
    body = F.regexp_extract(t, NOTE_HEAD, 1)
    letters = _count(body, r"\p{L}")
    wordy = (letters >= 3) & (letters > 2 * _count(body, r"\p{Nd}"))
    plain = (F.size(_words(body)) <= 4) & ~body.rlike(ROLES) & ~body.rlike(r"[^\p{L}&'(),\s-]")
    numbered = (body != "") & ~t.rlike(ROMAN) & wordy & (t.rlike(r"^\d") | plain)
    return (F.length(t) <= 80) & ~t.rlike(UNITS) & (t.rlike(SCHEDULE_HEAD) | numbered)


def banner_row(s: Column, top: Column) -> Column:
    """A bare page number, a line of units without other digits, or, at a page's top, four shouted words that are no title."""
    t = X.strip(s)
    number = F.replace(t, F.lit(" "), F.lit("")).rlike(r"^\d+$") & (F.length(t) <= 5)
    units = (F.length(t) <= 90) & t.rlike(UNITS) & F.regexp_replace(t, r"^[(\[]+", "").rlike(r"^[₹`RIKCH(r]") & ~F.regexp_replace(t, "['‘’`]?000s?", "").rlike(r"\d")
    return number | units | (top & ~good_title(s) & (F.size(_words(t)) >= 4) & shouts(t))


def value_token(word: Column) -> Column:
    return X.numericish(word) | F.lower(word).isin(*VALUE_TOKENS)


def total_row(words: Column) -> Column:
    """A ruled-off line of totals: 2 to 8 words, of which at least two and half are values."""
    n = F.size(F.filter(words, value_token))
    return F.size(words).between(2, 8) & (n >= 2) & (n >= 0.5 * F.size(words))


def value_side(rows: Column, run: int = 4) -> Column:
    """rows, each an array of words: so many in a row hold values for four fifths or more, as a table's detached columns do."""
    flags = F.transform(rows, lambda ws: F.when((F.size(ws) > 0) & (F.size(F.filter(ws, value_token)) >= 0.8 * F.size(ws)), "1").otherwise("0"))
    return F.array_join(flags, "").contains("1" * run)


def rescuable(selector: Column, value_type: Column, examples: Column) -> Column:
    """A concept that a printed line can answer: with examples, no gross or accumulated column, no count."""
    named = F.lower(F.coalesce(selector, F.lit(""))).rlike("gross|accumulated")
    return F.coalesce(F.size(examples) > 0, F.lit(False)) & ~named & ~value_type.eqNullSafe("count")


def english_rows(grid: Column) -> Column:
    """Rows of cells; a row labelled in an old font that has values takes the label of the next row, if that is only a readable label."""

    def row(i: Column) -> Column:
        return F.get(grid, i)

    def rest(r: Column) -> Column:
        return F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))

    def merges(i: Column) -> Column:
        a, b = row(i), row(i + 1)
        label = F.get(b, F.lit(0))
        test = (X.odd_share(F.get(a, F.lit(0))) > 0.15) & F.exists(rest(a), X.numericish) & (label != "") & (X.odd_share(label) < 0.1) & ~F.exists(rest(b), lambda c: X.strip(c) != "")
        return F.coalesce((i >= 0) & test, F.lit(False))

    kept = F.filter(F.sequence(F.lit(0), F.size(grid) - 1), lambda i: ~merges(i - 1))
    out = F.transform(kept, lambda i: F.when(merges(i), F.concat(F.array(F.get(row(i + 1), F.lit(0))), rest(row(i)))).otherwise(row(i)))
    return F.when(F.size(grid) > 0, out).otherwise(grid)
