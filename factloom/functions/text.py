"""Text expressions: normal forms, tokens, years, routing rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that carry no meaning in retrieval, in aliases and in location hints.
STOP = """a an the of to in on at for and or as is are was were be been being by with from this that these
those it its their our your his her they we you i he she them us has have had do does did not no nor so than then
there here which who whom whose what when where why how all any both each few more most other some such only own same
will would shall should can could may might must per ended year years as_at note notes rs inr crore lakh million""".split()
ALIAS_STOP = ("of", "and", "on", "for", "the", "to", "in", "from", "with", "a", "an", "net")
HINT_STOP = ("note", "the", "and", "for", "within", "under", "sub", "section", "of", "in", "p&l", "pl", "statement", "balance", "sheet", "current", "year", "end")
# Ordered rules, the first keyword found in an item's key and hint names its section.
ROUTES = (
    ("attributable", "consolidated_equity"),
    ("non-controlling", "consolidated_equity"),
    ("owners of the company", "consolidated_equity"),
    ("investment property", "investment_property"),
    ("changes in inventor", "pl_changes_inventory"),
    ("deferred tax", "deferred_tax"),
    ("finance cost", "finance_costs"),
    ("interest expense", "finance_costs"),
    ("auditor", "other_expenses"),
    ("other expenses", "other_expenses"),
    ("manufacturing expenses", "other_expenses"),
    ("csr", "other_expenses"),
    ("trade payable", "trade_payables"),
    ("borrowing", "borrowings"),
    ("other non-current liabilit", "other_nc_liabilities"),
    ("other current liabilit", "other_cur_liabilities"),
    ("share-based", "other_cur_liabilities"),
    ("other current assets", "other_cur_assets"),
    ("loans", "loans_advances"),
    ("other current financial assets", "loans_advances"),
    ("investments note", "investments"),
    ("investment", "investments"),
    ("property, plant", "ppe"),
    ("pp&e", "ppe"),
    ("cwip", "ppe"),
    ("depreciat", "ppe"),
    ("carrying value", "ppe"),
    ("other equity", "other_equity"),
    ("reserves", "other_equity"),
    ("changes in equity", "other_equity"),
    ("share capital", "share_capital"),
    ("consolidated", "consolidated_equity"),
)
DEFAULT_ROUTE = "other_expenses"


def let(value: Column, body) -> Column:
    """body of the value, which is worked out once however often the body has it; as an expression it would be worked out at each place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), r"\s+", "")


def normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(s), F.lit("&"), F.lit(" and ")), r"\s+", " "))


def squeezed(s: Column) -> Column:
    """Without white space and hyphens, & as and."""
    return F.regexp_replace(F.replace(F.lower(s), F.lit("&"), F.lit("and")), r"[\s\-]+", "")


def tokens(s: Column) -> Column:
    found = F.regexp_extract_all(F.lower(s), F.lit(r"[a-z0-9][a-z0-9&/\-]*"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*STOP))


def stem(w: Column) -> Column:
    return F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def alias_tokens(s: Column) -> Column:
    found = F.regexp_extract_all(F.lower(s), F.lit(r"[a-z][a-z&/\-]+"), F.lit(0))
    kept = F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*ALIAS_STOP))
    return F.array_sort(F.array_distinct(F.transform(kept, stem)))


def hint_terms(s: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(r"[a-z][a-z&-]{3,}"), F.lit(0)), lambda w: ~w.isin(*HINT_STOP))


def years(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))


def repeated_max_year(s: Column) -> Column:
    """The latest year met at least twice, else the latest, else 0."""
    ys = years(s)
    again = F.filter(ys, lambda y: F.size(F.filter(ys, lambda z: z == y)) >= 2)
    return F.coalesce(F.array_max(again), F.array_max(ys), F.lit(0))


def route(key: Column, hint: Column) -> Column:
    text = F.lower(F.concat_ws(" ", key, F.coalesce(hint, F.lit(""))))
    out = None
    for word, section in ROUTES:
        test = text.contains(word)
        out = F.when(test, section) if out is None else out.when(test, section)
    return out.otherwise(DEFAULT_ROUTE)


def statement_format(blob: Column) -> Column:
    """bank, insurer, nbfc or manufacturer, from the squeezed text of balance sheet pages."""
    b = squeezed(blob)
    return F.when(b.contains("capitalandliabilities"), "bank").when(b.contains("policyholders"), "insurer").when(b.contains("financialassets") & b.contains("debtsecurities"), "nbfc").otherwise("manufacturer")
