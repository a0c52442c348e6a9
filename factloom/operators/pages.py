"""Pages of a report: which may hold a statement, whose scope they belong to, where a note stands. All but the last step of
each operator is a projection of one page; only flags and ranks are shuffled, by document, never text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .retrieval import top_k

# Phrases of squeezed page text that mark a balance sheet, an income statement, a cash-flow statement.
TITLES = {"bs": r"balancesheet.{0,40}as(at|on)", "pl": "statementofprofitandloss", "cf": "statementofcashflow"}
LIABILITY_TOTALS = ("totalequityandliabilities", "totalliabilitiesandequity", "totalequity", "totalliabilities", "capitalandliabilities")
ASSET_SECTIONS = ("financialassets", "noncurrentassets")
REVENUE = ("revenuefromoperations", "interestearned", "premiumearned", "grosspremium", "incomefrominvestments", "totalincome", "totalrevenue")
PROFIT = ("earningspershare", "taxexpense", "profitbeforetax", "profitbeforetaxation", "beforetax", "fortheyear", "totalexpenses")
INCOME_SECTIONS = ("statementofprofitandloss", "profitandlossaccount", "revenueaccount")
CASH = ("operatingactivities", "cashflowfromoperatingactivities")
# Statement titles and section names that anchor a scope.
SCOPE_TITLES = ("balancesheet", "statementofprofit", "statementofcashflow")
SCOPE_SECTIONS = {"consolidated": ("consolidatedfinancialstatement", "consolidatedfinancialresults"), "standalone": ("standalonefinancialstatement",)}
PLAIN_TITLE = r"balancesheet.{0,40}asat|statementofprofitandloss.{0,40}forthe"
# Headings and footers of statements, and the start of the statements' part of a report.
HEADING = r"(?i)^(consolidated\s+|standalone\s+)?(balance sheet|statement of profit and loss|statement of cash flows?|cash flow statement|statement of changes in equity)\s*($|[\(:]|as at|as on|for the (year|period)|\d{1,2}\b|₹|rs\.?\b|in\b)"
NOTES_HEADING = r"(?i)^(notes\b|forming part\b).*financial statements?"
FOOTER = r"(?i)forming part of the\s+(consolidated|standalone)?\s*financial statements?"
STATEMENTS_START = r"(?i)^(independent auditor'?s report\b|(consolidated|standalone)\s+balance sheet\b|balance sheet\s+(as at|as on|\(|\d))"


def any_of(s: Column, words: tuple[str, ...]) -> Column:
    """One of the words is part of s."""
    out = F.lit(False)
    for w in words:
        out = out | s.contains(w)
    return out


def filled_lines(s: Column) -> Column:
    """Lines with anything but white space, stripped."""
    stripped = F.transform(F.split(s, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(stripped, lambda x: x != "")


def top_text(s: Column) -> Column:
    return T.collapse(F.array_join(F.slice(filled_lines(s), 1, 6), " "))


def marks(text: Column) -> Column:
    """Array of (kind, hit, title): a title at the top of the page, or phrases anywhere on it."""
    def told(c: Column, top: Column) -> Column:
        hits = {
            "bs": (c.contains("totalassets") & any_of(c, LIABILITY_TOTALS + ASSET_SECTIONS)) | (c.contains("sourcesoffunds") & c.contains("applicationoffunds"))
            | (c.contains("capitalandliabilities") & c.contains("deposits")) | c.rlike("balancesheetas(at|on)"),
            "pl": (any_of(c, REVENUE) & any_of(c, PROFIT)) | any_of(c, INCOME_SECTIONS),
            "cf": any_of(c, CASH),
        }
        return F.array(*[F.struct(F.lit(k).alias("kind"), (hits[k] | top.rlike(TITLES[k])).alias("hit"), top.rlike(TITLES[k]).alias("title")) for k in TITLES])

    return T.let(T.collapse(text), lambda c: T.let(top_text(text), lambda top: told(c, top)))


def candidate_pages(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", allowed: Column | None = None, k: int = 8) -> DataFrame:
    """(doc, kind, page, title, rank): titled pages first, then those in the last 60 % of the report, then by page.

    Pages outside `allowed` go before the cut, so that another scope's pages don't fill it. Neither side of the join is gathered in the driver:
    marked pages are more than Spark expects, and reports may be as many as pages.
    """
    flat = pages.select(doc, page, F.inline(F.filter(marks(F.col(text)), lambda m: m.hit)), *([allowed.alias("__ok")] if allowed is not None else []))
    if allowed is not None:
        flat = flat.where("__ok")
    size = pages.groupBy(doc).agg(F.max(page).alias("__n"))
    found = flat.join(size.hint("merge"), doc).withColumn("__front", F.col(page) / F.col("__n") < 0.4)
    return top_k(found, [doc, "kind"], [F.desc("title"), F.col("__front"), F.col(page)], k).select(doc, "kind", page, "title", "rank")


def statement_formats(pages: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, format): bank, insurer, nbfc or manufacturer, by phrases of any of its balance sheet pages."""
    t = T.squeezed(F.col(text))
    has = {w: F.bool_or(t.contains(w)) for w in ("capitalandliabilities", "policyholders", "financialassets", "debtsecurities")}
    kind = F.when(has["capitalandliabilities"], "bank").when(has["policyholders"], "insurer").when(has["financialassets"] & has["debtsecurities"], "nbfc").otherwise("manufacturer")
    return pages.groupBy(doc).agg(kind.alias("format"))


def _titled(lines: Column, scope: str) -> Column:
    """A scope's title starts a column of one of the lines, or follows anything but a small letter."""
    columns = F.flatten(F.transform(lines, lambda x: F.split(x, r"\s{3,}")))

    def starts(segment: Column) -> Column:
        return T.let(F.regexp_replace(segment, r"\s+", ""), lambda s: F.lower(s).contains(scope) & titled(s))

    def titled(s: Column) -> Column:
        out = F.lit(False)
        for title in SCOPE_TITLES:
            at = F.instr(F.lower(s), scope + title)
            out = out | (at == 1) | ((at > 1) & ~F.substring(s, at - 1, F.lit(1)).rlike(r"\p{Ll}"))
        return out

    return F.exists(columns, starts)


def _own_line(lines: Column, phrases: tuple[str, ...]) -> Column:
    def has(s: Column) -> Column:
        out = F.lit(False)
        for p in phrases:
            out = out | (s.contains(p) & (F.length(s) - len(p) <= 25))
        return out

    return F.exists(F.transform(lines, T.collapse), has)


def scope_anchor(text: Column) -> Column:
    """standalone, consolidated or null: titles before section names; a plain title without the word consolidated near it is standalone."""
    def told(lines: Column, top: Column) -> Column:
        titles = F.struct(_titled(lines, "consolidated").alias("con"), _titled(lines, "standalone").alias("std"))
        sections = F.struct((_own_line(lines, SCOPE_SECTIONS["consolidated"]) & ~top.contains("standalone")).alias("con"), (_own_line(lines, SCOPE_SECTIONS["standalone"]) & ~top.contains("consolidated")).alias("std"))
        found = T.let(titles, lambda t: F.when(t.con | t.std, t).otherwise(sections))
        plain = ~top.contains("consolidated") & top.rlike(PLAIN_TITLE)
        return T.let(found, lambda f: F.when(f.con & ~f.std, "consolidated").when((f.std & ~f.con) | (~f.con & ~f.std & plain), "standalone"))

    return T.let(F.slice(filled_lines(text), 1, 6), lambda lines: T.let(T.collapse(F.array_join(lines, " ")), lambda top: told(lines, top)))


def scope_tags(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, page, tag): the last anchor up to a page, unknown before the first."""
    w = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    anchored = pages.select(doc, page, scope_anchor(F.col(text)).alias("__a"))
    return anchored.select(doc, page, F.coalesce(F.last("__a", ignorenulls=True).over(w), F.lit("unknown")).alias("tag"))


def scope_pages(tagged: DataFrame, scope: str, doc: str = "doc") -> DataFrame:
    """Pages of the scope or of none known; all pages of a document that lacks the scope."""
    w = Window.partitionBy(doc)
    return tagged.withColumn("__has", F.max(F.col("tag") == scope).over(w)).where(F.col("tag").isin(scope, "unknown") | ~F.col("__has")).drop("__has")


def tagged_first(candidates: DataFrame, scope: str, by: list[str]) -> DataFrame:
    """Candidates of the scope alone where there are any, else all: a page of no known scope may be a summary of the other one."""
    w = Window.partitionBy(*by)
    return candidates.withColumn("__has", F.max(F.col("tag") == scope).over(w)).where((F.col("tag") == scope) | ~F.col("__has")).drop("__has")


def scope_signal(text: Column) -> Column:
    """STANDALONE, CONSOLIDATED or null, by headings and footers of at most 70 characters; both on one page cancel out."""
    heads = F.filter(filled_lines(text), lambda x: (F.length(x) <= 70) & (x.rlike(HEADING) | x.rlike(NOTES_HEADING) | x.rlike(FOOTER)))
    con = F.exists(heads, lambda x: F.lower(x).contains("consolidated"))
    std = F.exists(heads, lambda x: ~F.lower(x).contains("consolidated"))
    return F.when(con & ~std, "CONSOLIDATED").when(std & ~con, "STANDALONE")


def balance_marks(text: Column) -> Column:
    t = F.lower(text)
    body = t.contains("equity and liabilities") | t.contains("total equity") | (t.contains("total assets") & t.contains("total liabilities"))
    return body & (t.contains("as at") | t.contains("as on"))


def balance_heading(text: Column) -> Column:
    """standalone or consolidated by the page's first short heading of a balance sheet, null without one or without its marks."""
    heads = F.filter(filled_lines(text), lambda x: (F.length(x) <= 70) & x.rlike(r"(?i)^(consolidated\s+|standalone\s+)?balance sheet\b"))
    first = F.get(heads, 0)
    return F.when(balance_marks(text) & first.isNotNull(), F.when(F.lower(first).contains("consolidated"), "consolidated").otherwise("standalone"))


def balance_anchors(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, standalone, consolidated): the first balance sheet page of each scope."""
    h = pages.select(doc, page, balance_heading(F.col(text)).alias("__h"))
    return h.groupBy(doc).agg(*[F.min(F.when(F.col("__h") == s, F.col(page))).alias(s) for s in ("standalone", "consolidated")])


def starts_statements(text: Column) -> Column:
    return F.exists(filled_lines(text), lambda x: (F.length(x) < 70) & x.rlike(STATEMENTS_START))


def regions(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, page, region): with both balance sheets found, FRONT and the two parts that they begin; else FRONT up to the
    statements' start and the last signal from there on, STANDALONE before any."""
    t = F.col(text)
    flags = pages.select(doc, page, balance_heading(t).alias("__h"), starts_statements(t).alias("__s"), scope_signal(t).alias("__g"))
    all_, upto = Window.partitionBy(doc), Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    first = lambda c: F.min(F.when(c, F.col(page))).over(all_)
    flags = flags.withColumn("__a", first(F.col("__h") == "standalone")).withColumn("__b", first(F.col("__h") == "consolidated")).withColumn("__f", first(F.col("__s")))
    signal = F.last(F.when(F.col(page) >= F.col("__f"), F.col("__g")), ignorenulls=True).over(upto)
    p, a, b = F.col(page), F.col("__a"), F.col("__b")
    parts = F.when(p < F.least(a, b), "FRONT").when(p < F.greatest(a, b), F.when(a < b, "STANDALONE").otherwise("CONSOLIDATED")).otherwise(F.when(a < b, "CONSOLIDATED").otherwise("STANDALONE"))
    filled = F.when(F.col("__f").isNull() | (p < F.col("__f")), "FRONT").otherwise(F.coalesce(signal, F.lit("STANDALONE")))
    return flags.select(doc, page, F.when(a.isNotNull() & b.isNotNull(), parts).otherwise(filled).alias("region"))


def contents_page(text: Column) -> Column:
    """At least 8 lines, over 40 % of them short and ending in a page number, or over 30 % dotted."""
    lines = filled_lines(text)
    numbered = F.size(F.filter(lines, lambda x: (F.length(x) < 80) & F.regexp_replace(x, r"[. ]+$", "").rlike(r"(^|\s)\d+$")))
    dotted = F.size(F.filter(lines, lambda x: x.contains("...") | (F.length(x) - F.length(F.replace(x, F.lit("."), F.lit(""))) > 8)))
    return (F.size(lines) >= 8) & ((numbered > 0.4 * F.size(lines)) | (dotted > 0.3 * F.size(lines)))


def note_pages(pages: DataFrame, refs: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, ref, page): pages that have the note's title and, at a line's start, its number, or both in a row anywhere.

    refs: doc, ref, title (lower case). Joined by document; the title test comes before the expressions built from the row.
    """
    escape = lambda c: F.regexp_replace(c, r"([^A-Za-z0-9\s])", r"\\$1")
    ref, title, t = escape(F.col("ref")), escape(F.col("title")), F.col(text)
    at_start = F.concat(F.lit(r"(?mi)^\s*(note\s*)?"), ref, F.lit(r"[.)\s:]"))
    in_line = F.concat(F.lit(r"(?i)\b"), ref, F.lit(r"\s*[.)]\s*"), title)
    both = pages.join(refs, doc).where(F.contains(F.lower(t), F.col("title")))
    return both.where(F.rlike(t, at_start) | F.rlike(t, in_line)).select(doc, "ref", page).distinct()


def signature_pages(pages: DataFrame, terms: list[str], core: list[list[str]], allowed: Column, doc: str = "doc", page: str = "page", text: str = "text", k: int = 2, least: int = 4) -> DataFrame:
    """(doc, page, core, hits, rank): pages with at least 4 of the terms, by core groups met, then terms; pages outside
    `allowed` only in documents where no allowed page has so many."""
    t = F.lower(F.col(text))
    count = lambda tests: sum((x.cast("int") for x in tests), F.lit(0))
    hits = count([t.contains(w) for w in terms])
    groups = count([any_of(t, tuple(g)) for g in core])
    scored = pages.select(doc, page, groups.alias("core"), hits.alias("hits"), F.coalesce(allowed, F.lit(False)).alias("__ok")).where(F.col("hits") >= least)
    best = scored.withColumn("__any", F.max("__ok").over(Window.partitionBy(doc))).where("__ok or not __any").drop("__ok", "__any")
    return top_k(best, [doc], [F.desc("core"), F.desc("hits"), F.col(page)], k)


def assemble(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, body): the pages' texts in order, each under its number. One report's text in one row: for chosen pages."""
    block = F.concat(F.lit("=== PAGE "), F.col(page).cast("string"), F.lit(" ===\n"), F.col(text))
    return pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), block.alias("b")))).alias("__l")).select(doc, F.array_join(F.transform("__l", lambda s: s.b), "\n").alias("body"))


def routing(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, n_pages, small, one_call, image_only): small reports fit one reading, by the gate of reports (50 pages, 100,000 tokens of
    four characters) and by that of items (one_call: 60 pages, 60,000 tokens); image-only ones have under 1,500 characters on up to
    60 evenly spaced pages."""
    sized = pages.select(doc, page, F.coalesce(F.length(text), F.lit(0)).cast("long").alias("__c"))
    n = sized.groupBy(doc).agg(F.max(page).alias("n_pages"), F.sum("__c").alias("__all"))
    step = F.greatest(F.lit(1), F.floor(F.col("n_pages") / 60))
    sampled = sized.join(n, doc).withColumn("__s", F.when((F.col(page) - 1) % step == 0, F.col("__c")).otherwise(0))
    out = sampled.groupBy(doc, "n_pages", "__all").agg(F.sum("__s").alias("__t"))
    return out.select(doc, "n_pages", ((F.col("n_pages") <= 50) & (F.col("__all") / 4 <= 100000)).alias("small"), ((F.col("n_pages") <= 60) & (F.floor(F.col("__all") / 4) <= 60000)).alias("one_call"), (F.col("__t") < 1500).alias("image_only"))


def loses_numbers(before: Column, after: Column) -> Column:
    """Some number of the first text is rarer in the second (commas aside); page by page, without a shuffle."""
    numbers = lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"\d[\d,]*\.?\d*"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    a, b = numbers(before), numbers(F.coalesce(after, F.lit("")))
    times = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return after.isNull() | F.exists(F.array_distinct(a), lambda t: times(a, t) > times(b, t))
