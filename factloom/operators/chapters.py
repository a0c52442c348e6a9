"""Where a report discusses its year: the span of a chapter, found by title, by running ribbon or by a heading inside a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import values as X
from .pages import any_of, contents_page, filled_lines

# The chapter's name, headings of the next chapter, headings that end it within a directors' report.
NAME = "management discussion"
NEXT = (
    "sustainability at", "board's report", "boards report", "directors' report", "corporate governance", "business responsibility", "brsr",
    "standalone financial", "consolidated financial", "financial statements", "independent auditor", "risk management report", "integrated report",
)
ENDS = (
    "OTHER STATUTORY DISCLOSURES", "ANNEXURE", "RESPONSIBILITY STATEMENT", "SECRETARIAL AUDIT", "CORPORATE GOVERNANCE", "ACKNOWLEDGEMENT",
    "ANNUAL RETURN", "CONSERVATION OF ENERGY", "STATUTORY AUDITOR",
)


def heading_lines(text: Column, k: int = 8) -> Column:
    return F.transform(F.slice(F.split(X.strip(text), r"\r?\n"), 1, k), lambda x: F.lower(X.strip(x)))


def capitals(s: Column) -> Column:
    return (F.upper(s) == s) & (F.lower(s) != s)


def discussion_span(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", longest: int = 60) -> DataFrame:
    """(doc, start, end, found_by) of each report that has the chapter; the first of these that gives a span:

    `title`: a short title in a page's first eight lines (no contents page), up to the page before the next chapter, three pages at
    least; `ribbon`: three or more pages with a running header, their first run with gaps up to 2, three pages at least; `heading`:
    a line of capitals that prose follows, up to the page before a heading that ends it; `short`: the first title after all.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    tops, lines = F.col("__tops"), F.col("__lines")
    prose = lambda at: F.exists(F.slice(lines, at + 2, F.lit(6)), lambda x: (F.length(x) >= 55) & ~capitals(x))
    spaced = lambda x: F.lower(F.regexp_replace(x, r"\s+", " "))
    inner = F.transform(lines, lambda x, i: F.lower(x).contains(NAME) & capitals(x) & (F.length(x) <= 60) & prose(i))
    read = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), heading_lines(t).alias("__tops"), filled_lines(t).alias("__lines"), contents_page(t).alias("__contents"))
    marked = read.select(
        "doc", "page",
        (F.exists(tops, lambda x: x.contains(NAME) & (F.length(x) <= 60) & (F.size(F.split(x, r"\s+")) <= 6)) & ~F.col("__contents")).alias("titled"),
        F.exists(lines, lambda x: spaced(x).contains(NAME) & (F.length(spaced(x)) <= 80) & x.contains("|")).alias("ribbon"),
        (F.exists(inner, lambda x: x) & ~F.col("__contents")).alias("headed"),
        (F.exists(tops, lambda x: any_of(x, NEXT) & (F.length(x) <= 60)) & ~F.exists(tops, lambda x: x.contains(NAME))).alias("next"),
        F.exists(lines, lambda x: capitals(x) & (F.length(x) > 8) & (F.length(x) < 70) & any_of(x, ENDS)).alias("ends"),
    )
    later = Window.partitionBy("doc").orderBy(F.desc("page")).rowsBetween(Window.unboundedPreceding, -1)  # downwards: linear, unlike a frame up to the end
    last = F.max("page").over(Window.partitionBy("doc"))

    def upto(stop: str) -> Column:
        at = F.min(F.when(F.col(stop), F.col("page"))).over(later)
        return F.when(at <= F.least(F.col("page") + longest, last), at - 1).otherwise(F.least(F.col("page") + longest - 1, last))

    spans = marked.select("doc", "page", "titled", "ribbon", "headed", upto("next").alias("title_end"), upto("ends").alias("heading_end"))

    def first(where: Column, end: str) -> Column:
        return F.min(F.when(where, F.struct(F.col("page").alias("start"), F.col(end).alias("end"))))

    by = spans.groupBy("doc").agg(
        first(F.col("titled") & (F.col("title_end") - F.col("page") >= 2), "title_end").alias("title"), first(F.col("titled"), "title_end").alias("short"),
        first(F.col("headed"), "heading_end").alias("heading"), F.array_sort(F.collect_list(F.when(F.col("ribbon"), F.col("page")))).alias("__r"),
    )
    start = F.get("__r", F.lit(0))
    end = F.aggregate("__r", start, lambda reached, p: F.when(p - reached <= 2, p).otherwise(reached))
    ribbon = F.when((F.size("__r") >= 3) & (end - start >= 2), F.struct(start.alias("start"), end.alias("end")))
    ways = {"title": F.col("title"), "ribbon": ribbon, "heading": F.col("heading"), "short": F.col("short")}
    found = F.coalesce(*[F.when(c.isNotNull(), F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(n).alias("found_by"))) for n, c in ways.items()])
    return by.select("doc", found.alias("__f")).where("__f is not null").select("doc", "__f.*")
