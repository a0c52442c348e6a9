"""Identities over whole tables, grounding of answers, and the merging of what several readers found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N, text as T, values as X
from .lineage import cut
from .retrieval import top_k


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(2.0), F.abs(b) * 0.005)


def results_tie(rows: DataFrame, by: list[str], order: str = "row_no", cells: str = "cells") -> DataFrame:
    """(by, ok, failed, n_checks): printed identities of a results statement, column by column. One grid is one row here;
    identities whose lines are missing are not checked, and a grid without any of them passes."""
    grid = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.transform(cells, lambda c: F.struct(c.alias("c"), N.whole_cell_number(c).alias("v"))).alias("r")))).alias("__g"))
    text = lambda cs: F.lower(F.array_join(F.transform(F.filter(cs, lambda x: F.coalesce(x.c, F.lit("")) != ""), lambda x: x.c), " "))
    line = lambda r: F.struct(text(F.filter(r.r, lambda x: x.v.isNull())).alias("label"), text(r.r).alias("all"), F.transform(r.r, lambda x: x.v).alias("v"), F.filter(F.transform(r.r, lambda x: x.v), lambda v: v.isNotNull()).alias("n"))
    grid = grid.withColumn("__g", F.transform("__g", line))

    def find(has: str, *hasnt: str) -> Column:
        def test(r: Column) -> Column:
            out = r.label.contains(has) & (F.size(r.n) > 0)
            for w in hasnt:
                out = out & ~r.label.contains(w)
            return out

        return F.get(F.filter("__g", test), 0).n

    names = {
        "pbt": find("profit before tax"), "tax": F.coalesce(find("total tax"), find("tax expense", "current", "deferred")),
        "profit": F.coalesce(find("profit for the period", "attributable"), find("profit for the year", "attributable")),
        "oci": find("total other comprehensive"), "tci": find("total comprehensive income", "attributable"), "income": find("total income"), "expense": find("total expenses"),
        "paid": find("finance expenses"), "earned": find("finance and other income"), "share": find("share of net profit"), "before": find("profit before exceptional"),
    }
    place = lambda word, *no: F.expr("transform(__g, (r, i) -> if(" + " and ".join([f"contains(r.all, '{word}')", "size(r.n) > 0", *[f"not contains(r.all, '{w}')" for w in no]]) + ", i, null))")
    grid = grid.select(*by, "__g", *[c.alias(n) for n, c in names.items()], F.array_min(place("profit for the", "attributable")).alias("__p"), F.array_min(place("total other comprehensive")).alias("__t"))
    c = {n: F.col(n) for n in names}
    at = F.get
    upto = lambda *arrays: F.sequence(F.lit(0), F.least(*[F.size(a) for a in arrays]) - 1)
    ties = lambda a, b, out: F.forall(upto(a, b, out), lambda i: _near(at(a, i) - at(b, i), at(out, i)))

    def income_ties(target: Column) -> Column:
        tries = F.lit(False)
        for fin in (False, True):
            for share in (False, True):
                def one(i: Column) -> Column:
                    v = at(c["income"], i) - at(c["expense"], i)
                    v = v + F.coalesce(at(c["earned"], i) - at(c["paid"], i), F.lit(0.0)) if fin else v
                    v = v + F.coalesce(at(c["share"], i), F.lit(0.0)) if share else v
                    return _near(v, at(target, i))

                tries = tries | F.forall(upto(c["income"], c["expense"], target), one)
        return F.when(target.isNotNull(), tries)

    has = lambda *ns: F.when(sum((c[n].isNull().cast("int") for n in ns), F.lit(0)) == 0, True)
    total = F.get("__g", F.col("__t"))
    parts = F.filter(F.slice("__g", F.col("__p") + 2, F.greatest(F.col("__t") - F.col("__p") - 1, F.lit(0))), lambda r: F.size(r.n) > 0)
    columns = F.filter(F.sequence(F.lit(0), F.size(total.v) - 1), lambda j: at(total.v, j).isNotNull())
    summed = F.forall(columns, lambda j: _near(F.aggregate(parts, F.lit(0.0), lambda s, r: s + F.coalesce(at(r.v, j), F.lit(0.0))), at(total.v, j)))
    checks = {
        "income less expenses": F.when(c["income"].isNotNull() & c["expense"].isNotNull() & (c["pbt"].isNotNull() | c["before"].isNotNull()), F.coalesce(income_ties(c["pbt"]), F.lit(False)) | F.coalesce(income_ties(c["before"]), F.lit(False))),
        "profit after tax": F.when(has("pbt", "tax", "profit"), ties(c["pbt"], c["tax"], c["profit"])),
        "comprehensive income": F.when(has("profit", "oci", "tci"), ties(c["tci"], c["oci"], c["profit"]) | ties(c["tci"], c["profit"], c["oci"])),
        "other comprehensive income": F.when((F.col("__t") - F.col("__p") >= 3) & (F.size(parts) >= 2), summed),
    }
    done = F.array(*[F.struct(F.lit(n).alias("name"), x.alias("ok")) for n, x in checks.items()])
    return grid.select(*by, done.alias("__c")).select(
        *by, F.forall("__c", lambda x: F.coalesce(x.ok, F.lit(True))).alias("ok"), F.array_join(F.transform(F.filter("__c", lambda x: ~x.ok), lambda x: x["name"]), "; ").alias("failed"), F.size(F.filter("__c", lambda x: x.ok.isNotNull())).alias("n_checks"))


def refused(value: Column, total: Column, components: Column, wants_total: Column) -> Column:
    """A sub-item that equals its note's total, where at least two components matter, was taken from the wrong line."""
    material = F.size(F.filter(components, lambda x: F.abs(F.coalesce(x, F.lit(0.0))) > F.greatest(F.abs(total) * 0.005, F.lit(0.5))))
    return F.coalesce(~wants_total & (material >= 2) & N.within(value, total, 0.005, 0.5), F.lit(False))


def splits(values: Column, closes, tolerance: float = 0.02) -> Column:
    """Every (gross, depreciation, net) by which a row parts into a gross block, a depreciation block and their difference.

    closes: values -> boolean Column, whether a block's opening and movements give its closing.
    """
    n = F.size(values)
    ends = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    pairs = F.flatten(F.transform(ends(F.lit(1), n - 3), lambda g: F.transform(ends(g + 2, n - 2), lambda d: F.struct(g.alias("g"), d.alias("d")))))
    at = lambda i: F.get(values, i)

    def fits(p: Column) -> Column:
        net = F.abs(at(p.g) - at(p.d) - at(p.d + 1)) <= tolerance
        return net & closes(F.slice(values, F.lit(1), p.g + 1)) & closes(F.slice(values, p.g + 2, p.d - p.g))

    return F.transform(F.filter(pairs, fits), lambda p: F.struct(at(p.g).alias("gross"), at(p.d).alias("depreciation"), at(p.d + 1).alias("net")))


def deferred_tax_tables(lines: DataFrame, by: list[str], order: str = "line_no", text: str = "line") -> DataFrame:
    """(by, total_no, line_no, label, value, block): component rows above a total of deferred tax with two columns, where they
    sum to it in both. Rows are looked up among the 13 lines before the total, down to the nearest one that ends the table."""
    w = Window.partitionBy(*by).orderBy(order)
    low = F.lower(F.trim(text))
    d = lines.withColumn("__n", N.row_numbers(F.col(text))).withColumn("__l", low)
    plain = lambda k: F.when(~F.lag(text, k).over(w).rlike(r"\d"), F.lower(F.trim(F.lag(text, k).over(w))))
    d = d.withColumn("__ctx", F.concat_ws(" ", "__l", plain(1), plain(2)))
    heading = r"(gross|total)\s+deferred\s+tax\s+(asset|liabilit)"
    totals = d.where(F.col("__l").rlike("^" + heading) & (F.size("__n") == 2)).select(
        *by, F.col(order).alias("total_no"), F.col("__n").alias("__t"), F.when(F.regexp_extract("__l", "^" + heading, 2) == "asset", "dta").otherwise("dtl").alias("block"), F.explode(F.sequence(F.lit(1), F.lit(13))).alias("__back"))
    totals = totals.withColumn(order, F.col("total_no") - F.col("__back")).where(F.col(order) > 0)
    near = totals.join(d.select(*by, order, "__n", "__l", "__ctx"), [*by, order])
    none = F.size("__n") == 0
    ends = F.when(none, F.col("__l").rlike(r"deferred\s+tax\s+(asset|liabilit)")).otherwise((F.size("__n") != 2) | F.col("__l").contains("total") | F.col("__l").contains("gross"))
    table = Window.partitionBy(*by, "total_no")
    parts = near.withColumn("__end", F.max(F.when(ends, F.col(order))).over(table)).where((F.col("__end").isNull() | (F.col(order) > F.col("__end"))) & ~none)
    ties = lambda i: F.abs(F.sum(F.get("__n", i)).over(table) - F.get("__t", i)) < F.greatest(F.abs(F.get("__t", i)) * 0.001, F.lit(0.6))
    good = parts.withColumn("__ok", (F.count("*").over(table) >= 2) & ties(0) & ties(1)).where("__ok")
    return good.select(*by, "total_no", order, F.col("__ctx").alias("label"), F.get("__n", 0).alias("value"), "block")


def answer_grounding(answers: DataFrame, candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, page, grounded): the first candidate page with the value's digits, else the first with the quote's start, else the cited page.

    answers: id, doc, page, value, quote; candidates: id, page, rank; pages: doc, page, text. The cited page comes first.
    """
    asked = answers.select("id", "doc", F.col("page").alias("cited"), N.digits(F.coalesce("value", F.lit(""))).alias("__v"), F.substring(T.collapse(F.coalesce("quote", F.lit(""))), 1, 60).alias("__q"))
    cited = asked.where("cited is not null").select("id", F.col("cited").alias("page"), F.lit(0).alias("rank"))
    tried = candidates.select("id", "page", "rank").unionByName(cited).groupBy("id", "page").agg(F.min("rank").alias("rank"))
    seen = asked.join(tried, "id").join(pages.select("doc", "page", "text"), ["doc", "page"])
    way = F.when((F.length("__v") >= 3) & F.contains(N.digits(F.col("text")), F.col("__v")), 1).when((F.col("__q") != "") & F.contains(T.collapse(F.col("text")), F.col("__q")), 2)
    best = seen.withColumn("__w", way).where("__w is not null").groupBy("id").agg(F.min(F.struct("__w", "rank", "page")).alias("__b"))
    return asked.join(best, "id", "left").select("id", F.coalesce("__b.page", "cited").alias("page"), F.col("__b").isNotNull().alias("grounded"))


def image_grounding(value: Column, page_text: Column) -> Column:
    """False only where the page has text enough (200 characters) to hold a value of three digits, and doesn't."""
    return F.coalesce(~((F.length(page_text) >= 200) & (F.length(N.digits(value)) >= 3) & ~F.contains(N.digits(page_text), N.digits(value))), F.lit(True))


def row_grounding(cells: Column, page_text: Column) -> Column:
    """Every cell with at least three digits stands in the page's digits."""
    page = N.digits(F.coalesce(page_text, F.lit("")))
    return F.forall(cells, lambda c: (F.length(N.digits(F.coalesce(c, F.lit("")))) < 3) | F.contains(page, N.digits(c)))


def unfounded(summary: Column, source: Column) -> Column:
    """Figures of three digits or more in a summary that the source does not hold, sorted."""
    page = N.digits(source)
    found = F.regexp_extract_all(summary, F.lit(r"[₹$]?\(?-?[\d,]+(?:\.\d+)?\)?%?"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: (F.length(N.digits(t)) >= 3) & ~F.contains(page, N.digits(t)))))


def outcome(expected: Column, present: Column, value: Column) -> Column:
    """ok, miss, mismatch or false_positive; a match is to 1 % of the value read, or below one half where that is zero."""
    want, got = N.statement_number(expected), N.statement_number(value)
    has = F.coalesce(present, F.lit(False))
    match = F.when(F.abs(got) < 1e-9, F.abs(want) < 0.5).otherwise(F.abs(want - got) / F.abs(got) < 0.01)
    return F.when(want.isNull(), F.when(has, "false_positive").otherwise("ok")).when(~has, "miss").when(F.coalesce(match, F.lit(False)), "ok").otherwise("mismatch")


def worst_outcome(rows: DataFrame, by: list[str], outcome_col: str = "outcome") -> DataFrame:
    """(by, outcome): over the scopes of an item, mismatch before miss before false_positive before ok."""
    order = F.array_position(F.array(*[F.lit(x) for x in ("mismatch", "miss", "false_positive", "ok")]), F.col(outcome_col))
    return rows.groupBy(*by).agg(F.min_by(outcome_col, order).alias(outcome_col))


def validated(statements: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """(by, fully): every statement ties or is absent, and one ties."""
    return statements.groupBy(*by).agg((F.bool_and(F.col(status).isin("tie", "absent")) & F.bool_or(F.col(status) == "tie")).alias("fully"))


def capped(confidence: Column, section: Column) -> Column:
    """Figures of investments stay unverified: their note has no total to reconcile with."""
    return F.when((section == "investments") & confidence.isin("reconciled", "grounded"), "unverified").otherwise(confidence)


def precedence(readers: list[tuple[int, DataFrame]], keys: list[str], order: str = "ord") -> DataFrame:
    """Rows of all readers, one for each key: present before absent, then the reader of the smallest number, then the first row."""
    tagged = [d.withColumn("priority", F.lit(p)) for p, d in readers]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d)
    return top_k(out, keys, [F.desc("present"), F.col("priority"), F.col(order)], 1, "__r").drop("__r")


def applicability(items: DataFrame, companies: DataFrame) -> DataFrame:
    """(company, key, scope, status): scopes of every item for every company, N/A where its sector or its statements lack it.

    companies: company, na_items array, has_consolidated. items x companies is what is asked for: the items are a fixed,
    small vocabulary that travels in one array, so that no join is needed.
    """
    listed = items.agg(F.collect_list(F.struct("key", "scope")).alias("__i"))
    rows = companies.withColumn("__k", F.lit(1)).join(listed.withColumn("__k", F.lit(1)), "__k").select("company", "na_items", "has_consolidated", F.inline("__i"))
    sector = F.array_contains(F.coalesce("na_items", F.array().cast("array<string>")), F.col("key"))
    scopes = F.when(sector, F.array(F.lit("both"))).when(F.col("scope") == "both", F.array(F.lit("standalone"), F.lit("consolidated"))).otherwise(F.array("scope"))
    status = F.when(sector, "N/A (sector)").when((F.col("scope") == "consolidated") & ~F.col("has_consolidated"), "N/A (no consolidated statements)").otherwise("wanted")
    return rows.withColumn("__s", sector).withColumn("scope", F.explode(scopes)).select("company", "key", "scope", status.alias("status"))


def merge_audit(items: DataFrame, audit: DataFrame, deferred: list[str]) -> DataFrame:
    """Items with what an audit suggests where it suggests something; new aliases after the old ones; deferred items only marked.

    items: key, concept, column_hint, aliases; audit: key, severity, suggested_concept, suggested_column_hint, suggested_aliases.
    """
    given = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    found = audit.select(T.normal(F.col("key")).alias("__k"), F.upper(F.trim("severity")).alias("severity"), *[given(f"suggested_{c}").alias(f"__{c}") for c in ("concept", "column_hint", "aliases")]).where("severity <> 'OK'")
    out = items.withColumn("__k", T.normal(F.col("key"))).join(found, "__k", "left")
    held = F.col("key").isin(*deferred) if deferred else F.lit(False)
    new = F.filter(F.transform(F.split(F.coalesce("__aliases", F.lit("")), "[;|]"), lambda a: F.trim(a)), lambda a: a != "")
    pick = lambda c, v: F.when(held | F.col("severity").isNull(), F.col(c)).otherwise(v)
    review = F.when(F.col("severity").isNull(), None).when(held, "deferred").otherwise("accepted")
    return out.select("key", pick("concept", F.coalesce("__concept", "concept")).alias("concept"), pick("column_hint", F.coalesce("__column_hint", "column_hint")).alias("column_hint"),
        pick("aliases", F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), new))).alias("aliases"), review.alias("review"))


def distinct_tables(tables: DataFrame, by: list[str]) -> DataFrame:
    """Tables of a page with equal figures in their first three rows (80 characters of them) once, the longest; renumbered.

    tables: by, page, n, grid array<array<string>>.
    """
    figures = F.filter(F.transform(F.flatten(F.slice("grid", 1, 3)), lambda c: N.digits(F.coalesce(c, F.lit("")))), lambda d: d != "")
    marked = tables.withColumn("__f", F.substring(F.array_join(figures, "|"), 1, 80)).withColumn("__len", F.size("grid"))
    kept = top_k(marked, [*by, "page", "__f"], [F.desc("__len"), F.col("n")], 1, "__r")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy(*by, "page").orderBy(F.desc("__len"), "n"))).drop("__f", "__len", "__r")


def accepted_faces(rows: DataFrame, by: list[str], kind: str) -> DataFrame:
    """(by, accepted) for the rows of a statement's face: page, line_no, label, ref, value, bank (the page speaks of capital and liabilities).

    bs: 12 rows and total assets equal to total equity and liabilities, or, of a bank, 8 rows and two equal totals. pl: 8 rows,
    income less expenses (with the share of joint ventures or without) a profit before tax, or that less tax the profit; and
    rows for finance costs and other expenses.
    """
    v, label = N.statement_number(F.col("value")), F.lower("label")
    at = F.struct("page", "line_no", v.alias("v"))
    first = lambda test: F.min(F.when(test & F.col("value").isNotNull(), at)).v
    total = lambda *names: first(X.is_face_total(F.col("label"), names))
    every = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test & v.isNotNull(), at))), lambda x: x.v)
    g = rows.groupBy(*by)
    if kind == "bs":
        bare = every(F.regexp_replace(label, "[^a-z]", "") == "total")
        out = g.agg(F.count("*").alias("n"), total("totalassets").alias("a"), total("totalequityandliabilities", "totalequityliabilities", "totalliabilitiesandequity").alias("b"), bare.alias("t"), F.bool_or("bank").alias("bank"))
        form_a = F.col("bank") & (F.col("n") >= 8) & (F.size("t") >= 2) & (F.get("t", 0) > 0) & (F.abs(F.get("t", 0) - F.get("t", 1)) < F.greatest(F.abs(F.get("t", 0)) * 0.005, F.lit(1.0)))
        ok = form_a | ((F.col("n") >= 12) & (F.col("a") > 0) & (F.abs(F.col("a") - F.col("b")) < F.greatest(F.abs(F.col("a")) * 0.005, F.lit(1.0))))
    else:
        venture = F.coalesce(first(label.contains("share of profit") & label.contains("joint")), first(label.contains("share of profit") & label.contains("associate")), F.lit(0.0))
        parent = lambda word: F.coalesce(F.bool_or(label.contains(word) & ~label.rlike("profit|earning") & v.isNotNull()), F.lit(False))
        out = g.agg(F.count("*").alias("n"), total("totalincome").alias("i"), total("totalexpenses", "totalexpense").alias("e"), venture.alias("j"), total("totaltaxexpense", "totaltaxexpenses", "taxexpense").alias("x"),
            every(label.rlike("(profit|loss).{0,15}before")).alias("before"), every(label.rlike("profit for the (year|period)")).alias("after"), (parent("finance cost") & parent("other expense")).alias("parents"))
        near = lambda a, b: F.coalesce(F.abs(a - b) < F.greatest(F.abs(b) * 0.005, F.lit(1.0)), F.lit(False))
        made = F.exists("before", lambda p: near(F.col("i") - F.col("e"), p) | near(F.col("i") - F.col("e") + F.col("j"), p))
        taxed = F.exists("before", lambda p: F.exists("after", lambda q: near(p - F.col("x"), q)))
        ok = (F.col("n") >= 8) & (made | taxed) & F.col("parents")
    return out.select(*by, F.coalesce(ok, F.lit(False)).alias("accepted"))


def statement_faces(pages: DataFrame, candidates: DataFrame, kind: str, tries: int = 5) -> DataFrame:
    """(doc, page, line_no, label, ref, value): the face of the first candidate page, or of it and the next page, whose identities hold.

    All sides of the joins grow with the pages, and what a page's lines and starts come to is not in Spark's estimate: the joins are told not to gather one in the driver.
    """
    asked = candidates.where((F.col("kind") == kind) & (F.col("rank") <= tries)).select("doc", F.col("page").alias("start"), "rank")
    wide = asked.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("width")).withColumn("page", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)))
    asked_pages = wide.select("doc", "page").distinct()
    lines = pages.join(asked_pages.hint("merge"), ["doc", "page"]).select("doc", "page", F.replace(F.lower("text"), F.lit("&"), F.lit("and")).contains("capital and liabilities").alias("bank"), F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "__line"))
    read = cut(lines.select("doc", "page", "bank", "line_no", F.inline(F.array_compact(F.array(X.face_row(F.col("__line")))))))  # a page's lines are read once, however many candidates it serves
    rows = wide.select("doc", "rank", "width", "page").join(read.hint("merge"), ["doc", "page"]).select("doc", "rank", "width", "page", "bank", "line_no", "label", "ref", "value")
    good = accepted_faces(rows, ["doc", "rank", "width"], kind).where("accepted")
    best = top_k(good, ["doc"], [F.col("rank"), F.col("width")], 1, "__r").select("doc", "rank", "width")
    return rows.join(best.hint("merge"), ["doc", "rank", "width"], "left_semi").drop("rank", "width", "bank")


# Sections read by a model from images or as a matrix, which are not asked for again.
NOT_ASKED_AGAIN = ("investments", "ppe", "borrowings")


def datapoints(items: DataFrame, readings: DataFrame, rescued: DataFrame, proven: DataFrame, by: tuple[str, ...] = ("doc",)) -> DataFrame:
    """(by, key, section, value, confidence, origin): one row for each item of a report.

    The reader of the smallest priority that has a row for a section reads all of it; its absent items stay absent. An absent item of
    a section that may be asked again takes a rescued value, and a proven value stands above all. Figures of investments stay unverified.
    items: by, key, section. readings: by, key, priority, value (null: absent), confidence. rescued: by, key, value, grounded. proven:
    by, key, value. Of several rows for one item the smallest value counts.
    """
    keys = [*by, "key"]
    asked = items.select(*keys, "section").distinct()
    read = readings.join(asked, keys)
    first = read.withColumn("__f", F.min("priority").over(Window.partitionBy(*by, "section"))).where("priority = __f")
    chosen = first.groupBy(*keys).agg(F.min(F.when(F.col("value").isNotNull(), F.struct("value", "confidence"))).alias("__c"))
    saved = rescued.where(F.col("grounded") & F.col("value").isNotNull()).groupBy(*keys).agg(F.min("value").alias("__s"))
    known = proven.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.min("value").alias("__p"))
    out = asked.join(chosen, keys, "left").join(saved, keys, "left").join(known, keys, "left")
    again = ~F.coalesce(F.col("section").isin(*NOT_ASKED_AGAIN), F.lit(False))
    origin = F.when(F.col("__p").isNotNull(), "proven").when(F.col("__c").isNotNull(), "read").when(again & F.col("__s").isNotNull(), "rescued").otherwise("absent")
    out = out.withColumn("origin", origin)
    value = F.when(F.col("origin") == "proven", F.col("__p")).when(F.col("origin") == "read", F.col("__c.value")).when(F.col("origin") == "rescued", F.col("__s"))
    trust = F.when(F.col("origin").isin("proven", "rescued"), "grounded").when(F.col("origin") == "read", F.col("__c.confidence")).otherwise("absent")
    return out.select(*keys, "section", value.alias("value"), capped(trust, F.col("section")).alias("confidence"), "origin")


def face_answers(items: DataFrame, faces: DataFrame, section: str = "pl_changes_inventory", words: str = "changes in inventor") -> DataFrame:
    """(doc, key, value): items of a section that a line of an accepted statement answers: the first with the words and a value. faces: doc, line_no, label, value."""
    lines = faces.where(F.lower("label").contains(words) & (F.coalesce("value", F.lit("")) != "")).groupBy("doc").agg(F.min_by("value", F.struct("line_no", "value")).alias("value"))
    return items.where(F.col("section") == section).select("doc", "key").distinct().join(lines, "doc")
