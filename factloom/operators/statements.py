"""Statements from what a model returned (JSON text) for pages or whole documents: code checks the identities and takes the first tie.

kinds: bs (balance sheet), pl (results), cf (cash flows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N, values as X
from . import verify as V
from .retrieval import top_k

KINDS = ("bs", "pl", "cf")
# A statement's fields, and what they are called where one answer holds all three.
FIELDS = {
    "bs": {"grand_total_a": "bs_total_assets", "grand_total_b": "bs_total_equity_and_liabilities"},
    "pl": {"total_income": "pl_total_income", "total_expenses": "pl_total_expenses", "profit_before_tax": "pl_profit_before_tax", "tax_total": "pl_tax_total", "profit_for_year": "pl_profit_for_period"},
    "cf": {"net_operating": "cf_net_operating", "net_investing": "cf_net_investing", "net_financing": "cf_net_financing", "forex_effect": "cf_forex_effect", "net_change": "cf_net_change", "opening_cash": "cf_opening_cash", "closing_cash": "cf_closing_cash"},
}
TARGETS = "array<struct<key string, present boolean, value string, evidence string, lines array<struct<label string, value string>>>>"


def anchor(kind: Column, data: Column) -> Column:
    """The figure that the kind's identity pins down in a map of printed values; null where none holds."""
    v = lambda field: N.statement_number(data[field])
    balance = F.when(V.balance_ties(v("grand_total_a"), v("grand_total_b")), v("grand_total_a"))
    profit = V.profit_anchor(v("profit_before_tax"), v("tax_total"), v("profit_for_year"), v("total_income"), v("total_expenses"))
    cash = V.cash_anchor(v("net_operating"), v("net_investing"), v("net_financing"), v("forex_effect"), v("net_change"), v("opening_cash"), v("closing_cash"))
    return F.when(kind == "bs", balance).when(kind == "pl", profit).when(kind == "cf", cash)


def page_statements(docs: DataFrame, candidates: DataFrame, payloads: DataFrame) -> DataFrame:
    """(doc, kind, status, page, unit, scope, anchor, data): one row a kind for each document.

    docs: doc. candidates: doc, kind, page, rank. payloads: doc, kind, page, attempt, payload (a JSON object of printed values).
    The first candidate with an attempt that ties; `no-tie` with the first candidate's page, `no-candidate` without any. What is
    not JSON, and a candidate without an answer, do not tie.
    """
    read = payloads.select("doc", "kind", "page", "attempt", F.from_json("payload", "map<string,string>").alias("data")).withColumn("anchor", anchor(F.col("kind"), F.col("data")))
    tried = candidates.join(read, ["doc", "kind", "page"], "left").groupBy("doc", "kind").agg(
        F.min_by(F.struct("page", "data", "anchor"), F.when(F.col("anchor").isNotNull(), F.struct("rank", "attempt"))).alias("__tie"), F.min_by("page", "rank").alias("__first"))
    every = docs.select("doc").distinct().select("doc", F.explode(F.array(*map(F.lit, KINDS))).alias("kind")).join(tried, ["doc", "kind"], "left")
    tie = F.col("__tie")
    status = F.when(tie.isNotNull(), "tie").when(F.col("__first").isNotNull(), "no-tie").otherwise("no-candidate")
    return every.select("doc", "kind", status.alias("status"), F.coalesce(tie["page"], "__first").alias("page"), tie["data"]["unit"].alias("unit"), tie["data"]["scope"].alias("scope"), tie["anchor"].alias("anchor"), tie["data"].alias("data"))


def whole_statements(payloads: DataFrame) -> DataFrame:
    """(doc, kind, status, unit, scope, anchor, data) from one answer a document (doc, payload) that holds all three statements.

    `absent` where none of a kind's fields has a value, as where the answer is missing or not JSON.
    """
    read = payloads.select("doc", F.from_json("payload", "map<string,string>").alias("__p"))
    part = lambda kind: F.struct(F.lit(kind).alias("kind"), F.create_map(*[x for to, of in FIELDS[kind].items() for x in (F.lit(to), F.col("__p")[of])]).alias("data"))
    parts = read.select("doc", "__p", F.inline(F.array(*[F.struct(part(k)["kind"].alias("kind"), part(k)["data"].cast("map<string,string>").alias("data")) for k in KINDS])))
    found = parts.withColumn("anchor", anchor(F.col("kind"), F.col("data")))
    ties = F.col("anchor").isNotNull()
    filled = F.exists(F.map_values("data"), lambda v: F.coalesce(v, F.lit("")) != "")
    status = F.when(ties, "tie").when(filled, "no-tie").otherwise("absent")
    return found.select("doc", "kind", status.alias("status"), F.when(ties, F.col("__p")["unit"]).alias("unit"), F.when(ties, F.col("__p")["scope"]).alias("scope"), "anchor", "data")


def face_lines(parsed: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc, ord, label, ref, value, parsed): a document's lines as its face was parsed, else as a model answered.

    parsed: doc, page, line_no, label, ref, value. answers: doc, payload (a JSON array of label, note_ref, value).
    """
    of_face = parsed.select("doc", F.struct("page", "line_no").alias("__at"), "label", "ref", "value")
    of_face = of_face.withColumn("ord", F.row_number().over(Window.partitionBy("doc").orderBy("__at"))).drop("__at")
    rows = answers.join(parsed.select("doc").distinct(), "doc", "left_anti").select("doc", F.posexplode(F.from_json("payload", "array<struct<label string, note_ref string, value string>>")).alias("__n", "__r"))
    of_answer = rows.select("doc", "__r.label", F.col("__r.note_ref").alias("ref"), "__r.value", (F.col("__n") + 1).alias("ord"))
    return of_face.withColumn("parsed", F.lit(True)).unionByName(of_answer.withColumn("parsed", F.lit(False))).select("doc", "ord", "label", "ref", "value", "parsed")


def fullest_window(payloads: DataFrame) -> DataFrame:
    """(doc, window, key, value): of a document's windows (doc, window, payload: a JSON array of targets) the one with most values
    present, the first of equals; values are cleaned and signed."""
    rows = payloads.select("doc", "window", F.inline(F.from_json("payload", TARGETS)))
    there = F.coalesce("present", F.lit(False)) & ~F.coalesce("value", F.lit("")).isin("", "-")
    rows = rows.select("doc", "window", "key", F.when(there, X.hygiene(F.col("value"), F.coalesce("evidence", F.lit("")), F.lit(False))).alias("value"))
    # one reading and one shuffle: windows of a document meet by its name
    counted = rows.where("doc is not null").repartition("doc").withColumn("__n", F.count("value").over(Window.partitionBy("doc", "window")))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col("window").alias("w"))).over(Window.partitionBy("doc"))
    return counted.withColumn("__b", best).where(F.col("__b.w") == F.col("window")).drop("__n", "__b")


def category_values(payloads: DataFrame) -> DataFrame:
    """(doc, key, value): each class of holdings in an answer (doc, payload) as the sum of its member lines; null if absent or without figures."""
    rows = payloads.select("doc", F.inline(F.from_json("payload", TARGETS)))
    members = F.transform(F.coalesce("lines", F.array().cast("array<struct<label string, value string>>")), lambda x: x["value"])
    return rows.select("doc", "key", F.when(F.col("present"), X.category_sum(members)).alias("value"))


def sections_in_force(pages: DataFrame, headings: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc, page, n, scope, section, units) for each table: the last heading before it in its run of pages of one scope.

    pages: doc, page, scope, statement (the title of a page that begins a statement, else null), units (null: as before).
    headings: doc, page, y, heading. tables: doc, page, n, y, own (heading of a statement right above it, else null), which
    holds for what follows too. A heading at a table's height comes first. Units are carried over scopes. Pages that are not
    in `pages` are left out.
    """
    w = Window.partitionBy("doc").orderBy("page")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    turns = (~F.col("scope").eqNullSafe(F.lag("scope").over(w))).cast("int")
    known = pages.withColumn("__turn", turns).select("doc", "page", "scope", "statement", F.sum("__turn").over(upto).alias("__run"), F.last("units", ignorenulls=True).over(upto).alias("__units"))
    event = lambda df, kind, y, text, n: df.select("doc", "page", F.lit(kind).alias("__kind"), y.cast("double").alias("y"), text.cast("string").alias("__text"), n.cast("int").alias("n"))
    events = event(known, -1, F.lit(float("-inf")), F.col("statement"), F.lit(None)).unionByName(event(headings, 0, F.col("y"), F.col("heading"), F.lit(None))).unionByName(event(tables, 1, F.col("y"), F.col("own"), F.col("n")))
    order = Window.partitionBy("doc", "__run").orderBy("page", "y", "__kind", "n").rowsBetween(Window.unboundedPreceding, 0)
    held = events.join(known.select("doc", "page", "scope", "__run", "__units"), ["doc", "page"]).withColumn("section", F.coalesce(F.last("__text", ignorenulls=True).over(order), F.lit("")))
    return held.where("__kind = 1").select("doc", "page", "n", "scope", "section", F.coalesce("__units", F.lit("")).alias("units"))
