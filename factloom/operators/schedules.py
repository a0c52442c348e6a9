"""Schedules of assets whose classes are columns: detection, the printed order of columns, closing rows, and what ties to the balance sheet.

A page is one row; its lines are an array, so that detection and order need no shuffle. Only closing rows are exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N, text as T, values as X

# Asset classes in a line of headers; labels of columns with the words that show them, in order of precedence;
# words of a requested item with the words of the column that answers it.
CLASSES = (r"\bland\b", r"\bbuilding", r"\bplant\b", r"\boffice\b", r"\bcomputer", r"\bfurnitur", r"\bleasehold", r"\bvehicle")
COLUMNS = {
    "Right-of-Use Assets": ("right-of-use", "right of use"),
    "Office Equipment": ("office equip", "office"),
    "Plant & Machinery": ("plant and machinery", "plant & machinery", "plant and equipment", "plant"),
    "Furniture & Fixtures": ("furniture", "furnitur", "fixture"),
    "Computers": ("computer", "data processing"),
    "Electrical": ("electric",),
    "Leasehold Improvements": ("leasehold",),
    "Buildings": ("building",),
    "Aircraft": ("aircraft", "air craft"),
    "Ships/Vessels": ("vessel", "ship"),
    "Vehicles": ("vehicle",),
    "Land": ("land",),
    "Total": ("total",),
}
REQUESTED = {
    "office equip": ("office equip", "equipment"),
    "furnitur": ("furnitur", "fixture"),
    "vehicle": ("vehicle",),
    "building": ("building",),
    "plant": ("plant",),
    "land": ("land",),
    "computer": ("computer",),
}
FIGURE = r"\(?-?\d[\d,]*\.?\d*\)?"


def _lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def _classes(line: Column) -> Column:
    return sum((line.rlike(c).cast("int") for c in CLASSES), F.lit(0))


def classes_as_columns(text: Column) -> Column:
    """A page whose text would mislead: one line heads four asset classes, or a movement grid has its headers torn from its figures."""
    low = F.lower(F.coalesce(text, F.lit("")))
    labelled = F.filter(_lines(low), lambda x: _classes(x) > 0)
    figures = lambda x: F.size(F.regexp_extract_all(x, F.lit(r"\d[\d,]*\.?\d*"), F.lit(0)))
    bare = F.size(F.filter(labelled, lambda x: figures(x) == 0))
    filled = F.size(F.filter(labelled, lambda x: (figures(x) >= 4) & (_classes(F.substring(x, 1, 40)) > 0)))
    depreciates = low.contains("accumulated depreciation")
    torn = (low.contains("gross carrying") | low.contains("gross block")) & depreciates & (_classes(low) >= 4) & (bare >= 4) & (filled < 3)
    return (low.contains("carrying value") | depreciates) & (F.exists(labelled, lambda x: _classes(x) >= 4) | torn)


def layout(text: Column) -> Column:
    """struct(layout, columns, n_columns): `shredded` with under three lines of five figures, `per_column` if the eight lines above the
    first of them name three classes or more with Total rightmost, else `per_row`. Columns are in the order of their offsets."""
    lines = _lines(F.coalesce(text, F.lit("")))
    counts = F.transform(lines, lambda x: F.size(F.regexp_extract_all(x, F.lit(FIGURE), F.lit(0))))
    full = F.filter(counts, lambda n: n >= 5)
    first = F.array_position(F.transform(counts, lambda n: n >= 5), F.lit(True)).cast("int")
    head = F.transform(F.slice(lines, F.greatest(first - 8, F.lit(1)), F.least(first - 1, F.lit(8))), F.lower)

    def offset(words: tuple[str, ...]) -> Column:
        at = F.flatten(F.transform(head, lambda x: F.array(*[F.instr(x, w) for w in words])))
        return F.array_min(F.filter(at, lambda p: p > 0))

    placed = F.array(*[F.struct(offset(words).alias("at"), F.lit(label).alias("label")) for label, words in COLUMNS.items()])
    order = F.transform(F.array_sort(F.filter(placed, lambda p: p["at"].isNotNull())), lambda p: p["label"])
    trusted = (F.size(order) >= 4) & (F.element_at(order, -1) == "Total")
    made = lambda name, columns: F.struct(F.lit(name).alias("layout"), columns.cast("array<string>").alias("columns"), F.coalesce(F.array_max(full), F.lit(0)).alias("n_columns"))
    shredded = F.struct(F.lit("shredded").alias("layout"), F.array().cast("array<string>").alias("columns"), F.lit(0).alias("n_columns"))
    return F.when(F.size(full) < 3, shredded).when(trusted, made("per_column", order)).otherwise(made("per_row", F.array()))


def closing_rows(pages: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, block, label, value): each block's first row dated the page's latest year, its last figures mapped to the trusted columns.

    Blocks are gross, dep and net, in force from the line that names them. Pages of other layouts give no rows.
    """
    known = pages.select(*by, F.col(text).alias("__t"), layout(F.col(text))["columns"].alias("__c")).where(F.size("__c") > 0)
    year = F.array_max(T.years(F.col("__t")))
    lines = known.select(*by, "__c", year.alias("__y"), F.posexplode(_lines(F.col("__t"))).alias("__n", "__l"))
    low = F.lower("__l")
    names = F.when(low.contains("gross") & low.rlike("carry|block|cost"), "gross").when(low.rlike("depreciation|amortis"), "dep").when(low.rlike("carrying value|net block|net carrying"), "net")
    w = Window.partitionBy(*by).orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    figures = F.filter(F.regexp_extract_all("__l", F.lit(X.VALUE), F.lit(0)), lambda x: x.rlike(r"\d"))
    held = lines.withColumn("block", F.last(names, ignorenulls=True).over(w)).withColumn("__v", figures)
    dated = held.where(F.col("block").isNotNull() & (F.array_max(T.years(F.col("__l"))) == F.col("__y")) & (F.size("__v") >= F.size("__c")))
    closing = dated.groupBy(*by, "block").agg(F.min_by(F.struct("__c", F.expr("slice(__v, -size(__c), size(__c))").alias("__v")), "__n").alias("__r"))
    return closing.select(*by, "block", F.explode(F.arrays_zip("__r.__c", "__r.__v")).alias("__z")).select(*by, "block", F.col("__z.__c").alias("label"), F.col("__z.__v").alias("value"))


def requested_block(key: Column) -> Column:
    return F.when(F.lower(key).startswith("gross"), "gross").when(F.lower(key).startswith("accumulated"), "dep")


def requested_words(key: Column) -> Column:
    """Words of the column that an item asks for, from the part of its key after the last underscore; null if none."""
    leaf = F.element_at(F.split(F.lower(key), "_"), -1)
    return F.coalesce(*[F.when(leaf.contains(stem), F.array(*map(F.lit, words))) for stem, words in REQUESTED.items()])


def net_ties(total: Column, parent: Column) -> Column:
    """A schedule's net total is the balance sheet's line, within 1 % or 1."""
    return F.coalesce(N.within(total, parent, 0.01, 1), F.lit(False))


def nets_tie(assets: DataFrame, by: list[str], net: str, parent: str) -> DataFrame:
    """(by, ties): the sum of a schedule's net values is its parent. Without a value or a parent it does not tie."""
    return assets.groupBy(*by).agg(F.sum(net).alias("__s"), F.max(parent).alias("__p")).select(*by, net_ties(F.col("__s"), F.col("__p")).alias("ties"))


def column_schedules(pages: DataFrame, parents: DataFrame, keys: list[str], k: int = 8) -> DataFrame:
    """(doc, key, page, value, confidence) for every item of a document with a schedule by columns.

    pages: doc, page, rank, text, candidates of which the first k are read. parents: doc, parent, one row a document. keys: the items.
    Pages before the latest year among the schedules are left out; of the rest, the first whose net total ties is taken, else the
    first with a closing row. An item without a value there is `absent`.
    """
    known = pages.where(F.col("rank") <= k).withColumn("__y", F.coalesce(F.array_max(T.years(F.col("text"))), F.lit(0))).withColumn("__c", layout(F.col("text"))["columns"]).where(F.size("__c") > 0)
    latest = known.withColumn("__latest", F.max("__y").over(Window.partitionBy("doc"))).where("__y = __latest")
    cells = closing_rows(latest, ["doc", "page", "rank"])
    total = F.max(F.when((F.col("block") == "net") & (F.col("label") == "Total"), N.statement_number(F.col("value"))))
    read = cells.groupBy("doc", "page", "rank").agg(F.array_sort(F.collect_list(F.struct("block", "label", "value"))).alias("cells"), total.alias("__net"), F.max(F.col("block").isin("gross", "dep")).alias("__any")).where("__any")
    tied = read.join(parents, "doc", "left").withColumn("__ties", net_ties(F.col("__net"), F.col("parent")))
    best = tied.groupBy("doc").agg(F.min_by(F.struct("page", "cells", "__ties"), F.struct(~F.col("__ties"), "rank")).alias("__b")).select("doc", "__b.*")
    asked = F.array(*[F.struct(F.lit(k).alias("key"), requested_block(F.lit(k)).alias("block"), requested_words(F.lit(k)).alias("words")) for k in keys])
    every = best.withColumn("__a", F.explode(asked)).select("*", F.col("__a.key").alias("key"), F.col("__a.block").alias("__block"), F.col("__a.words").alias("__words"))
    mine = F.filter("cells", lambda c: (c["block"] == F.col("__block")) & F.exists("__words", lambda w: F.lower(c["label"]).contains(w)))
    value = F.get(F.transform(mine, lambda c: c["value"]), F.lit(0))
    value = F.when(~value.isin("", "-"), X.clean_value(value))
    return every.select("doc", "key", "page", value.alias("value"), F.when(value.isNull(), "absent").when(F.col("__ties"), "reconciled").otherwise("grounded").alias("confidence"))


# The words of a schedule's column heads, by asset.
HEADS = {"land": "Land", "building": "Buildings", "plant": "Plant", "office": "Office", "computer": "Computer", "furnitur": "Furniture", "leasehold": "Leasehold", "vehicle": "Vehicles"}


def asset_target(key: Column) -> Column:
    """struct(block, stem): what a requested key asks for: gross or dep, and the asset of its last part; null if it asks for neither."""
    k = F.lower(key)
    leaf = F.element_at(F.split(k, "_"), -1)
    stem = F.coalesce(*[F.when(leaf.contains(w), F.lit(w)) for w in REQUESTED])
    block = F.when(k.startswith("gross"), "gross").when(k.startswith("accumulated"), "dep")
    return F.when(block.isNotNull() & stem.isNotNull(), F.struct(block.alias("block"), stem.alias("stem")))


def coordinate_cells(words: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc, page, key, value): the closing cell of a requested asset's column in an upright schedule, by coordinates.

    words: doc, page, x0, y0, x1, y1, word; targets: key, head (a value of HEADS), gross (else accumulated depreciation). A page needs a line
    with four heads; a column's centre is that of its head's word within 30 points of that line, at least 18 from the next one. Figures
    below it form rows up to gaps of 5 points. The first row counts whose label (left of the columns, up to 36 points above) names the
    closing of the page's latest year, and whose figure nearest the column is nearest to no other column and within 30 points.
    """
    page = ["doc", "page"]
    at = lambda c: F.bround(c).cast("int")
    w = words.select(*page, at(F.col("x0")).alias("x0"), at(F.col("x1")).alias("x1"), at((F.col("y0") + F.col("y1")) / 2).alias("y"), "word")
    token = F.regexp_replace(F.lower("word"), "^,+|,+$", "")
    head = F.coalesce(*[F.when(token.isin(stem, name.lower()), F.lit(name)) for stem, name in HEADS.items()])
    headed = w.withColumn("head", head).where("head is not null")
    line = headed.groupBy(*page, "y").agg(F.count_distinct("head").alias("n")).where("n >= 4").groupBy(*page).agg(F.min("y").alias("top"))
    columns = headed.join(line, page).where(F.abs(F.col("y") - F.col("top")) <= 30).groupBy(*page, "top", "head").agg(F.max_by((F.col("x0") + F.col("x1")) / 2, F.struct("y", "x0")).alias("centre"))
    sides = columns.groupBy(*page, "top").agg((F.min("centre") - 25).alias("left"), F.collect_list(F.struct("head", "centre")).alias("columns")).where("size(columns) >= 4")
    years = w.groupBy(*page).agg(F.max(F.array_max(F.transform(F.regexp_extract_all("word", F.lit(r"(20\d\d)"), F.lit(1)), lambda y: y.cast("int")))).alias("year")).where("year is not null")
    figures = w.where(F.col("word").rlike(r"^\(?[\d,]+\)?$|^[–-]$")).join(sides, page).where("x0 >= left and y > top + 5").withColumn("x", at((F.col("x0") + F.col("x1")) / 2))
    order = Window.partitionBy(*page).orderBy("y", "x")
    figures = figures.withColumn("__s", F.coalesce((F.col("y") - F.lag("y").over(order) > 5).cast("int"), F.lit(0))).withColumn("row", F.sum("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = figures.groupBy(*page, "row", "left", "columns").agg(at(F.avg("y")).alias("mid"), F.collect_list(F.struct("x", F.col("word").alias("text"))).alias("figures"))
    near = w.select(*page, F.col("x0").alias("wx"), F.col("x1").alias("wx1"), F.col("y").alias("wy"), "word").join(rows.select(*page, "row", "left", "mid"), page).where("wx1 < left and wy > mid - 36 and wy <= mid + 3")
    labels = near.groupBy(*page, "row").agg(F.lower(F.array_join(F.array_sort(F.collect_list(F.struct("wy", "wx", "word")))["word"], " ")).alias("label"))
    named = rows.join(labels, [*page, "row"]).join(years, page).where(F.expr("contains(label, cast(year as string)) and not contains(label, 'april') and not contains(label, 'beginning')"))
    asks = F.array_compact(F.array(F.when(F.col("label").contains("gross carrying value as at"), F.lit(True)), F.when(F.col("label").contains("accumulated depreciation as at"), F.lit(False))))
    asked = named.withColumn("gross", F.explode(asks)).join(targets, "gross")
    centre = F.get(F.filter("columns", lambda c: c.head == F.col("head")), F.lit(0)).centre
    asked = asked.withColumn("centre", centre).where("centre is not null").where(~F.exists("columns", lambda c: (c.head != F.col("head")) & (F.abs(c.centre - F.col("centre")) < 18)))
    best = F.array_min(F.transform("figures", lambda f: F.struct(F.abs(f.x - F.col("centre")).alias("gap"), f.x.alias("x"), f.text.alias("text"))))
    asked = asked.withColumn("best", best).where("best.gap <= 30").where(~F.exists("columns", lambda c: F.abs(c.centre - F.col("best.x")) < F.col("best.gap")))
    return asked.groupBy(*page, "key").agg(F.min_by("best.text", "row").alias("value"))
