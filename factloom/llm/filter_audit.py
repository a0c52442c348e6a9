"""How filters act on one another: for every order of them, what each step removes, by part of the corpus.

The rows are first counted by part and combination of failures, so what follows grows with parts and not with rows. One
SQL CUBE over the failure flags and the part then adds these counts up for every subset of the flags: a grouping-set row whose
selected flags are all false counts the survivors of that subset of filters. A step of an order goes from the survivors of the
filters before it to those of the filters with it, so steps are joins of pairs of subsets: 80 pairs for five filters, however
many orders share them.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut

WORDS = r"[^\x20\x09-\x0D]+"
# Fixed values of the five filters: fewest words, least share of distinct words and greatest share of capitals in hundredths, characters.
FEWEST, DISTINCT, CAPITALS, MARKS = 50, 65, 5, "[#$%&*|]"
LETTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D on a text without nulls: few words, few distinct words, many capitals, marks. Whole texts, of any length."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n = F.size(words).cast("long")
    return {
        "A": n < FEWEST,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(MARKS),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): documents counted by part and failures; good and toxic are those with such a label.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; others are left out, whatever their names. A null text is an empty one, a null source the
    part "". E: the text is that of a row with a smaller doc_id, which a row without an id neither has nor is; of rows that repeat an id
    none is smaller. A document with several label rows has a label if one of them has it; labels without an id are nobody's. No documents
    give no rows. Texts are read once and whole, and only digests of them are shuffled: the first id of each digest is a
    minimum that tasks compute ahead, and it meets the rows by id and digest, so copies of one text do not meet in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    seen = slim.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in text_failures(F.col("text")).items()])
    rows = cut(seen.groupBy(*seen.columns).agg(F.count("*").alias("n")))
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality").eqNullSafe(1)).alias("is_good"), F.max(F.col("toxic").eqNullSafe(1)).alias("is_toxic"))
    # rows without an id are in neither join: their null would bring them all to one task
    with_id = rows.where("id is not null").join(first, ["id", "digest"], "left").join(marks, "id", "left")
    without = rows.where("id is null").withColumns({"first": F.lit(True), "is_good": F.lit(False), "is_toxic": F.lit(False)})
    both = with_id.unionByName(without).withColumn("E", F.col("first").isNull())
    return both.groupBy("part", *LETTERS).agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(f"is_{m}"), F.col("n")).otherwise(0)).alias(m) for m in MEASURES[1:]])


def survivors(counted: DataFrame, letters: str = LETTERS, part: str = "part") -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part that pass all filters of a subset; bit i of the mask is filter i. Absent: none pass."""
    k = len(letters)
    # grouping_id has a bit for every column that is not selected, the first column's highest
    chosen = (F.lit((1 << k) - 1) - F.col("gid")).cast("int")
    passed = F.lit(True)
    for c in letters:
        passed = passed & ((F.grouping(c) == 1) | ~F.col(c))
    cube = counted.cube(part, *letters).agg(F.grouping_id().alias("gid"), passed.alias("passed"), *[F.sum(m).alias(m) for m in MEASURES])
    mask = F.lit(0)
    for i, _ in enumerate(letters):
        mask = mask + F.when(chosen.bitwiseAND(1 << (k - 1 - i)) != 0, 1 << i).otherwise(0)
    return cube.where((F.col("gid") < (1 << k)) & F.col("passed")).select(part, mask.alias("mask"), *MEASURES)


def steps(spark: SparkSession, letters: str) -> DataFrame:
    """(filter_order, step, filter, before, after): every step of every order of the filters."""
    bit = {c: 1 << i for i, c in enumerate(letters)}
    made = [("".join(o), i + 1, c, sum(bit[x] for x in o[:i]), sum(bit[x] for x in o[: i + 1])) for o in permutations(letters) for i, c in enumerate(o)]
    return spark.createDataFrame(made, "filter_order string, step int, filter string, before int, after int")


def audit(counted: DataFrame, letters: str = LETTERS, part: str = "part") -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (all long, zeros included).

    counted: part, a boolean for each letter (true: fails; null: does not), n, good, toxic. Equal rows add up; no rows give none. Up to six
    filters, whose 720 orders the driver still lists; parts may be many and one may hold most rows.
    """
    if not 1 <= len(letters) <= 6:
        raise ValueError("one to six filters")
    spark, k = counted.sparkSession, len(letters)
    flat = counted.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in letters}).groupBy(part, *letters).agg(*[F.sum(m).alias(m) for m in MEASURES])
    alive = cut(survivors(flat, letters, part))
    pairs = [(c, m, m | 1 << i, 1 << i, (1 << k) - 1, (1 << k) - 1 - (1 << i), factorial(bin(m).count("1")) * factorial(k - 1 - bin(m).count("1"))) for i, c in enumerate(letters) for m in range(1 << k) if not m >> i & 1]
    pair = F.broadcast(spark.createDataFrame(pairs, "filter string, before int, after int, alone int, whole int, others int, orders long"))

    def at(name: str) -> DataFrame:
        return alive.select(part, F.col("mask").alias(name), *[F.col(m).alias(f"{name}_{m}") for m in MEASURES])

    # the empty subset has a row for each part; a subset that none survives has no row
    parts = alive.where("mask = 0").select(part, F.col("n").alias("all_n"), F.explode(F.lit(list(range(1 << k)))).alias("before"))
    found = parts.join(at("before"), [part, "before"], "left").join(pair, "before")
    for name in ("after", "alone", "whole", "others"):
        found = found.join(at(name), [part, name], "left")
    v = lambda c: F.coalesce(F.col(c), F.lit(0))
    moved = found.select(
        part, "filter", "before", "orders", v("after_n").alias("kept"), (v("before_n") - v("after_n")).alias("removed"),
        (F.col("all_n") - v("alone_n") - v("before_n") + v("after_n")).alias("redundant"), (v("others_n") - v("whole_n")).alias("unique_fails"),
        *[(v(f"before_{m}") - v(f"after_{m}")).alias(f"{m}_lost") for m in MEASURES[1:]],
    )
    total = moved.groupBy(part, "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    all_steps = F.broadcast(steps(spark, letters).drop("after"))
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return moved.join(total, [part, "filter"]).join(all_steps, ["filter", "before"]).select(part, "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in counts])
