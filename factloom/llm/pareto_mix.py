"""Mixing sources to target weights by Pareto order sampling.

Sources are weighed, share a budget of words, and none gets more than `most` times its own words; what is beyond
that is shared again by weight (water-filling). A source's target over its words is the copies that each of its documents gets
for certain (the whole part), and what remains is a number of words to be sampled. A document's inclusion probability for
that is proportional to a measure of its size (the square root of its size class, a power of two), so long documents are
likelier, though less than their words are; the proportion is such that the expected words are those that remain. Documents
whose probability reaches 1 are certain too. The others are ranked by their random odds divided by their inclusion odds, and
taken in that order until the words are met.

The order is never sorted as a whole: a source's ranks are counted in 4096 bins, the bin that the sample ends in again
in 4096, and only the rows of that last bin are put in order. Rows before and after it are decided by one comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import aside, cut, joined_by_site, unit_hash

# Fixed values of the mix: weights by the source's place in code point order (repeating), share of all words, most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
WORDS = r"[^\x20\x09-\x0D]+"
BINS = 4096
#: Bins are added up in runs of so many, so that no running sum has more rows than that for one source.
RUN = 64


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """docs with __size (words of the whole text), __class (of the size), __u (random in (0, 1), by the id, or the text where that is null) and __site (its source, null too)."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.withColumns({
        "__size": size,
        "__class": F.length(F.bin(F.greatest(size, F.lit(1)))) - 1,
        "__u": unit_hash(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("string")))),
        "__site": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t")),
    })


def places(sites: DataFrame) -> DataFrame:
    """sites with their place in the order of __site, from 0: ranks within ranges, after the counts of the ranges before; no task has them all."""
    ranged = cut(sites.repartitionByRange("__site").withColumn("__part", F.spark_partition_id()))
    before, at = {}, 0
    for r in ranged.groupBy("__part").count().orderBy("__part").collect():  # one row for each shuffle partition
        before[r["__part"]], at = at, at + r["count"]
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("__part")] if before else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("__site")) - 1
    return ranged.withColumn("place", start + rank).drop("__part")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(__site, source_size, target) per source of sized rows; "t", the null source, sorts after every "s...".

    The water level rises until no further source is full: each round is one sum over the sources.
    """
    by_site = places(sizes.groupBy("__site").agg(F.sum("__size").alias("source_size")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sites = cut(by_site.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double")))
    total = (sites.agg(F.sum("source_size")).first()[0] or 0) * share
    level, last = 0.0, None
    while level != last:
        last, full = level, F.col("cap") < F.col("w") * level
        r = sites.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open")).first()
        if not r.open:
            return sites.select("__site", "source_size", F.col("cap").alias("target"))
        level = max(last, (total - r.held) / r.open)
    return sites.select("__site", "source_size", F.least("cap", level * F.col("w")).alias("target"))


def inclusion(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """(__site, scale): what a class's measure is multiplied by to give its documents' inclusion probability. sites: __site, need.

    Classes reach probability 1 from the largest down; the scale is the first at which the next class stays below it.
    """
    classes = joined_by_site(rows.groupBy("__site", "__class").agg(F.sum("__size").alias("words")), sites.select(F.col("__site").alias("s"), "need"), F.expr("__site = s")).drop("s")
    m = measure(F.col("__class"))
    down = Window.partitionBy("__site").orderBy(F.desc("__class"))  # a source has at most 63 classes
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum(m * F.col("words")).over(Window.partitionBy("__site").orderBy("__class").rowsBetween(Window.unboundedPreceding, 0))
    scales = classes.withColumn("scale", F.when(upto > 0, (F.col("need") - above) / upto).otherwise(0.0)).withColumn("m", m)
    fits = scales.where("scale * m < 1").groupBy("__site").agg(F.max_by("scale", "__class").alias("scale"))
    return fits.withColumn("scale", F.greatest("scale", F.lit(0.0)))


def measure(size_class: Column) -> Column:
    return F.sqrt(F.pow(F.lit(2.0), size_class))


def _ranked(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """rows with their source's plan, __certain (copies beyond doubt) and __q, the random odds over the inclusion odds, with its bins."""
    rows = joined_by_site(rows, sites.withColumnRenamed("__site", "__s"), F.expr("__site = __s")).drop("__s")
    p = measure(F.col("__class")) * F.coalesce("__scale", F.lit(0.0))
    rows = rows.withColumn("__p", p).withColumn("__certain", F.col("__whole") + F.when(F.col("__p") >= 1, 1).otherwise(0))
    bounded = F.least(F.greatest(F.col("__p"), F.lit(1e-9)), F.lit(1 - 1e-9))
    rows = rows.withColumn("__q", (F.col("__u") / (1 - F.col("__u"))) / (bounded / (1 - bounded))).withColumn("__at", F.col("__q") / (1 + F.col("__q")) * BINS)
    return rows.withColumn("__bin", F.floor("__at")).withColumn("__bin2", F.floor((F.col("__at") - F.floor("__at")) * BINS))


def _boundary(rows: DataFrame, bin_col: str, start: str) -> DataFrame:
    """(s, bin, before) of the bin in which a source's words in Pareto order reach __need. rows: __site, bin_col, __size, __need, `start`.

    Words of bins are added up to runs of bins; first the run is found, then the bin in it.
    """
    bins = cut(rows.groupBy("__site", F.col(bin_col).alias("bin")).agg(F.sum("__size").alias("words"), F.first("__need").alias("need"), F.first(start).alias("start")).withColumn("run", F.floor(F.col("bin") / RUN)))

    def first_reached(sums: DataFrame, at: str) -> DataFrame:
        upto = F.col("start") + F.sum("words").over(Window.partitionBy("__site").orderBy(at))
        reached = sums.withColumn("upto", upto).where(F.col("upto") > F.col("need"))
        return reached.groupBy("__site").agg(F.min(F.struct(F.col(at).alias("at"), (F.col("upto") - F.col("words")).alias("before"))).alias("b")).select(F.col("__site").alias("s"), "b.at", "b.before")

    runs = first_reached(bins.groupBy("__site", "run").agg(F.sum("words").alias("words"), F.first("need").alias("need"), F.first("start").alias("start")), "run")
    inside = bins.drop("start").join(runs.withColumnRenamed("before", "start"), F.expr("__site = s and run = at")).drop("s", "at")
    return first_reached(inside, "bin").withColumnRenamed("at", "bin")


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: its target, whole copies, scale of inclusion, and where its sample ends. rows: __site, __size, __class, __u."""
    sites = targets(rows, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    sites = sites.withColumn("whole", F.floor(ratio).cast("long")).withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    sites = cut(sites)
    sites = sites.join(inclusion(rows, sites), "__site", "left").select("__site", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.col("need").alias("__need"), F.col("scale").alias("__scale"))
    sites, rows = cut(sites), rows.select("__site", "__size", "__class", "__u")
    sure = _ranked(rows, sites).where("__p >= 1").groupBy("__site").agg(F.sum("__size").alias("__sure"))
    sites = cut(sites.join(sure, "__site", "left").withColumn("__need", F.greatest(F.lit(0.0), F.col("__need") - F.coalesce("__sure", F.lit(0)))).drop("__sure"))
    one = _boundary(_ranked(rows, sites).where("__p < 1").withColumn("__zero", F.lit(0).cast("long")), "__bin", "__zero")
    sites = cut(sites.join(one.select("s", F.col("bin").alias("__bin1"), F.col("before").alias("__before1")), F.expr("__site = s"), "left").drop("s"))
    two = _boundary(_ranked(rows, sites).where("__p < 1 and __bin = __bin1"), "__bin2", "__before1")
    return cut(sites.join(two.select("s", F.col("bin").alias("__end2"), F.col("before").alias("__before2")), F.expr("__site = s"), "left").drop("s"))


def mix(rows: DataFrame, sites: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows (as made by `sized`) with __source_size, __target and __copies, the number of times the mix takes each.

    Null and empty texts have no words and the measure of one word; they are taken as the shortest texts are. A null source is a
    source of its own and comes last; rows without an id are ranked by their texts. Rows of one id (or, without one, text) and size class have one rank; among
    them, and among ties, the id (nulls first), then the size decide. Repeated rows are documents of their own. An empty table
    gives no rows. Columns of rows may have any names that do not begin with two underscores.
    """
    got = _ranked(rows, sites)
    last = F.expr("__p < 1 and __need > 0 and __bin = __bin1 and __bin2 = __end2")
    first = F.expr("__p < 1 and __need > 0 and (__bin1 is null or __bin < __bin1 or (__bin = __bin1 and (__end2 is null or __bin2 < __end2)))")
    got = got.withColumn("__last", F.coalesce(last, F.lit(False))).withColumn("__first", F.coalesce(first, F.lit(False)))
    clear = got.where("not __last").withColumn("__copies", F.col("__certain") + F.when(F.col("__first"), 1).otherwise(0))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy("__site").orderBy("__q", id_col, "__size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = got.where("__last").withColumn("__middle", F.col("__before2") + before + F.col("__size") / 2).withColumn("__copies", F.col("__certain") + F.when(F.col("__middle") <= F.col("__need"), 1).otherwise(0)).drop("__middle")
    return clear.unionByName(edge).select(*rows.columns, "__source_size", "__target", "__copies")


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) per row of docs; see mix for the cases."""
    rows = cut(sized(docs.select(id_col, text_col, source_col), id_col, text_col, source_col).drop(text_col, source_col))
    return mix(rows, plan(rows, weights, share, most), id_col).select(F.col(id_col).alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"), F.col("__copies").alias("copies"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs, whatever their names."""
    docs, own = aside(docs, (id_col, text_col, source_col))
    rows = cut(sized(docs.select(id_col, text_col, source_col), id_col, text_col, source_col).select("__site", "__size", "__class", "__u"))
    out = mix(sized(docs, id_col, text_col, source_col), plan(rows, weights, share, most), id_col)
    return own(out.where("__copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1L, __copies)"))).drop("__copy"))
