"""Which of many phrases or figures stand in which of many texts, without a product of the two.

A phrase that stands in a text brings its inner words there as whole words, a short one its characters in runs; a
figure brings its digits in runs. Each needle is looked up by one such key, the one that the fewest texts hold, and only
texts with that key are searched for it. The keys that texts hold are found in one reading; those that no needle has
are dropped before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers as N, text as T
from . import retrieval as R
from .lineage import cut, same_keys

#: Longest run of characters that a short phrase is looked up by, longest run of digits for a figure.
RUN, DIGITS = 5, 6
#: Keys of needles that are sent to all tasks at most; more are joined by a shuffle.
BOUND = 500_000
#: Keys of texts that a task hands on at a time.
BATCH = 100_000


def runs(needle: Column, n: int) -> Column:
    """All runs of n characters (code points, as in text_keys)."""
    last = F.length(needle) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(needle, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def phrase_keys(needle: Column) -> Column:
    """Inner words of a normal phrase of three words or more; else its runs of RUN characters (of all, if it is shorter)."""
    words = F.split(needle, " ")
    sizes = F.least(F.length(needle), F.lit(RUN))
    short = F.coalesce(*[F.when(sizes == n, F.transform(runs(needle, n), lambda r: F.concat(F.lit(f"{n}:"), r))) for n in range(1, RUN + 1)])
    inner = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.concat(F.lit("w:"), w))
    return F.array_distinct(F.when(F.size(words) >= 3, inner).otherwise(short))


def digit_keys(needle: Column) -> Column:
    """Runs of DIGITS digits of a figure, or the whole of a shorter one."""
    return F.array_distinct(F.coalesce(*[F.when(F.least(F.length(needle), F.lit(DIGITS)) == n, F.transform(runs(needle, n), lambda r: F.concat(F.lit(f"{n}:"), r))) for n in range(1, DIGITS + 1)]))


def _mixed(characters: list[np.ndarray]) -> np.ndarray:
    """A number of 20 bits for each run, given the first, second, ... characters of all runs; runs that are equal have equal ones."""
    h = characters[0]
    for c in characters[1:]:
        h = h * np.uint64(0x9E3779B97F4A7C15) + c
    return (h * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(44)


def _codes(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def text_keys(kinds: list[str], asked: list[str] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The keys of texts, each once for a text, of the kinds that needles have: w for whole words, a number for runs of so many characters. Batches (keys, text) become (keys, key).

    If the keys that needles have are given, others are left out where they are read: runs by a table of bits first, then by themselves.
    """
    known = {k: {a.split(":", 1)[1] for a in asked or [] if a.startswith(f"{k}:")} for k in kinds}

    def of(t: str, bits: dict[str, np.ndarray]) -> list[str]:
        found, codes = [], None if asked is None else _codes(t)
        for k in kinds:
            if k == "w":
                parts = set(t.split(" "))
            else:
                n = int(k)
                at = range(len(t) - n + 1) if asked is None else np.flatnonzero(bits[k][_mixed([codes[i : len(codes) - n + 1 + i] for i in range(n)])]).tolist() if len(codes) >= n else ()
                parts = {t[i : i + n] for i in at}
            found += [f"{k}:{x}" for x in (parts if asked is None else parts & known[k])]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {k: np.zeros(1 << 20, bool) for k in kinds if k != "w"}
        for k in bits:
            if known[k]:
                bits[k][_mixed(list(_codes("".join(known[k])).reshape(-1, int(k)).T))] = True
        for batch in batches:
            at, keys = [], []

            def made(at=at, keys=keys, batch=batch):
                rows = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns[:-1]], pa.array(keys, pa.string())], [*batch.schema.names[:-1], "key"])

            for i, t in enumerate(batch.column(batch.num_columns - 1)):
                if t.is_valid and (found := of(t.as_py(), bits)):
                    at += [i] * len(found)
                    keys += found
                if len(keys) >= BATCH:
                    yield made()
                    at.clear(), keys.clear()
            yield made()

    return run


def candidates(needles: DataFrame, texts: DataFrame, keys: list[str], needle_keys: Column, text: str = "text") -> DataFrame:
    """(needle, keys): texts that hold the needle's rarest key, of equally rare ones the first. A needle with a key that no text holds has none.

    needles: needle, each once. How many kinds of keys there are is looked up (six at most); up to BOUND keys are sent to all tasks, nothing else reaches the driver.
    """
    wanted = cut(needles.select("needle", F.explode(needle_keys).alias("key")))
    asked = wanted.select("key").distinct()
    kinds = sorted(r[0] for r in wanted.select(F.split("key", ":")[0]).distinct().collect())
    if not kinds:
        return texts.where("false").select(F.lit("").alias("needle"), *keys)
    read = texts.select(*keys, F.col(text).alias("key"))
    if asked.count() <= BOUND:
        held = cut(read.mapInArrow(text_keys(kinds, [r[0] for r in asked.collect()]), read.schema))
    else:
        held = cut(read.mapInArrow(text_keys(kinds), read.schema).join(asked, "key"))
    found = wanted.join(held.groupBy("key").agg(F.count("*").alias("n")), "key", "left")
    # a key of no text counts as none, so it is the rarest one and finds nothing
    rarest = found.groupBy("needle").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    rarest = F.broadcast(rarest) if needles.count() <= BOUND else rarest
    return held.join(rarest, "key").select("needle", *keys).distinct()


def contained(needles: DataFrame, texts: DataFrame, keys: list[str], needle_keys: Column, text: str = "text") -> DataFrame:
    """(needle, and the columns of texts but the text): every text that a needle stands in. Keys of texts may be null or repeat; a repeated row is found once for each."""
    return searched(candidates(needles, texts, keys, needle_keys, text), texts, keys, text)


def searched(found: DataFrame, texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Of candidates those that stand in their text, as contained gives them."""
    met = same_keys(texts, found, keys).where(F.col(text).contains(F.col("needle")))
    return met.select("needle", *[c for c in texts.columns if c != text])


def contained_phrases(aliases: DataFrame, pages: DataFrame, keys: list[str], alias: str = "alias", text: str = "text") -> DataFrame:
    """(needle, keys, other columns of pages): normal form of every alias and the pages whose normal text it is a part of. Empty and null ones find nothing."""
    needles = aliases.select(T.normal(F.col(alias)).alias("needle")).where("needle <> ''").distinct()
    return contained(needles, pages.withColumn(text, T.normal(F.col(text))), keys, phrase_keys(F.col("needle")), text)


def figures(values: DataFrame, value: str, least: int = 3) -> DataFrame:
    """(needle): digits of the values that have at least so many, each once."""
    return values.select(N.digits(F.col(value)).alias("needle")).where(F.length("needle") >= least).distinct()


def contained_figures(values: DataFrame, pages: DataFrame, keys: list[str], value: str = "value", text: str = "text", least: int = 3) -> DataFrame:
    """(needle, keys, other columns of pages): digits of every value of at least so many, and the pages in whose digits they stand in a row."""
    return contained(figures(values, value, least), pages.withColumn(text, N.digits(F.col(text))), keys, digit_keys(F.col("needle")), text)


def locate(concepts: DataFrame, pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", k: int = 5) -> DataFrame:
    """(concept, doc, page, score, rank): the best k pages of each concept in each document, by the alias score, for a whole table of concepts.

    pages: each number of a document once. concepts: concept, aliases (array of strings), location_hint, column_hint; a concept listed twice counts twice what it has twice. The
    score is that of retrieval.alias_score: aliases found, 0.6 for each hint word, number density, 0.5 for each column word, less 3 for income items on
    a cash-flow page; a page needs an alias or two hint words. Pages of equal score go by number.
    """
    hint = F.lower(F.coalesce("location_hint", F.lit("")))
    words = F.filter(F.regexp_extract_all(T.normal(F.coalesce("column_hint", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 3)
    kinds = {"a": F.transform("aliases", T.normal), "h": T.hint_terms(F.col("location_hint")), "c": words}
    listed = F.flatten(F.array(*[F.transform(v, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("needle"))) for kind, v in kinds.items()]))
    asked = concepts.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).select("concept", F.explode(listed).alias("x")).select("concept", "x.*").where("needle <> ''")
    asked = cut(asked.groupBy("concept", "kind", "needle").agg(F.count("*").alias("times")))
    income = concepts.select("concept", (~hint.contains("cash flow") & (hint.contains("p&l") | hint.contains("profit and loss") | hint.contains("expense") | hint.contains("finance cost"))).alias("income")).distinct()
    normal = pages.select(doc, page, T.normal(F.col(text)).alias(text), R.numeric_density(F.col(text)).alias("density"))
    found = contained(asked.select("needle").distinct(), normal.withColumn("cash", F.col(text).contains("cash flow from operating activities")), [doc, page], phrase_keys(F.col("needle")), text)
    met = found.join(asked, "needle").groupBy("concept", doc, page, "density", "cash").agg(*[F.sum(F.when(F.col("kind") == kind, F.col("times")).otherwise(0)).alias(kind) for kind in kinds])
    score = F.col("a") + 0.6 * F.col("h") + F.col("density") + 0.5 * F.col("c") - F.when(F.col("income") & F.col("cash"), 3.0).otherwise(0.0)
    scored = met.where("a > 0 or h >= 2").join(income, "concept").withColumn("score", score)
    return R.top_k(scored, ["concept", doc], [F.desc("score"), F.col(page)], k).select("concept", doc, page, "score", "rank")
