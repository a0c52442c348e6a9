"""Term statistics that are written once and asked many times."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from . import retrieval as R
from .lineage import cut

#: Terms of a batch that become literals, by which buckets are pruned; more are joined. Slots that a term's postings are spread over.
LITERALS, SPREAD = 1000, 8
#: The term under which every page is listed, also one without terms: no word is empty.
PAGE = ""
_WORD, _STOP = re.compile(r"[a-z0-9][a-z0-9&/\-]*"), frozenset(T.STOP)


def _slot(term, n):
    return F.concat(term, F.lit("#"), n.cast("string"))


def _counted(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """(doc, page, length, term, tf) of lower-cased texts (doc, page, text): the terms of T.tokens, counted text by text."""
    for batch in batches:
        at, lengths, terms, tfs = [], [], [], []

        def made() -> pa.RecordBatch:
            keys = [batch.column(i).take(pa.array(at, pa.int64())) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*keys, pa.array(lengths, pa.int32()), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], ["doc", "page", "length", "term", "tf"])

        for i, text in enumerate(batch.column(2)):
            kept = {w: n for w, n in Counter(_WORD.findall(text.as_py())).items() if len(w) > 1 and w not in _STOP}
            length = sum(kept.values())
            kept[PAGE] = 1
            at += [i] * len(kept)
            lengths += [length] * len(kept)
            terms += kept.keys()
            tfs += kept.values()
            if len(at) >= rows:
                yield made()
                at, lengths, terms, tfs = [], [], [], []
        yield made()


def write(pages: DataFrame, folder: str, name: str, doc: str = "doc", page: str = "page", text: str = "text", buckets: int = 64) -> None:
    """Tokenise pages once, into table `name` below the folder: (slot, doc, page, length, term, tf), and each page under the empty term.

    Buckets go by slot, a term and a hash of the page, so that a term that most pages have is not one task's, and a bucket is as many files as make
    enough tasks; it is not sorted, since the writer would work out the bucket at each comparison. Terms are counted where a text is read, so postings are shuffled once; only those of pages listed twice meet again. Such a page is
    one page in the postings and two in n, as in retrieval.bm25. Null texts have no terms and the length of an empty one; rows without a document are left out.
    """
    known = pages.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    kinds = {c: known.schema[c].dataType.simpleString() for c in ("doc", "page")}
    count = lambda rows: rows.mapInArrow(_counted, f"doc {kinds['doc']}, page {kinds['page']}, length int, term string, tf bigint")
    twice = cut(known.groupBy(F.col("doc").alias("__doc"), F.col("page").alias("__page")).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n"))
    if twice.isEmpty():
        tf = count(known)
    else:
        on = (F.col("doc") == F.col("__doc")) & F.col("page").eqNullSafe(F.col("__page"))
        again = count(known.join(twice, on, "left_semi")).groupBy("doc", "page", "length", "term").agg(F.sum("tf").alias("tf"))
        tf = count(known.join(twice, on, "left_anti")).unionByName(again)
    files = buckets * -(-int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    whole = tf.withColumn("slot", _slot(F.col("term"), F.pmod(F.xxhash64("page"), F.lit(SPREAD))))
    whole.repartition(files, "slot").write.bucketBy(buckets, "slot").option("path", folder).saveAsTable(name)


def bm25(spark: SparkSession, name: str, terms: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, page, score, rank) of a batch of queries (query, term; repeats add up) over a written index, as retrieval.bm25 gives over pages.

    The terms of a batch prune buckets. Frequencies are counted from the postings of these terms, numbers and lengths of pages from the empty term's.
    A batch of more terms than become literals is joined instead.
    """
    weights = terms.groupBy("query", "term").agg(F.count("*").alias("times"))
    asked = [r[0] for r in weights.select("term").where("term is not null").distinct().limit(LITERALS + 1).collect()]
    slots = lambda words: F.col("slot").isin([f"{t}#{i}" for t in words for i in range(SPREAD)])
    corpus = spark.table(name).where(slots([PAGE])).groupBy("doc").agg(F.sum("tf").alias("n"), (F.sum(F.col("tf") * F.col("length")) / F.sum("tf")).alias("mean"))
    postings = spark.table(name).where(F.col("term") != PAGE)
    if len(asked) <= LITERALS:
        postings = postings.where(slots(asked))
        weights = F.broadcast(weights) if weights.count() <= 100 * LITERALS else weights
    else:
        postings = postings.join(weights.select("term").distinct(), "term", "left_semi")
    df = postings.groupBy("doc", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    met = postings.join(df, ["doc", "term"]).join(corpus, "doc").join(weights, "term").groupBy("query", "doc", "page").agg(F.sum(F.col("times") * one).alias("score")).where("score > 0")
    return R.top_k(met, ["query", "doc"], [F.desc("score"), F.col("page")], k)
