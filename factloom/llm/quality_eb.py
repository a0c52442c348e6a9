"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on character and repetition statistics, fitted to labelled documents, gives each document's own
evidence of quality; a second one, on the words and word stems that mark toxic documents, its evidence of toxicity. A stem also
counts apart where a text makes two different words of it: any stem turns up by chance in a long text, but seldom twice. Those terms
are chosen from all terms of the labelled documents to cover the toxic ones with few, and weighed by their log-odds. The evidence of all documents is added up by host and by path; a Beta prior fitted by moments shrinks each host toward the global
mean, and each path toward its host, the more the fewer documents it has. A document's quality is its own log-odds
plus the log-odds by which its path departs from the global mean.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import append_columns, batch, cut, joined_by_site

#: At most so many labelled documents, by a hash of the id, are used to fit the document classifier.
LABELLED = 12_000
KEEP_QUALITY = 0.5
KEEP_TOXICITY = 0.5
#: A lexicon word's log-odds, two standard errors below the estimate, is at least so much.
LEXICON_ODDS = 1.0
#: Lengths of the stems that count as terms, beside whole words; and of those that count where two different words have them.
STEMS = (4, 5)
SHARED = (4, 5, 6, 7, 8)
_word = re.compile(r"\w+")


def terms(text: str | None) -> set[str]:
    """A text's words, the stems ("abcd*") of longer ones, and the stems ("abcd+") of two or more different longer ones."""
    words = set(_word.findall((text or "").lower()))
    found = set(words)
    for n in SHARED:
        stems = Counter(w[:n] for w in words if len(w) > n)
        found.update(s + "+" for s, k in stems.items() if k > 1)
        if n in STEMS:
            found.update(s + "*" for s in stems)
    return found


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of 128 ASCII bytes and of others, and repetition statistics of the whole text."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    x = np.zeros(136)
    if not len(data):
        return x
    h = np.bincount(data, minlength=256) / len(data)
    x[:128] = h[:128]
    x[128] = h[128:].sum()
    words, lines = text.split(), [l for l in text.split("\n") if l]
    n = max(1, len(words))
    x[129] = len(set(words)) / n
    x[130] = sum(map(str.__eq__, words, words[1:])) / n
    x[131] = 1 - len(set(lines)) / max(1, len(lines))
    x[132] = h[65:91].sum()
    x[133] = h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()
    x[:134] = np.sqrt(x[:134])
    x[134] = np.log1p(n)
    x[135] = np.log1p(len(text) / n)
    return x


class Logistic:
    """L2-regularised logistic regression by Newton steps; without both classes, a constant of even odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0):
        self.mean, self.sd = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.w = np.zeros(x.shape[1] + 1)
        if len(set(y.tolist())) < 2:
            return
        z = np.c_[(x - self.mean) / self.sd, np.ones(len(x))]
        ridge = np.full(z.shape[1], penalty)
        ridge[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.c_[(x - self.mean) / self.sd, np.ones(len(x))] @ self.w, -30, 30)


def cover(found: dict[str, float], hits: list[set[str]], toxic: list[bool]) -> dict[str, float]:
    """Greedily the terms that each add most toxic documents, less three times the others that they add; at least two.

    Terms that only go with chosen ones are left out: clean documents may have them too, as the other words of a toxic document
    that has copies.
    """
    yes: dict[str, set[int]] = {w: set() for w in found}
    no: dict[str, set[int]] = {w: set() for w in found}
    for i, (ws, t) in enumerate(zip(hits, toxic)):
        for w in ws:
            (yes if t else no)[w].add(i)
    chosen: dict[str, float] = {}
    seen: set[int] = set()
    wrong: set[int] = set()
    while yes:
        gain = {w: len(d - seen) - 3 * len(no[w] - wrong) for w, d in yes.items()}
        best = min(gain, key=lambda w: (-gain[w], w[-1] in "*+", w))
        if gain[best] < 2:
            break
        chosen[best] = found[best]
        seen |= yes.pop(best)
        wrong |= no[best]
        yes = {w: d for w, d in yes.items() if gain[w] >= 2}
    return chosen


class Model:
    def __init__(self, quality: Logistic, toxicity: Logistic, lexicon: dict[str, float]):
        self.quality, self.toxicity, self.lexicon, self.words = quality, toxicity, lexicon, frozenset(lexicon)
        self.stems: dict[int, set[str]] = {}
        for w in lexicon:
            if w[-1] in "*+":
                self.stems.setdefault(len(w) - 1, set()).add(w[:-1])

    def met(self, text: str | None) -> set[str]:
        """The terms of a text that are in the lexicon, without making all its terms."""
        words = set(_word.findall((text or "").lower()))
        found = words & self.words
        for n, stems in self.stems.items():
            k = Counter(w[:n] for w in words if len(w) > n and w[:n] in stems)
            found |= self.words & {s + "*" for s in k} | self.words & {s + "+" for s in k if k[s] > 1}
        return found

    def hits(self, text: str | None) -> list[float]:
        found = [self.lexicon[w] for w in sorted(self.met(text))]
        return [sum(found), max(found, default=0.0)]

    def evidence(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0), np.zeros(0)
        toxic = self.toxicity(np.array([self.hits(t) for t in texts])) if self.words else np.full(len(texts), -30.0)
        return self.quality(np.array([features(t) for t in texts])), toxic


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", bound: int = LABELLED) -> Model:
    """Of several labels of a document the strictest holds; null labels don't count. Of rows of one id the one with the smallest text
    hash is learned from, so that at most `bound` rows are."""
    some = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__label_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("__label_id"), "__label_id").limit(bound)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"q": pa.int32(), "t": pa.int32(), "x": pa.binary(), "words": pa.list_(pa.string())}
        for b in it:
            texts = b.column(0).to_pylist()
            yield batch({"q": b.column(1), "t": b.column(2), "x": [features(t).tobytes() for t in texts], "words": [sorted(terms(t)) for t in texts]}, types)

    # the labels are at most `bound` rows by the limit above
    rows = docs.select(F.col(id_col).alias("__doc_id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(some), F.expr("__doc_id = __label_id"))
    one = F.min(F.struct(F.xxhash64("__text").alias("h"), "__text"))["__text"]
    rows = rows.groupBy("__doc_id").agg(one.alias("__text"), F.first("quality").cast("int").alias("quality"), F.first("toxic").cast("int").alias("toxic")).select("__text", "quality", "toxic").mapInArrow(run, "q int, t int, x binary, words array<string>")
    rows = cut(rows)
    table = rows.select("q", "t", "x").toArrow().sort_by([("x", "ascending"), ("q", "ascending"), ("t", "ascending")])
    q, t = (np.array([np.nan if v is None else v for v in table[c].to_pylist()], float) for c in ("q", "t"))
    x = np.array([np.frombuffer(v) for v in table["x"].to_pylist()]).reshape(-1, 136)
    del table
    n_toxic, n_clean = int((t == 1).sum()), int((t == 0).sum())
    odds = F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("b") + 0.5) / (n_clean + 1))
    counted = rows.where("t is not null").select(F.explode("words").alias("word"), "t").groupBy("word").agg(F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("b")).where("a >= 4")
    low = odds - 2 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    found = {r.word: r for r in counted.select("word", odds.alias("odds"), low.alias("low")).where(F.col("low") >= LEXICON_ODDS).collect()} if n_toxic and n_clean else {}
    hits, toxic = [], []
    if found:
        candidates = frozenset(found)

        def among(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                yield batch({"t": b.column(0), "w": [[w for w in ws if w in candidates] for ws in b.column(1).to_pylist()]}, {"t": pa.int32(), "w": pa.list_(pa.string())})

        for b in rows.where("t is not null").select("t", "words").mapInArrow(among, "t int, w array<string>").toArrow().to_batches():
            for r in b.to_pylist():
                hits.append({sys.intern(w) for w in r["w"]})
                toxic.append(r["t"] == 1)
    lexicon = cover({w: r.odds for w, r in found.items()}, hits, toxic)
    known = ~np.isnan(q)
    quality = Logistic(x[known], q[known])
    toxicity = Logistic(np.zeros((0, 2)), np.zeros(0))
    if lexicon:
        kept = [[lexicon[w] for w in h if w in lexicon] for h in hits]
        toxicity = Logistic(np.array([[sum(k), max(k, default=0.0)] for k in kept]), np.array(toxic, float))
    return Model(quality, toxicity, lexicon)


def _evidence(df: DataFrame, model: Model, text_col: str) -> DataFrame:
    def f(texts: list) -> dict[str, list]:
        q, t = model.evidence(texts)
        return {"__q": q.tolist(), "__t": t.tolist()}

    return append_columns(df, text_col, f, {"__q": ("double", pa.float64()), "__t": ("double", pa.float64())})


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def _shrink(groups: DataFrame, prior: str, count: str, total: str) -> float:
    """Strength of the Beta prior, in documents, by moments: between-group variance beyond that of the groups' sizes."""
    r = groups.agg(F.sum(F.col(count) * (F.col(total) / F.col(count) - F.col(prior)) ** 2).alias("v"), F.sum(F.col(prior) * (1 - F.col(prior))).alias("s"), F.sum(F.col(count) * F.col(prior) * (1 - F.col(prior))).alias("m"), F.sum(count).alias("n")).first()
    if not r.n:
        return 1.0
    within, between = r.m / r.n, r.v / r.n - r.s / r.n
    return 1e6 if between <= within * 1e-6 else min(1e6, max(1.0, within / between - 1))


def posteriors(evidence: DataFrame, host: str = "__host", path: str = "__path") -> tuple[DataFrame, float]:
    """(host, path, host_quality, path_quality) by grouped sums of the documents' probabilities; and the global mean."""
    by_path = cut(evidence.groupBy(host, path).agg(F.count("*").alias("n"), F.sum(1 / (1 + F.exp(-F.col("__q")))).alias("p")))
    total = by_path.agg(F.sum("n").alias("n"), F.sum("p").alias("p")).first()
    mean = min(1 - 1e-6, max(1e-6, total.p / total.n)) if total.n else 0.5
    hosts = by_path.groupBy(host).agg(F.sum("n").alias("hn"), F.sum("p").alias("hp")).withColumn("prior", F.lit(mean))
    k = _shrink(hosts, "prior", "hn", "hp")
    hosts = hosts.select(F.col(host).alias("h"), ((k * mean + F.col("hp")) / (k + F.col("hn"))).alias("host_quality"))
    paths = joined_by_site(by_path, hosts, F.col(host).eqNullSafe(F.col("h")))
    k = _shrink(paths, "host_quality", "n", "p")
    return cut(paths.select(F.col(host).alias("h"), F.col(path).alias("u"), "host_quality", ((k * F.col("host_quality") + F.col("p")) / (k + F.col("n"))).alias("path_quality"))), mean


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """`columns` of docs (default: the id) and doc_quality, host_quality, path_quality, quality, toxicity (0 to 1), keep.

    Null and empty texts are classified by the statistics of an empty text. A null host or path is a site of its own. Without
    labels, or with labels of one class, the evidence is even odds and all is kept. Very long texts are read whole, one at a time.
    Repeated rows are scored each, and alike. A quality just at its threshold keeps a document, a toxicity just at its own rejects it. An empty
    table gives no rows. Columns of docs may have any names; ones named as the new ones are replaced.
    """
    model = fit(docs, labels, text_col, id_col)
    columns = columns or [id_col]
    inner = [f"c{i}" for i in range(len(columns))]
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, inner)], F.col(text_col).cast("string").alias("__text"), host.cast("string").alias("__host"), path.cast("string").alias("__path"))
    rows = cut(_evidence(named, model, "__text").drop("__text"))  # texts are read once; they go on only where they are among the columns
    sites, mean = posteriors(rows)
    both = joined_by_site(rows, sites, F.col("__host").eqNullSafe(F.col("h")) & F.col("__path").eqNullSafe(F.col("u")))
    odds = F.col("__q") + _logit(F.col("path_quality")) - _logit(F.lit(mean))
    made = {"doc_quality": 1 / (1 + F.exp(-F.col("__q"))), "host_quality": F.col("host_quality"), "path_quality": F.col("path_quality"), "quality": 1 / (1 + F.exp(-odds)), "toxicity": 1 / (1 + F.exp(-F.col("__t")))}
    out = both.select(*inner, *[c.alias(n) for n, c in made.items()])
    out = out.withColumn("keep", (F.col("quality") >= KEEP_QUALITY) & ((F.col("toxicity") < KEEP_TOXICITY) if model.words else F.lit(True)))
    return out.select(*[F.col(n).alias(c) for n, c in zip(inner, columns) if c not in (*made, "keep")], *made, "keep")
