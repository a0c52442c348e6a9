"""Language identification by hierarchical discrimination.

A linear support vector machine (one per pair of families, by vote) predicts the language family; within it, one
machine for each pair of languages votes for the language. Features are square roots of the shares of hashed byte
trigrams of the whole, lower-cased text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import append_columns, batch, joined_by_site

UNKNOWN = "und"
DIM = 4096
#: At most so many documents of each language, by a hash of the id and of the text, are learned from, and of all languages together.
PER_LANGUAGE = 800
LEARNED = 16_000
# The families of languages. A language not named here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indo-aryan": ["hi", "ur", "bn", "mr", "pa", "gu", "ne"],
    "sinitic": ["zh", "yue"],
    "celtic": ["ga", "cy", "gd", "br"],
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_alnum = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Has a character of Unicode's letters (categories L*); fractions, powers and numbers in circles are none."""
    return bool(text) and any(m.group().isalpha() for m in _alnum.finditer(text))


def features(text: str) -> np.ndarray:
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
    return np.sqrt(np.bincount(h, minlength=DIM) / len(h)).astype(np.float32)


def linear_svm(x: np.ndarray, on: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 150) -> np.ndarray:
    """Weights and bias of an L2-regularised squared-hinge machine on the rows `on` of x (y: +1, -1, of those), by accelerated gradient steps."""
    z = np.ones((len(y), x.shape[1] + 1), np.float32)  # the only float32 copy of the rows: the driver's memory is small
    for to, row in enumerate(np.flatnonzero(on)):
        z[to, :-1] = x[row]
    w = last = np.zeros(z.shape[1])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    rate = 1 / (1 + 2 * weight.sum() * 2)
    for k in range(steps):
        v = w + (k / (k + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (z @ v.astype(np.float32)))
        last, w = w, v - rate * (v - 2 * (z.T @ (weight * y * slack).astype(np.float32)))
    return w


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        self.languages = sorted(set(langs))
        y = np.array(langs)
        family = np.array([_FAMILY.get(l, l) for l in langs])
        self.families = {f: sorted(set(y[family == f].tolist())) for f in sorted(set(family.tolist()))}
        self.first = self._pairs(x, family, list(self.families))
        self.within = {f: self._pairs(x[family == f], y[family == f], ls) for f, ls in self.families.items()}

    @staticmethod
    def _pairs(x: np.ndarray, y: np.ndarray, names: list[str]) -> dict[tuple[str, str], np.ndarray]:
        return {(a, b): linear_svm(x, on := (y == a) | (y == b), np.where(y[on] == a, 1.0, -1.0)) for a, b in combinations(names, 2)}

    @staticmethod
    def _vote(x: np.ndarray, names: list[str], machines: dict) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        votes, margins = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for (a, b), w in machines.items():
            m = float(x @ w[:-1] + w[-1])
            votes[a if m >= 0 else b] += 1
            margins[a] += m
            margins[b] -= m
        best = max(names, key=lambda n: (votes[n], margins[n]))
        return best, 1 / (1 + float(np.exp(-4 * max(-7.0, margins[best] / (len(names) - 1)))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0
        x = features(text)
        family, p = self._vote(x, list(self.families), self.first)
        lang, q = self._vote(x, self.families[family], self.within[family])
        return lang, p * q


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, learned: int = LEARNED) -> Model:
    """Learn from documents with a language whose crc32(id as text) mod 3 is not 1 (a null id has no such remainder).

    Rows of one id and text count once; so at most `per_language` rows of a language, and about `learned` of all, reach the driver.
    """
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), F.col(lang_col).cast("string").alias("__lang"))
    known = docs.where((F.crc32(F.col("__id").cast("string")) % 3 != 1) & F.col("__lang").isNotNull() & F.col("__text").isNotNull())
    known = known.withColumn("__hash", F.xxhash64("__id", "__text"))
    counts = known.groupBy(F.col("__lang").alias("l")).agg(F.count("*").alias("n"))
    each = max(1, min(per_language, learned // max(1, counts.count())))
    # a share of the hashes that about twice as many documents of the language have, so that no task ranks more than those
    shares = counts.select("l", (F.lit(2.0 * each) / F.col("n")).alias("share"))
    near = joined_by_site(known.select("__lang", "__hash"), shares, F.expr("__lang = l")).where((F.shiftrightunsigned("__hash", 33) / 2.0**31 < F.col("share"))).select("__lang", "__hash").distinct()
    picked = near.withColumn("__n", F.row_number().over(Window.partitionBy("__lang").orderBy("__hash"))).where(F.col("__n") <= each).select(F.col("__lang").alias("l"), F.col("__hash").alias("h"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keep = [(t, l) for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if has_letter(t)]
            yield batch({"x": [features(t).astype(np.float16).tobytes() for t, _ in keep], "lang": [l for _, l in keep]}, {"x": pa.binary(), "lang": pa.string()})

    # `picked` has at most `each` rows for each language; equal rows meet before they are sent
    some = known.join(F.broadcast(picked), F.expr("__lang = l and __hash = h"), "left_semi").groupBy("__lang", "__hash").agg(F.first("__text").alias("__text"))
    rows = some.select("__text", "__lang").mapInArrow(run, "x binary, lang string").toArrow()
    order = pc.sort_indices(rows, [("lang", "ascending"), ("x", "ascending")])
    langs, x = rows["lang"].take(order).to_pylist(), np.empty((len(rows), DIM), np.float16)
    for to, at in enumerate(order.to_numpy()):
        x[to] = np.frombuffer(rows["x"][at].as_buffer(), np.float16)
    del rows
    pa.default_memory_pool().release_unused()
    return Model(x, langs)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1): `und` and 0 for a null text, one without letters, or a model without languages.

    Repeated rows are predicted each. An empty table gives no rows. docs may have any columns; ones named lang_pred or score are replaced.
    """

    def f(texts: list) -> dict[str, list]:
        got = [model.predict(t) for t in texts]
        return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return append_columns(docs, text_col, f, {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64())})
