"""Masked pseudo-likelihood by a bidirectional window network.

The network predicts a token's class (one of the most frequent words, a class of the others by a hash of their ending, or a
boundary) from the classes left and right of it: two embeddings, one tanh layer, one softmax. Its training objective over the
whole corpus depends only on how often each (left, token, right) occurs, so those counts are gathered from all documents
by partial aggregation, and numpy fits the network to them by full-batch Adam. No sampling, and the same network for
any partitioning. A word's probability is its class's by the network times its own within the class, by the counts of all
words; these are a distributed table that grows with the corpus.

A document's score is the sum of its tokens' log-probabilities, each given both neighbours. What a text says counts, not how often it
is in the corpus: a copy adds to the counts of classes and words only, and counts within a class are smoothed. Texts are parted into words
once and written as numbers, which counts and scores read. Words are told apart by hashes of 64 bits. Frequent
ones are looked up where the text is read, a bounded number of them, all others joined, so no join has a hot key.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import batch, cut

FREQUENT = 95
CLASSES = 32
WIDTH = 24
EPOCHS = 200
#: Each task holds the log-probabilities of words that are at least one of so many tokens, so never more than that.
HELD = 1_000_000
#: Added to the count of each word of a class, so that a copy of a text with words of its own moves its score by little.
SMOOTH = 5.0
_token = re.compile(r"\w+|[^\w\s]")
_FLUSH = 400_000
_CHUNK = 200_000
#: With so few cells a task counts them in an array, else by sorting.
_DENSE = 1 << 22
#: Pairs that the fit takes at a time: their products stay in the cache, and are too small for the library to spread over threads that wait.
_ROWS = 64


def tokens(text: str | None) -> list[str]:
    return _token.findall((text or "").lower())


def word_hash(w: str) -> int:
    """As a signed number."""
    h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class Words(dict):
    """Numbers of the words that a task has met, and by number their hashes and the classes of their endings."""

    def __init__(self, classes: int):
        super().__init__()
        self.classes, self.hashes, self.ends = classes, array("q"), array("h")

    def __missing__(self, w: str) -> int:
        self[w] = i = len(self)
        self.hashes.append(word_hash(w))
        self.ends.append(ending(w, self.classes))
        return i


class Lexicon:
    """Classes of words, by hash: 0 is the boundary, then the frequent words, then classes of endings; and log-probabilities of held words."""

    def __init__(self, frequent: list[int], classes: int, held: tuple[np.ndarray, np.ndarray] | None = None):
        """held: sorted hashes of words, and their log-probabilities."""
        self.classes, self.held = classes, held or (np.zeros(0, np.int64), np.zeros(0))
        order = np.argsort(np.array(frequent, np.int64))
        self.frequent = np.array(frequent, np.int64)[order], order + 1.0
        self.size = 1 + len(frequent) + classes

    @staticmethod
    def _found(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
        """The table's value of each hash, or NaN."""
        keys, values = table
        if not len(keys):
            return np.full(len(hashes), np.nan)
        place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[place] == hashes, values[place], np.nan)

    def kinds(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        place = self._found(self.frequent, hashes)
        return np.where(np.isnan(place), ends + (self.size - self.classes), place).astype(np.int64)

    def kind(self, w: str) -> int:
        return int(self.kinds(np.array([word_hash(w)]), np.array([ending(w, self.classes)]))[0])

    def known(self, hashes: np.ndarray) -> np.ndarray:
        return self._found(self.held, hashes)


class Chunk:
    """The tokens of some texts one after the other, as numbers of the chunk's own words; doc: the text of each."""

    def __init__(self, lens: np.ndarray, words: np.ndarray, ends: np.ndarray, ids: np.ndarray):
        self.lens, self.words, self.ends, self.ids = lens, words, ends, ids
        self.doc = np.repeat(np.arange(len(lens)), lens)

    def beside(self, values: np.ndarray, step: int) -> np.ndarray:
        """The value `step` places on in the same text; 0 beyond its ends."""
        out = np.zeros_like(values)
        n = len(values) - abs(step)
        if n > 0:
            to, of = (slice(0, n), slice(step, None)) if step > 0 else (slice(-step, None), slice(0, n))
            out[to] = np.where(self.doc[to] == self.doc[of], values[of], 0)
        return out

    def cells(self, lexicon: Lexicon) -> np.ndarray:
        """(left * V + right) * V + token, by class."""
        kind, v = lexicon.kinds(self.words, self.ends)[self.ids], lexicon.size
        return (self.beside(kind, -1) * v + self.beside(kind, 1)) * v + kind


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES) -> DataFrame:
    """(docs, lens, words, ends, ids): the texts in chunks of a bounded number of tokens (but for a text that is longer by itself).

    docs: their ids; lens: their numbers of tokens; words, ends: hashes of the chunk's different words and classes of their endings; ids:
    the tokens as places among these words, of two bytes each if these do. So texts are parted into words once, whatever reads them after.
    """
    types = {"docs": pa.list_(pa.int64()), "lens": pa.binary(), "words": pa.binary(), "ends": pa.binary(), "ids": pa.binary()}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Words(classes)
        for b in it:
            ids, size, first = [], 0, 0
            for at, text in enumerate(b.column(1).to_pylist()):
                words = tokens(text)
                ids.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
                size += len(words)
                if size > _CHUNK or at == b.num_rows - 1:
                    of, met = np.concatenate(ids), np.zeros(len(seen), bool)
                    met[of] = True
                    some = np.flatnonzero(met)
                    own = (np.cumsum(met) - 1)[of].astype(np.uint16 if len(some) <= 1 << 16 else np.uint32)
                    arrays = np.array([len(x) for x in ids], np.int64), np.array(seen.hashes, np.int64)[some], np.array(seen.ends, np.int16)[some], own
                    yield batch({"docs": [b.column(0)[first : at + 1].to_pylist()]} | {n: [x.tobytes()] for n, x in zip(("lens", "words", "ends", "ids"), arrays)}, types)
                    ids, size, first = [], 0, at + 1
                    if len(seen) > _FLUSH:
                        seen = Words(classes)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "docs array<long>, lens binary, words binary, ends binary, ids binary")


def chunks(b: pa.RecordBatch) -> Iterator[Chunk]:
    """Of rows whose last four columns are lens, words, ends and ids."""
    for lens, words, ends, ids in zip(*b.columns[-4:]):
        words = np.frombuffer(words.as_buffer(), np.int64)
        yield Chunk(np.frombuffer(lens.as_buffer(), np.int64), words, np.frombuffer(ends.as_buffer(), np.int16), np.frombuffer(ids.as_buffer(), np.uint16 if len(words) <= 1 << 16 else np.uint32))


def ending(w: str, classes: int) -> int:
    return zlib.crc32(w[-2:].encode("utf-8", "surrogatepass")) % classes


class Sums:
    """Counts of equal rows of integer columns, added up in a bounded memory."""

    def __init__(self, columns: int):
        self.columns, self.parts, self.size = columns, [], 0

    def add(self, *columns: np.ndarray, n: np.ndarray | None = None) -> None:
        self.parts.append((*columns, np.ones(len(columns[0]), np.int64) if n is None else n))
        self.size += len(columns[0])
        if self.size > 4 * _FLUSH:
            self._merge()

    def _merge(self) -> None:
        if self.parts:
            *keys, n = (np.concatenate(c) for c in zip(*self.parts))
            order = np.lexsort(keys)
            keys, n = [k[order] for k in keys], n[order]
            new = np.ones(len(n), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            first = np.flatnonzero(new)
            self.parts = [(*[k[first] for k in keys], np.add.reduceat(n, first) if len(n) else n)]
            self.size = len(first)

    def batches(self, types: dict[str, pa.DataType], beyond: int = 0) -> Iterator[pa.RecordBatch]:
        """All rows, and forget them, if there are more than `beyond` different ones."""
        if self.size <= beyond:
            return
        self._merge()
        if self.size > beyond:
            for lo in range(0, self.size, 1 << 18):
                yield batch({n: pa.array(c[lo : lo + (1 << 18)], t) for (n, t), c in zip(types.items(), self.parts[0])}, types)
            self.parts, self.size = [], 0


def gather(texts: DataFrame) -> DataFrame:
    """(tok, kind, n): how often each word occurs in all coded texts, by its hash; kind: the class of its ending.

    Each task adds up what it can hold, so that a row goes to the shuffle about once a task however often it occurs.
    """
    types = {"kind": pa.int32(), "tok": pa.int64(), "n": pa.int64()}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(2)
        for b in it:
            for c in chunks(b):
                sums.add(c.ends.astype(np.int32), c.words, n=np.bincount(c.ids, minlength=len(c.words)))
                yield from sums.batches(types, 2 * _FLUSH)
        yield from sums.batches(types)

    return texts.select("lens", "words", "ends", "ids").mapInArrow(run, "kind int, tok long, n long").groupBy("tok", "kind").agg(F.sum("n").alias("n"))


def class_counts(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(cell, n): how often each (left, token, right) of classes occurs over all coded texts; cell = (left * V + right) * V + token."""
    types, v = {"cell": pa.int64(), "n": pa.int64()}, lexicon.size

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, small = Sums(1), np.zeros(v**3 if v**3 <= _DENSE else 0, np.int64)
        for b in it:
            for c in chunks(b):
                if len(small):
                    small += np.bincount(c.cells(lexicon), minlength=len(small))
                else:
                    sums.add(c.cells(lexicon))
                    yield from sums.batches(types, 2 * _FLUSH)
        some = np.flatnonzero(small)
        sums.add(some, n=small[some])
        yield from sums.batches(types)

    return texts.select("lens", "words", "ends", "ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


class Network:
    """P(token | left, right) = softmax(tanh(A[left] + B[right] + c) W + d)."""

    def __init__(self, v: int, width: int = WIDTH, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.v = v
        self.w = [rng.normal(0, 0.3, (v, width)), rng.normal(0, 0.3, (v, width)), np.zeros(width), rng.normal(0, 0.3, (width, v)), np.zeros(v)]

    def log_probs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, w, d = self.w
        hidden = np.tanh(a[left] + b[right] + c)
        z = hidden @ w + d
        z -= z.max(1, keepdims=True)
        return hidden, z - np.log(np.exp(z).sum(1, keepdims=True))

    def table(self) -> np.ndarray:
        """Log-probability of every cell."""
        left, right = np.divmod(np.arange(self.v**2), self.v)
        return self.log_probs(left, right)[1].astype(np.float32).ravel()

    def fit(self, cells: np.ndarray, n: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05) -> list[float]:
        """Full-batch Adam on the counts; returns the mean log-probability before each epoch."""
        if not len(cells):
            return []
        order = np.argsort(cells)
        cells, n = cells[order].astype(np.int64), n[order].astype(np.float64) / n.sum()
        pair, token = np.divmod(cells, self.v)
        pairs, at = np.unique(pair, return_index=True)
        bounds = np.append(at, len(pair))
        mass = np.add.reduceat(n, at)
        left, right = np.divmod(pairs, self.v)  # sorted by left
        by_right = np.argsort(right, kind="stable")
        (lefts, at_left), (rights, at_right) = np.unique(left, return_index=True), np.unique(right[by_right], return_index=True)
        blocks = []
        for lo in range(0, len(pairs), _ROWS):
            hi = min(lo + _ROWS, len(pairs))
            span = slice(bounds[lo], bounds[hi])
            blocks.append((slice(lo, hi), np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1])) * self.v + token[span], n[span]))
        m, s, seen = [np.zeros_like(x) for x in self.w], [np.zeros_like(x) for x in self.w], []
        self.w[4] = np.log(np.bincount(token, n, self.v) + 1e-6)
        for epoch in range(1, epochs + 1):
            grads, total = [np.zeros_like(x) for x in self.w], 0.0
            hiddens = np.tanh(self.w[0][left] + self.w[1][right] + self.w[2])
            back = np.empty_like(hiddens)
            for rows, at, share in blocks:
                hidden = hiddens[rows]
                z = hidden @ self.w[3] + self.w[4]
                z -= z.max(1, keepdims=True)
                g = np.exp(z)
                whole = g.sum(1, keepdims=True)
                total += float(share @ z.ravel()[at]) - float(mass[rows] @ np.log(whole[:, 0]))
                g *= mass[rows, None] / whole
                g.ravel()[at] -= share
                back[rows] = g @ self.w[3].T
                grads[3] += hidden.T @ g
                grads[4] += g.sum(0)
            back *= 1 - hiddens**2
            grads[0][lefts], grads[1][rights] = np.add.reduceat(back, at_left), np.add.reduceat(back[by_right], at_right)
            grads[2] += back.sum(0)
            seen.append(total)
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.99 * s[i] + 0.01 * g**2
                self.w[i] = self.w[i] - rate * (1 - epoch / (epochs + 1)) * (m[i] / (1 - 0.9**epoch)) / (np.sqrt(s[i] / (1 - 0.99**epoch)) + 1e-10)
        return seen


class Model:
    """The network, its lexicon (with the log-probabilities of words that are held) and the other words' log-probabilities within their classes."""

    def __init__(self, texts: DataFrame, frequent: int, classes: int, epochs: int, held: int):
        words = cut(gather(texts))
        top = [r.tok for r in words.orderBy(F.desc("n"), "tok").limit(frequent).collect()]
        lexicon = Lexicon(top, classes)
        got = class_counts(texts, lexicon).toArrow()  # at most V^3 rows of 16 bytes
        cells, n = got["cell"].to_numpy(), got["n"].to_numpy()
        self.network = Network(lexicon.size)
        self.network.fit(cells, n, epochs)
        occurs = np.bincount(cells % lexicon.size, n, lexicon.size)
        of_ending = F.col("kind") + 1 + len(top)
        kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, h in enumerate(top) for x in (h, i + 1)]), F.col("tok")), of_ending) if top else of_ending
        different = {r["at"]: r["count"] for r in words.groupBy(kind.alias("at")).count().collect()}  # one row a class
        whole = F.element_at(F.array(*[F.lit(float(x) + SMOOTH * different.get(i, 0) or 1.0) for i, x in enumerate(occurs)]), kind + 1)
        own_words, often = words.select("tok", "n", F.log((F.col("n") + SMOOTH) / whole).alias("own")), F.col("n") * float(held) >= float(occurs.sum())
        known = own_words.where(often).select("tok", "own").toArrow().sort_by("tok")  # at most `held` rows of 16 bytes
        self.lexicon = Lexicon(top, classes, (known["tok"].to_numpy(), known["own"].to_numpy()))
        self.others = own_words.where(~often).select("tok", "own")


def train(texts: DataFrame, frequent: int = FREQUENT, classes: int = CLASSES, epochs: int = EPOCHS, held: int = HELD) -> Model:
    """Of coded texts, which are read twice."""
    return Model(texts, frequent, classes, epochs, held)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, classes: int = CLASSES, epochs: int = EPOCHS, held: int = HELD) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_prob) per row of docs, by a model of all of docs.

    Null or empty text, or one without tokens: 0 tokens, log-likelihood 0, mean null. A very long text is read whole, in one
    chunk of its own. Repeated rows are counted and scored each. A null id stays null. Ties among frequent words go by the
    word's hash. Empty table: no rows. Other columns are ignored.
    """
    texts = cut(coded(docs, id_col, text_col, classes))
    model = train(texts, frequent, classes, epochs, held)
    lexicon, network, table = model.lexicon, model.network, []
    types = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "part": pa.float64(), "others": pa.list_(pa.int64())}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not table:
            table.append(network.table())
        for b in it:
            for ids, c in zip(b.column(0), chunks(b)):
                own = lexicon.known(c.words)[c.ids]
                strange = np.isnan(own)
                log = table[0][c.cells(lexicon)].astype(np.float64) + np.where(strange, 0.0, own)
                ends = np.cumsum(np.bincount(c.doc[strange], minlength=len(c.lens)))
                others = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(c.words[c.ids[strange]]))
                yield batch({"doc_id": ids.values, "n_tokens": c.lens, "part": np.bincount(c.doc, log, len(c.lens)), "others": others}, types)

    seen = texts.mapInArrow(run, "doc_id long, n_tokens long, part double, others array<long>")
    seen = cut(seen.withColumn("row", F.monotonically_increasing_id()))  # numbered once, in what is written
    rest = seen.select("row", F.explode("others").alias("tok")).join(model.others, "tok").groupBy("row").agg(F.sum("own").alias("own"))
    out = seen.drop("others").join(rest, "row", "left").withColumn("log_likelihood", F.col("part") + F.coalesce("own", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "log_likelihood", F.expr("if(n_tokens > 0, log_likelihood / n_tokens, null)").alias("mean_log_prob"))
