"""Encoding with a merging (BPE) sentencepiece model, and decoding.

Merges of symbols define an encoding in which every prefix of a text has one last token, whatever follows. So a table over the
prefixes is enough: an automaton reports the pieces that end at a place, and the one is kept that is compatible with the
last token of the prefix in front of it, which means that the two merge to just these two. The ids are then read
backwards from the end. Time and memory are linear in the text, and no merge is carried out.

Normalization and decoding are the library's own. No piece holds a symbol that is followed by the mark of a space, nor
a character outside the model's alphabet (both are read from the vocabulary), so texts part there, and a part that occurs
again is looked up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
#: Parts that a task remembers (twice as many: those of late and those before), and pairs; beyond, it begins anew. Longer parts are not remembered.
PARTS, PAIRS, LONG = 250_000, 500_000, 48
#: Characters after which a task hands on what it has.
FLUSH = 2_000_000


class Pieces:
    """The tables of one model. Pieces are merged by falling score, equal ones from the left; characters are there from the start."""

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        ids = range(self.size)
        self.bytes = [i for i in ids if m.is_byte(i)]
        if len(self.bytes) != 256:
            raise ValueError("the model has to fall back to bytes")
        self.text = {i: m.id_to_piece(i) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        alphabet = sorted(set("".join(self.text.values())) - {SPACE})
        self.ids = {t: i for i, t in self.text.items()}
        for c in (*alphabet, SPACE):  # a character that only occurs within pieces is a symbol too, written in bytes if left alone
            if c not in self.ids:
                self.ids[c] = self.size + len(self.ids)
                self.text[self.ids[c]] = c
        place = {s: n for n, s in enumerate(sorted({m.get_score(i) for i in self.text if i < self.size}, reverse=True))}
        #: A token's rank: the lower, the earlier it is merged; -1 for characters.
        self.rank = {i: -1 if len(t) == 1 else place[m.get_score(i)] for i, t in self.text.items()}
        self.halves, self.odd, self.count = {}, set(), 0
        #: By token: whether it stands apart from a token in front of it, as far as that has been asked; -1 is the beginning of a text.
        self.fits: dict[int, dict[int, bool]] = {}
        for i, t in self.text.items():
            if len(t) > 1:
                made = self.merged(t, 2)
                if len(made) != 2 or self.ids.get(self.text[made[0]] + self.text[made[1]]) != i or self.merged(t) != [i]:
                    continue  # no merges lead to this piece
                self.halves[i] = tuple(made)
                if max(self.rank[made[0]], self.rank[made[1]]) >= self.rank[i] or made[0] in self.odd or made[1] in self.odd:
                    self.odd.add(i)  # merged before its halves would be: ranks do not tell when
            self.fits[i] = {-1: True}
        self._automaton()
        within = "".join(map(re.escape, alphabet))
        free = any(b == SPACE != a for t in self.text.values() for a, b in zip(t, t[1:]))
        self.parts = re.compile(f"[{within}{SPACE}]+|[^{within}{SPACE}]+" if free else f"{SPACE}*[{within}]+|{SPACE}+|[^{within}{SPACE}]+")
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str, until: int = 1) -> list[int]:
        """The definition, for the short texts of the tables: merge the pair of lowest rank, the leftmost, until none is left or `until` tokens are."""
        now = [self.ids[c] for c in text]
        while len(now) > until:
            found = [(self.rank[t], k, t) for k in range(len(now) - 1) if (t := self.ids.get(self.text[now[k]] + self.text[now[k + 1]])) is not None]
            if not found:
                break
            _, k, t = min(found)
            now[k : k + 2] = [t]
        return now

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, stay apart: no merge over their border comes before those that made them.

        What stands left of the border grows to a, each time by a merge whose right half it was; what stands right of it grows to b. Going back through both
        by the later merge first, a merge over the border is in the way if its rank is lower than that of the merge
        that ended the left symbol, or not higher than that of the one that ended the right symbol (from the left first).
        """
        if a in self.odd or b in self.odd:
            return self.merged(self.text[a] + self.text[b]) == [a, b]
        ends_a = ends_b = float("inf")
        while True:
            across = self.ids.get(self.text[a] + self.text[b])
            if across is not None and self.rank[across] < ends_a and self.rank[across] <= ends_b:
                return False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                ends_a, a = self.rank[a], self.halves[a][1]
            else:  # of one rank the left one is merged first, so the right one is undone first
                ends_b, b = self.rank[b], self.halves[b][0]

    def _automaton(self) -> None:
        """Of the tokens: next states by character, the state to fall back to, and the tokens that end in a state, longest first."""
        self.next, self.back, self.ends = [{}], [0], [[]]
        for i in self.fits:
            state = 0
            for c in self.text[i]:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({}), self.back.append(0), self.ends.append([])
                state = self.next[state][c]
            self.ends[state].append((i, len(self.text[i]), self.fits[i]))
        level = list(self.next[0].values())
        while level:
            for state in level:
                self.ends[state] += self.ends[self.back[state]]
                for c, below in self.next[state].items():
                    at = self.back[state]
                    while at and c not in self.next[at]:
                        at = self.back[at]
                    self.back[below] = self.next[at].get(c, 0)
            level = [below for state in level for below in self.next[state].values()]

    def _asked(self, a: int, b: int) -> bool:
        self.count += 1
        if self.count > PAIRS:
            for known in self.fits.values():
                known.clear()
                known[-1] = True
            self.count = 1
        self.fits[b][a] = got = self._compatible(a, b)
        return got

    def table(self, part: str) -> list[int]:
        """Ids of a part of the alphabet: each prefix's last token, then back from the end."""
        following, back, ends, last, state = self.next, self.back, self.ends, [-1], 0
        for at, c in enumerate(part, 1):
            while (found := following[state].get(c)) is None:
                state = back[state]
            state = found
            for token, n, fits in ends[state]:
                before = last[at - n]
                fit = fits.get(before)
                if fit or (fit is None and self._asked(before, token)):
                    break
            last.append(token)
        out, at = [], len(part)
        while at:
            token = last[at]
            if token < self.size:
                out.append(token)
                at -= len(self.text[token])
            else:
                out.extend(self.bytes[x] for x in reversed(part[at - 1].encode()))
                at -= 1
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.parts.findall(self.model.normalize(text)):
            got = self.known.get(part)
            if got is None:
                got = self.before.get(part)
                if got is None:
                    got = tuple(self.table(part)) if part[0] in self.ids else tuple(self.bytes[x] for x in part.encode())
                if len(part) <= LONG:
                    if len(self.known) >= PARTS:
                        self.before, self.known = self.known, {}
                    self.known[part] = got
            out += got
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _appended(df: DataFrame, of: str, types: dict[str, tuple[str, pa.DataType]], code: Callable, weight: Callable) -> DataFrame:
    """df and new columns, code(value) -> their values, handed on whenever the weights of what is made add up to FLUSH."""
    inner, place = [f"c{i}" for i in range(len(df.columns))], df.columns.index(of)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            row, begin, made, held = b.column(0), 0, [], 0
            values = row.field(place)
            for i in range(len(row)):
                value = values[i].as_py()
                made.append(code(value))
                held += weight(value)
                if held >= FLUSH or i + 1 == len(row):
                    new = [pa.array(c, t) for c, (_, t) in zip(zip(*made), types.values())]
                    yield pa.RecordBatch.from_arrays([row.slice(begin, len(made)), *new], ["__row", *types])
                    begin, made, held = i + 1, [], 0

    renamed = df.toDF(*inner)
    schema = f"__row {renamed.schema.simpleString()}, " + ", ".join(f"`{n}` {t}" for n, (t, _) in types.items())
    kept = [F.col(f"__row.{i}").alias(c) for i, c in zip(inner, df.columns) if c not in types]
    return renamed.select(F.struct(*inner).alias("__row")).mapInArrow(run, schema).select(*kept, *types)


IDS, TEXT = ("array<int>", pa.list_(pa.int32())), ("string", pa.string())


def encode(docs: DataFrame, path: str, text_col: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of the whole text, without begin or end, and, if named, the text that the library makes of them again.

    path: a sentencepiece model of merges with bytes to fall back to (one without them is refused), which every executor can read.
    A null text is an empty one and has no ids. Texts may be of any length; time grows linearly. Repeated rows are encoded each; equal
    scores merge from the left; no rows give none. Columns of docs may have any names; new ones replace those of theirs.
    """
    types = {ids: IDS} | ({decoded: TEXT} if decoded else {})

    def code(text: str | None) -> tuple:
        p = pieces(path)
        found = p.encode(text or "")
        return (found, p.model.decode(found)) if decoded else (found,)

    return _appended(docs, text_col, types, code, lambda t: len(t or ""))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text of the ids as the library decodes them; null for null, empty for none. Other columns stay, whatever their names."""
    return _appended(df, ids, {decoded: TEXT}, lambda v: (None if v is None else pieces(path).model.decode(v),), lambda v: 4 * len(v or ()))
