"""The filter audit, the coding with pieces and the manifest against plain Python, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import public_tokenizers
import pytest
import sentencepiece

from factloom.llm import filter_audit, merkle_manifest, piece_coding, queries as Q
from factloom.llm.common import read
from oracle import SF

PATH = public_tokenizers.path(Q.PIECES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, tree string, ids long, decoded int, n long, E string, path string"
CLASH = ("p", "t", 1, 2, 3, "e", "x")


@pytest.fixture(scope="module")
def odd(spark):
    long = "The Quick  brown fox, l'été à 北京 👍\r\n" * 20_000
    copies = [(100 + i, "one text of which there are many copies", "en", "hot", 39) for i in range(40)]
    data = [(1, None, None, None, None), (2, "", "en", "s1", 0), (3, "   \n", None, "s1", 4), (4, long, "en", "s2", None), (5, "SHOUT # " * 30, "fr", None, 1), (5, "SHOUT # " * 30, "fr", None, 1), (5, "shout " * 60, "fr", "", 1)]
    data += [(None, "no id here", "en", "s1", 10), (None, "no id here", "en", "s1", 10), (None, "one text of which there are many copies", None, "hot", 39), (-7, " ".join(f"w{i}" for i in range(80)), "de", "s1", 3), (12, "Ab " * 9, "DE", "s1", 3), *copies]
    return spark.createDataFrame([(*r, *CLASH) for r in data], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def failing(docs):
    out = []
    for i, text, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [d[0] for d in docs if (d[1] or "") == text and d[0] is not None]
        out.append("".join(c for c, bad in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and min(same) < i)) if bad))
    return out


def test_audit_by_walking_every_order(spark, odd):
    labels = [(1, 1, 0), (5, 0, 1), (5, 1, None), (100, 1, 1), (117, 1, 1), (None, 1, 1), (2, None, 1), (999, 1, 1)]
    got = filter_audit.audit(filter_audit.failures(odd, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, source string")))
    docs = [(r.doc_id, r.text, r.source or "") for r in odd.collect()]
    bad, good, toxic = failing(docs), {a for a, q, _ in labels if q == 1 and a}, {a for a, _, t in labels if t == 1 and a}
    want = {}
    for part in {d[2] for d in docs}:
        here = [(d, b) for d, b in zip(docs, bad) if d[2] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = here
            for k, c in enumerate(order):
                gone = [x for x in alive if c in x[1]]
                alive = [x for x in alive if c not in x[1]]
                shapley[c] += len(gone)
                want[part, "".join(order), k + 1] = [len(alive), len(gone), sum(c in b for _, b in here) - len(gone), sum(b == c for _, b in here), sum(d[0] in good for d, _ in gone), sum(d[0] in toxic for d, _ in gone), c]
        for key, v in want.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    found = got.collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found} == want and len(found) == len(want)


def test_audit_of_other_filters_and_of_nothing(spark, odd):
    counted = spark.createDataFrame([("p", True, None, 3, 1, 0), ("p", True, None, 2, 0, 0), ("p", False, True, 5, 5, 1), ("q", True, True, 1, 0, 1)], "part string, X boolean, Y boolean, n long, good long, toxic long")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(counted, "XY").collect()}
    assert got["p", "XY", 1] == (5, 5, 0, 5, 10) and got["p", "XY", 2] == (0, 5, 0, 5, 10) and got["q", "XY", 2] == (0, 0, 1, 0, 1) and len(got) == 8
    assert filter_audit.audit(filter_audit.failures(odd.where("false"), read(spark, SF, "labels"))).count() == 0
    none = odd.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failures(odd, none)).where("good_lost + toxic_lost > 0").count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(counted, "ABCDEFG")


def test_every_text_of_the_table_is_coded_as_the_library_does(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = []
    for r in read(spark, SF, "documents").collect():
        ids = model.encode(r.text or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    assert rows_of(Q.op12_piece_coding(spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_coding_of_odd_texts(spark, odd):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = piece_coding.encode(odd, PATH, ids="tokens", decoded="again")
    assert got.columns == [*odd.columns, "tokens", "again"]
    for r in got.collect():
        assert r.tokens == model.encode(r.text or "") and r.again == model.decode(r.tokens)
    assert piece_coding.encode(odd, PATH).columns == [c for c in odd.columns if c != "ids"] + ["ids"]
    back = piece_coding.decode(got.select("tokens", "again", "text").unionByName(spark.createDataFrame([(None, None, None)], "tokens array<int>, again string, text string")), PATH, "tokens")
    assert all(r.decoded == r.again for r in back.collect())
    assert piece_coding.encode(odd.where("false"), PATH).count() == 0


def test_prefix_table_equals_the_merges():
    p, rnd = piece_coding.pieces(PATH), random.Random(7)
    letters = [*" \n\t▁aabbccehtnisor.,;{}()\r019éü漢字的👍\x00ﬁ=/*_-", "    ", "ing", "();", "{\r", "www", "----", "<s>", "</s>"]
    merged = [p.text[i] for i in p.halves]
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    made += ["".join(rnd.choice(merged) for _ in range(rnd.randint(1, 8))).replace("▁", " ") for _ in range(3000)]
    made += [c * k + "word" for c in " a=-_.*" for k in range(70)] + ["ab" * 50_000]
    assert [p.encode(t) for t in made] == p.model.encode(made)
    tokens = list(p.rank)
    for _ in range(20_000):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        assert p._compatible(a, b) == (p.merged(p.text[a] + p.text[b]) == [a, b])


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climbed(nodes):
    """Root and each leaf's siblings, level by level, of a plain tree."""
    beside, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
            beside[i].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
            at[i] = k // 8
        nodes = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], beside


def by_hand(docs):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    trees = {}
    for i, source, lang, n, text in docs:
        tampered = h(*map(part, (i, source, lang, n, text and text.translate(low)))) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else None
        trees.setdefault(b"" if lang is None else b"v" + lang.encode(), []).append(((i is not None, i or 0), h(*map(part, (i, source, lang, n, text))), i, tampered))
    keys, out = sorted(trees), []
    made = {k: climbed([x[1] for x in sorted(trees[k], key=lambda x: x[:2])]) for k in keys}
    root, over = climbed([made[k][0] for k in keys])
    for k, upper in zip(keys, over):
        for (_, leaf, i, tampered), low_path in zip(sorted(trees[k], key=lambda x: x[:2]), made[k][1]):
            node = tampered or leaf
            for left, right in low_path + upper:
                node = h(left, node, right)
            out.append((i, leaf, made[k][0], root, h(*[a + b for a, b in low_path + upper]), node, node == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest(df):
    return rows_of(merkle_manifest.verified(merkle_manifest.manifest(df)), *COLUMNS)


def test_manifest_of_odd_rows(spark, odd):
    assert manifest(odd) == by_hand([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()])
    assert manifest(odd.where("false")) == []
    one = odd.where("doc_id = 12")
    assert manifest(one) == by_hand([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in one.collect()])


def test_manifest_of_more_blocks_than_one(spark):
    docs = [(i, f"s{i % 3}", "en" if i % 3 else None, i, f"Text {i % 50}") for i in range(20_000)] + [(7, "s", f"l{i}", 1, "X") for i in range(70)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert manifest(df) == by_hand(docs)


def test_manifest_of_one_row_repeated(spark):
    docs = [(3, "s", "en", 1, "Same")] * 9000
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert manifest(df) == by_hand(docs)
