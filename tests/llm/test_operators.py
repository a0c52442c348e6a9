"""Each operator against brute force on a small table, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import ball_simhash, cap_filters, chat_collapse, language_id, license_scan, lm_scoring, lz_fingerprint, pareto_mix, quality_eb, queries as Q, residual_packing
from factloom.llm.common import connected_components, read
from oracle import SF, by_sql, rows

PATH = public_tokenizers.path(Q.TOKENIZER)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, count long, fp long, target string"


@pytest.fixture(scope="module")
def odd(spark):
    long = "the quick brown fox MIT License " * 20_000
    data = [(1, None, None, None), (2, "", "en", "s1"), (3, "   \n", None, "s1"), (4, long, "en", "s2"), (5, "Le chat est là. CC BY", "fr", None), (5, "Le chat est là. CC BY", "fr", None), (6, "a b c d e f", "en", "s1"), (7, "A B C d e f", "en", "s1"), (None, "no id here <|endoftext|> ²½", "en", "s1"), (8, "%%% 123 ###", "de", "s2"), (9, "der Hund schläft nicht", "de", "s2"), (10, "the dog sleeps not", "en", "s2")]
    return spark.createDataFrame([(i, t, l, s, None, 0.5, 1, 2, "x") for i, t, l, s in data], SCHEMA)


def empty(df):
    return df.where("false")


def all_of(spark, table="documents"):
    return read(spark, SF, table)


def same_parts(pairs, n):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got, want = Q.queries()[name](spark, SF).toPandas(), by_sql(Q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(500, 500)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 160)} == {100} and got[500] == 500


def test_lm_scoring(spark, odd):
    docs = all_of(spark)
    coded = lm_scoring.coded(docs)
    lexicon = lm_scoring.train(coded, epochs=1).lexicon
    cells = lm_scoring.class_counts(coded, lexicon).toArrow()
    of_word = cache(lexicon.kind)
    brute, v = Counter(), lexicon.size
    for r in docs.collect():
        ids = [0, *map(of_word, lm_scoring.tokens(r.text)), 0]
        brute.update((a * v + c) * v + b for a, b, c in zip(ids, ids[1:], ids[2:]))
    assert dict(zip(cells["cell"].to_pylist(), cells["n"].to_pylist())) == brute
    fresh = lm_scoring.Network(v)
    seen = fresh.fit(cells["cell"].to_numpy(), cells["n"].to_numpy(), 20)
    assert seen[-1] > seen[0] + 0.1
    assert np.allclose(np.exp(fresh.table().reshape(-1, v)).sum(1), 1, atol=1e-4)
    got = {r.doc_id: r for r in lm_scoring.score(odd, epochs=3).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[1].log_likelihood == 0 and got[1].mean_log_prob is None
    assert got[4].n_tokens == 120_000 and got[4].log_likelihood < 0
    assert lm_scoring.score(odd, epochs=3).count() == odd.count() and lm_scoring.score(empty(odd), epochs=3).count() == 0


def test_texts_are_coded_once_however_many_words_they_have(spark):
    texts = ["w1 w2 w1", " ".join(f"w{i % 70_000}" for i in range(210_000)), None, "", "w3"]
    coded = lm_scoring.coded(spark.createDataFrame([(i or None, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1))
    assert [list(r.docs) for r in coded.collect()] == [[None, 1], [2, 3, 4]]
    want = Counter(lm_scoring.word_hash(w) for t in texts for w in lm_scoring.tokens(t))
    assert {r.tok: r.n for r in lm_scoring.gather(coded).collect()} == want


def test_lm_scores_by_brute_force(spark):
    texts = [r.text for r in all_of(spark).limit(40).collect()]
    texts += [texts[3], texts[3], texts[7] + " and more", "the nation of the station", "the nation of the qxzzvtion", None, "a", "station " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashed, words = lm_scoring.word_hash, [lm_scoring.tokens(t) for t in texts]
    n = Counter(w for ws in words for w in ws)
    for many in (30, 500_000):
        model = lm_scoring.train(lm_scoring.coded(docs), frequent=5, epochs=5, held=many)
        lexicon, v = model.lexicon, model.lexicon.size
        kind = {w: lexicon.kind(w) for w in n}
        of_kind = Counter()
        for w, k in n.items():
            of_kind[kind[w]] += k + lm_scoring.SMOOTH
        table, want = model.network.table().reshape(v, v, v), []
        for ws in words:
            ids = [0, *[kind[w] for w in ws], 0]
            want.append(sum(float(table[a, c, b]) + np.log((n[w] + lm_scoring.SMOOTH) / of_kind[kind[w]]) for a, b, c, w in zip(ids, ids[1:], ids[2:], ws)))
        got = {r.doc_id: r for r in lm_scoring.score(docs, frequent=5, epochs=5, held=many).collect()}
        assert all(abs(got[i].log_likelihood - x) < 1e-3 * (1 + abs(x)) and got[i].n_tokens == len(words[i]) for i, x in enumerate(want))
        assert got[43].mean_log_prob > got[44].mean_log_prob + 0.3


def test_lm_scores_tell_language_from_shuffled_words_and_not_copies(spark):
    """Held against texts whose words were shuffled: the real text scores above it, whether or not either is in the corpus twice."""
    base = [r.text for r in read(spark, "/root/testdata/sf0.01", "documents").where("n_chars between 400 and 4000").orderBy("doc_id").limit(700).collect()]
    rng, mean = np.random.default_rng(3), lambda texts: [r.mean_log_prob for r in lm_scoring.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    mixed = [" ".join(rng.permutation(t.split())) for t in base[:30]]
    once, twice = mean(base + mixed), mean(base + mixed + base[:15] + mixed[:15])
    real, odd = np.array(once[:30]), np.array(once[len(base) : len(base) + 30])
    assert (real > odd).mean() >= 0.9
    moved = np.abs(np.array(once) - np.array(twice[: len(once)]))
    assert moved[[*range(15), *range(len(base), len(base) + 15)]].max() < 0.35 and np.median(moved) < 0.05
    real, odd = np.array(twice[:30]), np.array(twice[len(base) : len(base) + 30])
    assert (real > odd).mean() >= 0.9


def test_license_scan(spark, odd):
    def brute(text):
        ws = license_scan.words(text)
        found = [(i, l) for p, l in license_scan.BASE.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in found]
        return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({l for _, l in found}))

    extra = spark.createDataFrame([(900, "GNU General Public License; cc-by; CC BY MIT  license. Licensed under the Apache License, Version 2.0"), (901, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"), (902, "apache apache license")], "doc_id long, text string")
    docs = all_of(spark).select("doc_id", "text").union(odd.select("doc_id", "text")).union(extra)
    got = [((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels), r) for r in license_scan.scan(docs).collect()]
    assert sorted(map(str, [g for g, _ in got])) == sorted(map(str, [brute(r.text) for r in docs.collect()]))
    by_id = {r.doc_id: r for _, r in got}
    assert by_id[901].labels == "mit" and by_id[901].base_labels == "" and by_id[900].labels == "apache,cc-by,gpl,mit"
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for _, r in got)
    assert license_scan.scan(empty(odd)).count() == 0


def test_license_labels_by_brute_force(spark):
    mit = license_scan.TEMPLATES[6][1].split()
    full = license_scan.TEMPLATES[13][1].split()
    other = [f"w{i}" for i in range(60)]
    texts = [" ".join(other + mit + other), " ".join(mit[:9] + ["really"] + mit[9:]), " ".join(mit[:12] + mit[13:]), " ".join(mit[15:]), " ".join(reversed(mit)), " ".join(full), " ".join(full[:80] + ["nothing"] * 3 + full[80:]), "this is free and unencumbered software", "released under the mit license", "permission is hereby granted", None, "", " ".join(other), "licensed under cc by 4 0 " * 5000]
    texts += [r.text for r in all_of(spark).limit(80).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    has = [set(license_scan.words(t)) for t in texts]
    vocab = license_scan.vocabulary(license_scan.BASE, license_scan.TEMPLATES)
    idf = {w: np.log(1 + len(texts) / (1 + sum(w in h for h in has))) for w in vocab}

    def common(a, b):
        best = np.zeros((len(a) + 1, len(b) + 1))
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + idf[x] if x == y else max(best[i, j + 1], best[i + 1, j])
        return best[-1, -1]

    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, t in enumerate(texts):
        ws, labels, score = license_scan.words(t)[: 400 if i == 13 else None], set(), 0.0
        for label, text, key in license_scan.TEMPLATES:
            k = key.split()
            if any(ws[j : j + len(k)] == k for j in range(len(ws))):
                share = common(text.split(), ws) / sum(idf[w] for w in text.split())
                score = max(score, share)
                labels |= {label} if share >= license_scan.MATCH else set()
        base = {l for p, l in license_scan.BASE.items() if any(ws[j : j + len(p.split())] == p.split() for j in range(len(ws)))}
        assert set(filter(None, got[i].labels.split(","))) == labels | base, (i, got[i].labels, labels | base)
        assert got[i].score <= (1.0 if base else score) + 1e-9
    assert [got[i].labels for i in range(7)] == ["mit", "mit", "mit", "", "", "mit", "mit"] and min(got[0].score, got[1].score) > 1 - 1e-9 and 0.9 < got[2].score < 0.999


def test_cap_filters(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 64))
    x = np.concatenate([base, base[:80] + rng.normal(size=(80, 64)) * 0.25, base[:3].repeat(40, 0) + rng.normal(size=(120, 64)) * 0.05, base[5:6].repeat(4, 0)]).astype(np.float32)
    label = (np.arange(len(x)) * 0 + rng.integers(0, 2, len(x))).tolist()
    for block, likely in ((1500, cap_filters.LIKELY), (16, cap_filters.LIKELY), (1500, 0)):
        monkeypatch.setattr(cap_filters, "LIKELY", likely)  # 0: every filter with a likely pair is dense
        data = [(i, v.tolist(), l, 1.0) for i, (v, l) in enumerate(zip(x, label))] + [(9000, None, 1, 0.0), (9001, [0.0] * 64, 1, 0.0), (9002, [float("nan")] * 64, 1, 0.0), (9003, x[0].tolist(), None, 0.0), (9004, [], 1, 0.0), (9005, [None] * 64, 1, 0.0)]
        got = {r.vec_id: r for r in cap_filters.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, f double"), block=block).collect()}
        u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
        near = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label))
        np.fill_diagonal(near, False)
        parts = same_parts(np.argwhere(near).tolist(), len(x))
        links = sum(got[i].n_links for i in range(len(x)))
        assert 0.99 * near.sum() <= links <= near.sum()
        assert np.mean([got[i].component_id == parts[i] for i in range(len(x))]) > 0.99
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(9000, 9006))
    e = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert cap_filters.near_duplicates(e).count() == 0


@pytest.mark.parametrize("n", [300, 20_000, 300_000, 1_000_000, 5_000_000])
def test_pairs_at_the_threshold_share_a_filter(n):
    p = cap_filters.plan(n, 64)
    codes = [cap_filters.directions(64, p["blocks"], p["code"], [cap_filters.SEED, k]) for k in range(p["codes"])]
    for cosine in (0.931, 0.95):
        x, y = cap_filters.pairs_at(cosine, 1000, 64, np.random.default_rng(n))
        a, b = (cap_filters.filters(v, p["height"], codes) for v in (x, y))
        assert len(cap_filters.sharing(a, b)) >= 998  # MISS is 1e-4


def test_quality(spark, odd):
    docs, labels = all_of(spark), all_of(spark, "labels")
    got = {r.doc_id: r for r in quality_eb.classify(docs, labels, *Q.site(docs)).collect()}
    known = {r.doc_id: r for r in labels.collect()}
    assert np.mean([(got[i].quality >= 0.5) == (known[i].quality == 1) for i in known]) > 0.9
    assert np.mean([got[i].toxicity < 0.5 for i in known if not known[i].toxic]) > 0.98
    out = quality_eb.classify(odd, labels, *Q.site(odd))
    assert out.count() == odd.count() and out.where("quality is null or quality < 0 or quality > 1").count() == 0
    assert quality_eb.classify(odd, empty(labels), *Q.site(odd)).where("not keep").count() == 0
    assert quality_eb.classify(empty(odd), labels, *Q.site(odd)).count() == 0


def test_quality_by_brute_force(spark):
    docs, labels = all_of(spark), all_of(spark, "labels")
    model = quality_eb.fit(docs, labels)
    rows_of = docs.collect()
    odds = lambda p: np.log(p / (1 - p))
    q = [float(np.clip(((quality_eb.features(r.text) - model.quality.mean) / model.quality.sd) @ model.quality.w[:-1] + model.quality.w[-1], -30, 30)) for r in rows_of]
    p = [1 / (1 + np.exp(-x)) for x in q]
    hosts, paths = [r.source for r in rows_of], [(r.source, r.lang) for r in rows_of]
    of = lambda keys: {k: [x for key, x in zip(keys, p) if key == k] for k in set(keys)}
    mean = sum(p) / len(p)

    def strength(groups, prior):
        """By moments: groups' means vary about their priors beyond p(1 - p) / n; k is within over between, less one."""
        n = sum(map(len, groups.values()))
        within = sum(len(g) * prior[k] * (1 - prior[k]) for k, g in groups.items()) / n
        between = sum(len(g) * (np.mean(g) - prior[k]) ** 2 - prior[k] * (1 - prior[k]) for k, g in groups.items()) / n
        return 1e6 if between <= within * 1e-6 else min(1e6, max(1.0, within / between - 1))

    by_host, by_path = of(hosts), of(paths)
    k = strength(by_host, dict.fromkeys(by_host, mean))
    host = {h: (k * mean + sum(g)) / (k + len(g)) for h, g in by_host.items()}
    k = strength(by_path, {u: host[u[0]] for u in by_path})
    path = {u: (k * host[u[0]] + sum(g)) / (k + len(g)) for u, g in by_path.items()}
    got = {r.doc_id: r for r in quality_eb.classify(docs, labels, *Q.site(docs)).collect()}
    for r, x, d in zip(rows_of, q, p):
        marks = [model.lexicon[w] for w in model.lexicon if w in quality_eb.terms(r.text)]
        t = float(model.toxicity(np.array([[sum(marks), max(marks, default=0.0)]]))[0]) if model.lexicon else -30.0
        quality = 1 / (1 + np.exp(-(x + odds(path[r.source, r.lang]) - odds(mean))))
        want = (d, host[r.source], path[r.source, r.lang], quality, 1 / (1 + np.exp(-t)))
        g = got[r.doc_id]
        assert np.allclose((g.doc_quality, g.host_quality, g.path_quality, g.quality, g.toxicity), want, atol=1e-6)
        assert g.keep == (quality >= 0.5 and want[4] < 0.5)


def test_quality_of_repeated_ids_and_clashing_columns(spark):
    data = [(1, "fine words of a text", "s", None, 0.5, True)] * 30 + [(2, "zz zz zz zz", "s", "en", 0.5, False), (None, None, None, None, None, None), (3, "more fine words", "t", "en", 0.1, True)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, quality double, keep boolean")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_eb.classify(docs, labels, *Q.site(docs), columns=docs.columns)
    assert got.columns == ["doc_id", "text", "source", "lang", "doc_quality", "host_quality", "path_quality", "quality", "toxicity", "keep"]
    assert got.count() == len(data) and got.where("quality is null or keep is null").count() == 0


def test_quality_shrinks_sparse_sites(spark):
    data = [("a", "a/x", 3.0)] * 200 + [("b", "b/x", -3.0)] * 200 + [("c", "c/x", -3.0)]
    sites, mean = quality_eb.posteriors(spark.createDataFrame(data, "__host string, __path string, __q double"))
    got = {r.h: r.host_quality for r in sites.collect()}
    assert got["a"] > 0.9 and got["b"] < 0.1 < got["c"] < mean


def test_lexicon_covers_without_bystanders():
    found = {"bad": 5.0, "dull*": 4.0, "near": 6.0}
    hits = [{"bad", "near"}] * 5 + [{"dull*"}] * 5 + [{"near"}] * 4
    assert set(quality_eb.cover(found, hits, [True] * 10 + [False] * 4)) == {"bad", "dull*"}


def test_copies_of_a_toxic_text_leave_room_for_terms_of_others(spark):
    long = " ".join(f"z{i:04d}" for i in range(3500))
    texts = [(long, 1)] * 30 + [(f"some vile{chr(97 + i)} plain common text", 1) for i in range(12)] + [(f"some plain common text {i}", 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - t, t) for i, (_, t) in enumerate(texts)], "doc_id long, quality int, toxic int")
    model = quality_eb.fit(docs, labels)
    assert "vile*" in model.lexicon


def test_stems_that_two_words_share_are_terms_of_their_own(spark):
    assert quality_eb.terms("Abcde abcdef abcdeg abcdeg xyz") == {"abcde", "abcdef", "abcdeg", "xyz", "abcd*", "abcde*", "abcd+", "abcde+"}
    assert quality_eb.terms("abcdef abcdef") == {"abcdef", "abcd*", "abcde*"} and quality_eb.terms(None) == quality_eb.terms("") == set()
    ends = [chr(97 + i) + chr(97 + j) for i in range(10) for j in range(10)]
    # bad texts have two new words of one stem, and any one such word is in a clean text too
    texts = [(f"plain text with grobu{ends[2 * i]} and grobu{ends[2 * i + 1]} in it", 1) for i in range(50)] + [(f"plain text and with grobu{e} in it", 0) for e in ends] + [(f"plain text {i}", 0) for i in range(100)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    model = quality_eb.fit(docs, spark.createDataFrame([(i, 1 - t, t) for i, (_, t) in enumerate(texts)], "doc_id long, quality int, toxic int"))
    assert all((model.evidence([t])[1][0] >= 0) == bool(bad) for t, bad in texts)
    for t in [*[t for t, _ in texts[:60]], None, "", "grobu grobuxx", "GROBUXX grobuyy " * 5000]:
        assert model.met(t) == set(model.lexicon) & quality_eb.terms(t)
    assert model.evidence(["GROBUXX grobuyy " * 5000])[1][0] >= 0 > model.evidence(["grobuxx GROBUXX " * 5000])[1][0]


def test_mix(spark, odd):
    for docs in (odd, all_of(spark)):
        got = pareto_mix.taken(docs).toPandas()
        assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all()
        total = got["size"].sum()
        assert abs(got.groupby(got.source_size.astype(str) + got.target.astype(str)).target.first().sum() - 1.5 * total) < 1e-6 * max(1, total)
        for (_, target), g in got.groupby(["source_size", "target"]):
            assert abs(g.taken.sum() - target) <= g["size"].max()
        assert sorted(got.itertuples(index=False)) == sorted(pareto_mix.taken(docs).toPandas().itertuples(index=False)) or got.doc_id.isna().any()
    mixed = pareto_mix.repeated(all_of(spark))
    assert mixed.columns == all_of(spark).columns and mixed.count() == int(pareto_mix.taken(all_of(spark)).agg(F.sum("copies")).first()[0])
    assert pareto_mix.taken(empty(odd)).count() == 0


def test_mix_of_one_source_by_brute_force(spark):
    rng = np.random.default_rng(4)
    sizes = [int(x) for x in rng.integers(1, 400, 300)] + [40_000]
    docs = spark.createDataFrame([(i, "w " * n, "only", 1.0, 2.0) for i, n in enumerate(sizes)] + [(i + 1000, "w " * n, "other", 1.0, 2.0) for i, n in enumerate(sizes)], "doc_id long, text string, source string, target double, need double")
    got = {r.doc_id: r.copies for r in pareto_mix.taken(docs).collect()}
    u = {r.doc_id: r["__u"] for r in pareto_mix.sized(docs).collect()}
    # weights 3 and 1: the first source gets its most, two copies; the second half of its words, so none for certain
    assert all(got[i] == 2 for i in range(len(sizes)))
    ids, need = np.arange(len(sizes)) + 1000, sum(sizes)
    assert abs(sum(got[i] * sizes[i - 1000] for i in ids) - need) <= 40_000
    docs = docs.where("doc_id >= 1000")
    got = {r.doc_id: r.copies for r in pareto_mix.taken(docs).collect()}
    need = 0.5 * sum(sizes)
    m = np.sqrt(2.0 ** np.floor(np.log2(sizes)))
    lo, hi = 0.0, 10.0
    for _ in range(200):
        c = (lo + hi) / 2
        lo, hi = (lo, c) if (np.minimum(1, c * m) * sizes).sum() > need else (c, hi)
    p = np.minimum(1, c * m)
    assert p[-1] == 1 and got[ids[-1]] == 2
    left, order = need - 40_000, sorted(range(len(sizes) - 1), key=lambda k: (u[ids[k]] / (1 - u[ids[k]])) / (p[k] / (1 - p[k])))
    assert order != sorted(order, key=lambda k: u[ids[k]])
    at, want = 0, {}
    for k in order:
        want[ids[k]] = 2 if at + sizes[k] / 2 <= left else 1
        at += sizes[k]
    assert all(got[i] == want[i] for i in want)
    mixed = pareto_mix.repeated(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(got.values())


def test_languages(spark, odd):
    got = Q.op6_language_id(spark, "/root/testdata/sf0.01").join(read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    model = language_id.fit(all_of(spark))
    out = {r.doc_id: r for r in language_id.identify(odd.select("doc_id", "text"), model).collect()}
    assert out[1].lang_pred == out[2].lang_pred == "und" and out[8].lang_pred == "und"
    assert language_id.identify(empty(odd).select("doc_id", "text"), language_id.fit(empty(odd))).count() == 0


def test_predictions_are_the_votes_of_the_machines(spark):
    model = language_id.fit(all_of(spark))

    def brute(text):
        data = f" {text.lower()} ".encode()
        x = np.zeros(language_id.DIM)
        for a, b, c in zip(data, data[1:], data[2:]):
            x[((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32) >> 20] += 1
        x = np.sqrt(x / x.sum())

        def winner(names, machines):
            wins = Counter(a if x @ w[:-1] + w[-1] >= 0 else b for (a, b), w in machines.items())
            return max(names, key=lambda n: (wins[n], sum((1 if n == a else -1) * (x @ w[:-1] + w[-1]) for (a, b), w in machines.items() if n in (a, b))))

        family = winner(list(model.families), model.first)
        return winner(model.families[family], model.within[family])

    some = all_of(spark).where("text is not null").limit(60).collect()
    assert [model.predict(r.text)[0] for r in some] == [brute(r.text) for r in some]
    assert len(model.languages) == 4 and set(model.families) >= {"germanic", "romance"}


def test_letters_are_those_of_unicode():
    assert not any(map(language_id.has_letter, ["½", "²", "①", "Ⅷ", "123 _", "", None, "٣"]))
    assert all(map(language_id.has_letter, ["½ a", "é", "漢", "ª", "١ب"]))


def test_languages_of_repeated_rows_and_clashing_columns(spark):
    a, b, c = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    data = [(a, "the cat sat", "en", 0.5, "k")] * 50 + [(c, "le chat est", "fr", 0.5, "k"), (b, "the dog ran", "en", 0.5, "k"), (None, "le chien", "fr", 0.5, "k"), (5, None, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score double, `a b` string")
    out = language_id.identify(docs, language_id.fit(docs, per_language=2))
    assert out.columns == ["doc_id", "text", "lang", "a b", "lang_pred", "score"] and out.count() == len(data)
    assert {r.doc_id: r.lang_pred for r in out.collect()} == {a: "en", b: "en", c: "fr", None: "fr", 5: "und"}


def chat_by_hand(rows):
    """(conv, n_turns, n_snapshots, rendered) of (conv, turn, role, text)."""
    null = lambda x: (x is not None, x)
    rank = lambda r: {"system": 1, "user": 2, "assistant": 3, "tool": 4}.get(r, 5)
    part = lambda x: "n" if x is None else f"v{len(x)}:{x}"
    turn_hash = lambda r, t: hashlib.md5(f"{part(r)}|{part(t)}".encode()).hexdigest()
    convs = {}
    for c, n, r, t in set(rows):
        convs.setdefault(("c", c) if c is not None else ("t", turn_hash(r, t)), set()).add((null(n), rank(r), null(r), turn_hash(r, t), r or "", t or ""))
    seqs = {k: [x[3:] for x in sorted(v)] for k, v in convs.items()}
    prefixes = {tuple(x[0] for x in s[:i]) for s in seqs.values() for i in range(1, len(s))}
    out = {}
    for (kind, c), s in sorted(seqs.items(), key=str):
        name = tuple(x[0] for x in s)
        if name not in prefixes:
            same = [k[1] for k, o in seqs.items() if k[0] == "c" and tuple(x[0] for x in o) == name]
            out[name] = (min(same, default=None), len(s), sum(tuple(x[0] for x in o) == name for o in seqs.values()), "".join(f"<|{r}|>\n{t}\n<|end|>\n" for _, r, t in s))
    return sorted(map(str, out.values()))


def test_chat(spark):
    t = [(1, 1, "u", "hi"), (1, 2, "a", "yo"), (2, 1, "u", "hi"), (3, 1, "u", "hi"), (3, 2, "a", "yo"), (3, 3, "u", None), (3, 3, "u", None), (4, 1, "u", ""), (5, 1, "u", None), (6, 1, "u", "hi"), (6, 2, "a", "yo"), (6, 3, "u", None), (None, 1, "u", "hi"), (7, None, None, "x")]
    t += [(None, 5, "u", "alone"), (None, 5, "u", "alone"), (None, 1, "b", None), (8, 1, "assistant", "yes"), (8, 1, "user", "well?"), (9, 1, "user", "why?"), (9, 1, "assistant", "so"), (9, 1, "system", "be kind"), (10, 2, "user", "x"), (10, 1, "user", "y" * 100_000)]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in t], "conv_id long, turn long, role string, text string, h string, key int, n int")
    got = chat_collapse.render(df).collect()
    assert sorted(str(tuple(r)) for r in got) == chat_by_hand(t)
    by_id = {r.conv_id: r for r in got if r.conv_id}
    assert set(by_id) == {3, 4, 5, 7, 8, 9, 10} and by_id[3].n_turns == 3 and by_id[3].n_snapshots == 2
    assert by_id[3].rendered == "<|u|>\nhi\n<|end|>\n<|a|>\nyo\n<|end|>\n<|u|>\n\n<|end|>\n"
    assert by_id[8].rendered.startswith("<|user|>") and by_id[9].rendered.startswith("<|system|>\nbe kind")
    assert chat_collapse.render(df.where("false")).count() == 0


def test_chat_of_the_whole_table(spark):
    rows_of = [tuple(r) for r in all_of(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(str(tuple(r)) for r in chat_collapse.render(all_of(spark, "conversations")).collect()) == chat_by_hand(rows_of)


def test_packing(spark, odd):
    own = Tokenizer.from_file(PATH)
    docs = odd.union(all_of(spark).select(*[F.col(c) if c in all_of(spark).columns else F.lit(None).alias(c) for c in odd.columns]))
    got = residual_packing.pack(docs.select("doc_id", "text", "score"), PATH, group=40).toPandas()
    ids = [np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()]
    want = sorted(zlib.crc32(i[s : s + n].tobytes()) for i in ids for s, n, _ in residual_packing.pieces_of(i.tobytes()))
    assert sorted(got.ids_crc32) == want and got.length.sum() == sum(map(len, ids))
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert by.length.sum().max() <= 1024
    assert all((g.offset.values == np.concatenate([[0], g.length.cumsum()[:-1]])).all() for _, g in by)
    assert by.ngroups <= 1.03 * -(-got.length.sum() // 1024) + 1
    assert residual_packing.pack(empty(odd), PATH).count() == 0


def test_pieces_are_those_of_the_tokenizer():
    encode, own = residual_packing.Tokens(PATH), Tokenizer.from_file(PATH)
    for t in ["", " ", "a\n\n b  \t c", "don't I'll 've 'S", "x y z", "1²³½ Ⅷ 四", "a_b __ _", "\x1c\x1d a\x85b", "été ñandú ß ẞ", "日本語 text 😀!!", "<|endoftext|>x", "é à", "ªº µ¶ ×÷", "  lead and trail  "]:
        assert encode(t) == np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def phrases_by_hand(text):
    """Lempel-Ziv phrases as byte strings: the shortest ones not met before, and what is left at the end, marked."""
    data, found, at = text.encode(), [], 0
    while at < len(data):
        end = at + 1
        while end <= len(data) and data[at:end] in found:
            end += 1
        found.append(data[at:end] if end <= len(data) else data[at:] + b"$")
        at = end
    return found


def test_phrases_by_hand():
    def mixed(phrase):
        h = 0
        for c in phrase:
            h = (h * 69069 + c + 1) & 1073741823
        return h

    for text in ["", "a", "aa", "abababab", "the cat sat on the mat, the cat sat", "éé漢漢é", "x" * 500]:
        want = {(mixed(p[:-1]) * 69069 + 257) & 1073741823 if p.endswith(b"$") else mixed(p) for p in phrases_by_hand(text)}
        seen = set()
        lz_fingerprint.close(lz_fingerprint.parse(text.encode(), seen), seen)
        assert seen == want
    assert lz_fingerprint.fingerprint("a").tobytes() != lz_fingerprint.fingerprint("aa").tobytes()


def signature_by_hand(text):
    """By places: the smallest mixed phrase hash of each, empty places filled from the next that is not."""
    seen = set()
    lz_fingerprint.close(lz_fingerprint.parse(text.encode(), seen), seen)
    m, low = 2**64, {}
    for p in seen:
        h = (p + 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 % m
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB % m
        h ^= h >> 31
        low[h >> 57] = min(h, low.get(h >> 57, m))
    out = []
    for place in range(128 if low else 0):
        away = next(d for d in range(128) if (place + d) % 128 in low)
        out.append((low[(place + away) % 128] * 0xD6E8FEB86659FD93 + away * 0xCA5A826395121157) % m >> 56)
    return bytes(out)


@pytest.mark.parametrize("size", [lz_fingerprint.RANGE, 3000])
def test_fingerprints(spark, odd, size):
    docs = odd.where("length(text) < 1000 or text is null").union(all_of(spark).limit(60).selectExpr("doc_id + 100", "text", "lang", "source", "n_chars", "0D", "1L", "1L", "''"))
    same = spark.createDataFrame([(50, f"one of many {i * 7919 % 101} texts of an id", None, None, None, 0.0, 1, 1, "") for i in range(60)] + [(None, f"nobody {i}", None, None, None, 0.0, 1, 1, "") for i in range(40)] + [(70, "twice", None, None, None, 0.0, 1, 1, "")] * 5, SCHEMA)
    docs = docs.union(same).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = sorted([(r.doc_id is None, r.doc_id or 0, r.h, r.text or "") for r in docs.collect()])
    want = []
    for k, (no, i, _, t) in enumerate(order):
        n = order[(k + 1) % len(order)][3]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        a, b, c = map(signature_by_hand, (t, e, n))
        like = lambda x, y: float(len(x) == len(y)) if not x or not y else max(0.0, (sum(map(int.__eq__, x, y)) / 128 - 1 / 256) / (1 - 1 / 256))
        want.append((str(None if no else i), len(t), hashlib.sha256(e.encode()).hexdigest(), a.hex(), b.hex(), round(like(a, b), 9), round(like(a, c), 9)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in lz_fingerprint.fingerprints(docs, size=size).collect()]
    assert sorted(got) == sorted(want)
    assert lz_fingerprint.fingerprints(empty(odd)).count() == 0


def simhash_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, odd):
    docs = all_of(spark).select("doc_id", "text").union(odd.select("doc_id", "text"))
    docs = docs.withColumn("component_id", F.lit(0))
    texts = docs.collect()
    fps = np.array([simhash_by_hand(r.text) for r in texts], np.uint64)
    parts = same_parts(np.argwhere(np.bitwise_count(fps[:, None] ^ fps) <= 4).tolist(), len(fps))
    low = {p: min([texts[i].doc_id for i in range(len(fps)) if parts[i] == p and texts[i].doc_id is not None], default=None) for p in set(parts)}
    want = sorted(str((r.doc_id, f"{int(f):016x}", low[p])) for r, f, p in zip(texts, fps, parts))
    for block in (4096, 2):  # the second sends every crowded bucket through the whole ball
        assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in ball_simhash.near_duplicates(docs, block=block).collect()) == want
    one = ball_simhash.keep_one(odd)
    assert one.columns == odd.columns and one.where("doc_id = 5").count() == 1 and one.where("doc_id in (6, 7)").count() == 1
    assert ball_simhash.near_duplicates(empty(odd)).count() == 0


def test_one_row_of_each_component_stays(spark):
    texts = ["the red fox ran over the far hill", "nine old men sat by a green door", "a small boat came home in heavy rain", "my cat will not eat blue cheese today"]
    data = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[2]), (3, texts[3]), (None, texts[3]), (None, "no id here at all but some words"), (None, "no id here at all but some words"), (4, None), (5, "")]
    got = ball_simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [data[0], data[2], data[3], data[4], data[6], data[8]]))


def test_one_row_stays_whatever_columns_are_called(spark):
    data = [(1, "one two three four five", 7, 1, "x"), (1, "one two three four five", 7, 1, "x"), (2, "one two three four five", 8, 2, "y"), (None, None, 9, 3, "z")]
    docs = spark.createDataFrame(data, "doc_id long, text string, `__id` long, fp long, `a b` string")
    got = ball_simhash.keep_one(docs)
    assert got.columns == docs.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [data[0], data[3]]))


def test_simhash_links_random_balls(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 30).astype(np.uint64)
    fps = np.concatenate([centre, *[centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 30)).astype(np.uint64)) for k in range(1, 7)]])
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    for block in (4096, 2):
        got = dict(connected_components(ball_simhash.links(df, block)).collect())
        parts = same_parts(np.argwhere(np.bitwise_count(fps[:, None] ^ fps) <= 4).tolist(), len(fps))
        mine = [got.get(int(v), int(v)) for v in fps.view(np.int64)]
        assert all((mine[i] == mine[j]) == (parts[i] == parts[j]) for i in range(len(fps)) for j in range(i))


def test_pipeline(spark, tmp_path, odd):
    docs, kept = all_of(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        if name != "packing":
            assert out.columns == docs.columns
        kept[name] = docs, docs = docs, spark.read.parquet(path)
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in kept["near_duplicates"])
    ids = sorted(before)
    fps = np.array([simhash_by_hand(before[i]) for i in ids], np.uint64)
    parts = same_parts(np.argwhere(np.bitwise_count(fps[:, None] ^ fps) <= 4).tolist(), len(fps))
    assert set(after) == {ids[p] for p in set(parts)}
    before, after = kept["mixing"]
    copies = {r.doc_id: r.copies for r in pareto_mix.taken(before).collect() if r.copies}
    assert Counter(r.doc_id for r in after.collect()) == copies
    own = Tokenizer.from_file(PATH)
    length = {r.doc_id: len(own.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect()}
    assert docs.agg(F.sum("length")).first()[0] == sum(length[i] * n for i, n in copies.items())
    before, after = kept["language"]
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect() if len(r.text or "") < 200}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(odd), SF).count() == 0
    ran = {name: stage(spark, odd, SF) for name, stage in corpus_pipeline.STAGES if name in ("near_duplicates", "mixing")}
    assert all(out.columns == odd.columns for out in ran.values()) and ran["near_duplicates"].where("doc_id in (6, 7)").count() == 1


def test_equal_rows_without_ids_are_ranked_by_text_and_collected_once(spark):
    """A third of the rows equal: turns without a conversation make one row of the shuffle a task, documents without ids have draws of their own."""
    n = 100_000
    turns = spark.range(n).selectExpr("if(id % 3 = 0, null, id) conv_id", "1 turn", "'user' role", "if(id % 3 = 0, 'same', concat('text ', id)) text")
    got = chat_collapse.render(turns)
    assert got.count() == n - (n + 2) // 3 + 1 and got.where("conv_id is null").select("rendered").first()[0] == "<|user|>\nsame\n<|end|>\n"
    docs = spark.range(5_000).selectExpr("cast(null as long) doc_id", "concat('a b c d ', id) text", "'s' source")
    assert pareto_mix.sized(docs).select("__u").distinct().count() == 5_000
    got = pareto_mix.taken(docs.union(spark.range(1_000).selectExpr("id", "'x y z'", "'t'"))).toPandas()
    assert all(abs(g.taken.sum() - target) <= g["size"].max() for target, g in got.groupby("target"))
