"""Whitening, language identification and periodic runs against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from storepulse.llm import language_id, periodic_runs, queries, whitening


def plain_runs(words, least=6, exponent=4):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, exponent * q):
                found.setdefault((start, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_catcher_finds_the_runs_of_random_words():
    rng = random.Random(11)
    for _ in range(4000):
        n, letters = rng.randint(0, 120), rng.choice([1, 2, 2, 3, 6])
        words = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n:
                a = rng.randrange(n)
                q = rng.randint(1, max(1, (n - a) // 4))
                for i in range(a + q, rng.randint(a, n)):
                    words[i] = words[i - q]
        catcher = periodic_runs.SquareCatcher()
        for w in words:
            catcher.append(w)
        assert catcher.finish() == plain_runs(words)


def test_catcher_of_long_repeats_keeps_little():
    catcher = periodic_runs.SquareCatcher()
    catcher.extend(["a"] * 5000 + [f"w{i % 700}" for i in range(7000)])
    assert catcher.finish() == [(0, 5000, 1), (5000, 7000, 700)]
    assert max(map(len, catcher.waiting.values())) < 100
    with pytest.raises(ValueError):
        periodic_runs.SquareCatcher(exponent=3)


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    first = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *first, 1000 * first[1] // first[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_op13_equals_the_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_periodic_runs(spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(plain_digest(r.doc_id, r.text) for r in docs)
    assert any(r[1] for r in rows) and any(not r[1] for r in rows)


def test_runs_of_odd_texts(spark):
    texts = [None, "", " \t\n", "a a a a a", "a a a a a a", "x " + "a b c " * 4 + "y", "é é " * 6, "lone", "a a a a a a b b b b b b"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(5, texts[5], "again", 2), (None, texts[4], "no id", 3)] + [(100 + i, "the same few words " * 5, "loop", 4) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_words int")
    got = periodic_runs.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].n_words for i in range(9)] == [0, 0, 0, 5, 6, 14, 6, 1, 12]
    assert [len(by[i].runs) for i in range(9)] == [0, 0, 0, 0, 1, 1, 1, 0, 2]
    assert by[4].collapsed == "a" and by[5].collapsed == "x a b c y" and by[8].collapsed == "a b" and by[0].collapsed == "" and by[None].collapsed == "a"
    digests = periodic_runs.run_digest(periodic_runs.periodic_runs(periodic_runs.looped_text(docs)))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, digests.collect()), key=key) == sorted((plain_digest(r[0], r[1]) for r in rows), key=key)
    assert periodic_runs.run_digest(periodic_runs.periodic_runs(docs.filter("false"))).count() == 0


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 30011}" for i in range(150_000))
    row = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 150_000, 30011)] and len(row.collapsed.split()) == 30011


# whitening


def plain_whitening(vectors, k=4):
    x = np.floor(256 * np.array(vectors, dtype=float)).astype(np.int64)
    once = np.unique(x, axis=0)
    n, s = len(once), once.sum(axis=0)
    c = once - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_op11_equals_the_plain_version(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    got = queries.op11_whitening(spark, sf_dir).collect()
    n, deviation, z, share = plain_whitening([r.embedding for r in rows])
    place = {r.vec_id: i for i, r in enumerate(rows)}
    assert len(got) == 4 * len(rows)
    signs = {}
    for r in got:
        i, c = place[r.vec_id], r.component - 1
        signs.setdefault(c, math.copysign(1, r.whitened * z[i, c]))
        assert r.n == n and r.deviation == deviation[i]
        assert r.whitened == pytest.approx(signs[c] * z[i, c], abs=1e-9) and r.explained == pytest.approx(share[c], rel=1e-9) and r.identity_error < 1e-9


def test_whitening_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 7)
    monkeypatch.setattr(whitening, "SPLIT", 2)
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))).tolist()
    vectors += [vectors[0]] * 100  # a third of all rows are equal
    rows = [(i % 290, v, "x", 5) for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, x string, n int").repartition(9)).collect()
    n, deviation, z, share = plain_whitening(vectors)
    assert n == 200 and {r.n for r in got} == {200} and len(got) == 4 * 300
    assert sorted(int(r.deviation) for r in got if r.component == 2) == sorted(deviation.tolist())
    for c in range(4):
        own = sorted(abs(r.whitened) for r in got if r.component == c + 1)
        assert np.allclose(own, sorted(abs(z[:, c])), atol=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25]), (2, [0.0, -0.0]), (2, [0.0, -0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [0.5, -0.25]), (7, [0.5])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = whitening.whiten(table).collect()
    assert sorted((r.vec_id or -1, r.component) for r in got) == [(-1, 1), (-1, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2), (7, 1), (7, 2)]
    assert {r.n for r in got} == {4}
    one = whitening.whiten(table.filter("vec_id = 2")).collect()  # one distinct vector: no variance
    assert {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0])], "vec_id bigint, embedding array<double>")).collect()
    assert {(r.component, r.whitened is None, round(r.explained, 9)) for r in flat} == {(1, False, 1.0), (2, True, 0.0)} and max(r.identity_error for r in flat) < 1e-9
    for empty in (table.filter("false"), table.filter("vec_id IN (3, 4, 5, 6)"), spark.createDataFrame([(1, [])], "vec_id bigint, embedding array<double>")):
        none = whitening.whiten(empty)
        assert none.count() == 0 and none.columns == whitening.whiten(table).columns


# languages


def test_op12_on_held_out_documents(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op12_language_id(spark, sf_dir).collect()
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_codewords_are_far_apart():
    for k in range(2, 12):
        code = language_id.codewords(k)
        assert code.shape[0] == k and set(np.unique(code)) == {-1.0, 1.0} and (np.abs(code.sum(axis=0)) < k).all()
        apart = min((code[a] != code[b]).sum() for a in range(k) for b in range(a))
        assert apart >= (code.shape[1] + 1) // 2 if k <= 7 else apart >= code.shape[1] // 4


def plain_prediction(rows, texts, code, languages):
    """The same method without numpy's shortcuts: counts of n-grams by dictionary, bits by sums of log-odds, trust by hits."""
    grams = lambda text: [b for part in language_id.buckets(text) for b in part.tolist()]
    counts = [[0.5] * language_id.BUCKETS for _ in languages]
    for lang, text in rows:
        for b in grams(text):
            counts[languages.index(lang)][b] += 1
    totals = [sum(c) for c in counts]

    def weight(b, j):
        share = lambda on: [counts[i][b] / totals[i] for i in range(len(languages)) if (code[i][j] > 0) == on]
        return math.log(sum(share(True)) / len(share(True))) - math.log(sum(share(False)) / len(share(False)))

    bits = range(len(code[0]))
    margin = lambda text: [sum(weight(b, j) for b in grams(text)) / 3 for j in bits]
    right = [[0.0] * len(code[0]) for _ in languages]
    for lang, text in rows:
        i = languages.index(lang)
        own = sum(r[0] == lang for r in rows)
        for j, m in enumerate(margin(text)):
            right[i][j] += (m * code[i][j] > 0) / own
    out = []
    for text in texts:
        m = margin(text)
        loss = [sum((math.log1p(math.exp(-abs(m[j]))) + max(0.0, -m[j] * code[i][j])) * right[i][j] / sum(right[i]) for j in bits) for i in range(len(languages))]
        best = min(range(len(languages)), key=lambda i: loss[i])
        scale = min(1.0, 8 / (len(grams(text)) / 3))
        out.append((languages[best], 1 / sum(math.exp((loss[best] - x) * scale) for x in loss)))
    return out


def test_predictions_equal_the_plain_version(spark):
    rows = [("a", "the thing that then was there"), ("a", "this and that with them"), ("b", "schöne grüße aus der küche"), ("b", "wo ist die tür"), ("c", "¿dónde está la niña?"), ("c", "una casa de los niños")]
    texts = ["the", "die küche", "la casa", "then die", "X", "ÄÖÜ 12"]
    train = spark.createDataFrame(rows, "lang string, text string")
    model = language_id.train(train)
    assert model.languages == ["a", "b", "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(language_id.predict(docs, model).collect())
    want = plain_prediction(rows, texts, model.code.tolist(), model.languages)
    assert [r.lang_pred for r in got] == [w[0] for w in want]
    assert [r.score for r in got] == pytest.approx([w[1] for w in want], abs=1e-4)
    assert all(r.ambiguous == (r.score < 0.9) for r in got)


def test_languages_of_odd_texts(spark):
    texts = [None, "", "12 34 !", "_", "½ ²", "the", "ß"]
    rows = [(i, t, None, "s") for i, t in enumerate(texts)] + [(None, "the", None, "s"), (5, "the", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    train = spark.createDataFrame([("en", "the and of"), ("de", "der die das"), (None, "la le"), ("xx", None), ("yy", "123")], "lang string, text string")
    model = language_id.train(train)
    assert model.languages == ["de", "en"]
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in range(5)] == ["und"] * 5 and by[5].lang_pred == "en" and by[None].lang_pred == "en" and by[0].score == 0
    assert language_id.predict(docs.filter("false"), model).count() == 0
    blind = language_id.train(train.filter("false"))
    assert {r.lang_pred for r in language_id.predict(docs, blind).collect()} == {"und"}
    alone = language_id.train(train.filter("lang = 'en'"))
    assert {r.lang_pred for r in language_id.predict(docs, alone).collect()} == {"und", "en"}
    assert language_id.train(train, most_languages=1).languages == ["de"]


def test_a_window_of_n_grams_at_a_time(monkeypatch):
    text = "Ünder the wide " * 40
    whole = np.sort(np.concatenate(list(language_id.buckets(text))))
    monkeypatch.setattr(language_id, "WINDOW", 16)
    assert np.array_equal(np.sort(np.concatenate(list(language_id.buckets(text)))), whole)
