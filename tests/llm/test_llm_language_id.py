import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterlens.llm import language_id as li

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r for r in docs.collect()}
    got = li.op5_language_id(spark, SF).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts_and_columns(spark):
    rows = [(i, t, lang, "x", 1.0) for i, (t, lang) in enumerate(
        [("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 30)]
    odd = [(None, "the dog", None, "x", 1.0), (901, None, "en", "x", 1.0), (902, "", "de", "x", 1.0),
           (903, "12 34 !!", "en", "x", 1.0), (903, "12 34 !!", "en", "x", 1.0),
           (904, "und die Katze " * 30_000, None, "x", 1.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string, score double")
    model = li.train(docs)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r.p for r in docs.select("doc_id", li.prediction(model).alias("p")).collect()}
    assert [got[i].lang_pred for i in (0, 1, None, 904)] == ["en", "de", "en", "de"]
    assert all(tuple(got[i]) == ("und", 0.0) for i in (901, 902, 903))
    kept = li.keep_known(docs, model, 0.4)
    assert kept.columns == docs.columns
    assert kept.count() == 62


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert li.train(docs) is None
    assert {tuple(r.p) for r in docs.select(li.prediction(None).alias("p")).collect()} == {("und", 0.0)}
    assert li.train(docs.limit(0)) is None
    assert li.keep_known(docs.limit(0), None, 0.4).count() == 0


def test_penalties_leave_most_weights_at_zero_and_temperature_lowers_loss():
    rng = np.random.default_rng(1)
    rows, labels = [], rng.integers(0, 2, 200)
    for y in labels:
        at = np.unique(np.append(rng.integers(100, 4000, 20), y))
        rows.append((at, np.full(len(at), 1 / np.sqrt(len(at)))))
    w = li.fit(rows, labels, 2)
    assert (w != 0).mean() < 0.2
    assert np.mean([np.argmax(v @ w[at]) == y for (at, v), y in zip(rows, labels, strict=True)]) > 0.97
    scores = np.array([[4.0, 0.0]] * 6 + [[0.0, 4.0]] * 4)
    assert li.temperature(scores, np.zeros(10, int)) > 3
    assert li.temperature(np.empty((0, 2)), np.empty(0, int)) == 1.0


def plain_ngrams(text):
    """Buckets of the one to three-letter n-grams, one by one, in whole numbers."""
    m, out = 1 << 32, Counter()

    def add(x):
        x ^= x >> 15
        out[(x * 0x2C1B3C6D % m) >> 17] += 1

    c = [ord(x) for x in re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")]
    for i in range(len(c)):
        x = c[i] * 0x9E3779B1 % m
        add(x)
        if i + 1 < len(c):
            x = (x ^ (c[i + 1] * 0x85EBCA77 % m)) * 0xC2B2AE3D % m
            add((x + 1) % m)
        if i + 2 < len(c):
            x = (x ^ (c[i + 2] * 0x27D4EB2F % m)) * 0x165667B1 % m
            add((x + 2) % m)
    return out


def plain_values(text, idf):
    v = {b: (1 + math.log(k)) * idf(b) for b, k in plain_ngrams(text).items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {b: x / norm for b, x in v.items()}


def plain_softmax(s):
    e = [math.exp(x - max(s)) for x in s]
    return [x / sum(e) for x in e]


def plain_fit(rows, classes, alpha=0.5, beta=1.0, l1=0.02, l2=0.02):
    """Follow-the-regularised-leader, coordinate by coordinate; rows are (values, class)."""
    z, n = Counter(), Counter()

    def weight(at):
        if abs(z[at]) <= l1:
            return 0.0
        return (math.copysign(l1, z[at]) - z[at]) / ((beta + math.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(li.EPOCHS):
        for k in order.permutation(len(rows)):
            v, label = rows[k]
            p = plain_softmax([sum(x * weight((b, c)) for b, x in v.items()) for c in range(classes)])
            for c in range(classes):
                for b, x in v.items():
                    g = x * (p[c] - (c == label))
                    step = (math.sqrt(n[b, c] + g * g) - math.sqrt(n[b, c])) / alpha
                    z[b, c] += g - step * weight((b, c))
                    n[b, c] += g * g
    return {at: weight(at) for at in z}


def test_equals_a_plain_model(spark):
    """Document frequencies, TF-IDF, weights, temperature and scores against loops over numbers."""
    rnd = random.Random(8)
    words = {"en": "the cat and dog with a house".split(), "de": "der hund und katze mit ein haus".split(),
             "fr": "le chien et chat avec un maison été".split()}
    rows = []
    for i in range(66):
        lang = rnd.choice(list(words))
        bag = words[lang] + words[rnd.choice(list(words))][:3]
        rows.append((i, " ".join(rnd.choice(bag) for _ in range(rnd.randrange(2, 9))) + rnd.choice(["", " 12", "!"]), lang))
    rows += [(100 + i, rows[0][1], rows[0][2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(docs)

    known = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    df = Counter(b for t, _ in known for b in plain_ngrams(t))
    for b in {*df, 5, 77}:
        assert model.idf[b] == pytest.approx(1 + math.log((1 + len(known)) / (1 + df[b])))
    marks = {r.text: r.mark for r in docs.select("text", F.xxhash64("text").alias("mark")).collect()}
    sample = sorted(set(known), key=lambda x: (marks[x[0]], x[1]))
    languages = sorted(words)
    data = [({**plain_values(t, lambda b: model.idf[b]), li.BUCKETS: 1.0}, languages.index(lang)) for t, lang in sample]
    weights = plain_fit([r for k, r in enumerate(data) if k % 5 != 4], 3)
    want = np.zeros_like(model.weights)
    for at, w in weights.items():
        want[at] = w
    assert np.allclose(model.weights, want, atol=1e-9) and (want != 0).any()

    def scores(v):
        return [sum(x * want[b, c] for b, x in v.items()) for c in range(3)]

    checked = [(scores(v), label) for k, (v, label) in enumerate(data) if k % 5 == 4]

    def loss(t):
        even, total = 1 / (len(checked) + 1), 0.0
        for s, label in checked:
            p = [math.log(max(x, 1e-12)) for x in plain_softmax([x / t for x in s])]
            total -= (1 - even) * p[label] + even * sum(p) / len(p)
        return total / len(checked)

    assert loss(model.temperature) <= min(loss(math.exp(k / 50)) for k in range(-149, 150)) + 1e-6
    got = {r.doc_id: r.p for r in docs.select("doc_id", li.prediction(model).alias("p")).collect()}
    for i, t, _ in rows:
        p = plain_softmax([x / model.temperature for x in scores(
            {**plain_values(t, lambda b: model.idf[b]), li.BUCKETS: 1.0})])
        assert got[i].score == pytest.approx(max(p), abs=1e-9)
        assert p[languages.index(got[i].lang_pred)] == pytest.approx(max(p), abs=1e-9)


def test_a_text_with_many_copies_does_not_fill_the_sample(spark):
    """Two thirds of a language's rows are one text; the others are still learnt from."""
    rows = [(i, "copy copy copy", "en") for i in range(2000)]
    rows += [(5000 + i, f"the weather in town {'abcdefghij'[i % 10]} was {'klmnopqrst'[i // 10 % 10]} fine {'uvwxyz'[i % 6]}", "en")
             for i in range(200)]
    rows += [(9000 + i, f"das wetter {'abcdefghij'[i % 10]} ist {'klmnopqrst'[i // 10 % 10]} gut", "de") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(docs, per_lang=60)
    asked = spark.createDataFrame([("the weather was fine in town",), ("das wetter ist gut",)], "text string")
    assert [r.p.lang_pred for r in asked.select(li.prediction(model).alias("p")).collect()] == ["en", "de"]


def test_fitted_rows_are_made_when_asked_for():
    idf = np.linspace(1, 2, li.BUCKETS)
    grams = [li.ngrams(t) for t in ("the cat sat", "die Katze", "the dog", "der Hund") * 3]
    at, counts = ([x[k].astype(np.int32) for x in grams] for k in (0, 1))
    rows = li.Rows(at, counts, idf)
    plain = [(np.append(a, li.BUCKETS), np.append(li._values(a, c, idf), 1.0)) for a, c in zip(at, counts, strict=True)]
    assert len(rows) == len(plain)
    for (a, v), (b, w) in zip(rows, plain, strict=True):
        assert a.tolist() == b.tolist() and v.tolist() == w.tolist()
    assert rows[0] is not rows[0]  # nothing is kept but the counts
    labels = np.array([0, 1] * 6)
    assert (li.fit(rows, labels, 2) == li.fit(plain, labels, 2)).all()
