import math
import zlib

import numpy as np

from tidemark.llm import toxicity


def trained(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, toxicity.train(docs, labels)


def test_held_out_accuracy_and_sentences(spark):
    docs, labels, model = trained(spark)
    out = {r.doc_id: r for r in toxicity.score(docs, model, keep=["doc_id", "text"]).collect()}
    held = [(out[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in out]
    toxic = [o for o, t in held if t]
    clean = [o for o, t in held if not t]
    assert sum(o.predicted for o in toxic) >= 0.85 * len(toxic)
    assert sum(o.predicted for o in clean) <= 0.03 * len(clean)
    named = [o for o in toxic if any(w in o.text.lower() for w in ("idiot", "moron", "scum"))]
    found = [s for o in named for s in o.sentences]
    hits = sum(any(w in o.text[s.begin : s.end].lower() for w in ("trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron")) for o in named for s in o.sentences)
    assert hits >= 0.9 * len(found) > 0


def test_score_is_the_noisy_or_of_its_sentences():
    weights = np.zeros((1 << toxicity.BITS) + 1, np.float32)
    row = toxicity.featurize(["vile"])[0][0, 0]
    weights[row] = 9.0
    kernel = toxicity.make_kernel(True)((weights, -8.0))
    texts = [None, "", "..!", "vile", "Vile. fine\nvile é vile!", "vile vile vile", "É vile", "fine"]
    score, predicted, where = kernel(texts)
    p, q = (1 / (1 + math.exp(-z)) for z in (1.0, -8.0))
    double = 1 / (1 + math.exp(-10.0))
    want = [0, 0, 0, p, 1 - (1 - p) * (1 - q) * (1 - double), p, p, q]
    assert np.allclose(score, want)
    assert predicted == [int(w >= 0.5) for w in want]
    assert [(s["begin"], s["end"]) for s in where[4]] == [(0, 4), (11, 22)] and [(s["begin"], s["end"]) for s in where[6]] == [(0, 6)]


def test_edges(spark):
    df = spark.createDataFrame([(1, "vile. thing", 5), (1, "vile. thing", 5), (None, None, None)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, folds=None)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == 3 and all(0 <= r.score < 0.5 for r in rows)
    assert toxicity.score(df.limit(0), toxicity.train(df.limit(0), labels.limit(0))).count() == 0


def test_gradient_equals_finite_differences_and_loss_its_definition():
    rng = np.random.default_rng(6)
    labels, n, f = np.array([1, 0, 1, 0, 1, 0]), 6, 5
    doc = np.sort(rng.integers(0, n, 12))
    sentence, feature = rng.integers(0, 12, 30), rng.integers(0, f, 30)
    plain, importance, decay = rng.integers(0, 4, n).astype(float), rng.random(n) + 0.5, 0.3
    w, bias = rng.normal(size=f), -1.5
    loss, dw, db = toxicity.objective(w, bias, labels, importance, doc, sentence, feature, plain, decay)
    total = 0.0
    for d in range(n):  # document by document, sentence by sentence
        clean = (1 - 1 / (1 + math.exp(-bias))) ** plain[d]
        for k in np.flatnonzero(doc == d):
            z = bias + sum(w[g] for s, g in zip(sentence, feature) if s == k)
            clean *= 1 - 1 / (1 + math.exp(-z))
        total -= importance[d] * math.log(1 - clean if labels[d] else clean)
    assert math.isclose(loss, total / n + decay * (w**2).sum() / (2 * n), rel_tol=1e-9)
    at = lambda w, b: toxicity.objective(w, b, labels, importance, doc, sentence, feature, plain, decay)[0]
    e = 1e-6
    assert math.isclose((at(w, bias + e) - at(w, bias - e)) / (2 * e), db, rel_tol=1e-5)
    for k in range(f):
        step = np.eye(f)[k] * e
        assert math.isclose((at(w + step, bias) - at(w - step, bias)) / (2 * e), dw[k], rel_tol=1e-4, abs_tol=1e-8)


def test_very_long_texts():
    weights = np.zeros((1 << toxicity.BITS) + 1, np.float32)
    weights[toxicity.featurize(["vile"])[0][0, 0]] = 12.0
    kernel = toxicity.make_kernel(True)((weights, -20.0))
    prose = "some é words here. " * 500_000
    score, predicted, where = kernel([prose + "so vile.", "x" * 10_000_000, prose])
    assert predicted == [0, 0, 0] and math.isclose(score[0] - score[2], math.exp(-8), rel_tol=0.01) and score[1] < 1e-6
    weights[toxicity.featurize(["vile"])[0][0, 0]] = 30.0
    score, predicted, where = kernel([prose + "so vile."])
    assert predicted == [1] and [(s["begin"], s["end"]) for s in where[0]] == [(len(prose), len(prose) + 7)]
