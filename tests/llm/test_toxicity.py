import math
import random

import numpy as np

from gridloom.llm.queries import op4_toxicity
from gridloom.llm.toxicity import Settings, features, fit, score, train
from tests.conftest import SF


def test_features_of_small_texts():
    docs, buckets = features([b"A b. a B", b"", b"x", b"a b"], 20)
    by = {k: sorted(buckets[docs == k]) for k in range(4)}
    assert [len(by[k]) for k in range(4)] == [4 + 3 + 2, 0, 1, 3]
    assert set(by[3]) < set(by[0])  # a, b and the pair "a b" are the same features


def test_training_separates_and_stays_sparse():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, 600).tolist()
    rows = [np.unique(np.append(rng.integers(10, 5000, 30), [3] if y else [])).astype(int) for y in labels]
    buckets, weights, bias = train(rows, labels, Settings(bits=13))
    assert 3 in buckets and weights[list(buckets).index(3)] > 1
    assert len(buckets) < 500 and np.isfinite(bias)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 8), (2, "", 8), (None, "x y z", None)], "doc_id long, text string, score int")
    model = fit(docs, spark.createDataFrame([], "doc_id long, label int"))
    rows = score(docs, model).collect()
    assert sorted(r.score for r in rows) == [0.5] * 4 and docs.columns == ["doc_id", "text", "score"]
    model = fit(docs, spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 1)], "doc_id long, label int"))
    assert score(spark.createDataFrame([], docs.schema), model).count() == 0
    assert len({r.score for r in score(docs, model).where("text is null or text = ''").collect()}) == 1


def test_planted_words_are_found(spark):
    rng = random.Random(2)
    plain = [" ".join(rng.choice("abcdefgh") + rng.choice("xyzw") for _ in range(60)) for _ in range(300)]
    rows = [(i, t.replace("ax", "awful", 1) + " awful" if i % 3 == 0 else t, int(i % 3 == 0)) for i, t in enumerate(plain)]
    train_rows, test_rows = rows[:200], rows[200:]
    schema = "doc_id long, text string, label int"
    found = score(spark.createDataFrame(test_rows, schema), fit(spark.createDataFrame(train_rows, schema).drop("label"), spark.createDataFrame(train_rows, schema).drop("text"))).collect()
    assert np.mean([(r.score >= 0.7) == bool(r.label) for r in found]) > 0.97


def test_query_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op4_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    if toxic and clean:
        assert np.mean([a > b for a in toxic for b in clean]) > 0.6


def test_training_against_a_plain_version():
    """FTRL-proximal with a dictionary for each coordinate's sums, one coordinate at a time."""
    rng = np.random.default_rng(4)
    settings = Settings(bits=6, alpha=0.5, beta=1.0, l1=0.4, l2=0.1, epochs=3)
    rows = [np.unique(rng.integers(0, 64, rng.integers(1, 12))) for _ in range(80)]
    labels = [int(7 in r or rng.random() < 0.1) for r in rows]
    z, n = {}, {}

    def weight(i):
        l1, l2 = (settings.l1, settings.l2) if i != "bias" else (0.0, settings.l2)
        zi = z.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - (l1 if zi > 0 else -l1)) / ((settings.beta + math.sqrt(n.get(i, 0.0))) / settings.alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(settings.epochs):
        for k in order.permutation(len(rows)):
            used = [*rows[k].tolist(), "bias"]
            w = {i: weight(i) for i in used}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[k]
            for i in used:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / settings.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    buckets, weights, bias = train(rows, labels, settings)
    expected = {i: weight(i) for i in range(64) if weight(i)}
    assert buckets.tolist() == sorted(expected) and 0 < len(expected) < 64
    assert np.allclose(weights, [expected[i] for i in sorted(expected)]) and abs(bias - weight("bias")) < 1e-9
