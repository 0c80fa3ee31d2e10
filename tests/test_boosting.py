"""The boosted trees against a plain version that sees all rows at once."""

import json

import numpy as np
import pytest

from gridloom.operators import boosting, models
from gridloom.operators.boosting import Model, Settings, _drawn, fit, gradients, response, start_score, tree_features


def plain(x, y, s, edges):
    """Leaf-wise boosting, one leaf at a time, from the rows themselves: scores after all rounds and the leaves of each tree."""
    bins = np.stack([(v[:, None] > e[None]).sum(1) for v, e in zip(x, edges)])
    score, sizes = np.full(len(y), start_score(s.objective, y.mean())), []
    for t in range(s.rounds):
        g, h = gradients(s.objective, y, score, s.power)
        leaves, features = [np.arange(len(y))], tree_features(s, len(x), t)

        def best(rows):
            out = (0.0, None, None)
            for f in features:
                for b in range(len(edges[f])):
                    left = bins[f, rows] <= b
                    n = left.sum()
                    if n < s.min_rows or len(rows) - n < s.min_rows:
                        continue
                    sides = [(g[rows[m]].sum(), h[rows[m]].sum()) for m in (left, ~left)]
                    if min(hh for _, hh in sides) < s.min_hessian:
                        continue
                    gain = sum(gg * gg / (hh + s.l2) for gg, hh in sides) - g[rows].sum() ** 2 / (h[rows].sum() + s.l2)
                    if gain > out[0] * (1 + 1e-9) and gain > 1e-9:
                        out = (gain, f, b)
            return out

        found = [best(leaves[0])]
        while len(leaves) < s.leaves:
            k = int(np.argmax([f[0] for f in found]))
            if not found[k][0]:
                break
            rows, (_, f, b) = leaves.pop(k), found.pop(k)
            for m in (bins[f, rows] <= b, bins[f, rows] > b):
                leaves.append(rows[m])
                found.append(best(rows[m]))
        sizes.append(sorted(map(len, leaves)))
        if len(leaves) > 1:
            for rows in leaves:
                score[rows] -= s.rate * g[rows].sum() / (h[rows].sum() + s.l2)
    return score, sizes


def table(spark, x, y, parts):
    rows = [(int(i), *map(float, v), float(z)) for i, (v, z) in enumerate(zip(x.T, y))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"f{k} double" for k in range(len(x))) + ", y double").repartition(parts, "id")


@pytest.mark.parametrize("objective,leaves,l2,most_local", [("tweedie", 9, 0.0, 0), ("tweedie", 9, 0.0, 1 << 22), ("logistic", 5, 1.0, 0), ("squared", 31, 0.0, 1 << 22)])
def test_equals_the_plain_version(spark, monkeypatch, objective, leaves, l2, most_local):
    monkeypatch.setattr(boosting, "MOST_LOCAL", most_local)
    rng = np.random.default_rng(leaves)
    x = np.stack([rng.random(400), rng.integers(0, 6, 400), rng.normal(size=400), np.zeros(400)]).round(3)
    mean = np.exp(1.5 * x[0] + 0.3 * x[1] - 1)
    y = {"tweedie": rng.poisson(mean) * 1.0, "logistic": (rng.random(400) < mean / (1 + mean)) * 1.0, "squared": mean + rng.normal(0, 0.1, 400)}[objective]
    s = Settings(objective, rounds=6, leaves=leaves, rate=0.3, min_rows=7, l2=l2)
    names = [f"f{k}" for k in range(4)]
    model = fit(table(spark, x, y, 5), names, "y", s)
    score, sizes = plain(x, y, s, model.edges)
    assert [len(t.splits) + 1 for t in model.trees] == [len(z) for z in sizes if len(z) > 1]
    got = {r.id: r.prediction for r in model.predict(table(spark, x, y, 3)).collect()}
    assert [got[i] for i in range(400)] == pytest.approx(response(objective, score).tolist(), rel=1e-9)


def test_bins_beyond_255_values(spark):
    rng = np.random.default_rng(3)
    x = rng.random((1, 3000))
    y = (x[0] > 0.7) * 2.0
    model = fit(table(spark, x, y, 4), ["f0"], "y", Settings(rounds=40, leaves=4, rate=0.3))
    assert 200 < len(model.edges[0]) < 255
    got = {r.id: r.prediction for r in model.predict(table(spark, x, y, 2)).collect()}
    assert np.mean([abs(got[i] - y[i]) for i in range(3000)]) < 0.02


def test_shares_of_rows_and_features(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.random((5, 600))
    y = rng.poisson(np.exp(2 * x[0])) * 1.0
    s = Settings("tweedie", rounds=6, leaves=6, row_share=0.8, feature_share=0.6, seed=7)
    one = fit(table(spark, x, y, 2), [f"f{k}" for k in range(5)], "y", s)
    # By jobs, with the scores written out on the way, the trees are the same.
    monkeypatch.setattr(boosting, "MOST_LOCAL", 0)
    monkeypatch.setattr(boosting, "TREES_PER_STAGE", 4)
    two = fit(table(spark, x, y, 7), [f"f{k}" for k in range(5)], "y", s)
    assert [t.splits for t in one.trees] == [t.splits for t in two.trees] and len(one.trees) == 6
    for t, tree in enumerate(one.trees):
        allowed = tree_features(s, 5, t)
        assert len(allowed) == 3 and {x.feature for x in tree.splits} <= set(allowed)
    keys = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    assert abs(_drawn(keys, 0.8, 7, 0).mean() - 0.8) < 0.02 and (_drawn(keys, 0.8, 7, 0) != _drawn(keys, 0.8, 7, 1)).any()


def test_nothing_to_learn(spark):
    schema = "id long, f0 double, y double"
    empty = spark.createDataFrame([], schema)
    assert fit(empty, ["f0"], "y").trees == [] and fit(empty, ["f0"], "y").predict(empty).count() == 0
    same = spark.createDataFrame([(k, None if k % 2 else float("nan"), 3.0) for k in range(50)] + [(50, 1.0, None)], schema)
    model = fit(same, ["f0"], "y", Settings("tweedie"))
    assert model.trees == [] and {round(r.prediction, 9) for r in model.predict(same).collect()} == {3.0}
    with pytest.raises(ValueError):
        Settings("huber")


def test_a_saved_model_predicts_alike(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.random((2, 300))
    y = (x[0] + x[1] > 1) * 1.0
    rows = table(spark, x, y, 3)
    model = fit(rows, ["f0", "f1"], "y", Settings("logistic", rounds=5, leaves=4))
    model.save(spark, str(tmp_path / "model"))
    loaded = Model.load(spark, str(tmp_path / "model"))
    assert json.dumps(loaded.edges[0].tolist()) == json.dumps(model.edges[0].tolist()) and loaded.settings == model.settings
    assert sorted(loaded.predict(rows).collect()) == sorted(model.predict(rows).collect())


def test_gate_ablations_and_transfer(spark):
    rng = np.random.default_rng(6)
    names = ("a", "b")
    frame = lambda shift: spark.createDataFrame([(k, float(a), float(b), int(a + 0.1 * b > 0.5 + shift)) for k, (a, b) in enumerate(rng.random((400, 2)))], "id long, a double, b double, label int")
    train, test, other = frame(0), frame(0), frame(0.02)
    found = {r.dropped: r for r in models.ablations(train, test, names, rounds=15, min_rows=10).collect()}
    assert set(found) == {None, "a", "b"} and found[None].auc > 0.97 and found["b"].auc > 0.9 > 0.7 > found["a"].auc
    gate = models.fit_gate(train, names, rounds=15, min_rows=10)
    transferred = models.gate_quality(gate, other)
    assert transferred["auc"] > 0.9 and 0 <= transferred["brier"] < 0.25
    summary = models.gate_summary(models.gate_weight(gate, test), test, names).first()
    assert summary.corr_a > 0.6 > abs(summary.corr_b)


def test_auc_counts_ties_half(spark):
    rows = spark.createDataFrame([(k, p, y) for k, (p, y) in enumerate([(0.1, 0), (0.5, 1), (0.5, 0), (0.5, 1), (0.9, 1), (0.2, 1), (0.7, 0)])], "id long, f double, label int")
    scores = {k: p for k, p, _ in rows.collect()}
    wins = [(scores[a.id] > scores[b.id]) + 0.5 * (scores[a.id] == scores[b.id]) for a in rows.where("label = 1").collect() for b in rows.where("label = 0").collect()]

    class Fixed:
        def predict(self, df, name):
            return df.withColumn(name, df["f"])

    assert models.gate_quality(Fixed(), rows)["auc"] == pytest.approx(np.mean(wins))
    assert models.gate_quality(0.5, rows.where("label = 1"))["auc"] is None
