import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import network as net
from tidewatch.operators import sampling
from tidewatch.plans import train_ae as ta
from tidewatch.plans.train_gmm import fit_mixture, mixture_step


def small(seed=0):
    layers = net.fresh_network(3, [5, 4], 2, seed)
    rng = np.random.default_rng(seed)
    for layer in layers:
        layer["bias"] = rng.normal(0, 0.3, layer["bias"].shape)
        if "gamma" in layer:
            layer["mean"], layer["var"] = rng.normal(0, 0.2, layer["mean"].shape), rng.uniform(0.5, 2, layer["var"].shape)
    return layers


@pytest.mark.parametrize("training", [True, False])
def test_gradient_matches_finite_differences(training):
    layers, x = small(), np.random.default_rng(1).normal(size=(7, 3))
    theta = net.pack(layers)

    def loss(t):
        y, _, _ = net.gradient(net.unpack(layers, t), x, lambda y: y * 0, training)
        return float((y**2).sum())

    _, g, _ = net.gradient(layers, x, lambda y: 2 * y, training)
    for i in range(0, len(theta), 5):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        assert g[i] == pytest.approx((loss(theta + step) - loss(theta - step)) / 2e-6, abs=2e-4)


def test_squared_gradient_is_the_sum_over_rows():
    layers, x = small(), np.random.default_rng(2).normal(size=(6, 3))
    _, g, _ = net.gradient(layers, x, lambda y: 2 * y, False, squared=True)
    rows = [net.gradient(layers, x[i : i + 1], lambda y: 2 * y, False)[1] ** 2 for i in range(6)]
    assert np.allclose(g, np.sum(rows, axis=0))


def test_size_of_the_standard_network():
    layers = net.fresh_network(18)
    assert len(net.pack(layers)) == 13_182
    assert sum(layer["kernel"].size for layer in layers) == 12_192


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 2)) @ rng.normal(size=(2, 3)) + 0.05 * rng.normal(size=(600, 3))
    df = spark.createDataFrame([(str(i), *map(float, r)) for i, r in enumerate(base)], "uid string, a double, b double, c double")
    return sampling.train_val_split(df, uid="uid")


def test_training_reduces_the_error_and_restores_the_best(data):
    table = ta.training_table(data, ["a", "b", "c"], 600, "uid", partitions=3)
    start = net.fresh_network(3, [8], 4, 1)
    out = ta.train_ae(table, start, epochs=12, batch=32, rate=5e-3)
    first, best = out.history[0]["val_recon_loss"], min(h["val_loss"] for h in out.history)
    assert best < first * 1.01 and out.history[-1]["recon_loss"] < out.history[0]["recon_loss"]
    again = ta.train_ae(table, start, epochs=12, batch=32, rate=5e-3)
    assert np.allclose(net.pack(out.layers), net.pack(again.layers))
    assert out.history_table(data.sparkSession).count() == len(out.history)


def test_early_stop(data):
    table = ta.training_table(data, ["a", "b", "c"], 600, "uid", partitions=2)
    out = ta.train_ae(table, net.fresh_network(3, [4], 2, 1), epochs=50, batch=64, rate=0.0, patience=2, l1=False)
    assert len(out.history) < 50 or out.history[-1]["val_recon_loss"] <= out.history[0]["val_recon_loss"]


def test_guarded_training_holds_important_weights(data):
    table = ta.training_table(data, ["a", "b", "c"], 600, "uid", partitions=2)
    start = net.fresh_network(3, [6], 3, 2)
    theta = net.pack(start)
    free = ta.train_ae(table, start, epochs=3, batch=32, rate=1e-3, l1=False, omega=np.ones_like(theta), strength=0.0)
    plain = ta.train_ae(table, start, epochs=3, batch=32, rate=1e-3, l1=False)
    held = ta.train_ae(table, start, epochs=3, batch=32, rate=1e-3, l1=False, omega=np.ones_like(theta), strength=1e6)

    def moved(t):
        return np.abs(net.pack(t.layers) - theta).max()

    assert np.allclose(net.pack(free.layers), net.pack(plain.layers))
    assert moved(held) < moved(free)


def test_importance_matches_numpy(spark, data):
    layers = small()
    x = np.array([[r.a, r.b, r.c] for r in data.select("a", "b", "c").collect()])
    _, g, _ = net.gradient(layers, x, lambda y: 2 * y, False)
    got = ta.importance(data.repartition(3), ["a", "b", "c"], layers, "uid", normalize=False)
    assert np.allclose(got, g**2 / len(x), rtol=1e-8)
    unit = ta.importance(data, ["a", "b", "c"], layers, "uid", n=100)
    assert unit.max() == pytest.approx(1.0)
    rowwise = ta.importance(data, ["a", "b", "c"], layers, "uid", normalize=False, per_row=True)
    assert np.allclose(rowwise, net.gradient(layers, x, lambda y: 2 * y, False, squared=True)[1] / len(x))


def test_mixture_fit(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal([0, 0], [0.5, 1.0], (400, 2)), rng.normal([6, 3], [1.0, 0.3], (200, 2))])
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "errors array<double>").repartition(3)
    w, means, covs, trace = fit_mixture(df, k=2, max_iter=50, tolerance=1e-9)
    assert all(b >= a - 1e-7 for a, b in zip(trace, trace[1:]))
    order = np.argsort(means[:, 0])
    assert np.allclose(w[order], [2 / 3, 1 / 3], atol=0.01)
    assert np.allclose(means[order], [[0, 0], [6, 3]], atol=0.2)
    near = x[:400]
    assert np.allclose(covs[order][0], np.cov(near.T), atol=0.1)
    log_density = net.Mixture(w, means, covs).log_density(x).mean()
    assert log_density == pytest.approx(trace[-1], abs=1e-6)
    with pytest.raises(ValueError):
        fit_mixture(df.limit(3), k=5)


def test_mixture_of_components_far_apart(spark):
    """Spreads of 0.01 survive means a million apart."""
    rng = np.random.default_rng(4)
    where = [[0.0, 0.0], [1e6, -1e6], [3e6, 5e5]]
    x = np.concatenate([rng.normal(m, [0.01, 0.02], (300, 2)) for m in where])
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "errors array<double>").repartition(4)
    w, means, covs, _ = fit_mixture(df, k=3, max_iter=20, ridge=1e-12)
    order = np.argsort(means[:, 0])
    for j, part in zip(order, np.split(x, 3), strict=True):
        assert np.allclose(means[j], part.mean(0), rtol=1e-12)
        assert np.allclose(covs[j], np.cov(part.T, bias=True), rtol=1e-3, atol=1e-8)
    assert np.allclose(w, 1 / 3)


def test_mixture_step_equals_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 3, (500, 3))
    weights, means = np.array([0.3, 0.7]), np.array([[1.0, 0, 0], [-1, 2, 0]])
    covs = np.array([np.eye(3) * 4, np.eye(3) + 0.5])
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "e array<double>").repartition(5)
    got = mixture_step(df, weights, means, covs, ridge=0.1)
    logs = np.stack([np.log(w) - 0.5 * (np.linalg.slogdet(2 * np.pi * c)[1] + np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m))
                     for w, m, c in zip(weights, means, covs, strict=True)], 1)
    density = np.logaddexp(*logs.T)
    r = np.exp(logs - density[:, None])
    new = r.T @ x / r.sum(0)[:, None]
    assert np.allclose(got[0], r.mean(0)) and np.allclose(got[1], new) and got[3] == pytest.approx(density.mean())
    for j in range(2):
        assert np.allclose(got[2][j], ((x - new[j]).T * r[:, j]) @ (x - new[j]) / r[:, j].sum() + 0.1 * np.eye(3))
