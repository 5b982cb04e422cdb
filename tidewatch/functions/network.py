"""Autoencoder and mixture arithmetic on numpy blocks, as used inside Spark tasks.

A network is a list of layers, each a dict with ``kernel`` and ``bias`` and, for
normalised layers, ``gamma``, ``beta``, ``mean`` and ``var``.  Every layer but the
last is followed by ReLU.
"""

from __future__ import annotations

import numpy as np

# Architecture and training constants.
ENCODER = [64, 48, 24, 18]
LATENT = 16
BN_EPS, BN_MOMENTUM = 1e-3, 0.99
L1_KERNEL = 1e-5
ADAM_B1, ADAM_B2, ADAM_EPS, CLIP_NORM = 0.9, 0.999, 1e-7, 1.0

TRAINABLE = ("kernel", "bias", "gamma", "beta")
MOVING = ("mean", "var")


def fresh_network(dim: int, encoder=None, latent: int = LATENT, seed: int = 42) -> list[dict]:
    """Mirrored autoencoder with uniform Glorot kernels."""
    encoder = ENCODER if encoder is None else list(encoder)
    rng = np.random.default_rng(seed)
    sizes = [dim, *encoder, latent, *reversed(encoder), dim]
    layers = []
    for i, (n_in, n_out) in enumerate(zip(sizes, sizes[1:])):
        limit = np.sqrt(6.0 / (n_in + n_out))
        layer = {"kernel": rng.uniform(-limit, limit, (n_in, n_out)), "bias": np.zeros(n_out)}
        if i < len(sizes) - 2:
            layer |= {"gamma": np.ones(n_out), "beta": np.zeros(n_out), "mean": np.zeros(n_out), "var": np.ones(n_out)}
        layers.append(layer)
    return layers


def pack(layers: list[dict], names=TRAINABLE) -> np.ndarray:
    parts = [layer[n].ravel() for layer in layers for n in names if n in layer]
    return np.concatenate(parts) if parts else np.empty(0)


def unpack(layers: list[dict], vector: np.ndarray, names=TRAINABLE) -> list[dict]:
    """A copy of ``layers`` with the named arrays taken from ``vector``."""
    out, at = [], 0
    for layer in layers:
        new = dict(layer)
        for n in names:
            if n in layer:
                size = layer[n].size
                new[n] = np.asarray(vector[at : at + size]).reshape(layer[n].shape)
                at += size
        out.append(new)
    return out


def variable_slices(layers: list[dict]) -> list[slice]:
    out, at = [], 0
    for layer in layers:
        for n in TRAINABLE:
            if n in layer:
                out.append(slice(at, at + layer[n].size))
                at += layer[n].size
    return out


def kernel_mask(layers: list[dict]) -> np.ndarray:
    """1 at the kernel weights of the hidden layers."""
    parts = []
    for i, layer in enumerate(layers):
        for n in TRAINABLE:
            if n in layer:
                parts.append(np.full(layer[n].size, float(n == "kernel" and i < len(layers) - 1)))
    return np.concatenate(parts)


def reconstruct(layers: list[dict], x: np.ndarray) -> np.ndarray:
    """Inference pass with the moving statistics."""
    for i, layer in enumerate(layers):
        x = x @ layer["kernel"] + layer["bias"]
        if "gamma" in layer:
            x = (x - layer["mean"]) * (layer["gamma"] / np.sqrt(layer["var"] + BN_EPS)) + layer["beta"]
        if i < len(layers) - 1:
            x = np.maximum(x, 0.0)
    return x


def gradient(layers: list[dict], x: np.ndarray, d_out, training: bool, squared: bool = False):
    """Output, packed gradient of the trainables, and batch statistics per layer.

    ``d_out(y)`` is the derivative of the loss by the output.  ``squared`` sums the
    squares of the per-row gradients (rows are independent without batch statistics).
    """
    power = 2 if squared else 1
    tape, stats, h = [], [], x
    for i, layer in enumerate(layers):
        z = h @ layer["kernel"] + layer["bias"]
        norm = None
        if "gamma" in layer:
            mean, var = (z.mean(0), z.var(0)) if training else (layer["mean"], layer["var"])
            stats.append((mean, var))
            inv = 1.0 / np.sqrt(var + BN_EPS)
            norm = ((z - mean) * inv, inv)
            z = norm[0] * layer["gamma"] + layer["beta"]
        out = np.maximum(z, 0.0) if i < len(layers) - 1 else z
        tape.append((h, z, norm))
        h = out
    d, grads = d_out(h), []
    for i in range(len(layers) - 1, -1, -1):
        layer, (h_in, z, norm) = layers[i], tape[i]
        if i < len(layers) - 1:
            d = d * (z > 0)
        g = {}
        if norm is not None:
            x_hat, inv = norm
            g["gamma"], g["beta"] = ((d * x_hat) ** power).sum(0), (d**power).sum(0)
            d = d * layer["gamma"]
            d = inv * (d - d.mean(0) - x_hat * (d * x_hat).mean(0)) if training else inv * d
        g["kernel"], g["bias"] = (h_in**power).T @ d**power, (d**power).sum(0)
        d = d @ layer["kernel"].T
        grads.append(np.concatenate([g[n].ravel() for n in TRAINABLE if n in layer]))
    return h, np.concatenate(grads[::-1]), stats


def mae_gradient(x: np.ndarray):
    return lambda y: np.sign(y - x) / x.size


def clip_by_variable(grad: np.ndarray, slices: list[slice]) -> np.ndarray:
    for s in slices:
        norm = np.linalg.norm(grad[s])
        if norm > CLIP_NORM:
            grad[s] *= CLIP_NORM / norm
    return grad


class Adam:
    """Adam state over one packed vector."""

    def __init__(self, m: np.ndarray, v: np.ndarray, step: float, rate: float):
        self.m, self.v, self.step, self.rate = m.copy(), v.copy(), step, rate

    def update(self, theta: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.step += 1
        self.m += (1 - ADAM_B1) * (grad - self.m)
        self.v += (1 - ADAM_B2) * (grad * grad - self.v)
        rate = self.rate * np.sqrt(1 - ADAM_B2**self.step) / (1 - ADAM_B1**self.step)
        return theta - rate * self.m / (np.sqrt(self.v) + ADAM_EPS)


class Mixture:
    """Log-density of a full-covariance Gaussian mixture."""

    def __init__(self, weights, means, covs):
        self.weights, self.means = np.asarray(weights, float), np.asarray(means, float)
        k, d = self.means.shape
        self.whiten = [np.linalg.inv(np.linalg.cholesky(np.asarray(c, float).reshape(d, d))) for c in covs]
        log_det = np.array([np.log(np.diag(w)).sum() for w in self.whiten])
        with np.errstate(divide="ignore"):
            self.const = np.log(self.weights) + log_det - 0.5 * d * np.log(2 * np.pi)

    def component_logs(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.weights)))
        for j, (mean, w) in enumerate(zip(self.means, self.whiten)):
            z = (x - mean) @ w.T
            out[:, j] = self.const[j] - 0.5 * np.einsum("ij,ij->i", z, z)
        return out

    def log_density(self, x: np.ndarray, logs: np.ndarray | None = None) -> np.ndarray:
        logs = self.component_logs(x) if logs is None else logs
        top = logs.max(1)
        return top + np.log(np.exp(logs - top[:, None]).sum(1))
