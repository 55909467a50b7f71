"""Moments, the Frechet distance, structural similarity and spectra against numpy on whole tables and made-up ones."""

import numpy as np
import pytest

from orrery.operators.fidelity import ag29_frechet_distance, moments, root_trace, structural_similarity
from orrery.operators.spectra import dominant, shape


def frechet(x, y):
    s, t = np.cov(x, rowvar=False), np.cov(y, rowvar=False)
    w = np.linalg.eigvals(s @ t)
    d = x.mean(0) - y.mean(0)
    return d @ d + np.trace(s + t) - 2 * np.sqrt(np.maximum(w.real, 0)).sum()


def test_frechet_on_the_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x, y = (np.array([r.embedding for r in rows if r.vec_id % 2 == k], float) for k in (0, 1))
    got = ag29_frechet_distance(spark, sf_dir).first()
    assert (got.n_a, got.n_b, got.vectors) == (len(x), len(y), len(rows)) and got.frechet == pytest.approx(frechet(x, y), abs=1e-5)


def test_moments_far_from_zero(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 1, (500, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    rows = [("a" if i % 3 else "b", [float(c) for c in v]) for i, v in enumerate(x)] + [("a", None)]
    got = moments(spark.createDataFrame(rows, "arm string, v array<double>").repartition(7))
    for arm, keep in (("a", np.arange(500) % 3 > 0), ("b", np.arange(500) % 3 == 0)):
        n, mean, cov = got[arm]
        assert n == keep.sum() and np.allclose(mean, x[keep].mean(0)) and np.allclose(cov, np.cov(x[keep], rowvar=False), atol=1e-6)
    assert moments(spark.createDataFrame([], "arm string, v array<double>")) == {}
    a, b = np.cov(rng.normal(size=(4, 9)), rowvar=False), np.cov(rng.normal(size=(30, 9)), rowvar=False)  # one of them singular
    assert root_trace(a, b) == pytest.approx(np.sqrt(np.maximum(np.linalg.eigvals(a @ b).real, 0)).sum(), abs=1e-6)


def test_structural_similarity(spark):
    rng = np.random.default_rng(4)
    frames = {k: (rng.integers(0, 256, (12, 15)).astype(float), rng.integers(0, 256, (12, 15)).astype(float)) for k in range(3)}
    frames[3] = (frames[0][0], frames[0][0].copy())
    rows = [(k, y, x, float(a[y, x]), float(b[y, x])) for k, (a, b) in frames.items() for y in range(12) for x in range(15)]
    got = {r.frame: r.ssim for r in structural_similarity(spark.createDataFrame(rows, "frame int, y int, x int, a double, b double"), ["frame"], 12, 15).collect()}
    for k, (a, b) in frames.items():
        each = []
        for y in range(3, 9):
            for x in range(3, 12):
                p, q = a[y - 3 : y + 4, x - 3 : x + 4].ravel(), b[y - 3 : y + 4, x - 3 : x + 4].ravel()
                c = np.cov(p, q)
                each.append((2 * p.mean() * q.mean() + 6.5025) * (2 * c[0, 1] + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (c[0, 0] + c[1, 1] + 58.5225)))
        assert got[k] == pytest.approx(np.mean(each))
    assert got[3] == pytest.approx(1.0)


def test_spectrum():
    i = np.arange(200)
    hz, share = dominant(3 + 0.2 * i + np.sin(2 * np.pi * 1.5 * i / 10))  # a trend hides nothing
    assert hz == 1.5 and share > 0.6
    assert dominant(np.ones(50)) == (0.0, 0.0) == dominant(np.arange(15.0)) and dominant(np.arange(99.0)) == (0.0, 0.0)
    assert abs(shape(np.sin(i)) - shape(5 + 2 * np.sin(i))).sum() < 1e-9
