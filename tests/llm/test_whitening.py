"""Embedding whitening: the solver against LAPACK, the job against a plain
computation with exact integers, and edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import catalog
from pagewright.llm.whitening import bidiagonalise, dqds, principal, whiten

SF001 = "/root/testdata/sf0.001"


def cases():
    rng = np.random.default_rng(1)
    for trial in range(80):
        d, m = int(rng.integers(1, 50)), int(rng.integers(1, 120))
        a = rng.normal(size=(m, d)) * np.exp(rng.normal(size=d) * rng.choice([0, 1, 3]))
        if trial % 5 == 0:
            a[:, rng.integers(0, d)] = 0
        if trial % 7 == 0 and d > 3:
            a[:, 1] = a[:, 0]
        if trial % 11 == 0:  # all singular values alike
            basis = np.linalg.qr(rng.normal(size=(d, d)))[0]
            a = np.vstack([basis, -basis])
        if trial % 13 == 0:
            a = np.vstack([np.eye(d), -np.eye(d)]) * 3
        yield a - a.mean(axis=0)


def test_solver_against_lapack():
    for a in cases():
        d = a.shape[1]
        r = np.zeros((d, d))
        top = np.linalg.qr(a, mode="r")
        r[:len(top)] = top
        if not r.any():
            continue
        diagonal, above, right = bidiagonalise(r)
        assert np.allclose(right.T @ right, np.eye(d), atol=1e-13)
        both = np.diag(diagonal) + np.diag(above, 1)
        assert np.allclose(right @ both.T @ both @ right.T, r.T @ r, atol=1e-11 * np.linalg.norm(r) ** 2)
        plain = np.zeros(d)
        plain[:min(a.shape)] = np.linalg.svd(a, compute_uv=False)[:d]
        assert np.abs(np.sqrt(dqds(diagonal, above)) - plain).max() < 1e-12 * plain[0]
        values, z = principal(r, 16)
        k = z.shape[1]
        assert np.abs(z.T @ z - np.eye(k)).max() < 1e-10
        assert np.linalg.norm(a.T @ (a @ z) - z * values[:k]) < 1e-10 * values[0]
        white = a @ z / np.sqrt(values[:k])
        assert np.abs(white.T @ white - np.eye(k)).max() < 1e-8


def test_dqds_is_accurate_for_tiny_values():
    diagonal = np.array([1.0, 1e-5, 1e-9, 1e-14])
    exact = np.linalg.svd(np.diag(diagonal), compute_uv=False)
    assert np.allclose(np.sqrt(dqds(diagonal, np.zeros(3))), exact, rtol=1e-14)
    # a graded matrix: the product of the singular values is the determinant, to full relative accuracy
    got = np.sqrt(dqds(diagonal, diagonal[1:] * 0.5))
    assert np.prod(got) == pytest.approx(np.prod(diagonal), rel=1e-13)


def plain(rows, most=16):
    """{id: [(deviation, whitened...)]}, explained, of (id, vector) rows."""
    kept = [(i, [int(np.floor(float(c) * 64)) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(col) for col in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = []
    for i, x in kept:
        scaled = [n * a - s for a, s in zip(x, sums)]
        out.append((i, n, sum(a * a for a in scaled), (np.array(scaled) / n) @ v[:, :most] / np.sqrt(e[:most])))
    return out, e / e.sum(), e


def test_query_against_plain(spark):
    got = catalog.queries()["op12_whitening"](spark, SF001).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    want, explained, e = plain(rows)
    assert len(got) == 16 * len(want)
    white = {(r.vec_id, r.component): r for r in got}
    first = got[0]
    signs = [np.sign(white[want[0][0], c + 1].whitened * want[0][3][c]) for c in range(16)]
    for i, n, deviation, w in want:
        for c in range(16):
            r = white[i, c + 1]
            assert (r.n, r.deviation) == (n, deviation)
            assert r.whitened == pytest.approx(signs[c] * w[c], abs=1e-9)
            assert r.explained == pytest.approx(explained[c], rel=1e-10)
    assert first.identity_error < 1e-10 and len({r.identity_error for r in got}) == 1


def test_edges(spark):
    rows = [(1, [0.5, 1.0, -0.25]), (1, [0.5, 1.0, -0.25]), (2, [0.1, 0.2, 0.3]), (None, [0.9, -1.0, 2.0]),
            (3, None), (4, [0.5, None, 1.0]), (5, [0.5, float("nan"), 1.0]), (6, [float("inf"), 0.0, 0.0]), (7, []),
            (8, [1.0, 2.0]), (9, [1.0, -2.0, 0.5]), (10, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for c in ("x", "n", "dim", "id", "vector", "component", "part"):
        df = df.withColumn(c, F.lit("clash"))
    got = whiten(df).collect()
    assert sorted({r.vec_id for r in got if r.vec_id is not None}) == [1, 2, 9]
    assert len(got) == 5 * 3 and {r.n for r in got} == {4}
    usable = [(i, v) for i, v in rows if i in (1, 2, None, 9)]
    want = {(i, round(w, 9)) for i, _, _, ws in plain(usable, 3)[0] for w in np.abs(ws)}
    assert {(r.vec_id, round(abs(r.whitened), 9)) for r in got} == want
    assert whiten(df.limit(0)).count() == 0
    assert whiten(df.filter("vec_id = 1")).count() == 0  # one distinct vector: no variance
    flat = spark.createDataFrame([(i, [float(i), 7.0]) for i in range(5)], "vec_id bigint, embedding array<double>")
    assert {r.component for r in whiten(flat).collect()} == {1}  # a constant dimension has no component
    huge = spark.createDataFrame([(i, [float(i * 2 ** 50), 1.0 * i * i]) for i in range(5)],
                                 "vec_id bigint, embedding array<double>")
    assert all(r.deviation is None or r.deviation >= 0 for r in whiten(huge).collect())


def test_many_blocks_agree_with_one(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=6) * [5, 4, 3, 2, 1, 0.5]]) for i in range(3000)]
    one = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    a = {(r.vec_id, r.component): abs(r.whitened) for r in whiten(one.repartition(40)).collect()}
    b = {(r.vec_id, r.component): abs(r.whitened) for r in whiten(one.coalesce(1)).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9
