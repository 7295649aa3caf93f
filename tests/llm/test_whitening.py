"""Whitening against numpy's own eigenvectors, and its edges."""
import numpy as np
import pandas as pd
import pytest

from beatwise.llm import whitening

SF = "/root/testdata/sf0.001"


def whole(frame):
    return frame.toPandas().sort_values(["vec_id", "component"]).reset_index(drop=True)


def by_definition(vectors):
    x = np.floor(64 * np.asarray(vectors, "float64")).astype("int64") + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return [sum(int(d) ** 2 for d in row) for row in n * x.astype(object) - s], c @ (u / np.sqrt(e)), e / e.sum()


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = whole(whitening.whiten(rows))
    have = rows.toPandas().sort_values("vec_id")
    deviation, want, explained = by_definition(np.stack(have["embedding"]))
    k = 32
    assert len(got) == len(have) * k and got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1
    assert [int(d) for d in got["deviation"][::k]] == deviation
    w = got["whitened"].to_numpy().reshape(-1, k)
    signs = np.sign((w * want[:, :k]).sum(0))
    assert np.abs(w - signs * want[:, :k]).max() < 1e-6
    assert np.allclose(got["explained"][:k], explained[:k], rtol=1e-9)


def test_factor_and_rotations():
    rng = np.random.default_rng(5)
    for d, rank in ((1, 1), (2, 2), (7, 4), (33, 33), (40, 11)):
        b = rng.normal(size=(d, rank)) * 10.0 ** -np.arange(rank).clip(0, 3)
        v = b @ b.T
        order, low = whitening.pivoted_cholesky(v)
        assert low.shape == (d, rank) and np.allclose(low @ low.T, v[np.ix_(order, order)])
        assert np.allclose(np.triu(low[:rank], 1), 0)
        turned = whitening.rotated(low)
        cross = turned.T @ turned
        norms = np.sqrt(np.diag(cross))
        assert np.abs(cross / norms / norms[:, None] - np.eye(rank)).max() < 1e-13
        values, vectors = whitening.eigen(v)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-9) and np.allclose(vectors @ np.diag(values) @ vectors.T, v)
    assert whitening.eigen(np.zeros((3, 3)))[0].size == 0


def test_whitening_edges(spark):
    nan, schema = float("nan"), "vec_id long, embedding array<float>, n string, component string"
    rng = np.random.default_rng(2)
    good = [(i, [float(a) for a in rng.normal(size=3)] + [0.5, 0.5], "n", "c") for i in range(30)]
    bad = [(90, None, "n", "c"), (91, [1.0, None, 1.0, 1.0, 1.0], "n", "c"), (92, [nan] * 5, "n", "c"), (93, [float("-inf")] * 5, "n", "c"), (94, [], "n", "c")]
    got = whole(whitening.whiten(spark.createDataFrame(good + bad + good[:2] + [(None, good[4][1], "n", "c"), (95, [1.0], "n", "c")], schema)))
    # Two constant dimensions: three components; the one row of another length has no variance.
    assert len(got) == 33 * 3 and set(got["n"]) == {33} and set(got["vec_id"].dropna()) == set(range(30)) and got["identity_error"].max() < 1e-9
    first = got[got["vec_id"] == 0]
    assert len(first) == 6 and first.groupby("component")["whitened"].nunique().eq(1).all()
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame(bad, schema)).count() == 0
    with pytest.raises(Exception, match="64-bit"):
        whitening.whiten(spark.createDataFrame([(1, [2.0 ** 41], "n", "c"), (2, [1.0], "n", "c")], schema))


def test_deviation_beyond_64_bits():
    fit = whitening.Fit(10 ** 12, np.array([3 * 10 ** 18]), np.ones(1), np.ones((1, 1)), 1.0, 4_000_000)
    far = whitening._centred(np.array([[4_000_000]]), fit)
    assert int((far * far).sum()) == (4 * 10 ** 18 - 3 * 10 ** 18) ** 2 and isinstance(pd.Series(far[0]).iat[0], int)
