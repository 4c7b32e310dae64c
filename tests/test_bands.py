"""Blocks meet in bands: how often they are sent, and that every pair still meets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import pairwise as P


@pytest.fixture
def sent(spark, monkeypatch):
    """Rows that are shuffled so that blocks meet, of each call."""
    seen, plain = [], P.each_pair
    monkeypatch.setattr(P, "each_pair", lambda rows, *a: seen.append(rows.count()) or plain(rows, *a))
    return seen


def vectors(spark, x: np.ndarray):
    return spark.createDataFrame([("all", i, list(map(float, e))) for i, e in enumerate(x)], "grp string, id long, emb array<double>")


def unit(seed: int, n: int = 600, dims: int = 8) -> np.ndarray:
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scored(spark, sent, name: str, tau: float, kernel) -> None:
    x = unit(1)
    got = P.dc_scores(vectors(spark, x), name, tau, size=12).first()
    k = kernel(x @ x.T)
    assert got.n == 600 and got.dc_score == pytest.approx(np.mean(np.exp(np.diag(k)) / np.exp(k).sum(1)), rel=1e-12)
    assert sent == [50 * 12]


def test_cs_sends_a_block_once_a_band(spark, sent):
    scored(spark, sent, "cs", 1.0, lambda s: s)
    zeros = np.vstack([unit(2, 40), np.zeros((3, 8))])
    for tau in (0.5, 0.01):
        k = zeros @ zeros.T / tau
        assert P.dc_scores(vectors(spark, zeros), "cs", tau, size=4).first().dc_score == pytest.approx(np.mean(1 / np.exp(k - np.diag(k)[:, None]).sum(1)), rel=1e-9)


def test_rbf_sends_a_block_once_a_band(spark, sent):
    scored(spark, sent, "rbf", 1.0, lambda s: np.exp(-(2 - 2 * s)))


def test_polynomial_sends_a_block_once_a_band(spark, sent):
    scored(spark, sent, "polynomial", 3.0, lambda s: (s / 8 + 1) ** 3)


@pytest.mark.parametrize("pruned", [10_000, 0])
def test_similar_pairs_send_a_block_once_a_band(spark, sent, pruned):
    """All blocks, and those of cells that meet."""
    x = unit(3)
    got = {(r.id_a, r.id_b) for r in P.similar_pairs(vectors(spark, x), 0.8, size=12, pruned=pruned).collect()}
    assert got == set(zip(*(a.tolist() for a in np.nonzero(np.triu(x @ x.T > 0.8, 1))), strict=True))
    # Of cells the lists of pairs are a row for each of the 78 pairs of bands.
    assert sent[0] <= (50 * 12 if pruned else 12 * 300 + 78)


def test_pairs_of_bands_wait_for_few_others(spark, monkeypatch):
    """The 78 pairs of bands of a group are not dealt to the session's 4 partitions."""
    x, seen, plain = unit(4), [], P.each_pair

    def dealt(*a):
        seen.append(plain(*a[:2], lambda grp, ids, x, other, y, same: (ids,), "id long", *a[4:]).groupBy(F.spark_partition_id()).agg(F.count_distinct("id").alias("n")).count())
        return plain(*a)

    monkeypatch.setattr(P, "each_pair", dealt)
    P.dc_scores(vectors(spark, x), "rbf", size=12).first()
    assert seen[0] > 50


@pytest.mark.parametrize("tau", [1.0, 3.0, 2.5, 12.0])
def test_powers_of_the_polynomial_kernel(monkeypatch, tau):
    """Whole powers take no general power, which costs twice the rest of the kernel."""
    x, y = unit(5, 40), unit(6, 30)
    assert np.allclose(P.kernel("polynomial", x, y, tau), (x @ y.T / 8 + 1) ** tau, rtol=1e-13, atol=0)
    if tau == 3.0:

        class Refusing(np.ndarray):
            def __pow__(self, other):
                raise AssertionError("general power")

        P.kernel("polynomial", x.view(Refusing), y, tau)


def test_rbf_kernel_of_any_length(spark):
    x, y = 3 * unit(7, 40), unit(8, 30)
    assert np.allclose(P.kernel("rbf", x, y, 0.7), np.exp(-0.7 * ((x[:, None] - y[None]) ** 2).sum(2)), rtol=1e-12, atol=0)


@pytest.mark.parametrize("pruned", [10_000, 0])
def test_similar_pairs_are_dealt_to_partitions_of_their_own(spark, monkeypatch, pruned):
    """All blocks, and those of cells that meet: two partitions a pair of bands, of the session's 4."""
    seen, plain = [], P.each_pair
    monkeypatch.setattr(P, "each_pair", lambda *a: seen.append(a[4:]) or plain(*a))
    P.similar_pairs(vectors(spark, unit(9)), 0.8, size=12, pruned=pruned).count()
    assert seen == [([288],)]


class Singly(np.ndarray):
    """Refuses products of whole blocks in double."""

    def __matmul__(self, other):
        assert self.dtype == np.float32
        return np.asarray(self) @ np.asarray(other)


@pytest.mark.parametrize("threshold", [0.9, 0.3])
def test_few_pairs_pass_by_a_product_in_single(threshold):
    """The pairs and cosines are those of the product in double, also where the cosine is off the threshold by less than single precision tells."""
    x, y = unit(10, 200, 64), unit(11, 150, 64)
    for k, off in enumerate((1e-9, -1e-9, 1e-12, -1e-12)):
        along = y[k] - (y[k] @ x[k]) * x[k]
        y[k] = (threshold + off) * x[k] + np.sqrt(1 - (threshold + off) ** 2) * along / np.linalg.norm(along)
    i, j, s = P.passing(x.view(Singly), y.view(Singly), threshold)
    want = x @ y.T
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(a.tolist() for a in np.nonzero(want > threshold)), strict=True)) >= {(0, 0), (2, 2)}
    assert np.allclose(s, want[i, j], rtol=0, atol=1e-14)


def test_many_pairs_pass():
    """More than the blocks have rows; copies, rows without a direction and rows that are not finite."""
    x = unit(12, 90, 3)
    x[10:40], x[50], x[51] = x[5], 0, np.nan
    for threshold in (-1.5, -0.2, 0.0, 0.95, 1.0):
        want = np.clip(x @ x.T, -1, 1)
        i, j, s = P.passing(x, x, threshold)
        near = np.abs(want - threshold) < 1e-14
        got = np.zeros_like(near)
        got[i, j] = True
        assert (got | near).tolist() == ((want > threshold) | near).tolist() and np.allclose(s, want[i, j], rtol=0, atol=1e-14)
