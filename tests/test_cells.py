"""Blocks pruned by pivots and radii against all pairs at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import cells as K
from assayer.operators import pairwise as P
from assayer.store import _made, mark


def clustered(seed: int, n: int, centres: int, dims: int = 12, noise: float = 0.05) -> np.ndarray:
    r = np.random.default_rng(seed)
    return r.normal(size=(centres, dims))[r.integers(0, centres, n)] + noise * r.normal(size=(n, dims))


def frame(spark, groups: dict[str, np.ndarray]):
    rows = [(g, i, list(map(float, e))) for g, x in groups.items() for i, e in enumerate(x)]
    return spark.createDataFrame(rows, "grp string, id long, emb array<double>")


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)
    return np.clip(unit(x) @ unit(y).T, -1, 1)


def data() -> dict[str, np.ndarray]:
    """Clusters, noise, a third of all rows equal, vectors without a direction, a group too small for cells, groups of one and two vectors."""
    r = np.random.default_rng(5)
    hot = clustered(2, 300, 9)
    hot[::3] = hot[0]
    zeros = clustered(3, 200, 5)
    zeros[[3, 50, 51]] = 0
    return {"clusters": clustered(1, 400, 10), "noise": r.normal(size=(150, 12)), "hot": hot, "zeros": zeros, "small": clustered(4, 12, 2), "one": r.normal(size=(1, 12)), "two": r.normal(size=(2, 12))}


@pytest.mark.parametrize("threshold", [0.9, 0.2, -0.5])
def test_similar_pairs(spark, threshold):
    groups = data()
    got = P.similar_pairs(frame(spark, groups), threshold, size=16, pruned=0).collect()
    want = {(g, i, j) for g, x in groups.items() for i, j in zip(*np.nonzero(np.triu(cosines(x, x) > threshold, 1)), strict=True)}
    assert len(got) == len(want) and {(r.grp, r.id_a, r.id_b) for r in got} == want


def test_least_similarity(spark):
    groups = data()
    got = {r.grp: r for r in P.pair_statistics(frame(spark, groups), size=16, pruned=0).collect()}
    for g, x in groups.items():
        if len(x) > 1:
            s = cosines(x, x)[np.triu_indices(len(x), 1)]
            assert got[g].min_sim == pytest.approx(s.min(), abs=1e-12) and got[g].pairs == len(s) and got[g].mean_sim == pytest.approx(s.mean())


def test_novelty(spark):
    groups = data()
    seeds = {g: clustered(1 if g == "clusters" else 9, 90, 10) for g in groups if g != "small"}
    seeds["noise"][4] = 0
    got = {(r.grp, r.id): r for r in P.novelty(frame(spark, groups), frame(spark, seeds), size=16, pruned=0).collect()}
    assert {g for g, _ in got} == set(seeds)
    for g in seeds:
        d = 1 - cosines(groups[g], seeds[g])
        for i, row in enumerate(d):
            assert got[g, i].novelty_min == pytest.approx(row.min(), abs=1e-12) and got[g, i].novelty_avg == pytest.approx(row.mean())


def test_what_does_not_meet(spark):
    v = frame(spark, {"all": clustered(1, 2000, 20, 32, 0.02)}).persist()
    made = K.cells(v, K.block_counts(v, 32), 32)
    share = lambda met, y=made: K.share_met(met, made, y).first().share
    assert share(K.meetings(K.cell_pairs(made, made, K.above(0.95)), True)) < 0.2
    # The least similarity is that of few clusters, and the nearest seed of a cluster is within it.
    assert share(K.meetings(K.cell_pairs(made, made, K.farthest), True)) < 0.2
    seeds = K.cells(v.where("id % 4 = 0"), K.block_counts(v.where("id % 4 = 0"), 32), 32)
    assert share(K.meetings(K.cell_pairs(made, seeds, K.nearest), False), seeds) < 0.3
    assert made.blocks.agg(F.sum(F.size("items"))).first()[0] == 2000


def test_noise_meets_in_plain_blocks(spark):
    """Without clusters nothing can be left out: the pairs are those of all blocks, and the result the same."""
    x = np.random.default_rng(3).normal(size=(600, 24))
    got = P.similar_pairs(frame(spark, {"all": x}), 0.6, size=32, pruned=2)
    assert "meetings" not in "".join(got.inputFiles()) and got.count() == int((np.triu(cosines(x, x), 1) > 0.6).sum())
    y = clustered(1, 2000, 20, 32, 0.02)
    assert "meetings" in "".join(P.similar_pairs(frame(spark, {"all": y}), 0.99, size=32, pruned=2).inputFiles())


def test_no_rows(spark):
    none = frame(spark, {"a": np.ones((1, 3))}).where("id < 0")
    assert P.similar_pairs(none, 0.5, pruned=0).count() == 0 == P.novelty(none, none, pruned=0).count() == P.pair_statistics(none, pruned=0).count()


def test_blocks_of_cells_are_written_only_if_they_meet(spark):
    """Noise, whose blocks all meet, has those of cells neither shuffled nor written."""
    start, made = mark(), lambda: [path.rsplit("/", 1)[-1].split("-")[0] for _, path in _made[start:]]
    P.similar_pairs(frame(spark, {"all": np.random.default_rng(3).normal(size=(600, 24))}), 0.6, size=32, pruned=2)
    assert "placed" in made() and "blocks" not in made()
    P.similar_pairs(frame(spark, {"all": clustered(1, 2000, 20, 32, 0.02)}), 0.99, size=32, pruned=2)
    assert made().count("blocks") == 1
