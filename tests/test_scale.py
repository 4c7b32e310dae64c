"""What grows beyond a task: ranks of combinations, curves by break points, percentiles by digits, sums and spectra by group, transport in blocks."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import labels as L
from assayer.operators import coverage as C
from assayer.operators import pairwise as P
from assayer.operators import spherical as S
from assayer.operators import transport as T


def test_gaps_are_what_is_not_observed(spark):
    r = random.Random(1)
    values = {"a": ["x", "y", "z"], "b": ["p"], "c": [str(i) for i in range(7)], "d": ["k", "l", "m", "n"]}
    every = list(itertools.product(*(sorted(v) for v in values.values())))
    space = C.Space(values)
    for share in (0, 0.02, 0.5, 1):
        seen = [c for c in every if r.random() < share]
        counts = spark.createDataFrame([(*c, r.randint(1, 4)) for c in seen] + [("no", "p", "1", "k", 9)], "a string, b string, c string, d string, n long")
        counts = counts.persist()
        enough = {c[:4] for c in counts.where("n >= 2").collect()}
        want = [c for c in every if c not in enough]
        assert sorted(map(tuple, C.missing(space, counts, 2).collect())) == want
        assert list(map(tuple, C.missing(space, counts, 2, most=5).orderBy(*values).collect())) == want[:5]
        one = C.completeness(space, counts, 2).first()
        assert (one.expected, one.observed) == (84, 84 - len(want))
        sizes = {x.n: x.groups for x in C.group_sizes(space, counts).collect()}
        assert sum(sizes.values()) == 84 and sizes.get(0, 0) == 84 - len(seen)


@pytest.mark.parametrize("dims, kind", [(10, "long"), (20, "decimal(38,0)")])
def test_large_spaces_are_not_listed(spark, dims, kind):
    columns = [f"c{i}" for i in range(dims)]
    space = C.Space({c: [f"v{k:02}" for k in range(20)] for c in columns})
    assert (space.expected, space.kind) == (20**dims, kind)
    rows = [tuple(f"v{(i * k) % 20:02}" for k in range(dims)) + (1 + i,) for i in range(20)]
    counts = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns) + ", n long")
    one = C.completeness(space, counts).first()
    assert (int(one.expected), one.observed) == (20**dims, 20)
    first = C.missing(space, counts, most=3).orderBy(*columns).collect()
    assert [r[-1] for r in first] == ["v01", "v02", "v03"] and all(set(r[:-1]) == {"v00"} for r in first)
    gaps = space.gaps(space.ranked(counts).select("rank")).agg(F.sum(F.col("past").cast("decimal(38,0)") - F.col("first").cast("decimal(38,0)"))).first()[0]
    assert int(gaps) == 20**dims - 20
    total = {int(x.n): int(x.groups) for x in C.group_sizes(space, counts).collect()}
    assert total[0] == 20**dims - 20
    assert C.score_at(C.group_sizes(space, counts), 1).first().score == pytest.approx(1.0)


def test_exclusions_are_counted_without_listing(spark):
    r = random.Random(3)
    values = {"a": ["x", "y (so)", "1"], "b": ["1", "2", "x"], "c": ["1", "x", "’q’"]}
    space, columns = C.Space(values), list(values)
    every = spark.createDataFrame(list(itertools.product(*values.values())), "a string, b string, c string")
    for _ in range(12):
        rules = [r.choices(["x", "y", "1", "2", "'q'", "none"], k=r.randint(1, 3)) for _ in range(r.randint(1, 3))]
        table = spark.createDataFrame([(x,) for x in rules], "values array<string>")
        assert space.excluded(rules) == C.excluded(every, table, columns, keep=True).count(), rules
    assert L.canonical_text(" ‘a’ (b)") == "'a'"


def test_curve_by_break_points(spark):
    sizes = [0, 0, 0, 2, 2, 5, 9000]
    groups = spark.createDataFrame([(n,) for n in sizes], "n long")
    score = lambda k: sum(1 - min(n, k) / k for n in sizes) / len(sizes)
    curve = {r.k: r.score for r in C.curve(groups).collect()}
    assert curve.keys() == set(range(1, 9001)) and all(abs(curve[k] - score(k)) < 1e-12 for k in curve)
    assert {r.k: round(r.score, 12) for r in C.curve(groups, 3).collect()} == {k: round(score(k), 12) for k in (1, 2, 3)}
    few = spark.createDataFrame([(2,), (1,)], "n long")
    assert {r.k: r.score for r in C.curve(few, 4).collect()} == {1: 0.0, 2: 0.25, 3: 0.5, 4: 0.625}
    steps = [tuple(r)[:4] for r in C.curve_steps(C._sized(groups)).orderBy("from_k").collect()]
    assert steps == [(1, 2, 3, 0), (3, 5, 5, 4), (6, 9000, 6, 9)]
    assert C.curve(groups.where("false")).collect() == [] and C.weighted_median(C._sized(groups)).first()[1:] == (sum(sizes) / 7, 2.0)


def test_percentiles_by_digits(spark):
    r = np.random.default_rng(5)
    groups = {"mixed": r.normal(size=501) * 10.0 ** r.integers(-300, 300, 501), "ties": np.repeat([-1.5, 0.0, -0.0, 7.25], 60), "one": np.array([3.0]), "two": np.array([-2.0, 5.0]), "ends": np.array([-np.inf, 1.0, np.inf, 2.0])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("mixed", None), ("none", None)]
    df = spark.createDataFrame(rows, "grp string, x double").repartition(5)
    for p in (0.0, 0.1, 0.37, 0.5):
        small, large = ({x.grp: x.cut for x in S.percentiles(df, "x", p, whole).collect()} for whole in (10_000, 0))
        assert small.keys() == large.keys() == groups.keys()
        for g, v in groups.items():
            if g != "ends":
                assert (large[g], small[g]) == pytest.approx((np.percentile(v, 100 * p),) * 2, rel=1e-12)


@pytest.mark.parametrize("held", [10, 4_000_000])
def test_sums_and_spectra_by_group(spark, monkeypatch, held):
    monkeypatch.setattr(S, "HELD", held)
    r = np.random.default_rng(6)
    sizes = {"large": 40, "one": 1, "few": 4, "same": 12}
    x = {g: r.normal(size=(n, 6)) if g != "same" else np.tile(r.normal(size=6), (n, 1)) for g, n in sizes.items()}
    rows = [(g, i, row.tolist()) for g, m in x.items() for i, row in enumerate(m)] + [("few", 99, None)]
    df = spark.createDataFrame(rows, "grp string, id long, emb array<double>").repartition(4)
    unit = {g: m / np.linalg.norm(m, axis=1, keepdims=True) for g, m in x.items()}
    means = {q.grp: q for q in S.mean_vectors(df).collect()}
    assert means.keys() == sizes.keys()
    for g, m in unit.items():
        assert means[g].n == len(m) and np.allclose(means[g].mean, m.mean(0)) and means[g].std_max == pytest.approx(m.std(0).max(), abs=1e-9) and means[g].square == pytest.approx(1)
    found = {q.grp: (q.n, q.vendi) for q in S.vendi(df).collect()}
    for g, m in unit.items():
        e = np.linalg.eigvalsh(m @ m.T / len(m))
        e = e[e > 1e-14] / e[e > 1e-14].sum()
        assert found[g][0] == len(m) and found[g][1] == pytest.approx(np.exp(-(e * np.log(e)).sum()), abs=1e-6)


def test_transport_in_blocks(spark):
    r = np.random.default_rng(7)
    x, y = (r.normal(size=(n, 5)) + 0.5 for n in (60, 45))
    frame = lambda m, grp: spark.createDataFrame([(grp, i, v.tolist()) for i, v in enumerate(m)], "grp string, id long, emb array<double>")
    ux, uy = T._unit(x), T._unit(y)
    two = lambda a, b: frame(a, "p").unionByName(frame(b, "q"))
    costs = {q.grp: q.cost for q in T.plan_costs(two(x, y), two(y, y[:30]), 0.5, size=32).collect()}
    assert costs["p"] == pytest.approx(T.plan_cost(ux, uy, 0.5), abs=1e-6) and costs["q"] == pytest.approx(T.plan_cost(uy, uy[:30], 0.5), abs=1e-6)
    own = {q.grp: q.cost for q in T.plan_costs(frame(x, "p"), None, 0.5, size=32).collect()}
    assert own["p"] == pytest.approx(T.plan_cost(ux, ux, 0.5), abs=1e-6)


def test_calibration_in_blocks(spark):
    r = np.random.default_rng(8)
    s, g = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(n, 4)) + 1)], "id long, emb array<double>") for n in (30, 40))
    small = T.raw(g, s, 1.0).first().raw
    got = T.calibrated(g, s, boots=1, reg=1.0, most=20, size=32).first()
    assert got.raw == pytest.approx(small, abs=1e-6)
    assert 0 <= got.near < got.far and 0 <= got.low <= got.score <= 1 and got.low <= got.high <= 1
