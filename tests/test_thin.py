"""Transport from few seeds to more vectors than a task solves: against dense plans, and without a job per half step."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import thin
from assayer.operators import transport as T


@pytest.fixture
def sets(spark, monkeypatch):
    r = np.random.default_rng(1)
    x, y = r.normal(size=(300, 16)), r.normal(size=(9, 16)) + 0.2
    x[100:160], x[200:230], x[250:280] = x[:60], x[5:35] + 0.05 * r.normal(size=(30, 16)), x[5]
    monkeypatch.setattr(T, "plan_costs", lambda *a, **k: pytest.fail("blocks with a job per half step"))
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, emb array<double>")
    return T._unit(x), T._unit(y), frame(x), frame(y)


def exact(x, y, reg):
    cost = lambda a, b: T.plan_cost(a, b, reg, 20_000, 1e-12)
    return cost(y, x) - cost(x, x) / 2 - cost(y, y) / 2


def test_calibration_of_few_seeds(sets):
    x, y, generated, seeds = sets
    got, small = (T.calibrated(generated, seeds, boots=3, reg=0.02, most=most).first() for most in (50, 1000))
    assert got.raw == pytest.approx(exact(x, y, 0.02), abs=1e-8) and got.near == pytest.approx(small.near, abs=1e-9)
    assert got.far == pytest.approx(small.far, abs=0.05) and 0 <= got.low <= got.score <= 1 and got.low <= got.high <= 1


def test_raw_cost_of_few_seeds(sets):
    x, y, generated, seeds = sets
    assert T.raw(generated, seeds, 0.01, most=50).first().raw == pytest.approx(exact(x, y, 0.01), abs=1e-8)


@pytest.mark.parametrize("together", [2_000, 20])
def test_components_are_solved_in_tasks(spark, monkeypatch, together):
    """Only components larger than a task solves take a job per round; the costs are those of the whole set's dense plan."""
    r = np.random.default_rng(5)
    base = T._unit(r.normal(size=(12, 24)))
    # Eleven clusters of six, and a chain whose ends have no pair.
    angles = np.linspace(0, 1.5, 40)
    chain = np.cos(angles)[:, None] * base[11] + np.sin(angles)[:, None] * T._unit(base[:1] - (base[0] @ base[11]) * base[11])
    x = T._unit(np.vstack([np.repeat(base[:11], 6, 0) + 0.02 * r.normal(size=(66, 24)), chain]))
    a = np.stack([np.full(len(x), 1 / len(x)), r.integers(0, 3, len(x)) / len(x)], 1)
    sets = spark.createDataFrame([("made", i, v.tolist(), w.tolist()) for i, (v, w) in enumerate(zip(x, a, strict=True))], "grp string, id long, emb array<double>, w array<double>")
    made, plain = [], thin.written
    monkeypatch.setattr(thin, "written", lambda df, name: made.append(name) or plain(df, name))
    monkeypatch.setattr(thin, "TOGETHER", together, raising=False)
    got = {r.solve: r.cost for r in thin.self_costs(sets, len(x), [("raw", "made", 0), ("ci", "made", 1)], 0.01).collect()}
    assert got["raw"] == pytest.approx(T.plan_cost(x, x, 0.01, 20_000, 1e-12), abs=1e-8)
    drawn = np.repeat(x, np.rint(a[:, 1] * len(x)).astype(int), 0)
    scale = len(drawn) / len(x)
    assert got["ci"] == pytest.approx(scale * T.plan_cost(drawn, drawn, 0.01, 20_000, 1e-12), abs=1e-6)
    assert ("nodes" in made) == (together < 40)


def test_draws_are_not_broadcast(spark, sets, monkeypatch):
    """Spark takes the draws of all replicates for as few as the range that they are made of."""
    _, _, generated, seeds = sets
    plans, plain = {}, T.written
    monkeypatch.setattr(T, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and plain(df, name))
    T.calibrated(generated, seeds, boots=2, reg=0.02, most=50).collect()
    assert "SortMergeJoin" in plans["sets"] and "BroadcastHashJoin" not in plans["sets"]


def test_random_directions_are_the_same_draws(spark):
    solves = spark.createDataFrame([("far/0",), ("far/1",)], "grp string")
    every = solves.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(29)))).select("grp", F.col("id").cast("long").alias("id"))
    number = lambda k: T._normal(F.xxhash64(F.lit(42), "grp", "id", k), F.xxhash64(F.lit(43), "grp", "id", k))
    asked = {(r.grp, r.id): r.emb for r in every.select("grp", "id", F.transform(F.sequence(F.lit(0), F.lit(6)), number).alias("emb")).collect()}
    got = {(r.grp, r.id): r.emb for r in T._random(solves, 30, 7, 42).collect()}
    assert got.keys() == asked.keys()
    for key, emb in got.items():
        assert np.allclose(emb, np.array(asked[key]) / np.linalg.norm(asked[key]), atol=1e-12)


def test_random_directions_meet_only_where_they_may_cost(spark, monkeypatch):
    """Of many dimensions no pair of random directions is looked for; the values are those of dense plans that have all pairs."""
    assert thin.none_between(10**7, 64, 0.01) and not thin.none_between(300, 16, 0.02) and not thin.none_between(300, 3, 0.001)
    r = np.random.default_rng(3)
    x, y = T._unit(r.normal(size=(120, 64))), T._unit(r.normal(size=(6, 64)))
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, emb array<double>")
    met, plain = [], thin.self_costs
    monkeypatch.setattr(thin, "self_costs", lambda sets, *a: met.extend(v.grp for v in sets.select("grp").distinct().collect()) or plain(sets, *a))
    got = [v.value for v in T._solved(frame(x), frame(y), [("raw", 0), ("far", 0)], 0.01, 42, 50, 1024).collect()]
    random = [v.emb for v in T._random(spark.createDataFrame([("far/0",)], "grp string"), 120, 64, 42).orderBy("id").collect()]
    assert got == pytest.approx([exact(x, y, 0.01), exact(T._unit(np.array(random)), y, 0.01)], abs=1e-8)
    assert met == ["made"]


def test_larger_components_are_solved_by_bands(spark, monkeypatch):
    """A near copy of one vector after another: one component, of which a task holds some rows at a time, and no job per round."""
    assert thin.TOGETHER >= 8_000
    r = np.random.default_rng(7)
    x = T._unit(r.normal(size=24) + 0.05 * r.normal(size=(50, 24)))
    sets = spark.createDataFrame([("made", i, v.tolist(), [1 / 50]) for i, v in enumerate(x)], "grp string, id long, emb array<double>, w array<double>")
    made, plain = [], thin.written
    monkeypatch.setattr(thin, "written", lambda df, name: made.append(name) or plain(df, name))
    monkeypatch.setattr(thin, "HELD", 10)
    monkeypatch.setattr(thin, "BAND", 7)
    got = thin.self_costs(sets, len(x), [("raw", "made", 0)], 0.01).first().cost
    assert got == pytest.approx(T.plan_cost(x, x, 0.01, 20_000, 1e-12), abs=1e-8) and "nodes" not in made
