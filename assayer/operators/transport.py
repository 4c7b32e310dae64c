"""Entropic optimal transport between vector sets, and its calibration against near and far replicates.

Of small sets (`MOST` vectors a side, which is counted first) a replicate is a row: both sets go to the tasks as one broadcast row, and the solves
run in parallel, each with one matrix of costs. Of larger sets nothing is held whole: vectors are dealt to blocks, the potentials are a table
with a row per block, and each half step of the iteration is a log-sum-exp over pairs of blocks, which meet by a shuffle on (solve, block,
block); costs are worked out anew each time and never kept. All replicates are solved by the same jobs, a group each. Where only the seeds
are few, `thin` solves for their potentials alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import free_since, mark, written
from ..functions.vectors import normalized
from ..sources.tables import numbered
from . import thin
from .pairwise import BLOCK, blocks

MOST, BAND = 6_000, 256


def _softmin(c: np.ndarray, potential: np.ndarray, reg: float) -> np.ndarray:
    """Per row of c the log of the sum of exp((potential - c) / reg)."""
    out = np.empty(len(c))
    for at in range(0, len(c), BAND):
        m = (potential[None] - c[at : at + BAND]) / reg
        top = m.max(1, keepdims=True)
        np.exp(np.subtract(m, top, out=m), out=m)
        out[at : at + BAND] = top[:, 0] + np.log(m.sum(1))
    return out


def _plan_rows(c: np.ndarray, f: np.ndarray, g: np.ndarray, reg: float) -> Iterator[tuple[slice, np.ndarray]]:
    for at in range(0, len(c), BAND):
        rows = slice(at, at + BAND)
        yield rows, np.exp((f[rows, None] + g[None] - c[rows]) / reg)


def plan_cost(x: np.ndarray, y: np.ndarray, reg: float = 0.01, rounds: int = 1000, tol: float = 1e-9) -> float:
    """<P, C> of the entropic plan with uniform marginals, in the log domain. Of a set with itself the plan is symmetric: one
    potential, averaged with its update, settles in few rounds."""
    c = 1 - np.clip(x @ y.T, -1, 1)
    la, lb = -np.log(len(x)), -np.log(len(y))
    f, g = np.zeros(len(x)), np.zeros(len(y))
    for i in range(rounds):
        new = reg * (la - _softmin(c, g, reg))
        if x is y:
            done, f = np.abs(np.exp((f - new) / reg) - 1).max() < tol * len(x), (f + new) / 2
            g = f
            if done:
                break
            continue
        f = new
        g = reg * (lb - _softmin(c.T, f, reg))
        if i % 10 == 9 and max(np.abs(p.sum(1) - 1 / len(x)).max() for _, p in _plan_rows(c, f, g, reg)) < tol:
            break
    return float(sum((p * c[rows]).sum() for rows, p in _plan_rows(c, f, g, reg)))


def sinkhorn(x: np.ndarray, y: np.ndarray, reg: float = 0.01) -> float:
    """Debiased, 0 at least."""
    return max(0.0, plan_cost(x, y, reg) - plan_cost(x, x, reg) / 2 - plan_cost(y, y, reg) / 2)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)


# ---- sets of any size -----------------------------------------------------------------------------------------------------


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(grp, block, blocks, n, total, x), written, of vectors(grp, id, emb): x has the n unit vectors of a block, total is the group's n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                items = b.column(3)[i].values
                x = items.field("emb").flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, 1) for k in range(3)), pa.array([len(items)]), pa.array([x.tobytes()], pa.binary())], names=["grp", "block", "blocks", "n", "x"])

    packed = blocks(vectors, size).select("grp", "block", "blocks", "items").mapInArrow(run, "grp string, block long, blocks long, n long, x binary")
    packed = written(packed, "blocks")
    totals = packed.groupBy("grp").agg(F.sum("n").alias("total"))
    return written(packed.join(totals, "grp"), "blocks")


def _meet(x: DataFrame, y: DataFrame) -> DataFrame:
    """(grp, bx, by, left, right): each block of x with each block of y of its group."""
    of = lambda df: df.groupBy("grp").agg(F.max("blocks").alias("others"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1))
    left = x.join(of(y), "grp").select("grp", F.col("block").alias("bx"), every.alias("by"), F.struct(*(c for c in x.columns if c != "grp")).alias("left"))
    right = y.join(of(x), "grp").select("grp", every.alias("bx"), F.col("block").alias("by"), F.struct(*(c for c in y.columns if c != "grp")).alias("right"))
    return left.join(right, ["grp", "bx", "by"])


def _costs(left: dict, right: dict) -> np.ndarray:
    x, y = (np.frombuffer(side["x"]).reshape(side["n"], -1) for side in (left, right))
    return 1 - np.clip(x @ y.T, -1, 1)


def _each_pair(pairs: DataFrame, fn: Callable, out: str) -> DataFrame:
    """fn(left, right) -> the values of `out` for each pair of blocks, besides grp and the left block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                values = fn(b.column(2)[i].as_py(), b.column(3)[i].as_py())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *(pa.array([v]) for v in values)], names=["grp", "block", *(c.split()[0] for c in out.split(", "))])

    return pairs.select("grp", F.col("bx").alias("block"), "left", "right").mapInArrow(run, f"grp string, block long, {out}")


def _half_step(x: DataFrame, y: DataFrame, old: DataFrame, other: DataFrame, reg: float, mixed: bool) -> DataFrame:
    """(grp, block, f, off), written: the potentials of x's blocks, given the other side's and the old ones, and how far the old ones' marginal is off
    at most. mixed: the mean of old and new ones."""

    def part(left: dict, right: dict) -> tuple:
        m = (np.frombuffer(right["f"])[None] - _costs(left, right)) / reg
        top = m.max(1)
        return top.tobytes(), np.exp(m - top[:, None]).sum(1).tobytes(), left["total"], left["before"]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def row() -> pa.RecordBatch:
            (grp, block), (top, sums, total, before) = key, held
            f = reg * (-np.log(total) - top - np.log(sums))
            off = float(np.abs(np.exp((before - f) / reg) - 1).max()) / total
            f = (before + f) / 2 if mixed else f
            return pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([block]), pa.array([f.tobytes()], pa.binary()), pa.array([off])], names=["grp", "block", "f", "off"])

        for b in batches:
            for grp, block, top, sums, total, before in zip(*(c.to_pylist() for c in b.columns), strict=True):
                top, sums = np.frombuffer(top), np.frombuffer(sums)
                if (grp, block) != key:
                    if key:
                        yield row()
                    key, held = (grp, block), (top, sums, total, np.frombuffer(before))
                    continue
                high = np.maximum(held[0], top)
                held = high, held[1] * np.exp(held[0] - high) + sums * np.exp(top - high), total, held[3]
        if key:
            yield row()

    own = x.join(old.select("grp", "block", F.col("f").alias("before")), ["grp", "block"]).select("grp", "block", "blocks", "n", "total", "x", "before")
    others = y.join(other.select("grp", "block", "f"), ["grp", "block"]).select("grp", "block", "blocks", "n", "x", "f")
    parts = _each_pair(_meet(own, others), part, "top binary, sums binary, total long, before binary")
    return written(parts.repartition("grp", "block").sortWithinPartitions("grp", "block").mapInArrow(merged, "grp string, block long, f binary, off double"), "potentials")


def plan_costs(x: DataFrame, y: DataFrame | None = None, reg: float = 0.01, rounds: int = 1000, tol: float = 1e-9, size: int = BLOCK) -> DataFrame:
    """(grp, cost), written: <P, C> of the entropic plan between x(grp, id, emb) and y(grp, id, emb) of each group, or of x with itself.

    grp is a string, and a group has rows on both sides. The regularisation falls to `reg` in steps of about three, which start from the potentials
    of the step before; groups that have settled stay out of further rounds."""
    one = y is None
    x = _blocks(x, size)
    y = x if one else _blocks(y, size)
    zero = lambda b: b.select("grp", "block", F.expr("unhex(repeat('00', cast(8 * n as int)))").alias("f"))
    f, g = written(zero(x), "potentials"), written(zero(y), "potentials")
    steps = [reg]
    while steps[0] < 0.3:
        steps.insert(0, steps[0] * 3)
    for step in steps:
        last = step == reg
        settled: list[tuple[DataFrame, DataFrame]] = []
        for _ in range(rounds if last else min(rounds, 15)):
            point = mark()
            some = lambda b, at: b.join(at.select("grp").distinct(), "grp", "left_semi") if settled else b
            f = _half_step(some(x, f), some(y, g), f, g, step, one)
            off = {r.grp: r.off for r in f.groupBy("grp").agg(F.max("off").alias("off")).collect()}  # a row per solve
            done = [grp for grp, e in off.items() if e < tol]
            g = f if one else _half_step(some(y, g), some(x, f), g, f, step, False)
            free_since(point, f, g)
            if len(done) == len(off):
                break
            if done:
                is_done = F.col("grp").isin(done)
                settled.append((written(f.where(is_done), "settled"), written(g.where(is_done), "settled")))
                f, g = written(f.where(~is_done), "potentials"), written(g.where(~is_done), "potentials")
        for a, b in settled:
            f, g = f.unionByName(a), g.unionByName(b)
        if settled:
            f, g = written(f, "potentials"), written(g, "potentials")

    def cost(left: dict, right: dict) -> tuple:
        c = _costs(left, right)
        return (float((np.exp((np.frombuffer(left["f"])[:, None] + np.frombuffer(right["f"])[None] - c) / reg) * c).sum()),)

    with_f = lambda b, f: b.join(f.select("grp", "block", "f"), ["grp", "block"]).select("grp", "block", "blocks", "n", "x", "f")
    pairs = _each_pair(_meet(with_f(x, f), with_f(y, f if one else g)), cost, "cost double")
    return written(pairs.groupBy("grp").agg(F.sum("cost").alias("cost")), "costs")


def _drawn(numbered: DataFrame, n: int, solves: DataFrame, seed: Column) -> DataFrame:
    """(grp, id, emb): for each of solves(grp) n vectors of numbered(at, emb), with repetition."""
    draws = solves.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("grp", F.col("id").cast("long").alias("id"), F.pmod(F.xxhash64(seed, "grp", "id"), F.lit(n)).alias("at"))
    return draws.join(numbered, "at").select("grp", "id", "emb")


def _normal(a: Column, b: Column) -> Column:
    """A normal number from two hashes."""
    unit = lambda h: (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(unit(a))) * F.cos(2 * math.pi * unit(b))


def _solved_in_blocks(generated: DataFrame, seeds: DataFrame, specs: list[tuple[str, int]], reg: float, seed: int, size: int) -> DataFrame:
    """(kind, value) as `_solved` gives; draws come from hashes of (seed, solve, place)."""
    spark = generated.sparkSession
    sides = {}
    for name, v in (("seeds", seeds), ("made", generated)):
        all_ = v.select("id", F.col("emb").cast("array<double>").alias("emb"))
        sides[name] = written(numbered(all_).select(F.col("row_id").alias("at"), "emb"), name)
    n_s, n_g = (sides[k].count() for k in ("seeds", "made"))
    dims = len(sides["seeds"].first().emb)
    solves = spark.createDataFrame([(f"{kind}/{i}", kind) for kind, i in specs if kind == "raw" or (n_s if kind != "ci" else min(n_s, n_g)) > 1 or kind == "far"], "grp string, kind string")
    of = lambda *kinds: solves.where(F.col("kind").isin(*kinds)).select("grp")
    copy = lambda side, *kinds: sides[side].withColumn("grp", F.explode(F.array(*(F.lit(f"{k}/{i}") for k, i in specs if k in kinds)))).select("grp", F.col("at").alias("id"), "emb")
    kinds = {k for k, _ in specs}
    random = _random(of("far"), max(2, n_g), dims, seed)
    xs = [_drawn(sides["seeds"], n_s, of("near", "ci"), F.lit(seed))]
    ys = [_drawn(sides["seeds"], n_s, of("near"), F.lit(seed + 2)), _drawn(sides["made"], n_g, of("ci"), F.lit(seed + 3)), random]
    if kinds & {"raw", "far"}:
        xs.append(copy("seeds", *(kinds & {"raw", "far"})))
    if "raw" in kinds:
        ys.append(copy("made", "raw"))
    x, y = (written(reduce(DataFrame.unionByName, v), "sets") for v in (xs, ys))
    both, xx, yy = plan_costs(x, y, reg, size=size), plan_costs(x, None, reg, size=size), plan_costs(y, None, reg, size=size)
    value = F.greatest(F.lit(0.0), F.col("xy") - F.col("xx") / 2 - F.col("yy") / 2)
    found = both.withColumnRenamed("cost", "xy").join(xx.withColumnRenamed("cost", "xx"), "grp").join(yy.withColumnRenamed("cost", "yy"), "grp")
    asked = spark.createDataFrame([(f"{kind}/{i}", kind) for kind, i in specs], "grp string, kind string")
    without = F.when(F.col("kind") == "near", 0.0).otherwise(float("nan"))
    return asked.join(found.select("grp", value.alias("value")), "grp", "left").select("kind", F.coalesce("value", without).alias("value"))


def _random(solves: DataFrame, n: int, dims: int, seed: int) -> DataFrame:
    """(grp, id, emb): for each of solves(grp), a row each, n random unit vectors, from hashes of (seed, solve, place).

    A number is a row until a task puts the numbers of a vector, which follow one another, together: of rows, hashes are compiled."""
    every = solves.sparkSession.range(n).crossJoin(F.broadcast(solves))
    numbers = every.select("grp", "id", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("k"))
    normal = _normal(F.xxhash64(F.lit(seed), "grp", "id", "k"), F.xxhash64(F.lit(seed + 1), "grp", "id", "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            b = b if rest is None else pa.concat_batches([rest, b])
            whole = b.num_rows // dims
            rest = b.slice(whole * dims)
            x = _unit(b.column(2).to_numpy()[: whole * dims].reshape(-1, dims))
            first = pa.array(np.arange(whole) * dims)
            emb = pa.ListArray.from_arrays(pa.array(np.arange(whole + 1) * dims, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(first), b.column(1).take(first), emb], names=["grp", "id", "emb"])

    return numbers.select("grp", "id", normal.alias("x")).mapInArrow(run, "grp string, id long, emb array<double>")


def _solved_thin(generated: DataFrame, seeds: DataFrame, specs: list[tuple[str, int]], reg: float, seed: int) -> DataFrame | None:
    """(kind, value) as `_solved` gives, of few seeds; draws of them come from their own generators, the others from hashes of (seed, solve, place).
    None where the plan of the generated vectors with themselves need not be sparse."""
    spark = generated.sparkSession
    s = _unit(np.array([r.emb for r in seeds.select("id", F.col("emb").cast("array<double>").alias("emb")).orderBy("id").collect()], float))  # thin.FEW rows at most
    made = written(numbered(generated.select(normalized(F.col("emb")).alias("emb"))).select(F.col("row_id").alias("at"), "emb"), "made")
    n_g = made.count()
    named = {f"{kind}/{i}": kind for kind, i in specs if kind in ("raw", "far") or (kind == "ci" and min(len(s), n_g) > 1)}
    drawn = [name for name, kind in named.items() if kind != "far"]
    # A row per distinct vector, with its weight in each solve; draws are counted by vector.
    one = written(made.groupBy("emb").agg(F.min("at").alias("id"), F.collect_list("at").alias("rows")), "distinct")
    of = one.select("id", F.explode("rows").alias("at"))
    resampled = [name for name in drawn if named[name] == "ci"]
    draws = spark.range(n_g).select("id", F.explode(F.array(*map(F.lit, resampled)) if resampled else F.array().cast("array<string>")).alias("grp"))
    places = draws.select("grp", F.pmod(F.xxhash64(F.lit(seed + 3), "grp", "id"), F.lit(n_g)).alias("at"))
    # Spark takes the draws for as many as the range has, and would send all of them to the driver and to every task.
    counted = places.join(of.hint("merge"), "at").groupBy("id", "grp").agg(F.count("*").alias("n")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("grp", "n"))).alias("n"))
    weight = lambda name: (F.size("rows") if named[name] == "raw" else F.coalesce(F.col("n")[name], F.lit(0))) / F.lit(float(n_g))
    whole = one.join(counted, "id", "left").select(F.lit("made").alias("grp"), "id", "emb", F.array(*map(weight, drawn)).alias("w"))
    far = spark.createDataFrame([(name,) for name, kind in named.items() if kind == "far"], "grp string")
    n_far = max(2, n_g)
    random = _random(far, n_far, s.shape[1], seed).withColumn("w", F.array(F.lit(1.0 / n_far)))
    lone = thin.none_between(n_far, s.shape[1], reg)
    sets = written(whole if lone else whole.unionByName(random), "sets")
    solves, alone = {}, {}
    for name, kind in named.items():
        a = np.full(len(s), 1.0 / len(s))
        if kind == "ci":
            a = np.bincount(np.random.default_rng((seed, 3, int(name.split("/")[1]))).integers(0, len(s), len(s)), minlength=len(s)) / len(s)
        solves[name] = ("made", drawn.index(name), a) if kind != "far" else (name, 0, a)
        own = np.repeat(s, np.rint(a * len(s)).astype(int), 0)
        alone[name] = plan_cost(own, own, reg) if kind == "ci" or "seeds" not in alone else alone["seeds"]
        if kind != "ci":
            alone["seeds"] = alone[name]
    yy = thin.self_costs(sets, n_far, [(name, grp, at) for name, (grp, at, _) in solves.items() if not (lone and named[name] == "far")], reg)
    if yy is None:
        return None
    own = {r.solve: r.cost for r in yy.collect()}  # a row per solve
    both = thin.thin_costs(thin.seed_costs(sets.unionByName(random) if lone else sets, s), solves, reg)
    found = [(named[name], max(0.0, both[name] - alone[name] / 2 - own.get(name, 0.0) / 2)) for name in named]
    found += [("ci", float("nan")) for kind, i in specs if kind == "ci" and f"ci/{i}" not in named]
    out = spark.createDataFrame(found, "kind string, value double")
    near = [(kind, i) for kind, i in specs if kind == "near"]
    return out.unionByName(_solved(seeds, seeds, near, reg, seed, thin.FEW, BLOCK)) if near else out


# ---- measures -------------------------------------------------------------------------------------------------------------


def raw(generated: DataFrame, seeds: DataFrame, reg: float = 0.01, most: int = MOST, size: int = BLOCK) -> DataFrame:
    """One row: the debiased cost alone, without replicates. Sets of more than `most` vectors are solved in blocks of `size`,
    or for the potentials of the seeds where these are few."""
    return _solved(generated, seeds, [("raw", 0)], reg, 0, most, size).select(F.col("value").alias("raw"))


def calibrated(generated: DataFrame, seeds: DataFrame, boots: int = 25, reg: float = 0.01, seed: int = 42, most: int = MOST, size: int = BLOCK) -> DataFrame:
    """One row: raw, near, far, score, low, high. near: between resamples of the seeds; far: from seeds to random directions. Sets of more than
    `most` vectors are solved in blocks of `size`, all replicates together."""
    kinds = [("raw", 0), *((kind, i) for kind in ("near", "far", "ci") for i in range(boots))]
    values = _solved(generated, seeds, kinds, reg, seed, most, size)
    one = values.agg(
        F.max(F.when(F.col("kind") == "raw", F.col("value"))).alias("raw"),
        F.median(F.when(F.col("kind") == "near", F.col("value"))).alias("near"),
        F.median(F.when(F.col("kind") == "far", F.col("value"))).alias("far"),
        F.percentile(F.when((F.col("kind") == "ci") & ~F.isnan("value"), F.col("value")), 0.05).alias("least"),
        F.percentile(F.when((F.col("kind") == "ci") & ~F.isnan("value"), F.col("value")), 0.95).alias("most"),
    )
    of = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.col(c) - F.col("near")) / F.greatest(F.col("far") - F.col("near"), F.lit(1e-8))))
    return one.select("raw", "near", "far", of("raw").alias("score"), F.coalesce(of("most"), of("raw")).alias("low"), F.coalesce(of("least"), of("raw")).alias("high"))


def _solved(generated: DataFrame, seeds: DataFrame, specs: list[tuple[str, int]], reg: float, seed: int, most: int, size: int) -> DataFrame:
    """(kind, value): a solve per spec; near: two resamples of the seeds, far: seeds and random directions, ci: resamples of both sets."""
    spark = generated.sparkSession
    if generated.limit(most + 1).count() > most or seeds.limit(most + 1).count() > most:
        few = 0 < seeds.limit(thin.FEW + 1).count() <= thin.FEW
        found = _solved_thin(generated, seeds, specs, reg, seed) if few else None
        return _solved_in_blocks(generated, seeds, specs, reg, seed, size) if found is None else found
    kinds = {"raw": 0, "near": 1, "far": 2, "ci": 3}
    # Both sets as one row, in the order of their ids.
    gathered = lambda v, name: v.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), F.col("emb").cast("array<double>").alias("emb")))), lambda x: x["emb"]).alias(name))
    sets = gathered(seeds, "s").join(gathered(generated, "g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, values = [], []
            for row in range(b.num_rows):
                kind, i = b.column(0)[row].as_py(), b.column(1)[row].as_py()
                s, g = (_unit(np.array(b.column(c)[row].as_py(), float).reshape(len(b.column(c)[row]), -1)) for c in (2, 3))
                names.append(kind)
                values.append(_solve(kind, i, s, g, reg, np.random.default_rng((seed, kinds[kind], i))))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(values, pa.float64())], names=["kind", "value"])

    frame = spark.createDataFrame(specs, "kind string, i int").repartition(min(len(specs), spark.sparkContext.defaultParallelism))
    return frame.join(F.broadcast(sets)).mapInArrow(run, "kind string, value double")


def _solve(kind: str, i: int, s: np.ndarray, g: np.ndarray, reg: float, rng: np.random.Generator) -> float:
    draw = lambda m: m[rng.integers(0, len(m), len(m))]
    if kind == "raw":
        return sinkhorn(s, g, reg)
    if kind == "near":
        return sinkhorn(draw(s), draw(s), reg) if len(s) > 1 else 0.0
    if kind == "far":
        return sinkhorn(s, _unit(rng.normal(size=(max(2, len(g)), s.shape[1]))), reg)
    return sinkhorn(draw(s), draw(g), reg) if min(len(s), len(g)) > 1 else float("nan")
