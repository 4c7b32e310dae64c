"""Transport between few seeds and sets of any size.

Between m seeds and any number of vectors the entropic problem has m unknowns: given the seeds' potentials, those of the other side follow row by
row. The dual in the seeds' potentials is concave, and its value, gradient (m) and curvature (m x m) are sums over the vectors, so that
a Newton step of all replicates is one aggregation. Resamples of one set are weights on its rows; costs are worked out and written once for all.

Of a set with itself the plan stays near the diagonal: with a cost of 0 to itself a vector has a scaling of at most the root of its weight, so that
of the marginal of n vectors of like weight at most the share n exp(-cut / reg) lies beyond a cost of `cut`. Pairs within it are a sparse
graph, and nothing passes between its components: each of up to TOGETHER vectors is solved in a task, in all solves at once, by bands of rows that are
worked out anew in each round where a task does not hold them, and only larger ones take a job per round. Vectors without such a pair stay where they are at no cost. Equal vectors are one with their weights added. Random directions
need no pairs where the mean of their cost says that it is none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import free_since, mark, written
from .pairwise import similar_pairs

#: Seeds at most: a replicate's curvature has their square of numbers.
FEW = 128
#: What is left out of a marginal, as a share of it, and the chance at most that a random cost taken as 0 is more than that.
LEFT_OUT, CHANCE = 1e-9, 1e-6
#: Least similarity of the pairs of a sparse graph, and pairs a vector at most.
LEAST, EDGES = 0.3, 256
#: Vectors of a component that a task solves, those of which it holds the matrices (two of 32 MB), the rows of which it has at a time else, and rounds in
#: which components are looked for.
TOGETHER, HELD, BAND, TURNS = 12_288, 2_000, 512, 8


def _sums(c: np.ndarray, b: np.ndarray, f: np.ndarray, reg: float) -> np.ndarray:
    """Of costs c(n, m), weights b(n) and potentials f(m): [value, cost, marginals of the seeds, second moments of the rows' shares]."""
    z = (f[None] - c) / reg
    top = z.max(1, keepdims=True)
    p = np.exp(z - top)
    total = p.sum(1, keepdims=True)
    p /= total
    shares = p * b[:, None]
    return np.concatenate([[-reg * float(b @ (top + np.log(total))[:, 0]), float((shares * c).sum())], shares.sum(0), (shares.T @ p).ravel()])


def seed_costs(rows: DataFrame, seeds: np.ndarray) -> DataFrame:
    """(grp, c, w), written, of rows(grp, emb, w): the costs to the seeds of vectors of unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = 1 - np.clip(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) @ seeds.T, -1, 1)
            ends = pa.array(np.arange(len(c) + 1) * len(seeds), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(c.ravel())), b.column(2)], names=["grp", "c", "w"])

    return written(rows.select("grp", "emb", "w").mapInArrow(run, "grp string, c array<double>, w array<double>"), "costs")


def _pass(rows: DataFrame, solves: dict[str, tuple[str, int, np.ndarray]], tried: dict[str, list[np.ndarray]], reg: float) -> dict[str, np.ndarray]:
    """For each solve the sums of the potentials tried, a row each, over rows(grp, c, w): c the costs to the seeds, w a weight per solve of the group."""
    of: dict[str, list] = {}
    for name, fs in tried.items():
        grp, at, a = solves[name]
        of.setdefault(grp, []).append((name, at, np.nonzero(a > 0)[0], fs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            keys = b.column(0).dictionary_encode()
            every = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            w = b.column(2)
            for code, grp in enumerate(keys.dictionary.to_pylist()):
                if grp not in of:
                    continue
                rows_ = np.nonzero(keys.indices.to_numpy() == code)[0]
                c = every[rows_]
                weights = w.take(pa.array(rows_)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows_), -1)
                for name, at, some, fs in of[grp]:
                    on = np.nonzero(weights[:, at] > 0)[0]
                    if len(on):
                        costs, share = c[np.ix_(on, some)], weights[on, at]
                        found = np.stack([_sums(costs, share, f, reg) for f in fs])
                        held[name] = held[name] + found if name in held else found
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["solve", "sums"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for name, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = np.frombuffer(sums)
                held[name] = held[name] + part if name in held else part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["solve", "sums"])

    schema = "solve string, sums binary"
    parts = rows.select("grp", "c", "w").mapInArrow(run, schema).repartition("solve").mapInArrow(merged, schema)
    return {r.solve: np.frombuffer(r.sums).reshape(len(tried[r.solve]), -1) for r in parts.collect()}  # a row per solve


def _steps(a: np.ndarray, sums: np.ndarray, reg: float) -> list[np.ndarray]:
    """What to add to the potentials: a Newton step whole and damped, and the step of an alternating round, which never makes it worse."""
    m = len(a)
    marginal, moments = sums[2 : 2 + m], sums[2 + m :].reshape(m, m)
    curve = (np.diag(marginal) - moments) / reg
    # Potentials are determined but for a constant.
    newton = np.linalg.lstsq(curve + np.trace(curve) / m**2 + 1e-300, a - marginal, rcond=1e-14)[0]
    far = np.ptp(newton) / reg
    turn = reg * (np.log(a) - np.log(np.maximum(marginal, 1e-300)))
    return [newton, newton * (np.log1p(far) / far if far > 0 else 1.0), turn]


def thin_costs(rows: DataFrame, solves: dict[str, tuple[str, int, np.ndarray]], reg: float, rounds: int = 1000, tol: float = 1e-9) -> dict[str, float]:
    """<P, C> of the entropic plan between weighted seeds and rows(grp, c, w) of `seed_costs`, for each of solves: name -> (grp, place in w, weights of the
    seeds).

    The regularisation falls to `reg` in steps of about three; a solve has settled when its marginals are met."""
    weights = {name: a[a > 0] for name, (_, _, a) in solves.items()}
    f = {name: np.zeros(len(a)) for name, a in weights.items()}
    steps = [reg]
    while steps[0] < 0.3:
        steps.insert(0, steps[0] * 3)
    costs: dict[str, float] = {}
    for step in steps:
        near = tol if step == reg else 1e-3
        tried = {name: [f[name]] for name in solves}
        best: dict[str, float] = {}
        for _ in range(rounds if step == reg else 30):
            found = _pass(rows, solves, tried, step)
            following = {}
            for name, sums in found.items():
                a = weights[name]
                value = np.array([a @ t for t in tried[name]]) + sums[:, 0]
                off = np.abs(sums[:, 2 : 2 + len(a)] - a).max(1)
                # Of values that are alike but for rounding the one that meets the marginals best.
                at = min(np.nonzero(value >= max(value.max(), best.get(name, -np.inf)) - 1e-12)[0], key=lambda k: off[k], default=int(off.argmin()))
                best[name], f[name], costs[name] = value[at], tried[name][at], float(sums[at, 1])
                if off[at] >= near:
                    following[name] = [f[name] + s for s in _steps(a, sums[at], step)]
            tried = following
            if not tried:
                break
    return costs


def self_cut(reg: float, n: int) -> float:
    """The cost beyond which pairs of n weighted vectors hold less than LEFT_OUT of any marginal."""
    return reg * (np.log(max(n, 2)) - np.log(LEFT_OUT))


def none_between(n: int, dims: int, reg: float) -> bool:
    """Whether n random directions cost nothing with themselves: more than LEFT_OUT by a chance of CHANCE at most.

    No entry of the plan is above exp(-c / reg) / n, and the cosine of two directions has a known density, so that the mean of the cost has a
    bound, and its chance to be so many times the mean is at most one to as many."""
    if dims < 4:
        return False
    c = np.geomspace(1e-9, 2, 100_000)[:-1]
    density = (dims - 3) / 2 * np.log(c * (2 - c)) - (math.lgamma(0.5) + math.lgamma((dims - 1) / 2) - math.lgamma(dims / 2))
    return (n - 1) * float(np.trapezoid(np.exp(density - c / reg) * c, c)) < LEFT_OUT * CHANCE


def self_costs(sets: DataFrame, total: int, solves: list[tuple[str, str, int]], reg: float, rounds: int = 1000, tol: float = 1e-9) -> DataFrame | None:
    """(solve, cost), written: <P, C> of the entropic plan of each weighting of sets(grp, id, emb, w) with itself; solves: (name, grp, place in w).

    total: the most rows that a set has with copies. None where the plan need not be sparse: pairs would be too many, or a vector has
    no direction and so a cost to itself."""
    spark = sets.sparkSession
    least = 1 - self_cut(reg, total)
    if least < LEAST or sets.where(F.aggregate("emb", F.lit(0.0), lambda s, x: s + x * x) < 0.25).limit(1).count():
        return None
    pairs = written(similar_pairs(sets.select("grp", "id", "emb"), least), "near")
    if pairs.count() > EDGES * sets.count():
        return None
    arcs = pairs.select("grp", F.col("id_a").alias("id"), F.col("id_b").alias("other"), "sim").unionByName(pairs.select("grp", F.col("id_b").alias("id"), F.col("id_a").alias("other"), "sim"))
    roots, classes = _classes(arcs)
    within = (~F.col("open")) & (F.col("n") <= TOGETHER)
    # A row per vector: few bytes in files, and many on the driver if it were broadcast.
    members = sets.join(roots.hint("merge"), ["grp", "id"]).join(classes.where(within), ["grp", "root"]).select("grp", "root", "emb", "w")
    cost = _together(members, solves, least, reg, rounds, tol * total)
    if classes.where(~within).limit(1).count():
        rest = roots.join(classes.where(~within), ["grp", "root"]).select("grp", "id")
        cost = cost.unionByName(_apart(sets, arcs.join(rest, ["grp", "id"], "left_semi"), solves, reg, rounds, tol * total))
    names = spark.createDataFrame([(name,) for name, _, _ in solves], "solve string")
    return written(names.join(cost.groupBy("solve").agg(F.sum("cost").alias("cost")), "solve", "left").select("solve", F.coalesce("cost", F.lit(0.0)).alias("cost")), "costs")


def _classes(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grp, id, root), written, and (grp, root, n, open), written: the vectors of arcs(grp, id, other) by the least id that reached them. Classes that
    no arc leaves are components; the others, of components too wide for TURNS rounds, are open."""
    point = mark()
    found = written(arcs.groupBy("grp", "id").agg(F.min("other").alias("low")).select("grp", "id", F.least("id", "low").alias("next")), "roots")
    for _ in range(TURNS):
        roots = found.select("grp", "id", F.col("next").alias("root"))
        seen = arcs.join(roots.select("grp", F.col("id").alias("other"), F.col("root").alias("to")), ["grp", "other"]).groupBy("grp", "id").agg(F.min("to").alias("low"), F.max("to").alias("high"))
        next_ = roots.join(seen.hint("merge"), ["grp", "id"]).select("grp", "id", "root", F.least("root", "low").alias("next"), ((F.col("low") != F.col("root")) | (F.col("high") != F.col("root"))).alias("open"))
        found = written(next_, "roots")
        free_since(point, found)
        if not found.where("open").limit(1).count():
            break
    return found.select("grp", "id", "root"), written(found.groupBy("grp", "root").agg(F.count("*").alias("n"), F.max("open").alias("open")), "classes")


def _together(members: DataFrame, solves: list[tuple[str, str, int]], least: float, reg: float, rounds: int, tol: float) -> DataFrame:
    """(solve, cost) per task: the costs of whole components, members(grp, root, emb, w)."""
    of: dict[str, list[tuple[str, int]]] = {}
    for name, grp, at in solves:
        of.setdefault(grp, []).append((name, at))

    def costs(x: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Of vectors x(n, d) and weights a(n, solves)."""

        def bands() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for at in range(0, len(x), BAND):
                c = 1 - np.clip(x[at : at + BAND] @ x.T, -1, 1)
                c[np.arange(len(c)), np.arange(at, at + len(c))] = 0
                yield c, np.where(c < 1 - least, np.exp(-c / reg), 0)

        held = list(bands()) if len(x) <= HELD else None
        u = np.sqrt(a)
        for _ in range(rounds):
            s = np.vstack([k @ u for _, k in held or bands()])
            off = np.abs(np.divide(u * s, a, out=np.ones_like(a), where=a > 0) - 1).max()
            # Half of the way to the potentials that meet the marginals now.
            u = np.sqrt(np.divide(u * a, s, out=np.zeros_like(a), where=a > 0))
            if off < min(tol, 1e-6):
                break
        return (u * np.vstack([(k * c) @ u for c, k in held or bands()])).sum(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, float] = {}
        key, xs, ws = None, [], []

        def close() -> None:
            if key and key[0] in of:
                names, places = zip(*of[key[0]], strict=True)
                for name, cost in zip(names, costs(np.vstack(xs), np.vstack(ws)[:, list(places)]), strict=True):
                    held[name] = held.get(name, 0.0) + float(cost)

        for b in batches:
            for now, rows in groupby(range(b.num_rows), list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)).__getitem__):
                if now != key:
                    close()
                    key, xs, ws = now, [], []
                at = list(rows)
                for held_, column in ((xs, 2), (ws, 3)):
                    held_.append(b.column(column).slice(at[0], len(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.float64())], names=["solve", "cost"])

    # Components are much work for few bytes: with a number of partitions Spark does not put them together.
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(parts, "grp", "root").sortWithinPartitions("grp", "root").mapInArrow(run, "solve string, cost double")


def _apart(sets: DataFrame, arcs: DataFrame, solves: list[tuple[str, str, int]], reg: float, rounds: int, tol: float) -> DataFrame:
    """(solve, cost) of the vectors that arcs(grp, id, other, sim) link, each round a job."""
    names = sets.sparkSession.createDataFrame(solves, "solve string, grp string, at int")
    point = mark()
    ends = sets.join(arcs.select("grp", "id").distinct(), ["grp", "id"], "left_semi").select("grp", "id", F.posexplode("w").alias("at", "a")).where("a > 0")
    nodes = written(ends.join(F.broadcast(names), ["grp", "at"]).select("solve", "grp", "id", "a", F.sqrt("a").alias("u")), "nodes")
    held = lambda n, name: n.select("solve", "grp", F.col("id").alias(name), F.col("u").alias(f"u_{name}"))
    linked = arcs.withColumn("k", F.exp((F.col("sim") - 1) / reg))
    for _ in range(rounds):
        sent = linked.join(held(nodes, "other"), ["grp", "other"]).groupBy("solve", "grp", "id").agg(F.sum(F.col("k") * F.col("u_other")).alias("s"))
        met = nodes.join(sent, ["solve", "grp", "id"], "left").withColumn("s", F.col("u") + F.coalesce("s", F.lit(0.0)))
        # Half of the way to the potentials that meet the marginals now.
        new = met.select("solve", "grp", "id", "a", F.sqrt(F.col("u") * F.col("a") / F.col("s")).alias("u"), F.abs(F.col("u") * F.col("s") / F.col("a") - 1).alias("off"))
        nodes = written(new, "nodes")
        off = nodes.agg(F.max("off")).first()[0]
        free_since(point, nodes)
        if off is None or off < min(tol, 1e-6):
            break
    both = linked.join(held(nodes, "id"), ["grp", "id"]).join(held(nodes, "other"), ["solve", "grp", "other"])
    return both.groupBy("solve").agg(F.sum(F.col("u_id") * F.col("u_other") * F.col("k") * (1 - F.col("sim"))).alias("cost"))
