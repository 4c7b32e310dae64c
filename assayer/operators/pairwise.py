"""All-pairs kernels over vectors, as products of blocks.

Vectors of a group are dealt to blocks of bounded size, and blocks to bands; each task multiplies the blocks of two bands, of which it holds one, and
emits sums per row, or the pairs that pass. Blocks meet by a shuffle on (group, band, band), so that one group of all vectors is spread
over all tasks and a vector is sent once a band, of which there are few. Neither side is broadcast, and no pair of vectors becomes a row unless it is asked for. Where extremes or a threshold are asked for and
groups are large, blocks are made within cells around pivots, and those that cannot hold what is asked for do not meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..store import written
from .cells import GRP_KINDS, Test, above, block_counts, block_items, cell_pairs, cells, farthest, matrix, meetings, nearest
from .spherical import beside, mean_vectors, unit

BLOCK = 1024
#: Partitions at most that pairs of bands are dealt to beyond the session's number.
PARTITIONS = 1024


#: Blocks of the largest group from which cells are made: below, all of the few blocks meet.
PRUNED = 8


def blocks(vectors: DataFrame, size: int = BLOCK, counts: DataFrame | None = None) -> DataFrame:
    """vectors(grp, id, emb) -> (grp, blocks, block, items), emb normalised; blocks: their number in the group."""
    return block_items(vectors, block_counts(vectors, size) if counts is None else counts)


def over_pairs(sides: list[DataFrame], counts: list[DataFrame], fn: Callable, schema: str, met: DataFrame | None = None) -> DataFrame:
    """fn(grp, ids_x, X, ids_y, Y, same) -> columns, for pairs of blocks of one group; of one side each pair once, in either order.

    sides: one or two of (grp, cell, block, items), with their counts. met(grp, cx, bx, cy, by): the blocks that meet, all of them by default. Blocks
    are dealt to bands, and a task has a pair of bands, of which it holds one: a block is sent once to each band of the other side at most."""
    own = len(sides) == 1
    bands = counts[0].select("grp", F.col("bands").alias("bands_x")).join(counts[-1].select("grp", F.col("bands").alias("bands_y")), "grp")
    band = lambda cell, block, n: F.pmod(F.col(cell) + F.col(block), F.col(n))
    turned = F.col("px") > F.col("py") if own else F.lit(False)
    first, second = F.least("px", "py") if own else F.col("px"), F.greatest("px", "py") if own else F.col("py")
    dealt, pair = [], ["grp", "px", "py"]
    if met is None:
        for k, (side, mine, others) in enumerate(zip(sides, ("bands_x", "bands_y"), ("bands_y", "bands_x"), strict=False)):
            at = [band("cell", "block", mine), F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))]
            to = beside(side, bands).select("grp", "cell", "block", "items", at[k].alias("px"), at[1 - k].alias("py"))
            dealt.append(to.select("grp", first.alias("px"), second.alias("py"), (turned.cast("int") if own else F.lit(k)).alias("side"), "cell", "block", "items"))
    else:
        at = beside(met, bands).select("grp", "cx", "bx", "cy", "by", band("cx", "bx", "bands_x").alias("px"), band("cy", "by", "bands_y").alias("py"))
        x, y = (F.struct(F.col(c).cast("long").alias("cell"), F.col(b).alias("block")) for c, b in (("cx", "bx"), ("cy", "by")))
        at = at.select("grp", first.alias("px"), second.alias("py"), F.when(turned, y).otherwise(x).alias("x"), F.when(turned, x).otherwise(y).alias("y"))
        of_second = F.when(F.col("px") == F.col("py"), 0).otherwise(1) if own else F.lit(1)
        needed = at.select(*pair, F.explode(F.array(*(F.struct(s.alias("side"), c) for s, c in ((F.lit(0), F.col("x").alias("tile")), (of_second, F.col("y").alias("tile")))))).alias("n"))
        needed = needed.select(*pair, "n.side", "n.tile.cell", "n.tile.block").distinct()
        for k, side in enumerate(sides):
            some = needed if own else needed.where(F.col("side") == k)
            dealt.append(some.join(side.withColumn("cell", F.col("cell").cast("long")), ["grp", "cell", "block"]).select(*pair, "side", "cell", "block", "items"))
        dealt.append(at.groupBy(*pair).agg(F.collect_list(F.struct("x", "y")).alias("wanted")).withColumn("side", F.lit(-1)))
    rows = dealt[0].withColumn("cell", F.col("cell").cast("long"))
    for more in dealt[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    if met is None:
        rows = rows.withColumn("wanted", F.lit(None).cast("array<struct<x: struct<cell: bigint, block: bigint>, y: struct<cell: bigint, block: bigint>>>"))
    return each_pair(rows.select(*pair, "side", "cell", "block", "items", "wanted"), own, fn, schema, spread(bands))


def spread(bands: DataFrame) -> list[int]:
    """The number of partitions for the pairs of bands, if it is to be more than the session's: they are few and each much work, so that of two in a
    partition the second is waited for."""
    most = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(PARTITIONS, 2 * (bands.agg(F.sum(F.col("bands_x") * F.col("bands_y"))).first()[0] or 0))
    return [wanted] if wanted > most else []


def each_pair(rows: DataFrame, own: bool, fn: Callable, schema: str, partitions: list[int]) -> DataFrame:
    """fn over the pairs of blocks of each pair of bands: rows(grp, px, py, side, cell, block, items, wanted), side 0 being held."""
    kind = rows.schema["grp"].dataType.simpleString()
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    arrow = [{"long": pa.int64(), "double": pa.float64()}[k] for k in kinds]

    def batch(grp, out) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([grp] * len(out[0]), GRP_KINDS[kind]), *map(pa.array, out, arrow)], names=["grp", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, wanted = None, [], None
        for b in batches:
            for i in range(b.num_rows):
                grp, px, py, side, cell, block = (b.column(k)[i].as_py() for k in range(6))
                if (grp, px, py) != key:
                    key, held, wanted = (grp, px, py), [], None
                if side < 0:
                    wanted = {tuple((p[k]["cell"], p[k]["block"]) for k in ("x", "y")) for p in b.column(7)[i].as_py()}
                    continue
                name, (ids, x) = (cell, block), matrix(b.column(6), i)
                alone = own and px == py
                for other, others, y in held if alone or side else ():
                    if wanted is None or (other, name) in wanted or (alone and (name, other) in wanted):
                        yield batch(grp, fn(grp, others, y, ids, x, False))
                if alone and (wanted is None or (name, name) in wanted):
                    yield batch(grp, fn(grp, ids, x, ids, x, True))
                if not side:
                    held.append((name, ids.copy(), x.copy()))

    dealt = rows.repartition(*partitions, "grp", "px", "py").sortWithinPartitions("grp", "px", "py", "side", "cell", "block")
    return dealt.mapInArrow(run, f"grp {kind}, {schema}")


def pruned_pairs(vectors: DataFrame, others: DataFrame | None, test: Test, fn: Callable, schema: str, size: int, pruned: int) -> DataFrame:
    """fn over the pairs of blocks that pass the test; others: the vectors of the other side, None where both sides are one (each pair once).

    Where no group of a side has as many as `pruned` blocks all blocks meet, which costs less than finding out which need to; so they do where
    cells, which are smaller than blocks, would have more vectors meet blocks. With 0 cells are made in any case."""
    sides = [vectors] if others is None else [vectors, others]
    counts = [block_counts(v, size) for v in sides]
    if min(c.agg(F.max("blocks")).first()[0] or 0 for c in counts) >= pruned:
        x, y = (made := [cells(v, c, size) for v, c in zip(sides, counts, strict=True)])[0], made[-1]
        met = cell_pairs(x, y, test)
        n = F.col("blocks") + 1 if others is None else 2 * F.col("others")
        each = counts[0].join(counts[-1].select("grp", F.col("blocks").alias("others")), "grp")
        every = each.agg(F.sum(F.col("blocks") * size * n)).first()[0] or 0
        if not pruned or (met.agg(F.sum("sent")).first()[0] or 0) < every:
            return over_pairs([written(side.blocks, "blocks") for side in made], counts, fn, schema, meetings(met, x is y))
    return over_pairs([plain(v, size, c) for v, c in zip(sides, counts, strict=True)], counts, fn, schema)


def plain(vectors: DataFrame, size: int, counts: DataFrame) -> DataFrame:
    """(grp, cell, block, items): blocks without cells."""
    return blocks(vectors, size, counts).select("grp", F.lit(0).cast("long").alias("cell"), "block", "items")


def kernel(name: str, x: np.ndarray, y: np.ndarray, tau: float, gamma: float | None = None) -> np.ndarray:
    """cs: cosine / tau; rbf, laplacian: exp(-tau distance); polynomial: (gamma x.y + 1) ** tau with gamma 1 / d by default."""
    if name == "cs":
        return x @ y.T / tau
    if name == "polynomial":
        k = (gamma or 1.0 / x.shape[1]) * x @ y.T
        k += 1.0
        if tau not in range(1, 9):
            return k**tau
        # Products take less than half of the time of a general power.
        out = k.copy()
        for _ in range(int(tau) - 1):
            out *= k
        return out
    if name == "rbf":
        # One product of matrices has the squares too.
        one = lambda m: np.ones((len(m), 1))
        square = lambda m: -tau * (m * m).sum(1, keepdims=True)
        k = np.hstack([2 * tau * x, square(x), one(x)]) @ np.hstack([y, one(y), square(y)]).T
        return np.exp(np.minimum(k, 0, out=k), out=k)
    if name == "laplacian":
        return np.exp(-tau * np.stack([np.abs(x - row).sum(1) for row in y], 1))
    raise ValueError(f"no kernel {name}")


def own_kernel(name: str, x: np.ndarray, tau: float, gamma: float | None = None) -> np.ndarray:
    """kernel of each row of x with itself."""
    square = (x * x).sum(1)
    if name == "cs":
        return square / tau
    return ((gamma or 1.0 / x.shape[1]) * square + 1.0) ** tau if name == "polynomial" else np.ones(len(x))


def dc_scores(vectors: DataFrame, name: str = "cs", tau: float = 1.0, size: int = BLOCK) -> DataFrame:
    """(grp, n, dc_score): the mean over rows of exp(K_ii) / sum_j exp(K_ij). Each term is exp(K_ij - K_ii), which a small tau cannot overflow."""

    def sums(grp, ids, x, other, y, same):
        """Kernels are symmetric: a pair of blocks has the sums of the rows of both."""
        k, own, others = kernel(name, x, y, tau), own_kernel(name, x, tau), own_kernel(name, y, tau)
        if same:
            return ids, np.exp(np.subtract(k, own[:, None], out=k)).sum(1)
        most = max(own.max(), others.max())
        if most - min(own.min(), others.min()) < 50:
            e = np.exp(np.subtract(k, most, out=k), out=k)
            totals = e.sum(1) * np.exp(most - own), e.sum(0) * np.exp(most - others)
        else:
            totals = np.exp(k - own[:, None]).sum(1), np.exp(k - others[None]).sum(0)
        return np.concatenate([ids, other]), np.concatenate(totals)

    counts = block_counts(vectors, size)
    rows = over_pairs([plain(vectors, size, counts)], [counts], sums, "id long, total double").groupBy("grp", "id").agg((1 / F.sum("total")).alias("p"))
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.avg("p").alias("dc_score"))


def passing(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x and of y, none longer than 1, of a cosine above the threshold, with the cosine.

    A product in single precision, off by less than its bound for so many terms, says which pairs may pass. Only their cosines are worked out in
    double, unless the pairs are more than the rows of both."""
    error = (x.shape[1] + 2) * float(np.finfo(np.float32).eps)
    i, j = np.divmod(np.flatnonzero(x.astype(np.float32) @ y.astype(np.float32).T > threshold - error), len(y))
    s = np.clip(np.einsum("ij,ij->i", x[i], y[j]) if len(i) <= len(x) + len(y) else (x @ y.T)[i, j], -1, 1)
    keep = s > threshold
    return i[keep], j[keep], s[keep]


def similar_pairs(vectors: DataFrame, threshold: float, size: int = BLOCK, pruned: int = PRUNED) -> DataFrame:
    """(grp, id_a, id_b, sim) with id_a < id_b and sim above the threshold."""

    def pick(grp, ids, x, other, y, same):
        i, j, s = passing(x, y, threshold)
        keep = ids[i] < other[j] if same else ids[i] != other[j]
        i, j = i[keep], j[keep]
        return np.minimum(ids[i], other[j]), np.maximum(ids[i], other[j]), s[keep]

    return pruned_pairs(vectors, None, above(threshold), pick, "id_a long, id_b long, sim double", size, pruned)


def mean_similarity(vectors: DataFrame) -> DataFrame:
    """(grp, pairs, mean_sim) over unordered pairs, from the sum of the unit vectors: no pair is made. mean_sim is null without pairs."""
    return mean_similarity_of(mean_vectors(vectors))


def mean_similarity_of(m: DataFrame) -> DataFrame:
    """mean_similarity of what `mean_vectors` gives."""
    n = F.col("n").cast("double")
    of_mean = F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x)
    mean = (n * of_mean - F.col("square")) / (n - 1)
    return m.select("grp", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), F.when(n > 1, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean))).alias("mean_sim"))


def pair_statistics(vectors: DataFrame, size: int = BLOCK, moments: DataFrame | None = None, pruned: int = PRUNED) -> DataFrame:
    """(grp, pairs, mean_sim, min_sim) over unordered pairs; only the least one needs the pairs. moments: what `mean_vectors` gave."""

    def least(grp, ids, x, other, y, same):
        s = np.clip(x @ y.T, -1, 1)
        s = s[np.triu_indices(len(ids), 1)] if same else s.ravel()
        return ([float(s.min())],) if len(s) else ([],)

    low = pruned_pairs(vectors, None, farthest, least, "low double", size, pruned).groupBy("grp").agg(F.min("low").alias("min_sim"))
    return (mean_similarity(vectors) if moments is None else mean_similarity_of(moments)).join(low, "grp")


def novelty(vectors: DataFrame, seeds: DataFrame, size: int = BLOCK, pruned: int = PRUNED) -> DataFrame:
    """(grp, id, novelty_min, novelty_avg): cosine distances of each vector to the seeds of its group. The mean one is that to the seeds'
    mean; only the least one needs the pairs."""

    def near(grp, ids, x, other, y, same):
        return ids, (1 - np.clip(x @ y.T, -1, 1)).min(1)

    low = pruned_pairs(vectors, seeds, nearest, near, "id long, low double", size, pruned).groupBy("grp", "id").agg(F.min("low").alias("novelty_min"))
    means = written(mean_vectors(seeds).select("grp", "mean"), "means")
    far = beside(unit(vectors), means).groupBy("grp", F.col("id").cast("long").alias("id")).agg(F.avg(1 - dot(F.col("emb"), F.col("mean"))).alias("novelty_avg"))
    return low.join(far, ["grp", "id"])
