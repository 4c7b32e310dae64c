"""Cells of vectors around pivots: which blocks need not meet.

Pivots are members of a group, about PIVOTS, or one for each FEW vectors of a small group, drawn by a hash of the id. Each vector goes to the
cell of its nearest pivot and a cell has the largest angle to it as its radius. By the triangle inequality two vectors of cells with
pivots at an angle t are at an angle within t -/+ the sum of the radii, so that pairs of cells which can hold nothing asked for are
dropped before any vector is sent. Vectors without a direction are a cell of their own, which meets all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import normalized
from ..store import written
from .spherical import beside

#: Pivots of a group, about. Their angles to each other are worked out in one task.
PIVOTS = 512
FEW = 8
#: Bands of a group at least, if it has as many blocks, and numbers that a band holds at most, about (32 MB).
BANDS, HELD = 12, 1 << 22
#: What rounding may do to an angle.
SLACK = 1e-6
GRP_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def matrix(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of array<struct<id, emb>> at a row."""
    items = column[row].values
    ids = items.field("id").to_numpy(zero_copy_only=False)
    return ids, items.field("emb").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def block_counts(vectors: DataFrame, size: int) -> DataFrame:
    """(grp, blocks, bands), written: how many blocks of about so many vectors a group has, and to how many bands they are dealt."""
    n, numbers = F.count("*"), F.count("*") * F.max(F.size("emb"))
    blocks, bands = F.ceil(n / size), F.greatest(F.lit(BANDS), F.ceil(numbers / HELD))
    return written(vectors.groupBy("grp").agg(blocks.alias("blocks"), F.greatest(F.lit(1), F.least(blocks, bands)).cast("long").alias("bands")), "sizes")


def block_items(vectors: DataFrame, counts: DataFrame) -> DataFrame:
    """vectors(grp, id, emb) -> (grp, blocks, block, items), emb normalised."""
    item = F.struct(F.col("id").cast("long").alias("id"), normalized(F.col("emb")).alias("emb")).alias("item")
    dealt = beside(vectors, counts).select("grp", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), item)
    return dealt.groupBy("grp", "blocks", "block").agg(F.collect_list("item").alias("items"))


@dataclass
class Cells:
    """blocks(grp, cell, block, items), to be written by who needs them; about(grp, cells: array<struct<cell, blocks, n, radius, pivot>>), a row per
    group."""

    blocks: DataFrame
    about: DataFrame


def cells(vectors: DataFrame, counts: DataFrame, size: int) -> Cells:
    kind = vectors.schema["grp"].dataType.simpleString()
    wanted = F.least(F.col("blocks") * size / FEW, F.lit(PIVOTS))
    drawn = beside(vectors, counts).where(F.pmod(F.xxhash64("id", F.lit(17)), F.ceil(F.col("blocks") * size / wanted)) == 0)
    one = drawn.groupBy("grp", F.col("id").cast("long").alias("id")).agg(normalized(F.first("emb")).alias("emb"))
    some = one.where(F.aggregate("emb", F.lit(0.0), lambda a, x: a + x * x) > 0.25)
    pivots = written(some.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("id", "emb"))).alias("pivots")), "pivots")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, x = matrix(b.column(1), i)
                cell, angle = np.zeros(len(ids), np.int32), np.full(len(ids), np.pi)
                if b.column(2)[i].is_valid:
                    s = np.clip(x @ matrix(b.column(2), i)[1].T, -1, 1)
                    cell = s.argmax(1).astype(np.int32)
                    angle = np.arccos(s[np.arange(len(ids)), cell])
                    lost = ~((x * x).sum(1) > 0.25)
                    cell[lost], angle[lost] = -1, np.pi
                ends = pa.array(np.arange(len(ids) + 1) * x.shape[1], pa.int32())
                columns = pa.array([b.column(0)[i].as_py()] * len(ids), GRP_KINDS[kind]), pa.array(cell), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(x.ravel())), pa.array(angle)
                yield pa.RecordBatch.from_arrays(list(columns), names=["grp", "cell", "id", "emb", "angle"])

    beside_pivots = beside(block_items(vectors, counts), pivots, "left").select("grp", "items", "pivots")
    placed = written(beside_pivots.mapInArrow(assign, f"grp {kind}, cell int, id long, emb array<double>, angle double"), "placed")
    sums = written(placed.groupBy("grp", "cell").agg(F.ceil(F.count("*") / size).alias("blocks"), F.count("*").alias("n"), F.max("angle").alias("radius")), "cells")
    dealt = placed.join(sums, ["grp", "cell"]).select("grp", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.struct("id", "emb").alias("item"))
    blocks = dealt.groupBy("grp", "cell", "block").agg(F.collect_list("item").alias("items"))
    listed = sums.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("cell", "blocks", "n", "radius"))).alias("cells")).join(pivots, "grp", "left")
    at = lambda c: F.when(c["cell"] >= 0, F.get("pivots", c["cell"])["emb"])
    about = listed.select("grp", F.transform("cells", lambda c: F.struct(*(c[k].alias(k) for k in ("cell", "blocks", "n", "radius")), at(c).alias("pivot"))).alias("cells"))
    return Cells(blocks, about)


@dataclass
class Side:
    """Cells of one group. real: which have a pivot."""

    cell: np.ndarray
    blocks: np.ndarray
    n: np.ndarray
    radius: np.ndarray
    pivot: np.ndarray
    real: np.ndarray


def _side(cells_: list[dict], dims: int) -> Side:
    of = lambda k, t: np.array([c[k] for c in cells_], t)
    pivot = np.array([c["pivot"] or [0.0] * dims for c in cells_]).reshape(len(cells_), -1)
    return Side(of("cell", np.int32), of("blocks", np.int64), of("n", np.int64), of("radius", float), pivot, np.array([c["pivot"] is not None for c in cells_]))


#: What cells must meet, from the angles of their pivots (x cells by y cells).
Test = Callable[[Side, Side, np.ndarray], np.ndarray]


def above(threshold: float) -> Test:
    """Pairs of a cosine above the threshold."""
    most = float(np.arccos(np.clip(threshold, -1, 1)))
    return lambda x, y, t: t - x.radius[:, None] - y.radius[None] <= most + SLACK


def farthest(x: Side, y: Side, t: np.ndarray) -> np.ndarray:
    """The pair of the largest angle: no less than that of the pivots farthest apart, which are a pair themselves."""
    known = t[np.ix_(x.real, y.real)].max(initial=0.0)
    return t + x.radius[:, None] + y.radius[None] >= known - SLACK


def nearest(x: Side, y: Side, t: np.ndarray) -> np.ndarray:
    """The nearest y of each x: no farther than the nearest pivot of y, which is a y itself."""
    bound = x.radius + t[:, y.real].min(1, initial=np.inf)
    return t - x.radius[:, None] - y.radius[None] <= bound[:, None] + SLACK


def cell_pairs(x: Cells, y: Cells, test: Test) -> DataFrame:
    """(grp, cx, nx, cy, ny, sent), written: the cells that meet, with their numbers of blocks and the vectors that are sent for it; each pair
    once where both sides are one."""
    own = x is y
    kind = x.about.schema["grp"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                grp, left, right = (b.column(c)[i].as_py() for c in range(3))
                dims = max((len(c["pivot"]) for c in left + right if c["pivot"]), default=1)
                p, q = _side(left, dims), _side(right, dims)
                t = np.arccos(np.clip(p.pivot @ q.pivot.T, -1, 1))
                # A cell without a pivot has a radius of half a turn: it meets all.
                met = test(p, q, t) | ~p.real[:, None] | ~q.real[None]
                m, n = np.nonzero(np.triu(met) if own else met)
                columns = [pa.array([grp] * len(m), GRP_KINDS[kind]), *(pa.array(a) for a in (p.cell[m], p.blocks[m], q.cell[n], q.blocks[n], p.n[m] * q.blocks[n] + q.n[n] * p.blocks[m]))]
                yield pa.RecordBatch.from_arrays(columns, names=["grp", "cx", "nx", "cy", "ny", "sent"])

    both = x.about.join(y.about.withColumnRenamed("cells", "others"), "grp").select("grp", "cells", "others")
    return written(both.mapInArrow(run, f"grp {kind}, cx int, nx long, cy int, ny long, sent long"), "cell-pairs")


def meetings(found: DataFrame, own: bool) -> DataFrame:
    """(grp, cx, bx, cy, by), written: the blocks of the cell pairs; each pair once where both sides are one."""
    first = F.when(F.col("cx") == F.col("cy"), F.col("bx")).otherwise(F.lit(0).cast("long")) if own else F.lit(0).cast("long")
    every = found.withColumn("bx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)))
    return written(every.select("grp", "cx", "bx", "cy", F.explode(F.sequence(first, F.col("ny") - 1)).alias("by")), "meetings")


def share_met(met: DataFrame, x: Cells, y: Cells) -> DataFrame:
    """(grp, met, share): pairs of blocks that meet, and their share of all pairs of blocks of the group."""
    of = lambda c, name: c.blocks.groupBy("grp").agg(F.count("*").alias(name))
    n = F.col("nx") * (F.col("nx") + 1) / 2 if x is y else F.col("nx") * F.col("ny")
    sizes = of(x, "nx").join(of(y, "ny"), "grp").select("grp", n.alias("every"))
    return sizes.join(met.groupBy("grp").agg(F.count("*").alias("met")), "grp", "left").select("grp", F.coalesce("met", F.lit(0)).alias("met"), (F.coalesce("met", F.lit(0)) / F.col("every")).alias("share"))
