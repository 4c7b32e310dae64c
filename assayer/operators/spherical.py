"""Centroids, von Mises-Fisher fits, log-likelihoods, outliers, coherence, Vendi score."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine_distance, dot, normalized
from ..store import written


def unit(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("emb", normalized(F.col("emb")))


#: Numbers that a task holds for the groups it has met before it hands their sums on.
HELD = 4_000_000


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch (grp, emb), made unit."""
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(batch.num_rows, -1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-10)


def _moments(a: tuple, b: tuple) -> tuple:
    """(n, mean, sum of squared deviations, sum of squared lengths) of two parts together."""
    n = a[0] + b[0]
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + step * step * (a[0] * b[0] / n), a[3] + b[3]


def by_group(vectors: DataFrame, of: Callable, merge: Callable, give: Callable, schema: str) -> DataFrame:
    """A row (grp, ...) per group of vectors(grp, emb): of(X) -> (n, arrays or numbers, ...) of some rows of a group, merge of two of these,
    give of the last to values.

    Tasks sum up the groups that they meet, at most HELD numbers at a time; a shuffle by group brings sorted partial sums together,
    which are merged one after the other. No row of all its dimensions is made, and a hot group comes as a row or a few per task. Null
    vectors do not count."""
    kind = vectors.schema["grp"].dataType.simpleString()
    grp_kind = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        held = 0

        def flush() -> pa.RecordBatch:
            raw = [pickle.dumps(x, 5) for x in found.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(found), grp_kind), pa.array(raw, pa.binary())], names=["grp", "part"])

        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(0).dictionary_encode("encode")
            names, at = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            x, ends = _rows(b)[order], np.searchsorted(at[order], np.arange(len(names) + 1))
            for k, grp in enumerate(names):
                part = of(x[ends[k] : ends[k + 1]])
                if grp in found:
                    part = merge(found[grp], part)
                else:
                    held += sum(np.size(p) for p in part)
                found[grp] = part
                if held > HELD:
                    yield flush()
                    found.clear()
                    held = 0
        if found:
            yield flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        grp, part = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([grp], grp_kind), *(pa.array([v]) for v in give(part))], names=["grp", *names])

        for b in batches:
            for g, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                one = pickle.loads(raw)
                if part is not None and g == grp:
                    part = merge(part, one)
                    continue
                if part is not None:
                    yield row()
                grp, part = g, one
        if part is not None:
            yield row()

    parts = vectors.where("emb is not null").select("grp", "emb").mapInArrow(sums, f"grp {kind}, part binary")
    return parts.repartition("grp").sortWithinPartitions("grp").mapInArrow(merged, f"grp {kind}, {schema}")


def mean_vectors(vectors: DataFrame) -> DataFrame:
    """(grp, n, mean, std_max, square) of vectors(grp, id, emb), made unit; square: the mean of their squared lengths."""

    def of(x: np.ndarray) -> tuple:
        mean = x.mean(0)
        return len(x), mean, ((x - mean) ** 2).sum(0), float((x * x).sum())

    def give(part: tuple) -> tuple:
        n, mean, spread, square = part
        return n, mean, float(np.sqrt(spread.max(initial=0.0) / n)), square / n

    return by_group(vectors, of, _moments, give, "n long, mean array<double>, std_max double, square double")


def centroids(vectors: DataFrame) -> DataFrame:
    return mean_vectors(vectors).select("grp", "n", normalized(F.col("mean")).alias("centroid"))


def beside(rows: DataFrame, per_group: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the one row of per_group that their grp has. Whether it is broadcast follows from its size: that of its files where it is
    a written table, else that of the shuffled rows, when adaptive execution has them; a hot group's rows are split where it is not."""
    return rows.join(per_group, "grp", how)


def centroid_distances(vectors: DataFrame) -> DataFrame:
    """(grp, id, distance) of each vector to its group's centroid."""
    return beside(unit(vectors), centroids(vectors)).select("grp", "id", cosine_distance(F.col("emb"), F.col("centroid")).alias("distance"))


def closed_form(vectors: DataFrame, least: int = 2) -> DataFrame:
    return closed_form_of(mean_vectors(vectors), least)


def closed_form_of(moments: DataFrame, least: int = 2) -> DataFrame:
    """(grp, n, mu, r, kappa) of what `mean_vectors` gives: kappa = r (d - r^2) / (1 - r^2), r clipped to [1e-6, 1 - 1e-6], kappa 1e-3 at least; mu of a mean of no
    length is the first axis."""
    m = moments.where((F.col("n") >= least) & (F.col("std_max") >= 1e-6) & ~F.isnan("std_max"))
    r = F.least(F.greatest(F.sqrt(dot(F.col("mean"), F.col("mean"))), F.lit(1e-6)), F.lit(1 - 1e-6))
    axis = F.transform("mean", lambda x, i: F.when(i == 0, 1.0).otherwise(0.0))
    mu = F.when(dot(F.col("mean"), F.col("mean")) > 1e-24, normalized(F.col("mean"))).otherwise(axis)
    return m.withColumn("r", r).select("grp", "n", mu.alias("mu"), "r", F.greatest(F.col("r") * (F.size("mean") - F.col("r") ** 2) / (1 - F.col("r") ** 2), F.lit(1e-3)).alias("kappa"))


def skipped(moments: DataFrame, least: int = 2) -> DataFrame:
    """(grp, n, reason) of the groups with rows enough that have no fit: vectors with values that are not finite, or all alike."""
    reason = F.when(F.isnan("std_max"), "not finite").when(F.col("std_max") < 1e-6, "no variance")
    return moments.where(F.col("n") >= least).select("grp", "n", reason.alias("reason")).where("reason is not null")


@lru_cache(1)
def _debye(terms: int = 8) -> list[list[tuple[int, float]]]:
    """The polynomials u_k(t) of the uniform expansion of I_v, as (power, factor) pairs, by their recurrence:
    u_{k+1} = t^2 (1 - t^2) u_k' / 2 + the integral of (1 - 5 s^2) u_k / 8 from 0 to t."""
    u, out = {0: Fraction(1)}, []
    for _ in range(terms):
        new: dict[int, Fraction] = {}
        for n, c in u.items():
            for power, more in ((n + 1, c * n / 2 + c / (8 * (n + 1))), (n + 3, -c * n / 2 - 5 * c / (8 * (n + 3)))):
                new[power] = new.get(power, Fraction(0)) + more
        u = new
        out.append([(n, float(c)) for n, c in u.items() if c])
    return out


def _correction(v: float, x: float) -> float:
    """log of 1 + u_1(t) / v + u_2(t) / v^2 + ..., t = v / sqrt(v^2 + x^2); all powers of v cancel, so v may be 0."""
    q = 1 / math.hypot(v, x)
    return math.log1p(sum(c * q**k * (v * q) ** (n - k) for k, u in enumerate(_debye(), 1) for n, c in u))


#: From this value of sqrt(v^2 + x^2) on the uniform expansion has all digits of a double; below it a series of few terms has.
_FAR = 60.0


def log_bessel(v: float, x: float) -> float:
    """log I_v(x) for v >= 0, x > 0."""
    r = math.hypot(v, x)
    if r >= _FAR:
        return r - v * math.asinh(v / x) - math.log(2 * math.pi * r) / 2 + _correction(v, x)
    # sum of (x / 2)^(2 k + v) / (k! gamma(k + v + 1)) over k; its terms rise up to k near x / 2
    k = np.arange(int(x) + 60)
    log_terms = (2 * k + v) * math.log(x / 2) - np.array([math.lgamma(i + 1) + math.lgamma(i + v + 1) for i in k.tolist()])
    top = float(log_terms.max())
    return top + math.log(np.exp(log_terms - top).sum())


def log_bessel_ratio(kappa: float, d: int) -> float:
    """log of I_{d/2}(kappa) / I_{d/2-1}(kappa), the mean length of a sum's share, without the loss that a difference of large logs has."""
    v = d / 2 - 1
    low, high = math.hypot(v, kappa), math.hypot(v + 1, kappa)
    if low < _FAR:
        return log_bessel(v + 1, kappa) - log_bessel(v, kappa)
    more = (2 * v + 1) / (low + high)
    return more - (v + 1) * math.asinh((v + 1) / kappa) + v * math.asinh(v / kappa) - math.log1p(more / low) / 2 + _correction(v + 1, kappa) - _correction(v, kappa)


def bessel_ratio(kappa: float, d: int) -> float:
    return math.exp(log_bessel_ratio(kappa, d))


def exact_kappa(r: float, d: int) -> float:
    """The kappa whose ratio is r, by bisection of its logarithm: the ratio rises with kappa. 1e-8 at least."""
    want = math.log(r)
    guess = max(1e-8, r * (d - r * r) / (1 - r * r))
    low, high = math.log(guess) - 1, math.log(guess) + 1
    while log_bessel_ratio(math.exp(low), d) > want and low > math.log(1e-8):
        low -= 2
    while log_bessel_ratio(math.exp(high), d) < want:
        high += 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if log_bessel_ratio(math.exp(mid), d) < want else (low, mid)
    return max(1e-8, math.exp((low + high) / 2))


def fit(vectors: DataFrame, least: int = 2, exact: bool = True) -> DataFrame:
    return fit_of(mean_vectors(vectors), least, exact)


def fit_of(moments: DataFrame, least: int = 2, exact: bool = True) -> DataFrame:
    """(grp, n, mu, r, kappa, log_c): the fit and the log of the density's constant; one small row per group."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            d = [len(m) for m in p.mu]
            if exact:
                p["kappa"] = [exact_kappa(r, k) for r, k in zip(p.r, d, strict=True)]
            p["log_c"] = [(k / 2 - 1) * math.log(q) - k / 2 * math.log(2 * math.pi) - log_bessel(k / 2 - 1, q) for q, k in zip(p.kappa, d, strict=True)]
            yield p

    base = closed_form_of(moments, least)
    return base.mapInPandas(run, T.StructType([*base.schema.fields, T.StructField("log_c", T.DoubleType())]))


def log_likelihoods(vectors: DataFrame, fits: DataFrame) -> DataFrame:
    """(grp, id, ll); fits are one row per category."""
    return beside(unit(vectors), fits).select("grp", "id", (F.col("log_c") + F.col("kappa") * dot(F.col("emb"), F.col("mu"))).alias("ll"))


#: Bits of a value's order that a pass of `percentiles` counts by.
DIGIT = 16


def _ordered(rows: DataFrame, grp: str) -> DataFrame:
    """(grp, key): x as a whole number with the order of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = (b.column(1).to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits ^ (bits >> 63 & np.int64((1 << 63) - 1)))], names=["grp", "key"])

    return rows.mapInArrow(run, f"grp {grp}, key long")


def _values(found: DataFrame, grp: str) -> DataFrame:
    """(grp, n, rank, x) of found(grp, n, rank, key): the numbers of `_ordered` back as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(3).to_numpy(zero_copy_only=False)
            bits = key ^ (key >> 63 & np.int64((1 << 63) - 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(bits.view(np.float64))], names=["grp", "n", "rank", "x"])

    return found.select("grp", "n", "rank", "key").mapInArrow(run, f"grp {grp}, n long, rank long, x double")


def _selected(some: DataFrame, sizes: DataFrame, p: float) -> DataFrame:
    """(grp, cut) by digits: each pass counts the values that share what is known of the sought one by their next digit, and so finds that
    digit; the last pass knows the value. Per group it holds a count per digit."""
    grp = some.schema["grp"].dataType.simpleString()
    point = (F.col("n") - 1) * F.lit(p)
    keys = written(_ordered(some, grp), "keys")
    ranks = F.explode(F.array_distinct(F.array(F.floor(point).cast("long"), F.ceil(point).cast("long"))))
    sought = written(sizes.select("grp", "n", ranks.alias("rank")).withColumns({"left": F.col("rank"), "known": F.lit(0).cast("long")}), "sought")
    for shift in range(64 - DIGIT, -1, -DIGIT):
        # The sign makes the first digit count from below: all further ones are of bits without a sign.
        digit = F.shiftright("key", shift) + (1 << DIGIT - 1) if shift == 64 - DIGIT else F.shiftrightunsigned("key", shift).bitwiseAND((1 << DIGIT) - 1)
        known = F.lit(0).cast("long") if shift == 64 - DIGIT else F.shiftright("key", shift + DIGIT)
        counts = keys.select("grp", known.alias("known"), digit.alias("digit")).join(sought.select("grp", "known").distinct(), ["grp", "known"], "left_semi")
        digits = counts.groupBy("grp", "known", "digit").agg(F.count("*").alias("times")).groupBy("grp", "known").agg(F.sort_array(F.collect_list(F.struct("digit", "times"))).alias("digits"))
        start = F.struct(F.col("left").alias("left"), F.lit(-1).cast("long").alias("digit"))
        over = F.aggregate("digits", start, lambda at, d: F.when(at["digit"] >= 0, at).when(at["left"] < d["times"], F.struct(at["left"].alias("left"), d["digit"].cast("long").alias("digit"))).otherwise(F.struct((at["left"] - d["times"]).alias("left"), at["digit"].alias("digit"))))
        found = sought.join(digits, ["grp", "known"]).select("grp", "n", "rank", "known", over.alias("at"))
        value = F.col("at.digit") - (1 << DIGIT - 1) if shift == 64 - DIGIT else F.shiftleft("known", DIGIT).bitwiseOR(F.col("at.digit"))
        sought = written(found.select("grp", "n", "rank", F.col("at.left").alias("left"), value.alias("known")), "sought")
    values = _values(sought.withColumnRenamed("known", "key"), grp).groupBy("grp", "n").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return values.select("grp", (F.col("a") + (F.col("b") - F.col("a")) * (point - F.floor(point))).alias("cut"))


def percentiles(rows: DataFrame, value: str, p: float, whole: int = 100_000) -> DataFrame:
    """(grp, cut): the exact interpolated percentile of value in each group. Null values do not count.

    Groups are counted first. While the largest has at most `whole` rows, an aggregate of the group's values gives it; else it is
    selected digit by digit, so that no task holds or sorts a group. rows are read several times: write them first."""
    x = F.col(value)
    some = rows.where(x.isNotNull()).select("grp", x.cast("double").alias("x"))
    sizes = some.groupBy("grp").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most <= whole:
        return some.groupBy("grp").agg(F.percentile("x", F.lit(p)).alias("cut"))
    return _selected(some, sizes, p)


def outliers(lls: DataFrame, percent: float = 0.1) -> DataFrame:
    """Rows below the percentile (interpolated) of their group, strictly."""
    return beside(lls, percentiles(lls, "ll", percent)).where("ll < cut").select("grp", "id", "ll")


def _vendi(n: int, e: np.ndarray, normalize: bool) -> float:
    e = e[e > 1e-14]
    q = e / e.sum()
    score = 1.0 if n <= 1 or not len(e) else float(np.exp(-(q * np.log(q + 1e-15)).sum()))
    return score / n if normalize and n > 1 else score


def vendi(vectors: DataFrame, normalize: bool = False) -> DataFrame:
    """(grp, n, vendi): exp of the entropy of the eigenvalues of X X' / n.

    They are those of the d x d matrix X' X, summed from partial sums, or for a group of fewer rows than dimensions those of its n x n matrix,
    from its rows: no group takes more than d x d numbers in a task, or more than it has in a shuffle."""
    kind = vectors.schema["grp"].dataType.simpleString()
    some = vectors.where("emb is not null").select("grp", "emb")
    sizes = written(some.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.size("emb")).alias("d")), "sizes")
    sized = beside(some, sizes)

    def of_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for rows in p.rows:
                x = np.stack(rows).astype(float)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
                out.append(_vendi(len(x), np.linalg.eigvalsh(x @ x.T / len(x)), normalize))
            yield pd.DataFrame({"grp": p.grp, "n": p.n, "vendi": out})

    few = sized.where("n < d").groupBy("grp", "n").agg(F.collect_list("emb").alias("rows")).mapInPandas(of_rows, f"grp {kind}, n long, vendi double")
    add = lambda a, b: (a[0] + b[0], a[1] + b[1])
    give = lambda part: (part[0], _vendi(part[0], np.linalg.eigvalsh(part[1] / part[0]), normalize))
    return few.unionByName(by_group(sized.where("n >= d").select("grp", "emb"), lambda x: (len(x), x.T @ x), add, give, "n long, vendi double"))
