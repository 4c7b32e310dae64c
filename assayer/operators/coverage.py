"""Coverage: expected and observed combinations of values, completeness, curves, exclusions, distributions."""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L


def expected_combinations(values: dict[str, DataFrame], distinct: bool = True) -> DataFrame:
    """The product of the values of each dimension, for those who want it listed. distinct: a value listed twice counts once."""
    parts = [v.select(F.col(v.columns[0]).alias(name)) for name, v in values.items()]
    return reduce(DataFrame.crossJoin, [p.distinct() for p in parts] if distinct else parts)


def row_combinations(rows: DataFrame, columns: list[str], id_col: str = "row_id", elide: bool = False) -> DataFrame:
    """A row per combination of a row's own atoms; rows with an empty dimension give none. elide: placeholders are empty."""
    out = rows.select(id_col, *columns)
    for c in columns:
        cell = F.when(L.placeholder(c), F.lit(None)).otherwise(F.col(c)) if elide else F.col(c)
        out = out.withColumn(c, F.explode(F.array_distinct(L.atoms(cell))))
    return out


def combination_counts(rows: DataFrame, columns: list[str], id_col: str = "row_id", elide: bool = False) -> DataFrame:
    return row_combinations(rows, columns, id_col, elide).groupBy(*columns).agg(F.count("*").alias("n"))


class Space:
    """The combinations of the values of some dimensions, a schema's lists: numbered, never listed as a whole.

    A combination's rank has a digit per dimension, the place of its value among the dimension's sorted ones, so that ranks are in the order of the
    values. Ranks are whole numbers of 64 bits, or decimals where there are more; at most 10^32 combinations."""

    def __init__(self, values: dict[str, list[str]]):
        self.values = {c: sorted(set(vs)) for c, vs in values.items()}
        self.columns, self.sizes = list(values), [len(vs) for vs in self.values.values()]
        self.expected = math.prod(self.sizes)
        if self.expected > 10**32:
            raise ValueError("more than 10^32 combinations")
        self.strides = [math.prod(self.sizes[i + 1 :]) for i in range(len(self.sizes))]
        self.kind = "long" if self.expected < 1 << 62 else "decimal(38,0)"

    def number(self, n: int) -> Column:
        return F.lit(n) if n < 1 << 31 else F.lit(str(n)).cast(self.kind)

    def quotient(self, rank: Column, n: int) -> Column:
        """Whole number division. Of decimals the rest goes first, and the division is exact."""
        by = self.number(n).cast(self.kind)
        return (F.call_function("div", rank, by) if self.kind == "long" else (rank - rank % by) / by).cast(self.kind)

    def places(self, spark: SparkSession, column: str) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.values[column])), f"_place int, `{column}` string")

    def ranked(self, combos: DataFrame) -> DataFrame:
        """combos with their rank; those that are not in the space go."""
        out = combos.withColumn("rank", F.lit(0).cast(self.kind))
        for c, stride in zip(self.columns, self.strides, strict=True):
            place = F.col("_place").cast(self.kind) * self.number(stride)
            out = out.join(self.places(combos.sparkSession, c), c).withColumn("rank", (F.col("rank") + place).cast(self.kind)).drop("_place")
        return out

    def combinations(self, ranks: DataFrame) -> DataFrame:
        """The columns of ranks(rank)."""
        out = ranks
        for c, stride, size in zip(self.columns, self.strides, self.sizes, strict=True):
            digit = self.quotient(F.col("rank"), stride) % size
            out = out.withColumn("_place", digit.cast("int")).join(self.places(ranks.sparkSession, c), "_place").drop("_place")
        return out.select(*self.columns)

    def gaps(self, ranked: DataFrame) -> DataFrame:
        """(first, past): the stretches of ranks that ranked(rank) lacks. Digit by digit: what begins like some rank but goes on with a value that
        none of these has is one stretch."""
        spark, found = ranked.sparkSession, []
        if not self.expected:
            return spark.createDataFrame([], f"first {self.kind}, past {self.kind}")
        for stride, size in zip(self.strides, self.sizes, strict=True):
            node = self.quotient(F.col("rank"), stride)
            parents = ranked.select(node.alias("node")).distinct().select(self.quotient(F.col("node"), size).alias("parent"), (F.col("node") % size).cast("int").alias("place"))
            if stride * size == self.expected:
                parents = parents.unionByName(spark.createDataFrame([(None,)], "place int").select(F.lit(0).cast(self.kind).alias("parent"), "place"))
            left = F.array_except(F.sequence(F.lit(0), F.lit(size - 1)), F.collect_set("place"))
            child = (F.col("parent") * self.number(size) + F.col("place")).cast(self.kind)
            lost = parents.groupBy("parent").agg(left.alias("left")).select("parent", F.explode("left").alias("place"))
            first = (child * self.number(stride)).cast(self.kind)
            found.append(lost.select(first.alias("first"), (first + self.number(stride)).cast(self.kind).alias("past")))
        return reduce(DataFrame.unionByName, found)

    def listed(self, gaps: DataFrame, most: int | None = None) -> DataFrame:
        """The combinations in the gaps, or the first `most` of them: only those are made."""
        step = 4_096
        if most is not None:
            gaps = gaps.orderBy("first").limit(most).select("first", F.least("past", F.col("first") + most).cast(self.kind).alias("past"))
        if self.kind != "long":  # sequences are of 64-bit numbers: from the start of a gap on
            starts = gaps.select("first", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("past") - F.col("first") - 1).cast("long"))).alias("_k"))
            ranks = starts.select((F.col("first") + F.col("_k")).cast(self.kind).alias("rank"))
        else:
            starts = gaps.select(F.explode(F.sequence("first", F.col("past") - 1, F.lit(step).cast("long"))).alias("first"), "past")
            ranks = starts.select(F.explode(F.sequence("first", F.least(F.col("first") + step, "past") - 1)).alias("rank"))
        return self.combinations(ranks if most is None else ranks.orderBy("rank").limit(most))

    def excluded(self, rules: list[list[str]]) -> int:
        """How many combinations some rule excludes: one whose values, in whatever columns, are among the combination's as often as the rule
        has them. Each way to give a rule's values to columns is a box; the size of the union is found column by column."""
        plain = {c: [L.canonical_text(v) for v in vs] for c, vs in self.values.items()}
        boxes: set[tuple] = set()
        for rule in rules:
            some = {frozenset()}
            for item in map(L.canonical_text, rule):
                some = {box | {(i, item)} for box in some for i, c in enumerate(self.columns) if item in plain[c] and all(i != j for j, _ in box)}
            boxes |= {tuple(sorted(box)) for box in some}
        wanted = [dict(box) for box in boxes]

        @lru_cache(None)
        def hit(column: int, alive: frozenset) -> int:
            if not alive:
                return 0
            if any(all(i < column for i in wanted[b]) for b in alive):
                return math.prod(self.sizes[column:])
            kinds = Counter(frozenset(b for b in alive if wanted[b].get(column, v) == v) for v in plain[self.columns[column]])
            return sum(times * hit(column + 1, left) for left, times in kinds.items())

        return hit(0, frozenset(range(len(wanted))))


def with_counts(expected: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    return expected.join(counts, columns, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def _at_least(counts: DataFrame, least: Column | int) -> DataFrame:
    return counts.where(F.col("n") >= (F.lit(least) if isinstance(least, int) else least))


def completeness(space: Space, counts: DataFrame, min_count: Column | int = 1, intersect: bool = True, excluded: int = 0) -> DataFrame:
    """One row: expected, observed, ratio (1 if nothing is expected). intersect: only expected combinations count as observed. excluded: of the
    expected ones; counts are without them then."""
    seen = _at_least(counts, min_count)
    seen = space.ranked(seen) if intersect else seen
    expected = space.expected - excluded
    one = seen.agg(F.count("*").alias("observed")).select(space.number(expected).cast(space.kind).alias("expected"), "observed")
    return one.withColumn("ratio", F.when(F.col("expected") == 0, 1.0).otherwise(F.col("observed") / F.col("expected").cast("double")))


def missing(space: Space, counts: DataFrame, min_count: int = 1, most: int | None = None) -> DataFrame:
    """The expected combinations with fewer rows, or the first `most`, in the order of their values."""
    return space.listed(space.gaps(space.ranked(_at_least(counts, min_count)).select("rank")), most)


def group_sizes(space: Space, counts: DataFrame, excluded: int = 0) -> DataFrame:
    """(n, groups): how many expected combinations have n rows. No combination without rows is made."""
    seen = space.ranked(counts).groupBy("n").agg(F.count("*").alias("groups"))
    none = seen.agg(F.coalesce(F.sum("groups"), F.lit(0)).alias("seen")).select(F.lit(0).cast("long").alias("n"), (space.number(space.expected - excluded) - F.col("seen")).cast(space.kind).alias("groups"))
    return seen.unionByName(none.where("groups > 0"))


def _sized(counted: DataFrame) -> DataFrame:
    """(n, groups) of groups given one by one (n), or as they are."""
    return counted if "groups" in counted.columns else counted.groupBy("n").agg(F.count("*").alias("groups"))


def curve_steps(sizes: DataFrame) -> DataFrame:
    """(from_k, to_k, below, held, groups) of sizes(n, groups), a row between two sizes that occur: `below` groups have fewer than k rows, and
    `held` rows together, for all k of a step, so that the penalty is (below k - held) / (k groups).

    The running sums go over distinct sizes, of which R rows have at most sqrt(2 R)."""
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = sizes.agg(F.sum("groups").alias("total"))
    steps = sizes.groupBy("n").agg(F.sum("groups").alias("groups"))
    steps = steps.select("n", F.sum("groups").over(upto).alias("below"), F.sum(F.col("n") * F.col("groups")).over(upto).alias("held"), F.lead("n").over(Window.orderBy("n")).alias("to_k"))
    first = sizes.agg(F.min("n").alias("to_k")).select(F.lit(0).cast("long").alias("n"), F.lit(0).alias("below"), F.lit(0).alias("held"), "to_k").where("to_k > 0")
    return steps.unionByName(first).where("to_k > n").crossJoin(F.broadcast(every)).select((F.col("n") + 1).alias("from_k"), "to_k", "below", "held", F.col("total").alias("groups"))


def _score(k: Column) -> Column:
    return (F.col("below") * k - F.col("held")) / (k * F.col("groups"))


def curve(sizes: DataFrame, max_k: int | None = None) -> DataFrame:
    """k, score: the mean penalty 1 - min(n, k) / k of sizes(n, groups), or of groups(n), for k from 1 to max_k (default: the largest n, at least 1). Of a
    step between two sizes only a stretch at a time is listed; whole numbers are summed, so that a score is one division."""
    step, sizes = 4_096, _sized(sizes)
    steps = curve_steps(sizes)
    top = sizes.agg(F.max("n").alias("n"), F.sum("groups").alias("groups"), F.sum(F.col("n") * F.col("groups")).alias("held"))
    # Beyond the largest size all groups are below.
    last = top.select((F.col("n") + 1).alias("from_k"), F.lit(max_k if max_k else 1).cast("long").alias("to_k"), F.col("groups").alias("below"), "held", "groups").where("to_k >= from_k")
    steps = steps.unionByName(last).withColumn("to_k", F.least("to_k", F.lit(max_k).cast("long"))).where("to_k >= from_k") if max_k else steps.unionByName(last)
    some = steps.select(F.explode(F.sequence("from_k", "to_k", F.lit(step).cast("long"))).alias("from_k"), "to_k", "below", "held", "groups")
    return some.select(F.explode(F.sequence("from_k", F.least(F.col("from_k") + step - 1, "to_k"))).alias("k"), "below", "held", "groups").select("k", _score(F.col("k")).alias("score"))


def score_at(sizes: DataFrame, k: int) -> DataFrame:
    """One row: the penalty at k, null without groups."""
    lacking = F.sum(F.col("groups") * (k - F.least(F.col("n"), F.lit(k))))
    return sizes.agg((lacking / (k * F.sum("groups"))).alias("score"))


def weighted_median(sizes: DataFrame) -> DataFrame:
    """(group_count, group_mean, group_median) of sizes(n, groups)."""
    running = sizes.groupBy("n").agg(F.sum("groups").alias("groups")).withColumn("upto", F.sum("groups").over(Window.orderBy("n")))
    total = sizes.agg(F.sum("groups").alias("total"), (F.sum(F.col("n") * F.col("groups")) / F.sum("groups")).alias("mean"))
    low, high = F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("n"))), F.min(F.when(F.col("upto") * 2 > F.col("total"), F.col("n")))
    return running.crossJoin(F.broadcast(total)).groupBy("total", "mean").agg(((low + high) / 2).alias("group_median")).select(F.col("total").alias("group_count"), F.col("mean").alias("group_mean"), "group_median")


def excluded(combos: DataFrame, rules: DataFrame, columns: list[str], keep: bool = False) -> DataFrame:
    """combos without those that a rule(values) excludes, or only these; rules are a short list given by the user."""
    combo = F.transform(F.array(*columns), L.canonical)
    return combos.join(F.broadcast(rules), L.contains_rule(combo, F.transform(rules["values"], L.canonical)), "left_semi" if keep else "left_anti")


def holistic(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The mean over optional columns of the share of cells with a value; 1 without such columns."""
    if not columns:
        return rows.sparkSession.range(1).select(F.lit(1.0).alias("holistic"))
    shares = [F.avg(F.when(L.placeholder(c), 0.0).otherwise(1.0)) for c in columns]
    return rows.agg((reduce(lambda a, b: a + b, shares) / len(columns)).alias("holistic"))


def _unpivot(rows: DataFrame, columns: list[str], cell) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(c).alias("col"), cell(c).alias("value")) for c in columns))
    return rows.select(F.explode(pairs).alias("p")).select("p.col", "p.value")


def cross_distribution(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Percent of rows per raw cell value, a missing one as NA."""
    counts = _unpivot(rows, columns, L.or_na).groupBy("col", "value").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("col", "value", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def marginal_distribution(rows: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """Percent of rows that have each expected(col, value), canonical on both sides; a row counts once per value; 0 of no rows."""
    cells = _unpivot(rows, columns, lambda c: F.array_distinct(F.transform(L.atoms(c), L.canonical)))
    counts = cells.select("col", F.explode("value").alias("value")).groupBy("col", "value").agg(F.count("*").alias("n"))
    wanted = expected.select("col", L.canonical("value").alias("value")).distinct()
    total = rows.agg(F.count("*").alias("total"))
    return wanted.join(counts, ["col", "value"], "left").crossJoin(F.broadcast(total)).select("col", "value", (100.0 * F.coalesce("n", F.lit(0)) / F.greatest("total", F.lit(1))).alias("percent"))


def marginal_coverage(rows: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: expected, covered and new values, and the share of expected ones that are covered."""
    seen = _unpivot(rows, columns, L.atoms).select("col", F.explode("value").alias("value")).distinct().withColumn("seen", F.lit(True))
    wanted = expected.select("col", "value").distinct().withColumn("wanted", F.lit(True))
    both = seen.join(wanted, ["col", "value"], "full_outer").groupBy("col").agg(
        F.count("wanted").alias("expected"), F.count(F.when(F.col("seen") & F.col("wanted"), 1)).alias("covered"), F.count(F.when(F.col("seen") & F.col("wanted").isNull(), 1)).alias("new_values")
    )
    return both.withColumn("ratio", F.when(F.col("expected") == 0, 1.0).otherwise(F.col("covered") / F.col("expected")))


def marginal_values(rows: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """(col, value, kind): the expected values that no row has (missing) and the values of rows that are not expected (new)."""
    seen = _unpivot(rows, columns, L.atoms).select("col", F.explode("value").alias("value")).distinct()
    wanted = expected.select("col", "value").distinct()
    missing = wanted.join(seen, ["col", "value"], "left_anti").withColumn("kind", F.lit("missing"))
    return missing.unionByName(seen.join(wanted, ["col", "value"], "left_anti").withColumn("kind", F.lit("new")))


def audit(rows: DataFrame, rules: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per invalid combination, those without rows too."""
    hits = rows.groupBy(*columns).agg(F.count("*").alias("rows"))
    return rules.join(hits, columns, "left").select(*columns, F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def outlier_codes(rows: DataFrame, outliers: DataFrame, rules: DataFrame, columns: list[str], id_col: str = "row_id") -> DataFrame:
    """0: none, 1: coverage outlier, 2: invalid combination, 3: both."""
    far = outliers.select(id_col).distinct().withColumn("_far", F.lit(1))
    bad = rules.select(*columns).distinct().withColumn("_bad", F.lit(2))
    both = rows.select(id_col, *columns).join(far, id_col, "left").join(F.broadcast(bad), columns, "left")
    return both.select(id_col, (F.coalesce("_far", F.lit(0)) + F.coalesce("_bad", F.lit(0))).cast("int").alias("outlier"))
