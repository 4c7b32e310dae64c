"""Evaluation of a labelled dataset against its schema: full results as DataFrames, a document of the small ones, row metrics.

Vectors come as columns. What several numbers need (the rows, their categories with vectors, sums per category, fits, likelihoods, similar
pairs) is a named table, written once and read by all of them. Results that grow with the rows (pairs, outliers, instances, curves, row
metrics) are frames; the document has their counts and the first few in a fixed order.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import labels as L
from .functions.vectors import cosine_distance, normalized
from .operators import coverage as C
from .operators import pairwise as P
from .operators import realism as R
from .operators import spherical as S
from .operators import transport as T
from .schema import Schema
from .sources.tables import numbered
from .store import written

NAN = float("nan")


@dataclass(frozen=True)
class Options:
    """k: rows wanted per combination; curve_k: to which k the document lists the curves, which frames have whole. least_*: rows a category needs for a fit, for
    diversity, for the marginal mean. shown: categories that the document lists, by name; frames have all."""

    k: int = 10
    curve_k: int = 1_000
    shown: int = 1_000
    redundancy: float = 0.95
    least_samples: int = 3
    least_subgroup: int = 2
    least_marginal: int = 6
    percentile: float = 0.1
    kernel: str = "cs"
    tau: float = 1.0
    transport: bool = True  # off to leave out the transport distances, which take a job per half step for large sets
    boots: int = 25
    seed: int = 42


@dataclass
class Report:
    """document: the report; frames: whole results by name; rows: the dataset with four columns more."""

    document: dict[str, Any]
    frames: dict[str, DataFrame] = field(default_factory=dict)
    rows: DataFrame | None = None

    def lines(self) -> list[str]:
        return [*coverage_lines(self.document), *diversity_lines(self.document), *realism_lines(self.document)]


def tagged(grp: Column, by: str | None) -> Column:
    """A group's key among those of all datasets: with that of its dataset in front."""
    return grp if by is None else F.concat_ws("\x1f", F.col(by), grp)


def memberships(rows: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(id, grp, coarse): each row under each part of its composite label and under the whole of it, once each; by: a column whose values
    have categories of their own."""
    parts = F.array(*(F.struct(tagged(L.part(c), by).alias("grp"), F.lit(True).alias("coarse")) for c in columns))
    whole = F.struct(tagged(L.composite(columns), by).alias("grp"), F.lit(len(columns) == 1).alias("coarse"))
    return rows.select(F.col("row_id").alias("id"), F.explode(F.array_distinct(F.array_append(parts, whole))).alias("m")).select("id", "m.grp", "m.coarse")


def evaluate(
    rows: DataFrame,
    schema: Schema,
    vectors: DataFrame,
    seeds: DataFrame,
    *,
    style: DataFrame | None = None,
    style_seeds: DataFrame | None = None,
    seed_labels: DataFrame | None = None,
    subset: list[int] | None = None,
    exclusions: list[list[str]] | None = None,
    options: Options = Options(),
) -> Report:
    """rows(row_id, columns of the schema), vectors(id, emb) of the rows, seeds(id, emb) of the seed texts, id being their index.

    Extra columns of rows are kept. A row without a vector has null distances; a dataset without rows gives NaN scores. subset: the
    seeds of a second realism part; ValueError if an index is not among the seeds. exclusions: combinations that do not count.
    seed_labels(id, label): composite labels of seeds; with them realism has a part per category."""
    if options.k < 1:
        raise ValueError("k is 1 at least")
    rows = written(schema.require(rows), "rows")
    one = lambda v: v.select(F.lit("all").alias("grp"), F.col("id").cast("long").alias("id"), F.col("emb").cast("array<double>").alias("emb"))
    v, s = one(vectors), one(seeds)
    if subset is not None:
        found = {r.id for r in s.where(F.col("id").isin(subset)).select("id").collect()}
        if lost := sorted(set(subset) - found):
            raise ValueError(f"no seeds of index {lost}")
    frames: dict[str, DataFrame] = {}
    doc: dict[str, Any] = {"inputs": _inputs(schema, subset, exclusions, s), **_coverage(rows, schema, exclusions, options, frames)}
    grouped = _fitted(rows, schema, v, options, frames)
    doc["coverage"] |= _categories(grouped, options, frames)
    doc["diversity"] = _diversity(v, grouped, options, frames)
    doc["realism_full"] = _realism(rows, schema, v, s, style and one(style), style_seeds and one(style_seeds), options, frames, "full", grouped, seed_labels)
    doc["realism_subset"] = None
    if subset is not None:
        part = lambda d: d and one(d).where(F.col("id").isin(subset))
        doc["realism_subset"] = _realism(rows, schema, v, part(seeds), style and one(style), part(style_seeds), options, frames, "subset", grouped, seed_labels)
    out = written(_row_metrics(rows, schema, v, grouped, frames, options), "row-metrics")
    doc |= _row_level(out, frames)
    doc["summary"] = _summary(doc, rows, schema)
    fixed = schema.document.get("fixedFields") or {}
    doc["schema"] = {"capability": fixed.get("capability"), "deployment_population": schema.population, "contextual_constraints": fixed.get("contextualConstraints")}
    return Report(doc, frames, out)


def _fitted(rows: DataFrame, schema: Schema, v: DataFrame, options: Options, frames: dict, by: str | None = None) -> DataFrame:
    """The rows' vectors under each of their categories, written; with the tables that all the rest reads: moments, fits, likelihoods and
    category_outliers."""
    grouped = written(memberships(rows, schema.columns, by).join(v.drop("grp"), "id"), "grouped")
    frames["moments"] = written(S.mean_vectors(grouped.select("grp", "id", "emb")), "moments")
    frames["skipped_categories"] = S.skipped(frames["moments"], options.least_samples)
    frames["fits"] = written(S.fit_of(frames["moments"], options.least_samples), "fits")
    frames["likelihoods"] = written(S.log_likelihoods(grouped, frames["fits"]), "likelihoods")
    frames["category_outliers"] = written(S.outliers(frames["likelihoods"], options.percentile), "outliers")
    return grouped


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def _inputs(schema: Schema, subset, exclusions, seeds: DataFrame) -> dict:
    return {"constituent_columns": schema.columns, "required_columns": schema.required, "optional_columns": schema.optional, "invalid_combinations": len(schema.invalid_combinations()), "seeds": seeds.count(), "seed_subset": subset, "not_realistic": exclusions}


def _coverage(rows: DataFrame, schema: Schema, exclusions, options: Options, frames: dict) -> dict:
    spark, out = rows.sparkSession, {}
    required, every = schema.required, [*schema.required, *schema.optional]
    rules = spark.createDataFrame([(r,) for r in exclusions or []], "values array<string>")

    def vary(name: str, columns: list[str], limited: bool = False) -> dict:
        if not columns:
            return _curve(None, None, options, 0)
        space, counts = C.Space({c: schema.values[c] for c in columns}), C.combination_counts(rows, columns)
        gone = space.excluded(exclusions) if limited else 0
        sizes = written(C.group_sizes(space, C.excluded(counts, rules, columns) if limited else counts, gone), "sizes")
        frames[f"{name}_steps"], frames[f"{name}_curve"] = C.curve_steps(sizes), C.curve(sizes)
        return _curve(sizes, frames[f"{name}_curve"], options, gone)

    ratio = {"expected": 0, "observed": 0, "ratio": 1.0}
    out["coverage_constrained"] = None
    missing: list = []
    if required:
        space, counts = C.Space({c: schema.values[c] for c in required}), written(C.combination_counts(rows, required, elide=True), "combinations")
        frames["missing_combinations"] = C.missing(space, counts)
        ratio = _dicts(C.completeness(space, counts))[0]
        missing = [list(r) for r in C.missing(space, counts, most=20).orderBy(*required).collect()]
        if exclusions:
            left = _dicts(C.completeness(space, C.excluded(counts, rules, required), excluded=space.excluded(exclusions)))[0]
            out["coverage_constrained"] = {"expected_count": left["expected"], "observed_count": left["observed"], "excluded_count": ratio["expected"] - left["expected"], "missing_count": left["expected"] - left["observed"], "coverage_constrained": left["ratio"]}
    marginal: list[dict] = []
    if required:
        of_required = schema.expected(spark).where(F.col("col").isin(required))
        marginal = _dicts(C.marginal_coverage(rows, of_required, required).orderBy("col"))
        frames["marginal_values"] = C.marginal_values(rows, of_required, required)
        place = F.row_number().over(Window.partitionBy("col", "kind").orderBy("value"))
        firsts = frames["marginal_values"].withColumn("place", place).where("place <= 20").orderBy("col", "kind", "value").collect()
        for m in marginal:
            m |= {f"{kind}_values_sample": [r.value for r in firsts if (r.col, r.kind) == (m["col"], kind)] for kind in ("missing", "new")}
    out["coverage"] = {
        "expected_combinations_count": ratio["expected"], "observed_combinations_count": ratio["observed"], "missing_combinations_count": ratio["expected"] - ratio["observed"], "missing_combinations_sample": missing,
        "completeness_ratio": ratio["ratio"], "holistic_completeness_score": C.holistic(rows, schema.optional).first().holistic,
        "marginal_coverage": {m.pop("col"): m for m in marginal}, "marginal_coverage_mean": _mean([m["ratio"] for m in marginal]),
    }
    out["coverage_vary"] = out["coverage_uncertain"] = vary("coverage_vary", required)
    out["coverage_vary_constrained"] = vary("coverage_vary_constrained", required, True) if exclusions else None
    out["coverage_vary_all"] = vary("coverage_vary_all", every)
    return out


def _curve(sizes: DataFrame | None, curve: DataFrame | None, options: Options, excluded: int) -> dict:
    """sizes: a written table of how many expected combinations have how many rows."""
    out = {"default_k": options.k, "excluded_group_count": excluded, "penalty_definition": "1 - min(n, k) / k, averaged over the expected combinations"}
    total = _dicts(C.weighted_median(sizes).join(sizes.agg(F.max("n").alias("top"))))[:1] if sizes is not None else []
    if not total:
        return out | {"default_score": NAN, "max_k": 0, "k_values": [], "scores": [], "group_count": 0, "group_count_mean": NAN, "group_count_median": NAN}
    top = total[0]["top"]
    listed = curve.where(F.col("k") <= min(top, options.curve_k)).orderBy("k").collect()
    return out | {
        "default_score": C.score_at(sizes, options.k).first().score, "max_k": top, "k_values": [r.k for r in listed], "scores": [r.score for r in listed],
        "group_count": int(total[0]["group_count"]), "group_count_mean": float(total[0]["group_mean"]), "group_count_median": total[0]["group_median"],
    }


def _categories(grouped: DataFrame, options: Options, frames: dict) -> dict:
    """Outliers and similarities per category; coherence of rows with the parts of their labels; redundant pairs."""
    fits, lls, moments = frames["fits"], frames["likelihoods"], frames["moments"]
    both = grouped.select("grp", "id", "coarse").join(lls, ["grp", "id"], "left").join(fits.select("grp", "kappa"), "grp", "left")
    flag = F.col("coarse") & (F.col("ll") < -F.col("kappa"))
    results = both.groupBy("id").agg(
        F.max(F.when(~F.col("coarse"), F.col("grp"))).alias("label"), F.max(F.when(~F.col("coarse"), F.col("ll"))).alias("ll"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("coarse"), F.struct("grp", "ll"))))).alias("coarse"), F.array_sort(F.collect_list(F.when(flag, F.col("grp")))).alias("flags"),
    )
    frames["hierarchical_results"] = written(results, "coherence")
    whole = grouped.where("not coarse").select("grp", "id", "emb")
    frames["redundant_pairs_in_labels"] = written(P.similar_pairs(whole, options.redundancy), "similar")
    wholes = grouped.where("not coarse").select("grp").distinct()
    within = P.mean_similarity_of(moments.join(wholes, "grp", "left_semi")).agg((F.sum(F.col("mean_sim") * F.col("pairs")) / F.sum("pairs")).alias("sim")).first().sim
    per = fits.select("grp", "n", "kappa").join(P.pair_statistics(grouped.select("grp", "id", "emb"), moments=moments), "grp", "left")
    per = per.join(frames["category_outliers"].groupBy("grp").agg(F.count("*").alias("n_outliers")), "grp", "left").fillna(0, ["n_outliers"])
    frames["category_stats"] = written(per, "category-stats")
    stats = {
        r.grp: {"count": r.n, "concentration_kappa": r.kappa, "mean_pairwise_similarity": r.mean_sim, "min_pairwise_similarity": r.min_sim, "n_outliers": r.n_outliers}
        for r in frames["category_stats"].orderBy("grp").limit(options.shown).collect()
    }
    flagged = frames["hierarchical_results"].where(F.size("flags") > 0)
    skipped, first = frames["skipped_categories"].count(), frames["skipped_categories"].orderBy("grp").limit(20).collect()
    if skipped:
        warnings.warn(f"{skipped} categories have no fit, as {', '.join(f'{r.grp} ({r.reason})' for r in first)}", RuntimeWarning, stacklevel=3)
    return {
        "category_stats": stats, "skipped_categories_count": skipped, "skipped_categories_sample": [[r.grp, r.reason] for r in first], "overall_diversity_score": 0.0 if within is None else 1 - within, **_pairs(frames["redundant_pairs_in_labels"], "redundant_pairs"),
        "hierarchical_flagged_count": flagged.count(), "hierarchical_flagged_sample": _dicts(flagged.select("id", "label", "ll", "flags").orderBy("id").limit(10)),
    }


def _pairs(pairs: DataFrame, name: str) -> dict:
    return {f"{name}_count": pairs.count(), f"{name}_sample": [[r.id_a, r.id_b] for r in pairs.select("id_a", "id_b").distinct().orderBy("id_a", "id_b").limit(50).collect()]}


def _diversity(v: DataFrame, grouped: DataFrame, options: Options, frames: dict) -> dict:
    def scores(x: DataFrame) -> DataFrame:
        means = P.mean_similarity(x).select("grp", F.col("mean_sim").alias("mean_pairwise_similarity"))
        return P.dc_scores(x, options.kernel, options.tau).join(S.vendi(x, normalize=True).drop("n"), "grp").join(means, "grp", "left")

    frames["redundant_pairs"] = written(P.similar_pairs(v, options.redundancy), "similar")
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("n"), F.max("coarse").alias("coarse")).where(F.col("n") >= options.least_subgroup)
    sizes = written(sizes, "sizes")
    groups = frames["subgroup_diversity"] = written(scores(grouped.join(sizes.select("grp"), "grp", "left_semi").select("grp", "id", "emb")).join(sizes.select("grp", "coarse"), "grp"), "diversity")
    over = (_dicts(scores(v)) or [{}])[0]
    large = groups.where(F.col("coarse") & (F.col("n") >= options.least_marginal) & ~F.isnan("dc_score")).agg(F.avg("dc_score").alias("m")).first().m
    collapse = lambda g: g["dc_score"] < min(1.0, 2 / max(g["n"], 1))
    return {
        "overall_dc_score": over.get("dc_score", NAN), "overall_vendi_score": over.get("vendi", NAN), "overall_mean_pairwise_similarity": _or_nan(over.get("mean_pairwise_similarity")), "marginal_diversity": _or_nan(large),
        "subgroup_stats": {
            g["grp"]: {"count": g["n"], "dc_score": g["dc_score"], "vendi_score": g["vendi"], "mean_pairwise_similarity": g["mean_pairwise_similarity"], "mode_collapse": collapse(g)}
            for g in _dicts(groups.orderBy("grp").limit(options.shown))
        },
        "lowest_diversity_groups": [[g["grp"], g["dc_score"]] for g in _dicts(groups.orderBy("dc_score", "grp").limit(5))], **_pairs(frames["redundant_pairs"], "all_redundant_pairs"),
    }


def _or_nan(x: float | None) -> float:
    return NAN if x is None else x


def _realism(rows, schema, v, s, style, style_seeds, options: Options, frames: dict, name: str, grouped: DataFrame, seed_labels: DataFrame | None) -> dict:
    """One fit of seeds and rows gives the scope: rows as likely as the seeds' percentile are in it. Without a fit none is."""
    if s.isEmpty():
        raise ValueError("realism needs one seed at least")
    inside, cut = R.scope(v, s, options.percentile, options.least_samples)
    frames[f"instances_{name}"] = written(P.novelty(v, s).drop("grp").join(inside.drop("grp"), "id").select("id", "novelty_min", "novelty_avg", "ll", "in_scope"), "instances")
    means = _dicts(frames[f"instances_{name}"].agg(F.avg("novelty_min").alias("mean_dataset_novelty_min"), F.avg("novelty_avg").alias("mean_dataset_novelty_avg"), F.avg(F.col("in_scope").cast("double")).alias("dataset_containment_rate"), F.count(F.when(~F.col("in_scope"), 1)).alias("out_of_scope_count")))[0]
    first = cut.first()
    out = {k: NAN if x is None else x for k, x in means.items()} | {"seed_validity_score": first and first.validity}
    out["dataset_extrapolation_quality"] = out["mean_dataset_novelty_min"] * out["dataset_containment_rate"]
    solved = T.calibrated(v.select("id", "emb"), s.select("id", "emb"), options.boots, seed=options.seed).first() if options.transport and not v.isEmpty() else None
    for key, of in (("raw_sinkhorn_distance", "raw"), ("calibrated_sinkhorn_distance", "score"), ("calibrated_sinkhorn_distance_ci_005", "low"), ("calibrated_sinkhorn_distance_ci_095", "high")):
        out[key] = solved[of] if solved else NAN
    far = P.novelty(style, style_seeds).agg(F.avg("novelty_avg").alias("far")).first().far if style and style_seeds else None
    out |= {"mean_style_distance_avg": NAN if far is None else far, "style_realism_score": NAN if far is None else 1 / (1 + far)}
    out["seed_has_labels"], out["category_stats"] = seed_labels is not None, {}
    if seed_labels is not None:
        labelled = s.drop("grp").join(seed_labels.select(F.col("id").cast("long").alias("id"), F.col("label").alias("grp")), "id").select("grp", "id", "emb")
        whole = grouped.where("not coarse" if len(schema.columns) > 1 else "coarse").select("grp", "id", "emb")
        frames[f"realism_categories_{name}"] = written(R.category_stats(whole, labelled, options.percentile, options.least_samples), "realism")
        out["category_stats"] = {r.pop("grp"): r for r in _dicts(frames[f"realism_categories_{name}"].orderBy("grp").limit(options.shown))}
    rules = schema.invalid_combinations()
    if rules:
        table = rows.sparkSession.createDataFrame(rules, ", ".join(f"`{c}` string" for c in schema.columns)).distinct()
        frames["invalid_combinations"] = C.audit(rows.select(*(L.or_na(c).alias(c) for c in schema.columns)), table, schema.columns)
    out["invalid_combo_coverage"] = {" | ".join(r[:-1]): r[-1] for r in frames["invalid_combinations"].orderBy(*schema.columns).collect()} if rules else {}
    return out


def _row_metrics(rows: DataFrame, schema: Schema, v: DataFrame, grouped: DataFrame, frames: dict, options: Options, by: str | None = None) -> DataFrame:
    """centroid_dist (to the centroid of the row's composite label, or else to the mean of those of its values), dataset_center_dist, outlier, min_seed_dist."""
    columns, whole = schema.columns, grouped.where("not coarse" if len(schema.columns) > 1 else "coarse").select("grp", "id", "emb")
    composite = frames["moments"].where(F.col("n") >= options.least_samples).select("grp", normalized(F.col("mean")).alias("own"))
    atoms = F.flatten(F.array(*(F.transform(F.array_distinct(L.atoms_or_na(c)), lambda a, c=c: F.concat(F.lit(f"{c}="), a)) for c in columns)))
    valued = rows.select(F.col("row_id").alias("id"), F.explode(atoms).alias("atom"), *([by] if by else [])).select("id", tagged(F.col("atom"), by).alias("grp"))
    # The whole of a dataset is a group too; its key has no mark of a value.
    whole_key = lambda c: F.concat(F.lit("whole "), F.coalesce(c, F.lit(""))).alias("grp")
    everything = v.select(whole_key(F.col(by) if by else F.lit("")), "id", "emb")
    places = written(S.centroids(valued.join(v.drop("grp"), "id").select(F.concat(F.lit("value "), "grp").alias("grp"), "id", "emb").unionByName(everything)), "centres")
    centres = places.where("grp like 'value %'").withColumn("grp", F.expr("substring(grp, 7)"))
    added = lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    parts = valued.join(centres, "grp").groupBy("id").agg(F.collect_list("centroid").alias("c"))  # as many as a row has values
    mean = parts.select("id", normalized(F.aggregate("c", F.array().cast("array<double>"), added)).alias("mean"))
    middle = places.where("grp like 'whole %'").select(F.col("grp").alias("all_of"), F.col("centroid").alias("middle"))
    placed = S.unit(everything).select("id", "emb", F.col("grp").alias("all_of")).join(middle, "all_of").join(whole.select("id", "grp"), "id", "left").join(composite, "grp", "left").join(mean, "id", "left")
    far = placed.select(F.col("id").alias("row_id"), cosine_distance(F.col("emb"), F.coalesce("own", "mean")).alias("centroid_dist"), cosine_distance(F.col("emb"), F.col("middle")).alias("dataset_center_dist"))
    rules = rows.sparkSession.createDataFrame(schema.invalid_combinations(), ", ".join(f"`{c}` string" for c in columns))
    shown = rows.select("row_id", *(L.or_na(c).alias(c) for c in columns))
    frames["outlier_codes"] = C.outlier_codes(shown, frames["category_outliers"].select(F.col("id").alias("row_id")), rules, columns)
    near = frames["instances_full"].select(F.col("id").alias("row_id"), F.col("novelty_min").alias("min_seed_dist"))
    return reduce(lambda a, b: a.join(b, "row_id", "left"), [far, frames["outlier_codes"], near], rows)


def row_metrics(rows: DataFrame, schema: Schema, vectors: DataFrame, seeds: DataFrame, options: Options = Options()) -> DataFrame:
    """rows with the four metrics of `evaluate` alone: without the document and what only that needs."""
    rows, frames = written(schema.require(rows), "rows"), {}
    one = lambda v: v.select(F.lit("all").alias("grp"), F.col("id").cast("long").alias("id"), F.col("emb").cast("array<double>").alias("emb"))
    v = one(vectors)
    grouped = _fitted(rows, schema, v, options, frames)
    frames["instances_full"] = P.novelty(v, one(seeds)).select("id", "novelty_min")
    return _row_metrics(rows, schema, v, grouped, frames, options)


def folder_row_metrics(rows: DataFrame, schema: Schema, vectors: DataFrame, seeds: DataFrame, options: Options = Options()) -> DataFrame:
    """`row_metrics` of each dataset of rows(dataset, row_id, columns) by vectors(dataset, id, emb), in as many jobs as for one dataset.

    Groups have their dataset in front, and rows a number among those of all datasets; the seeds are the same for all. Datasets
    without rows have none; a row without a vector has null distances."""
    rows = written(numbered(schema.require(rows).withColumnRenamed("row_id", "own_id")), "rows")
    ids = rows.select("dataset", F.col("own_id").alias("id"), F.col("row_id"))
    own = vectors.select("dataset", F.col("id").cast("long").alias("id"), F.col("emb").cast("array<double>").alias("emb"))
    # Vectors without a row, whose id is null here, count for the middle of their dataset.
    every = written(own.join(ids, ["dataset", "id"], "left").select(F.lit("all").alias("grp"), F.col("row_id").alias("id"), "emb", "dataset"), "vectors")
    v = every.where("id is not null").drop("dataset")
    frames: dict[str, DataFrame] = {}
    grouped = _fitted(rows, schema, v, options, frames, "dataset")
    s = seeds.select(F.lit("all").alias("grp"), F.col("id").cast("long").alias("id"), F.col("emb").cast("array<double>").alias("emb"))
    frames["instances_full"] = P.novelty(v, s).select("id", "novelty_min")
    return _row_metrics(rows, schema, every, grouped, frames, options, "dataset").drop("row_id").withColumnRenamed("own_id", "row_id")


def _row_level(out: DataFrame, frames: dict) -> dict:
    r = out.agg(F.count("*").alias("n"), *(F.count(F.when(F.col("outlier") == k, 1)).alias(f"o{k}") for k in range(4)), F.avg("centroid_dist").alias("mean"), F.median("centroid_dist").alias("median"), F.avg("dataset_center_dist").alias("center"), F.avg("min_seed_dist").alias("seed")).first()
    of = lambda code: [x.row_id for x in frames["outlier_codes"].where(code).select("row_id").orderBy("row_id").limit(50).collect()]
    level = {"n_rows": r.n, "outlier_counts": {str(k): r[f"o{k}"] for k in range(4)}, "centroid_dist_mean": r["mean"], "centroid_dist_median": r["median"], "dataset_center_dist_mean": r.center, "min_seed_dist_mean": r.seed}
    return {"row_level": level | {"coverage_outlier_sample": of("outlier in (1, 3)"), "invalid_group_sample": of("outlier in (2, 3)")}, "regeneration_subset": {"candidates_count": r.n - r.o0, "candidates_sample": of("outlier <> 0")}}


def _summary(doc: dict, rows: DataFrame, schema: Schema) -> dict:
    limited, some = doc["coverage_constrained"] or {}, doc["realism_subset"] or {}
    vary = lambda k: 1 - (doc[k] or {}).get("default_score", NAN)
    out = {
        "coverage": doc["coverage"]["completeness_ratio"], "coverage_vary": vary("coverage_vary"), "coverage_constrained": limited.get("coverage_constrained", NAN), "coverage_vary_constrained": vary("coverage_vary_constrained"), "coverage_uncertain": vary("coverage_uncertain"),
        "dist_diversity": doc["diversity"]["overall_dc_score"], "marginal_diversity": doc["diversity"]["marginal_diversity"],
    }
    for name, part in (("full", doc["realism_full"]), ("subset", some)):
        out |= {f"{name}_stylistic_realism": part.get("style_realism_score", NAN), f"{name}_distributional_realism": part.get("calibrated_sinkhorn_distance", NAN)}
    nested = lambda df: {c: {r.value: r.percent for r in sorted(rs, key=lambda r: r.value)} for c, rs in _by_column(df).items()}
    out["cross_distribution"] = nested(C.cross_distribution(rows, schema.required)) if schema.required else {}
    out["marginal_distribution"] = nested(C.marginal_distribution(rows, schema.expected(rows.sparkSession), schema.columns))
    return out


def _by_column(df: DataFrame) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in df.collect():
        out.setdefault(r.col, []).append(r)
    return dict(sorted(out.items()))


def _mean(values: list[float]) -> float:
    kept = [x for x in values if x is not None and math.isfinite(x)]
    return sum(kept) / len(kept) if kept else NAN


def linguistic_realism(part: dict) -> float:
    return _mean([1 - part["mean_dataset_novelty_min"], 1 - part["mean_dataset_novelty_avg"], part["dataset_containment_rate"]])


def combined_realism(part: dict) -> float:
    return _mean([linguistic_realism(part), part["calibrated_sinkhorn_distance"], part["dataset_extrapolation_quality"]])


def coverage_lines(doc: dict) -> list[str]:
    c = doc["coverage"]
    out = ["Coverage", f"  combinations: {c['observed_combinations_count']} of {c['expected_combinations_count']} ({c['completeness_ratio']:.2%})", f"  optional columns filled: {c['holistic_completeness_score']:.2%}"]
    out += [f"  missing: {' | '.join(map(str, m))}" for m in c["missing_combinations_sample"]]
    return out + [f"  row {h['id']} does not fit {', '.join(h['flags'])}" for h in c["hierarchical_flagged_sample"]]


def diversity_lines(doc: dict) -> list[str]:
    d = doc["diversity"]
    out = ["Diversity", f"  DCScore {d['overall_dc_score']:.4f}, Vendi {d['overall_vendi_score']:.4f}, redundant pairs {d['all_redundant_pairs_count']}"]
    out += [f"  low: {label} {score:.4f}" for label, score in d["lowest_diversity_groups"]]
    return out + [f"  collapsed: {label}" for label, g in d["subgroup_stats"].items() if g["mode_collapse"]]


def realism_lines(doc: dict) -> list[str]:
    out = []
    for name in ("full", "subset"):
        if part := doc[f"realism_{name}"]:
            out += [f"Realism ({name} seeds)", f"  linguistic {linguistic_realism(part):.4f}, combined {combined_realism(part):.4f}, aligned {part['calibrated_sinkhorn_distance']:.4f}, style {part['style_realism_score']:.4f}", f"  out of scope: {part['out_of_scope_count']} rows"]
    return out


def valid_json(value: Any) -> Any:
    """value with non-finite floats as None, as JSON has none."""
    if isinstance(value, dict):
        return {str(k): valid_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [valid_json(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write(report: Report, json_path: str | None, csv_path: str | None) -> None:
    """The document, rounded, as a file of the driver; the rows as a CSV table by Spark."""
    from .sources.tables import rounded, write_csv

    if json_path:
        with open(json_path, "w", encoding="utf-8") as f:
            json.dump(valid_json(rounded(report.document)), f, indent=2, ensure_ascii=False, default=str)
    if csv_path:
        write_csv(report.rows, csv_path)
