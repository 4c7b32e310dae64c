"""Realism of generated vectors against seed vectors, per category and as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..store import written
from . import pairwise as P
from . import spherical as S


def scored(vectors: DataFrame, seeds: DataFrame, least: int = 2) -> DataFrame:
    """(grp, id, is_seed, ll), written, of both under one fit per group; ll is null in a group without a fit."""
    both = vectors.select("grp", "id", "emb").withColumn("is_seed", F.lit(False)).unionByName(seeds.select("grp", "id", "emb").withColumn("is_seed", F.lit(True)))
    fits = written(S.fit(both.select("grp", "id", "emb"), least).select("grp", "mu", "kappa", "log_c"), "fits")
    ll = F.col("log_c") + F.col("kappa") * dot(F.col("emb"), F.col("mu"))
    return written(S.beside(S.unit(both), fits, "left").select("grp", "id", "is_seed", ll.alias("ll")), "scored")


def scope(vectors: DataFrame, seeds: DataFrame, percent: float = 0.1, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """((grp, id, ll, in_scope) of vectors, (grp, cut, validity) of seeds). In scope: as likely as the seeds' percentile; without a fit
    none is."""
    lls = scored(vectors, seeds, least)
    of_seeds = lls.where("is_seed")
    cut = written(S.percentiles(of_seeds, "ll", percent).join(of_seeds.groupBy("grp").agg(F.avg("ll").alias("validity")), "grp"), "cuts")
    inside = F.coalesce(F.col("ll") >= F.col("cut"), F.lit(False))
    return S.beside(lls.where("not is_seed"), cut, "left").select("grp", "id", "ll", inside.alias("in_scope")), cut


def category_stats(vectors: DataFrame, seeds: DataFrame, percent: float = 0.1, least: int = 2) -> DataFrame:
    """(grp, n_generated, n_seeds, seed_validity, containment, novelty_min, novelty_avg, extrapolation) per group of vectors(grp, id, emb).

    Without seeds all vectors are contained and the other measures are null; a group without a fit has no row."""
    inside, cut = scope(vectors, seeds, percent, least)
    counted = seeds.groupBy("grp").agg(F.count("*").alias("n_seeds"))
    held = S.beside(inside.where("ll is not null"), cut.withColumn("seeded", F.lit(True)), "left")
    contained = F.when(F.col("seeded"), F.col("in_scope").cast("double")).otherwise(1.0)
    per = held.groupBy("grp").agg(F.count("*").alias("n_generated"), F.first("validity").alias("seed_validity"), F.avg(contained).alias("containment"))
    new = P.novelty(vectors, seeds).groupBy("grp").agg(F.avg("novelty_min").alias("novelty_min"), F.avg("novelty_avg").alias("novelty_avg"))
    both = per.join(counted, "grp", "left").join(new, "grp", "left")
    return both.select("grp", "n_generated", F.coalesce("n_seeds", F.lit(0)).cast("long").alias("n_seeds"), "seed_validity", "containment", "novelty_min", "novelty_avg", (F.col("novelty_min") * F.col("containment")).alias("extrapolation"))
