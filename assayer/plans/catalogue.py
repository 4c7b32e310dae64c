"""Named queries over the test tables, each with the SQL that must give the same rows.

documents with their labels stand for labelled examples (required: lang, source; optional: quality, toxic), the event types of a
user's day for a multi-value cell, embeddings with their label for categories, and vectors with vec_id < 20 for seeds.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import runs
from ..functions import labels as L
from ..functions.vectors import cosine_distance, normalized
from ..operators import coverage as C
from ..operators import pairwise as P
from ..operators import realism as Z
from ..operators import repair as R
from ..operators import spherical as S
from ..operators import splits as X
from ..operators import transport as T
from ..operators import workflow as W
from ..report import row_metrics as row_metrics_of
from ..schema import Schema
from ..schema import seed_combinations as drawn_combinations
from ..sources.tables import result_lines, unlabelled, write_requests
from ..store import new_folder
from ..workers import ship

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            return f(spark, d)

        _queries[f.__name__] = run
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# ---- inputs -------------------------------------------------------------------------------------------------------------

REQUIRED, OPTIONAL = ["lang", "source"], ["quality", "toxic"]
FOUR = [*REQUIRED, *OPTIONAL]
KINDS = ["click", "purchase", "view"]


def examples(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(lab, "doc_id", "left").withColumnRenamed("doc_id", "row_id")


EX = "ex AS (SELECT d.doc_id AS row_id, d.lang, d.source, CAST(l.quality AS VARCHAR) AS quality, CAST(l.toxic AS VARCHAR) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def days(spark: SparkSession, d: str) -> DataFrame:
    """A row per user and day: the cell `kinds` and the weekday."""
    e = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    g = e.groupBy("user_id", "day").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "; ").alias("kinds"))
    return g.withColumn("row_id", F.concat_ws("/", F.col("user_id").cast("string"), "day")).withColumn("month", F.substring("day", 6, 2))


DAYS = "days AS (SELECT user_id::VARCHAR || '/' || strftime(ts, '%Y-%m-%d') AS row_id, strftime(ts, '%m') AS month, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS kinds FROM events GROUP BY 1, 2)"


def vectors(spark: SparkSession, d: str, grouped: bool = False) -> DataFrame:
    grp = F.concat(F.lit("label="), F.col("label").cast("string")) if grouped else F.lit("all")
    return table(spark, d, "embeddings").select(grp.alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("emb"))


def VEC(grouped: bool = False) -> str:
    grp = "'label=' || label::VARCHAR" if grouped else "'all'"
    return f"""raw AS (SELECT {grp} AS grp, vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
v AS (SELECT grp, id, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-10)) AS emb FROM raw)"""


def space(spark: SparkSession, d: str, columns: list[str]) -> C.Space:
    """The values that occur, as a schema would list them."""
    return C.Space(examples(spark, d).agg(*(F.collect_set(c).alias(c) for c in columns)).first().asDict())


def expected(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    ex = examples(spark, d)
    return C.expected_combinations({c: ex.where(F.col(c).isNotNull()).select(c).distinct() for c in columns})


def EXP(columns: list[str]) -> str:
    parts = ", ".join(f"(SELECT DISTINCT {c} FROM ex WHERE {c} IS NOT NULL)" for c in columns)
    return f"exp AS (SELECT * FROM {parts})"


def CNT(columns: list[str]) -> str:
    return f"cnt AS (SELECT {', '.join(columns)}, count(*) AS n FROM ex WHERE {' AND '.join(f'{c} IS NOT NULL' for c in columns)} GROUP BY ALL)"


COVER = ["lang", "quality", "toxic"]
BASE = f"WITH {EX}, {EXP(COVER)}, {CNT(COVER)}, g AS (SELECT exp.*, coalesce(n, 0)::BIGINT AS n FROM exp LEFT JOIN cnt USING ({', '.join(COVER)})) "


def counts(spark: SparkSession, d: str, columns: list[str] = COVER) -> DataFrame:
    return C.combination_counts(examples(spark, d), columns)


def groups(spark: SparkSession, d: str, columns: list[str] = COVER) -> DataFrame:
    return C.with_counts(expected(spark, d, columns), counts(spark, d, columns), columns)


def sizes(spark: SparkSession, d: str, columns: list[str] = COVER) -> DataFrame:
    return C.group_sizes(space(spark, d, columns), counts(spark, d, columns))


# ---- coverage -----------------------------------------------------------------------------------------------------------


@query(BASE + "SELECT lang, quality, toxic, n, n >= 1 AS covered, round(1.0 - least(n, 10)::DOUBLE / 10, 6) AS penalty_k FROM g")
def coverage_counts(spark, d):
    return groups(spark, d).select(*COVER, "n", (F.col("n") >= 1).alias("covered"), r6(L.penalty(F.col("n"), F.lit(10))).alias("penalty_k"))


@query(BASE + "SELECT lang, quality, toxic FROM exp")
def coverage_expected(spark, d):
    return expected(spark, d, COVER)


@query(BASE + "SELECT * FROM cnt")
def coverage_observed(spark, d):
    return counts(spark, d)


@query(BASE + "SELECT lang, quality, toxic FROM g WHERE n < 3")
def coverage_missing(spark, d):
    return C.missing(space(spark, d, COVER), counts(spark, d), 3)


@query(BASE + "SELECT count(*) AS expected, count(*) FILTER (n >= 1) AS observed, round(count(*) FILTER (n >= 1)::DOUBLE / count(*), 6) AS ratio FROM g")
def coverage_ratio(spark, d):
    return C.completeness(space(spark, d, COVER), counts(spark, d)).withColumn("ratio", r6(F.col("ratio")))


@query(BASE + ", m AS (SELECT greatest(3, (SELECT count(*) FROM ex) // greatest(1, (SELECT count(DISTINCT coalesce(lang,'NA') || '+' || coalesce(quality,'NA') || '+' || coalesce(toxic,'NA')) FROM ex))) AS k) SELECT (SELECT count(*) FROM exp) AS expected, count(*) AS observed, round(count(*)::DOUBLE / (SELECT count(*) FROM exp), 6) AS ratio FROM cnt, m WHERE n >= k")
def coverage_dynamic_min_count_compat(spark, d):
    ex = examples(spark, d)
    k = ex.agg(F.greatest(F.lit(3), F.floor(F.count("*") / F.greatest(F.lit(1), F.countDistinct(L.composite(COVER))))).alias("k"))
    cnt = counts(spark, d).crossJoin(F.broadcast(k))
    return C.completeness(space(spark, d, COVER), cnt, F.col("k"), intersect=False).withColumn("ratio", r6(F.col("ratio")))


@query(BASE + "SELECT k, round(sum(k - least(n, k))::DOUBLE / (k * count(*)), 6) AS score FROM g, (SELECT unnest(range(1, greatest(1, (SELECT max(n) FROM g)) + 1)) AS k) GROUP BY k")
def coverage_vary_curve(spark, d):
    return C.curve(sizes(spark, d)).withColumn("score", r6(F.col("score")))


@query(BASE + "SELECT 10::BIGINT AS k, round(sum(10 - least(n, 10))::DOUBLE / (10 * count(*)), 6) AS score, round(1 - sum(10 - least(n, 10))::DOUBLE / (10 * count(*)), 6) AS coverage FROM g")
def coverage_vary_default(spark, d):
    return C.score_at(sizes(spark, d), 10).select(F.lit(10).cast("long").alias("k"), r6(F.col("score")).alias("score"), r6(1 - F.col("score")).alias("coverage"))


@query(BASE + "SELECT count(*) AS group_count, round(avg(n), 6) AS group_mean, round(median(n)::DOUBLE, 6) AS group_median FROM g")
def coverage_group_stats(spark, d):
    return C.weighted_median(sizes(spark, d)).select("group_count", r6(F.col("group_mean")).alias("group_mean"), r6(F.col("group_median")).alias("group_median"))


RULES = [["en", "0"], ["fr", "1", "1"], ["de"]]
RULE_SQL = """(list_contains([lang, quality, toxic], 'en') AND list_contains([lang, quality, toxic], '0'))
 OR (lang = 'fr' AND quality = '1' AND toxic = '1') OR lang = 'de'"""


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, r) for i, r in enumerate(RULES)], "rule_id int, values array<string>")


@query(BASE + f"SELECT lang, quality, toxic FROM exp WHERE {RULE_SQL}")
def not_realistic_match(spark, d):
    return C.excluded(expected(spark, d, COVER), rules(spark), COVER, keep=True)


@query(BASE + f", r AS (SELECT * FROM g WHERE NOT ({RULE_SQL})) SELECT count(*) AS expected, count(*) FILTER (n >= 1) AS observed, round(count(*) FILTER (n >= 1)::DOUBLE / count(*), 6) AS ratio, (SELECT count(*) FROM exp) - count(*) AS excluded FROM r")
def coverage_constrained(spark, d):
    exp = space(spark, d, COVER)
    left, out = C.excluded(counts(spark, d), rules(spark), COVER), exp.excluded(RULES)
    return C.completeness(exp, left, excluded=out).select("expected", "observed", r6(F.col("ratio")).alias("ratio"), F.lit(out).cast("long").alias("excluded"))


@query(BASE + f"SELECT k, round(sum(k - least(n, k))::DOUBLE / (k * count(*)), 6) AS score FROM g, (SELECT unnest(range(1, 21)) AS k) WHERE NOT ({RULE_SQL}) GROUP BY k")
def coverage_vary_constrained(spark, d):
    exp = space(spark, d, COVER)
    return C.curve(C.group_sizes(exp, C.excluded(counts(spark, d), rules(spark), COVER), exp.excluded(RULES)), 20).withColumn("score", r6(F.col("score")))


BASE4 = f"WITH {EX}, {EXP(FOUR)}, {CNT(FOUR)}, g AS (SELECT exp.*, coalesce(n, 0)::BIGINT AS n FROM exp LEFT JOIN cnt USING (lang, source, quality, toxic)) "


@query(BASE4 + "SELECT k, round(sum(k - least(n, k))::DOUBLE / (k * count(*)), 6) AS score FROM g, (SELECT unnest(range(1, 31)) AS k) GROUP BY k")
def coverage_vary_all(spark, d):
    return C.curve(sizes(spark, d, FOUR), 30).withColumn("score", r6(F.col("score")))


def expected_values(spark: SparkSession) -> DataFrame:
    rows = [("lang", v) for v in ("en", "de", "it")] + [("quality", v) for v in ("0", "1", "2")] + [("toxic", "1 (so marked)")]
    return spark.createDataFrame(rows, "col string, value string")


EV = "ev AS (SELECT * FROM (VALUES ('lang','en'),('lang','de'),('lang','it'),('quality','0'),('quality','1'),('quality','2'),('toxic','1 (so marked)')) t(col, value))"
UNP = "u AS (SELECT row_id, 'lang' AS col, lang AS value FROM ex UNION ALL SELECT row_id, 'quality', quality FROM ex UNION ALL SELECT row_id, 'toxic', toxic FROM ex)"
MARG = f"WITH {EX}, {EV}, {UNP}, o AS (SELECT DISTINCT col, value FROM u WHERE value IS NOT NULL), m AS (SELECT coalesce(o.col, ev.col) AS col, count(ev.value) AS expected, count(*) FILTER (o.value IS NOT NULL AND ev.value IS NOT NULL) AS covered, count(*) FILTER (ev.value IS NULL) AS new_values FROM o FULL JOIN ev ON o.col = ev.col AND o.value = ev.value GROUP BY 1) "


@query(MARG + "SELECT col, expected, covered, new_values, round(covered::DOUBLE / expected, 6) AS ratio FROM m")
def marginal_coverage(spark, d):
    return C.marginal_coverage(examples(spark, d), expected_values(spark), COVER).withColumn("ratio", r6(F.col("ratio")))


@query(MARG + "SELECT round(avg(covered::DOUBLE / expected), 6) AS ratio FROM m")
def marginal_coverage_overall(spark, d):
    return C.marginal_coverage(examples(spark, d), expected_values(spark), COVER).agg(r6(F.avg("ratio")).alias("ratio"))


@query(f"WITH {EX} SELECT round((avg((quality IS NOT NULL)::INT) + avg((toxic IS NOT NULL)::INT)) / 2, 6) AS holistic FROM ex")
def holistic_completeness(spark, d):
    return C.holistic(examples(spark, d), OPTIONAL).select(r6(F.col("holistic")).alias("holistic"))


@query(f"WITH {EX}, {UNP} SELECT col, coalesce(value, 'NA') AS value, round(100.0 * count(*) / (SELECT count(*) FROM ex), 6)::DOUBLE AS percent FROM u GROUP BY 1, 2")
def cross_distribution(spark, d):
    return C.cross_distribution(examples(spark, d), COVER).withColumn("percent", r6(F.col("percent")))


@query(f"WITH {EX}, {EV}, {UNP}, w AS (SELECT DISTINCT col, trim(split_part(value, '(', 1)) AS value FROM ev) SELECT w.col, w.value, round(100.0 * count(u.row_id) / (SELECT count(*) FROM ex), 6)::DOUBLE AS percent FROM w LEFT JOIN u ON u.col = w.col AND u.value = w.value GROUP BY 1, 2")
def marginal_distribution(spark, d):
    return C.marginal_distribution(examples(spark, d), expected_values(spark), COVER).withColumn("percent", r6(F.col("percent")))


# ---- labels -------------------------------------------------------------------------------------------------------------


@query(f"WITH {DAYS} SELECT row_id, unnest(list_filter(list_transform(string_split(kinds, ';'), lambda x: trim(x)), lambda x: x <> '')) AS kind FROM days")
def atomic_explode(spark, d):
    return days(spark, d).select("row_id", F.explode(L.atoms_or_na("kinds")).alias("kind"))


@query(f"WITH {EX} SELECT row_id, unnest([quality]) AS quality FROM ex WHERE quality IS NOT NULL")
def atomic_explode_coverage(spark, d):
    return examples(spark, d).select("row_id", F.explode(L.atoms("quality")).alias("quality"))


@query(f"WITH {DAYS}, x AS (SELECT month, unnest(string_split(kinds, '; ')) AS kind FROM days) SELECT month, kind, count(*) AS n FROM x GROUP BY ALL")
def multi_value_combos(spark, d):
    return C.combination_counts(days(spark, d), ["month", "kinds"]).withColumnRenamed("kinds", "kind")


@query("SELECT DISTINCT c_mktsegment AS segment, trim(split_part(replace(replace(' ' || c_mktsegment || '’s (“so”)', '’', ''''), '“', '\"'), '(', 1)) AS canonical FROM customer")
def canonical_category(spark, d):
    segment = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    return segment.select("segment", L.canonical(F.concat(F.lit(" "), F.col("segment"), F.lit("’s (“so”)"))).alias("canonical"))


@query(f"WITH {EX} SELECT row_id, quality IS NULL AS no_quality, lower(trim(lang)) IN ('optional', 'none', '', 'na') AS no_lang FROM ex")
def placeholder_flags(spark, d):
    return examples(spark, d).select("row_id", L.placeholder("quality").alias("no_quality"), L.placeholder("lang").alias("no_lang"))


@query(f"WITH {EX} SELECT row_id, 'lang=' || lang || '+quality=' || coalesce(quality, 'NA') || '+toxic=' || coalesce(toxic, 'NA') AS label FROM ex")
def composite_labels(spark, d):
    return examples(spark, d).select("row_id", L.composite(COVER).alias("label"))


@query(f"WITH {EX}, p AS (SELECT row_id, ['lang=' || lang, 'quality=' || coalesce(quality, 'NA'), 'toxic=' || coalesce(toxic, 'NA')] AS parts FROM ex), m AS (SELECT row_id, unnest(parts) AS category, 'coarse' AS kind FROM p UNION ALL SELECT row_id, array_to_string(parts, '+'), 'composite' FROM p) SELECT category, kind, count(*) AS n FROM m GROUP BY ALL")
def category_membership(spark, d):
    parts = F.array(*(F.struct(L.part(c).alias("category"), F.lit("coarse").alias("kind")) for c in COVER), F.struct(L.composite(COVER).alias("category"), F.lit("composite").alias("kind")))
    return examples(spark, d).select("row_id", F.explode(parts).alias("m")).groupBy("m.category", "m.kind").agg(F.count("*").alias("n"))


INVALID = [("en", "0", "0"), ("fr", "1", "1"), ("xx", "1", "1")]
INV = "inv AS (SELECT * FROM (VALUES ('en','0','0'),('fr','1','1'),('xx','1','1')) t(lang, quality, toxic))"


def invalid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INVALID, "lang string, quality string, toxic string")


@query(f"WITH {EX}, {INV} SELECT lang, quality, toxic, count(row_id) AS rows FROM inv LEFT JOIN ex USING (lang, quality, toxic) GROUP BY ALL")
def invalid_combo_audit(spark, d):
    return C.audit(examples(spark, d), invalid(spark), COVER)


@query(f"WITH {EX}, {INV} SELECT row_id FROM ex SEMI JOIN inv USING (lang, quality, toxic)")
def invalid_row_flags(spark, d):
    ex = examples(spark, d)
    return C.outlier_codes(ex, ex.where("false"), invalid(spark), COVER).where("outlier >= 2").select("row_id")


CODES = f"WITH {EX}, {INV}, lo AS (SELECT lang, quantile_cont(n_chars, 0.1) AS cut FROM documents GROUP BY 1), far AS (SELECT doc_id AS row_id FROM documents d JOIN lo ON d.lang = lo.lang WHERE n_chars < cut), c AS (SELECT ex.row_id, ((far.row_id IS NOT NULL)::INT + 2 * (inv.lang IS NOT NULL)::INT)::INT AS outlier FROM ex LEFT JOIN far ON ex.row_id = far.row_id LEFT JOIN inv ON ex.lang = inv.lang AND ex.quality = inv.quality AND ex.toxic = inv.toxic) "


def codes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), F.col("n_chars").alias("ll"))
    return C.outlier_codes(examples(spark, d), S.outliers(docs).withColumnRenamed("id", "row_id"), invalid(spark), COVER)


@query(CODES + "SELECT row_id, outlier FROM c")
def outlier_codes(spark, d):
    return codes(spark, d)


@query(CODES + "SELECT outlier, count(*) AS rows FROM c GROUP BY 1")
def row_level_summary(spark, d):
    return codes(spark, d).groupBy("outlier").agg(F.count("*").alias("rows"))


@query("SELECT doc_id, n_chars, CASE WHEN n_chars = 0 THEN 0.0 ELSE round(n_chars * pow(10.0, 1 - floor(log10(n_chars)))) / pow(10.0, 1 - floor(log10(n_chars))) END AS rounded FROM documents")
def sigfig_round(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars", L.significant(F.col("n_chars")).alias("rounded"))


# ---- vectors ------------------------------------------------------------------------------------------------------------


@query(f"WITH {VEC()} SELECT id, round(emb[1], 6) AS x1, round(emb[64], 6) AS x64, round(sqrt(list_dot_product(emb, emb)), 6) AS norm FROM v")
def l2_normalize(spark, d):
    v = S.unit(vectors(spark, d))
    return v.select("id", r6(F.col("emb")[0]).alias("x1"), r6(F.col("emb")[63]).alias("x64"), r6(F.sqrt(F.aggregate("emb", F.lit(0.0), lambda s, x: s + x * x))).alias("norm"))


def PAIRS(grouped: bool) -> str:
    return f"WITH {VEC(grouped)}, p AS (SELECT a.grp, a.id AS id_a, b.id AS id_b, list_dot_product(a.emb, b.emb) AS sim FROM v a JOIN v b ON a.grp = b.grp AND a.id < b.id) "


@query(PAIRS(True) + "SELECT grp, count(*) AS pairs, round(avg(sim), 6) AS mean_sim, round(min(sim), 6) AS min_sim FROM p GROUP BY 1")
def pairwise_similarity_by_label(spark, d):
    return P.pair_statistics(vectors(spark, d, True)).select("grp", "pairs", r6(F.col("mean_sim")).alias("mean_sim"), r6(F.col("min_sim")).alias("min_sim"))


@query(PAIRS(False) + "SELECT grp, count(*) AS pairs, round(avg(sim), 6) AS mean_sim FROM p GROUP BY 1")
def pairwise_mean_similarity(spark, d):
    return P.mean_similarity(vectors(spark, d)).select("grp", "pairs", r6(F.col("mean_sim")).alias("mean_sim"))


@query(PAIRS(False) + "SELECT id_a, id_b, round(sim, 6) AS sim FROM p WHERE sim > 0.45")
def redundant_pairs(spark, d):
    return P.similar_pairs(vectors(spark, d), 0.45).select("id_a", "id_b", r6(F.col("sim")).alias("sim"))


@query(PAIRS(True) + "SELECT grp, id_a, id_b, round(sim, 6) AS sim FROM p WHERE sim > 0.4")
def redundant_pairs_by_label(spark, d):
    return P.similar_pairs(vectors(spark, d, True), 0.4).select("grp", "id_a", "id_b", r6(F.col("sim")).alias("sim"))


@query(PAIRS(True) + "SELECT round(1 - avg(sim), 6) AS diversity FROM p")
def within_label_diversity(spark, d):
    s = P.mean_similarity(vectors(spark, d, True))
    return s.agg(r6(1 - F.sum(F.col("mean_sim") * F.col("pairs")) / F.sum("pairs")).alias("diversity"))


def MEANS(grouped: bool) -> str:
    return f"WITH {VEC(grouped)}, x AS (SELECT grp, generate_subscripts(emb, 1) AS pos, unnest(emb) AS x FROM v), m AS (SELECT grp, pos, count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY ALL), q AS (SELECT grp, max(n) AS n, sqrt(sum(m * m)) AS r, max(s) AS s, list(m ORDER BY pos) AS mean FROM m GROUP BY 1), c AS (SELECT *, list_transform(mean, lambda y: y / greatest(r, 1e-10)) AS centroid FROM q) "


@query(MEANS(True) + "SELECT grp, n, round(centroid[1], 6) AS c1, round(centroid[2], 6) AS c2, round(centroid[64], 6) AS c64 FROM c")
def atomic_centroids(spark, d):
    c = S.centroids(vectors(spark, d, True))
    return c.select("grp", "n", r6(F.col("centroid")[0]).alias("c1"), r6(F.col("centroid")[1]).alias("c2"), r6(F.col("centroid")[63]).alias("c64"))


@query(MEANS(True) + "SELECT v.grp, id, round(1 - list_dot_product(emb, centroid), 6) AS distance FROM v JOIN c ON v.grp = c.grp")
def centroid_dist(spark, d):
    return S.centroid_distances(vectors(spark, d, True)).withColumn("distance", r6(F.col("distance")))


@query(MEANS(False) + "SELECT v.grp, id, round(1 - list_dot_product(emb, centroid), 6) AS distance FROM v JOIN c ON v.grp = c.grp")
def dataset_center_dist(spark, d):
    return S.centroid_distances(vectors(spark, d)).withColumn("distance", r6(F.col("distance")))


@query(MEANS(True) + "SELECT grp, n >= 2 AND s >= 1e-6 AS sufficient FROM c")
def sufficient_variance(spark, d):
    m = S.mean_vectors(vectors(spark, d, True))
    return m.select("grp", ((F.col("n") >= 2) & (F.col("std_max") >= 1e-6)).alias("sufficient"))


@query(MEANS(True) + "SELECT grp, n, round(r, 6) AS r, round(greatest(r * (64 - r * r) / (1 - r * r), 1e-3), 6) AS kappa FROM c WHERE n >= 2")
def vmf_closed_form(spark, d):
    return S.closed_form(vectors(spark, d, True)).select("grp", "n", r6(F.col("r")).alias("r"), r6(F.col("kappa")).alias("kappa"))


NOV = f"WITH {VEC()}, s AS (SELECT * FROM v WHERE id < 20), n AS (SELECT v.id, min(1 - list_dot_product(v.emb, s.emb)) AS novelty_min, avg(1 - list_dot_product(v.emb, s.emb)) AS novelty_avg FROM v, s WHERE v.id >= 20 GROUP BY 1) "


@query(NOV + "SELECT id, round(novelty_min, 6) AS novelty_min, round(novelty_avg, 6) AS novelty_avg FROM n")
def novelty_min_avg(spark, d):
    v = vectors(spark, d)
    return P.novelty(v.where("id >= 20"), v.where("id < 20")).select("id", r6(F.col("novelty_min")).alias("novelty_min"), r6(F.col("novelty_avg")).alias("novelty_avg"))


@query(NOV + "SELECT round(avg(novelty_min), 6) AS novelty_min, round(avg(novelty_avg), 6) AS novelty_avg FROM n")
def novelty_dataset(spark, d):
    v = vectors(spark, d)
    return P.novelty(v.where("id >= 20"), v.where("id < 20")).agg(r6(F.avg("novelty_min")).alias("novelty_min"), r6(F.avg("novelty_avg")).alias("novelty_avg"))


@query(MEANS(False) + "SELECT round(1 / (1 + avg(1 - list_dot_product(emb, centroid))), 6) AS style_score FROM v JOIN c ON v.grp = c.grp")
def style_score(spark, d):
    return S.centroid_distances(vectors(spark, d)).agg(r6(1 / (1 + F.avg("distance"))).alias("style_score"))


def DC(kernel: str, grouped: bool) -> str:
    return f"WITH {VEC(grouped)}, k AS (SELECT a.grp, a.id AS i, b.id AS j, exp({kernel}) AS e FROM v a JOIN v b ON a.grp = b.grp), p AS (SELECT grp, i, max(CASE WHEN i = j THEN e END) / sum(e) AS p FROM k GROUP BY ALL), dc AS (SELECT grp, count(*) AS n, avg(p) AS dc_score FROM p GROUP BY 1) "


_DOT = "list_dot_product(a.emb, b.emb)"


def _dc(spark: SparkSession, d: str, grouped: bool, kernel: str = "cs", tau: float = 1.0) -> DataFrame:
    return P.dc_scores(vectors(spark, d, grouped), kernel, tau).withColumn("dc_score", r6(F.col("dc_score")))


@query(DC(_DOT, False) + "SELECT grp, n, round(dc_score, 6) AS dc_score FROM dc")
def dc_score_cs(spark, d):
    return _dc(spark, d, False)


@query(DC(f"exp(-(2 - 2 * {_DOT}))", False) + "SELECT grp, n, round(dc_score, 6) AS dc_score FROM dc")
def dc_score_rbf(spark, d):
    return _dc(spark, d, False, "rbf")


@query(DC("exp(-list_sum(list_transform(list_zip(a.emb, b.emb), lambda z: abs(z[1] - z[2]))))", True) + "SELECT grp, n, round(dc_score, 6) AS dc_score FROM dc")
def dc_score_laplacian(spark, d):
    return _dc(spark, d, True, "laplacian")


@query(DC(f"pow({_DOT} / 64 + 1, 3)", False) + "SELECT grp, n, round(dc_score, 6) AS dc_score FROM dc")
def dc_score_polynomial(spark, d):
    return _dc(spark, d, False, "polynomial", 3.0)


@query(DC(_DOT, True) + "SELECT grp, n, round(dc_score, 6) AS dc_score FROM dc")
def dc_score_by_label(spark, d):
    return _dc(spark, d, True)


@query(DC(_DOT, True) + "SELECT round(avg(dc_score), 6) AS marginal_diversity FROM dc WHERE n >= 6")
def marginal_diversity(spark, d):
    return P.dc_scores(vectors(spark, d, True)).where("n >= 6").agg(r6(F.avg("dc_score")).alias("marginal_diversity"))


@query(DC(_DOT, True) + "SELECT grp, round(dc_score, 6) AS dc_score FROM dc ORDER BY dc.dc_score, grp LIMIT 5")
def lowest_diversity_groups(spark, d):
    return P.dc_scores(vectors(spark, d, True)).orderBy("dc_score", "grp").limit(5).select("grp", r6(F.col("dc_score")).alias("dc_score"))


@query(DC(_DOT, True) + "SELECT grp, dc_score < least(1.0, 2.0 / greatest(n, 1)) AS collapsed FROM dc")
def mode_collapse_flags(spark, d):
    return P.dc_scores(vectors(spark, d, True)).select("grp", (F.col("dc_score") < F.least(F.lit(1.0), 2.0 / F.greatest("n", F.lit(1)))).alias("collapsed"))


# ---- fits, realism ------------------------------------------------------------------------------------------------------


def r4(c: Column) -> Column:
    return F.round(c, 4)


def FITS(vec: str = VEC(True), least: int = 2) -> str:
    """SQL of fits of 64 dimensions: kappa by bisection of the ratio of two Bessel series, each term scaled by exp(-kappa)."""
    series = "list_sum(list_transform(range(0, 700), lambda k: exp((2 * k + {v}) * ln({x} / 2) - lgamma(k + 1) - lgamma(k + {v} + 1) - {x})))"
    x = "((lo + hi) / 2)"
    ratio = f"{series.format(v=32, x=x)} / {series.format(v=31, x=x)}"
    return f"""WITH RECURSIVE {vec},
x AS (SELECT grp, generate_subscripts(emb, 1) AS pos, unnest(emb) AS x FROM fitted),
m AS (SELECT grp, pos, count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY ALL),
q AS (SELECT grp, max(n) AS n, sqrt(sum(m * m)) AS r, max(s) AS s, list(m ORDER BY pos) AS mean FROM m GROUP BY 1),
c AS (SELECT grp, n, least(greatest(r, 1e-6), 1 - 1e-6) AS r, list_transform(mean, lambda y: y / greatest(r, 1e-10)) AS mu FROM q WHERE n >= {least} AND s >= 1e-6),
b AS (SELECT grp, r, 0 AS i, 1e-3::DOUBLE AS lo, 1000.0::DOUBLE AS hi FROM c UNION ALL
 SELECT grp, r, i + 1, CASE WHEN a < r THEN {x} ELSE lo END, CASE WHEN a < r THEN hi ELSE {x} END FROM (SELECT *, {ratio} AS a FROM b WHERE i < 60)),
k AS (SELECT grp, (lo + hi) / 2 AS kappa FROM b WHERE i = 60),
fits AS (SELECT c.grp, n, mu, kappa, 31 * ln(kappa) - 32 * ln(2 * pi()) - (ln({series.format(v=31, x="kappa")}) + kappa) AS log_c FROM c JOIN k USING (grp)),
lls AS (SELECT v.grp, id, log_c + kappa * list_dot_product(emb, mu) AS ll FROM v JOIN fits USING (grp)) """


def fitted(where: str = "true", vec: str | None = None) -> str:
    """The vectors v and those of them that are fitted."""
    return f"{vec or VEC(True)}, fitted AS (SELECT * FROM v WHERE {where})"


@query(FITS(fitted()) + "SELECT grp, n, round(kappa, 4) AS kappa, round(log_c, 4) AS log_c FROM fits")
def vmf_fit(spark, d):
    return S.fit(vectors(spark, d, True)).select("grp", "n", r4(F.col("kappa")).alias("kappa"), r4(F.col("log_c")).alias("log_c"))


@query(FITS(fitted()) + "SELECT grp, id, round(ll, 4) AS ll FROM lls")
def vmf_log_likelihood(spark, d):
    v = vectors(spark, d, True)
    return S.log_likelihoods(v, S.fit(v)).withColumn("ll", r4(F.col("ll")))


@query(FITS(fitted()) + ", cut AS (SELECT grp, quantile_cont(ll, 0.1) AS cut FROM lls GROUP BY 1) SELECT grp, id, round(ll, 4) AS ll FROM lls JOIN cut USING (grp) WHERE ll < cut")
def category_outliers(spark, d):
    v = vectors(spark, d, True)
    return S.outliers(S.log_likelihoods(v, S.fit(v))).withColumn("ll", r4(F.col("ll")))


@query("SELECT lang AS grp, round(quantile_cont(n_chars, 0.1), 4) AS cut FROM documents GROUP BY 1")
def group_percentiles(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("grp"), "n_chars")
    return S.percentiles(docs, "n_chars", 0.1, whole=50).withColumn("cut", r4(F.col("cut")))


PARTS = """raw AS (SELECT unnest(['label=' || label::VARCHAR, 'third=' || (vec_id % 3)::VARCHAR]) AS grp, vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
v AS (SELECT grp, id, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-10)) AS emb FROM raw)"""


@query(FITS(fitted(vec=PARTS)) + "SELECT id, grp, round(ll, 4) AS ll, ll < -kappa AS flag FROM lls JOIN fits USING (grp)")
def hierarchical_coherence(spark, d):
    """The likelihood of each row under each coarse part of its label, flagged below minus that part's kappa."""
    e = table(spark, d, "embeddings")
    parts = F.array(F.concat(F.lit("label="), F.col("label").cast("string")), F.concat(F.lit("third="), (F.col("vec_id") % 3).cast("string")))
    v = e.select(F.explode(parts).alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("emb"))
    fits = S.fit(v)
    lls = S.log_likelihoods(v, fits)
    return S.beside(lls, fits.select("grp", "kappa")).select("id", "grp", r4(F.col("ll")).alias("ll"), (F.col("ll") < -F.col("kappa")).alias("flag"))


@query(FITS(fitted(vec=VEC())) + ", cut AS (SELECT quantile_cont(ll, 0.1) AS cut FROM lls WHERE id < 20) SELECT id, ll >= cut AS in_scope FROM lls, cut WHERE id >= 20")
def scope_flags(spark, d):
    """Whether a generated vector is as likely as the tenth percentile of the seeds under one fit of both."""
    v = vectors(spark, d)
    return Z.scope(v.where("id >= 20"), v.where("id < 20"))[0].select("id", "in_scope")


_CATEGORIES = """, seeds AS (SELECT grp, count(*) AS n_seeds, avg(ll) AS validity, quantile_cont(ll, 0.1) AS cut FROM lls WHERE id < 20 GROUP BY 1),
held AS (SELECT lls.grp, count(*) AS n_generated, max(n_seeds) AS n_seeds, max(validity) AS validity, avg(CASE WHEN cut IS NULL OR ll >= cut THEN 1.0 ELSE 0.0 END) AS inside FROM lls LEFT JOIN seeds USING (grp) WHERE id >= 20 GROUP BY 1),
far AS (SELECT a.grp, a.id, min(1 - list_dot_product(a.emb, b.emb)) AS low, avg(1 - list_dot_product(a.emb, b.emb)) AS mean FROM v a JOIN v b ON a.grp = b.grp AND a.id >= 20 AND b.id < 20 GROUP BY ALL),
new AS (SELECT grp, avg(low) AS low, avg(mean) AS mean FROM far GROUP BY 1)
SELECT grp, n_generated, coalesce(n_seeds, 0)::BIGINT AS n_seeds, round(validity, 4) AS seed_validity, round(inside, 4) AS containment, round(low, 4) AS novelty_min, round(mean, 4) AS novelty_avg, round(low * inside, 4) AS extrapolation
FROM held LEFT JOIN new USING (grp)"""


@query(FITS(fitted()) + _CATEGORIES)
def realism_category_stats(spark, d):
    v = vectors(spark, d, True)
    stats = Z.category_stats(v.where("id >= 20"), v.where("id < 20"))
    measures = ("seed_validity", "containment", "novelty_min", "novelty_avg", "extrapolation")
    return stats.select("grp", "n_generated", "n_seeds", *(r4(F.col(c)).alias(c) for c in measures))


# An eigenvalue problem and an iteration to convergence: tests compare these with plain numpy.


@query()
def vendi_score(spark, d):
    return S.vendi(vectors(spark, d)).withColumn("vendi", r6(F.col("vendi")))


@query()
def vendi_score_by_label(spark, d):
    return S.vendi(vectors(spark, d, True), normalize=True).withColumn("vendi", r6(F.col("vendi")))


@query()
def sinkhorn_calibrated(spark, d):
    v = vectors(spark, d)
    return T.calibrated(v.where("id >= 20"), v.where("id < 20")).select(*(F.round(c, 4).alias(c) for c in ("raw", "near", "far", "score", "low", "high")))


@query()
def sinkhorn_raw(spark, d):
    v = vectors(spark, d)
    return T.raw(v.where("id >= 20"), v.where("id < 20")).select(r4(F.col("raw")).alias("raw"))


_ROWS = """, cut AS (SELECT grp, quantile_cont(ll, 0.1) AS cut FROM lls WHERE id >= 20 GROUP BY 1),
far AS (SELECT id FROM lls JOIN cut USING (grp) WHERE ll < cut AND id >= 20),
middle AS (SELECT list(m ORDER BY pos) AS mean, sqrt(sum(m * m)) AS r FROM (SELECT pos, avg(x) AS m FROM x GROUP BY 1)),
own AS (SELECT grp, list_transform(mean, lambda y: y / greatest(r, 1e-10)) AS centre FROM q),
near AS (SELECT a.id, min(1 - list_dot_product(a.emb, b.emb)) AS low FROM v a, v b WHERE a.id >= 20 AND b.id < 20 GROUP BY 1)
SELECT v.id AS row_id, replace(v.grp, 'label=', '') AS label, ((v.id IN (FROM far))::INT + 2 * (v.grp = 'label=3')::INT)::INT AS outlier,
 round(1 - list_dot_product(v.emb, own.centre), 6) AS centroid_dist, round(1 - list_dot_product(v.emb, middle.mean) / middle.r, 6) AS dataset_center_dist, round(near.low, 6) AS min_seed_dist
FROM v JOIN own USING (grp) JOIN near USING (id), middle WHERE v.id >= 20"""


@query(FITS(fitted("id >= 20"), 3) + _ROWS)
def row_metrics(spark, d):
    """The rows of an evaluation with their four metrics; alignment has queries of its own."""
    e = table(spark, d, "embeddings")
    document = {
        "fixedFields": {"deploymentPopulation": "readers"},
        "constituents": {"label": {"required": True, "value": [str(i) for i in range(10)]}},
        "invalidCombinations": [["3"]],
    }
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))
    rows = e.where("vec_id >= 20").select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("label"))
    out = row_metrics_of(rows, Schema.parse(document), v.where("id >= 20"), v.where("id < 20"))
    return out.select("row_id", "label", "outlier", *(r6(F.col(c)).alias(c) for c in ("centroid_dist", "dataset_center_dist", "min_seed_dist")))


# ---- workflow -----------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS job, unnest(range(0, (n + 24) // 25))::INT AS chunk, least(25, n - 25 * unnest(range(0, (n + 24) // 25)))::INT AS chunk_rows
FROM (SELECT c_custkey, c_custkey % 97 AS n FROM customer) WHERE n > 0""")
def chunk_plan(spark, d):
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("job"), (F.col("c_custkey") % 97).alias("n"))
    return W.chunk_plan(jobs).select("job", "chunk", "chunk_rows")


@query("""WITH planned AS (SELECT c_custkey AS n_, 'c' || c_custkey::VARCHAR AS stem, c_custkey % 97 AS n FROM customer),
made AS (SELECT stem, sum(rows) AS have, max(chunk) AS last FROM (SELECT 'c' || (c_custkey - c_custkey % 2)::VARCHAR AS stem, c_custkey % 2 AS chunk, 7 AS rows FROM customer) GROUP BY 1),
l AS (SELECT stem, n, greatest(n - coalesce(have, 0), 0)::BIGINT AS missing, coalesce(last, -1) + 1 AS base FROM planned LEFT JOIN made USING (stem))
SELECT stem, n, (base + unnest(range(0, (missing + 24) // 25)))::INT AS chunk, least(25, missing - 25 * unnest(range(0, (missing + 24) // 25)))::INT AS chunk_rows FROM l WHERE missing > 0""")
def shortfall_chunks(spark, d):
    """What is asked for anew where answers gave fewer rows than planned."""
    c = table(spark, d, "customer")
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    planned = c.select(name(F.col("c_custkey")).alias("stem"), F.lit("schema").alias("kind"), (F.col("c_custkey") % 97).alias("n"))
    made = c.select(name(F.col("c_custkey") - F.col("c_custkey") % 2).alias("stem"), F.lit("schema").alias("kind"), (F.col("c_custkey") % 2).alias("chunk"), F.lit(7).alias("rows"))
    return W.shortfall(planned, made).select("stem", "n", "chunk", "chunk_rows")


@query("""SELECT p_size AS n, least(40000, 200 + 350 * p_size)::INT AS baseline, floor(least(40000, 200 + 350 * p_size) * 12 / 10)::INT AS schema
FROM (SELECT DISTINCT p_size FROM part)""")
def token_budget(spark, d):
    sizes = table(spark, d, "part").select(F.col("p_size").alias("n")).distinct()
    return sizes.select("n", W.token_budget(F.col("n"), F.lit("baseline")).alias("baseline"), W.token_budget(F.col("n"), F.lit("schema")).alias("schema"))


def ID_SQL(kind: str, stem: str, chunk: str) -> str:
    room = f"(64 - 2 - length({kind}) - greatest(length({chunk}::VARCHAR), 3) - 7)"
    cut = f"substr({stem}, 1, {room} - 9) || '_' || substr(sha1({stem}), 1, 8)"
    return f"{kind} || '__' || CASE WHEN length({stem}) <= {room} THEN {stem} ELSE {cut} END || '__chunk' || printf('%03d', {chunk})"


@query(f"WITH x AS (SELECT p_partkey, repeat(p_type || '_', 1 + p_partkey::INT % 4) AS stem, (p_partkey % 50 * 413)::INT AS chunk FROM part) SELECT p_partkey, {ID_SQL("'schema'", 'stem', 'chunk')} AS custom_id FROM x")
def custom_ids(spark, d):
    """Chunk numbers of one to five digits, stems that fit and that do not."""
    p = table(spark, d, "part").select("p_partkey", F.expr("repeat(p_type || '_', cast(1 + p_partkey % 4 as int))").alias("stem"))
    return p.select("p_partkey", W.custom_id(F.lit("schema"), F.col("stem"), F.col("p_partkey") % 50 * 413).alias("custom_id"))


@query("""WITH x AS (SELECT p_partkey, '/runs/' || p_brand || '/' || repeat(p_type || '! ', 1 + p_partkey::INT % 3) || '.txt' AS path, repeat(p_type || '! ', 1 + p_partkey::INT % 3) AS stem FROM part)
SELECT p_partkey, 'label__' || substr(regexp_replace(stem, '[^a-zA-Z0-9_-]+', '_', 'g'), 1, 45) || '__' || substr(sha1(path), 1, 10) AS custom_id FROM x""")
def label_ids(spark, d):
    path = F.expr("concat('/runs/', p_brand, '/', repeat(p_type || '! ', cast(1 + p_partkey % 3 as int)), '.txt')")
    return table(spark, d, "part").select("p_partkey", W.label_id(path).alias("custom_id"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS chunks FROM conversations GROUP BY 1")
def chunk_assembly(spark, d):
    return W.assemble(table(spark, d, "conversations"), ["conv_id"], "turn")


@query("""WITH x AS (SELECT 'lot ' || (p_partkey // 4) AS stem, p_partkey, p_size % 7 <> 0 AS answered FROM part)
SELECT stem, string_agg('part ' || p_partkey, chr(10) ORDER BY p_partkey) AS text FROM x GROUP BY 1 HAVING bool_and(answered)""")
def collection_stream(spark, d):
    """Answers to a request per part, of which some fail, collected by a stream: the files that lack none, a file being a lot of four parts."""
    p = table(spark, d, "part").select(F.expr("concat('lot ', p_partkey div 4)").alias("stem"), F.col("p_partkey").cast("long").alias("chunk"), (F.col("p_size") % 7 != 0).alias("answered"))
    folder = new_folder(spark, "run")
    write_requests(p.select(F.col("chunk").cast("string").alias("custom_id"), "stem", F.lit("baseline").alias("kind"), "chunk", F.lit(0).alias("variant_id")), f"{folder}/manifest")
    said = F.struct(F.when(F.col("answered"), 200).otherwise(500).alias("status_code"), F.struct(F.concat(F.lit("part "), "chunk").alias("output_text")).alias("body"))
    p.select(F.to_json(F.struct(F.col("chunk").cast("string").alias("custom_id"), said.alias("response"))).alias("value")).write.text(f"{folder}/results")
    return runs.collect_stream(spark, folder, f"{folder}/results").texts.select("stem", "text")


@query("""WITH x AS (SELECT p_brand, p_partkey, p_partkey % 2 = 0 AS even, p_size FROM part),
b AS (SELECT p_brand, bool_or(NOT even) AS odd, bool_or(even) AS even, min_by(even, p_partkey) AS even_first FROM x GROUP BY 1)
SELECT p_brand, CASE WHEN NOT odd THEN 'k,size' WHEN NOT b.even THEN 'size,note,k' WHEN even_first THEN 'k,size,note' ELSE 'size,note,k' END || chr(10) ||
 string_agg(CASE WHEN NOT odd THEN p_partkey || ',' || p_size WHEN even_first AND b.even THEN p_partkey || ',' || p_size || ',' || CASE WHEN x.even THEN '' ELSE '"so, it is"' END
  ELSE p_size || ',' || CASE WHEN x.even THEN '' ELSE '"so, it is"' END || ',' || p_partkey END, chr(10) ORDER BY p_partkey) || chr(10) AS text
FROM x JOIN b USING (p_brand) GROUP BY p_brand, odd, b.even, even_first""")
def chunk_combination(spark, d):
    """Answers with columns of other orders and names, fenced ones too, put together by name."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    plain = F.concat(F.lit("k,size\n"), k, F.lit(","), size, F.lit("\n"))
    fenced = F.concat(F.lit("```csv\nsize,note,k\n"), size, F.lit(',"so, it is",'), k, F.lit("\n```"))
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 2 == 0, plain).otherwise(fenced).alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "text"))), lambda x: x["text"])
    return p.groupBy("p_brand").agg(texts.alias("texts")).select("p_brand", R.combined_csv(F.col("texts")).alias("text"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type || ', ' || p_name ELSE p_name || chr(10) || p_name END AS text FROM part""")
def example_texts(spark, d):
    """The text column of an answer: by name, or the longest one; short rows have none."""
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    known = F.concat(F.lit("note,prompt\na much longer note than any name that a part may have,"), name)
    longest = F.concat(F.lit("k,story\n"), k, F.lit(',"'), F.col("p_type"), F.lit(", "), name, F.lit('"'))
    several = F.concat(F.lit("text,k\n"), name, F.lit("\n"), name, F.lit(",2\n,3"))
    kind = F.col("p_partkey") % 3
    return table(spark, d, "part").select("p_partkey", R.text_lines(F.when(kind == 0, known).when(kind == 1, longest).otherwise(several)).alias("text"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE trim(n_name) || CASE WHEN n_nationkey % 5 = 2 THEN '!' ELSE '' END END AS text FROM nation")
def response_text(spark, d):
    """Each place where a response may have its text, and none."""
    say, k = F.col("n_name"), F.col("n_nationkey") % 5
    part = lambda kind, field, text: F.to_json(F.struct(F.lit(" ").alias("output_text"), F.array(F.struct(F.array(F.struct(F.lit(kind).alias("type"), text.alias(field)), F.struct(F.lit("other").alias("type"), F.lit("no").alias(field))).alias("content"))).alias("output")))
    plain = F.to_json(F.struct(say.alias("output_text")))
    choices = F.to_json(F.struct(F.array(F.struct(F.struct(say.alias("content")).alias("message"))).alias("choices")))
    body = F.when(k == 0, plain).when(k == 1, part("output_text", "text", say)).when(k == 2, part("text", "value", F.concat(say, F.lit("!")))).when(k == 3, choices).otherwise(F.lit('{"output": [], "choices": []}'))
    return table(spark, d, "nation").select("n_nationkey", W.response_text(body).alias("text"))


@query("""SELECT o_orderkey AS custom_id, CASE WHEN c_custkey IS NULL THEN 'unknown id' WHEN o_orderstatus = 'P' THEN 'no text' ELSE 'ok' END AS state
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) ON o_orderkey = c_custkey""")
def manifest_join(spark, d):
    results = table(spark, d, "orders").select(F.col("o_orderkey").alias("custom_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("text"))
    manifest = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("custom_id"))
    ok, failed = W.with_manifest(results, manifest)
    return ok.select("custom_id", F.lit("ok").alias("state")).unionByName(failed.select("custom_id", F.col("error").alias("state")))


@query("""SELECT c.conv_id, c.turn, c.text, l.text AS label FROM conversations c
LEFT JOIN (SELECT conv_id, turn, text FROM conversations WHERE turn < 2) l ON c.conv_id = l.conv_id AND c.turn = l.turn""")
def label_positional_zip(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return W.positional_zip(c, c.where("turn < 2").withColumnRenamed("text", "label"), "conv_id", "turn")


@query("SELECT s_name AS stem FROM supplier WHERE s_suppkey % 3 <> 0")
def unlabeled_files(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("stem"))
    return unlabelled(s.select("stem"), s.where("s_suppkey % 3 = 0").select(F.concat("stem", F.lit("_labeled")).alias("stem")))


@query("SELECT s_name AS stem, s_suppkey AS n FROM supplier WHERE s_suppkey % 4 IN (0, 1)")
def rerun_filter(spark, d):
    """Files named by path, stem or with an extension."""
    s = table(spark, d, "supplier").select(F.col("s_name").alias("stem"), F.col("s_suppkey").alias("n"))
    names = s.where("n % 4 in (0, 1)").select(F.when(F.col("n") % 4 == 0, F.concat(F.lit(" /runs/schema/"), "stem", F.lit(".txt "))).otherwise(F.concat("stem", F.lit(".csv"))).alias("name"))
    return W.rerun(s, names)


@query("SELECT s_name AS stem, CASE s_suppkey % 2 WHEN 0 THEN 'schema' ELSE 'baseline' END AS kind FROM supplier WHERE NOT (s_suppkey % 2 = 0 AND s_suppkey % 3 = 0)")
def existing_output_skip(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("stem"), F.when(F.col("s_suppkey") % 2 == 0, "schema").otherwise("baseline").alias("kind"))
    return W.without_output(s.select("stem", "kind"), s.where("s_suppkey % 3 = 0").select("stem", F.lit("schema").alias("kind")))


@query("SELECT n_nationkey, n_regionkey::VARCHAR AS text, last AS seed_idx FROM nation LEFT JOIN (SELECT c_nationkey, max(c_custkey) AS last FROM customer WHERE c_nationkey < 4 GROUP BY 1) ON c_nationkey = n_regionkey")
def seed_lookup(spark, d):
    seeds = table(spark, d, "customer").where("c_nationkey < 4").select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").cast("string").alias("text"))
    return W.seed_indices(table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("text")), seeds)


SCHEMA = Schema.parse(
    {
        "fixedFields": {"capability": "x", "systematizedConcept": "x", "deploymentPopulation": "readers", "contextualConstraints": "x", "systematizedInstance": "x"},
        "constituents": {"lang": {"required": True, "value": ["en", "de", "en"]}, "marks": {"subConstituents": {"quality": {"value": "0; 1"}, "toxic": {"value": None}}}},
        "seedExamples": ["a", "b", "c", "d"],
    }
)


def schema_of(spark: SparkSession, d: str) -> Schema:
    """A schema that lists what the documents have: every lang once per source that has it, quality in one cell, toxic without values."""
    ex = examples(spark, d)
    pairs = ex.groupBy("lang", "source").agg(F.count("*").alias("n")).where("lang is not null").orderBy("lang", "source").collect()
    marks = ex.agg(F.array_join(F.array_sort(F.collect_set("quality")), "; ").alias("m")).first().m
    seeds = [str(r.item_id) for r in table(spark, d, "benchmark").select("item_id").orderBy("item_id").collect()]
    document = SCHEMA.document | {"constituents": {"lang": {"required": True, "value": [r.lang for r in pairs]}, "marks": {"subConstituents": {"quality": {"value": marks}, "toxic": {"value": None}}}}, "seedExamples": seeds}
    return Schema.parse(document)


_PAIRS_SQL = "pr AS (SELECT lang, source FROM ex WHERE lang IS NOT NULL GROUP BY ALL), mk AS (SELECT DISTINCT quality FROM ex WHERE quality IS NOT NULL)"


@query(f"WITH {EX}, {_PAIRS_SQL}, l AS (SELECT DISTINCT lang FROM pr) SELECT 'lang' AS col, true AS required, (row_number() OVER (ORDER BY lang) - 1)::INT AS ordinal, lang AS value FROM l UNION ALL SELECT 'quality', false, (row_number() OVER (ORDER BY quality) - 1)::INT, quality FROM mk")
def required_split(spark, d):
    schema = schema_of(spark, d)
    return schema.expected(spark).withColumn("required", F.col("col").isin(schema.required))


@query(f"WITH {EX}, s AS (SELECT * FROM (VALUES ('en'), ('de')) l(lang), (VALUES ('0'), ('1')) q(quality)) SELECT s.lang, s.quality, count(ex.row_id) AS n FROM s LEFT JOIN ex ON s.lang = ex.lang AND s.quality = ex.quality GROUP BY ALL")
def schema_coverage(spark, d):
    """Combinations that a schema expects, with their rows."""
    values = {c: spark.createDataFrame([(v,) for v in SCHEMA.values[c]], "value string") for c in ("lang", "quality")}
    return C.with_counts(C.expected_combinations(values), C.combination_counts(examples(spark, d), ["lang", "quality"]), ["lang", "quality"])


@query(f"WITH {EX}, {_PAIRS_SQL} SELECT lang, quality, count(*)::INT AS n FROM pr, mk GROUP BY ALL")
def expected_with_duplicates(spark, d):
    """A value that the schema lists several times counts as often."""
    schema = schema_of(spark, d)
    values = {c: spark.createDataFrame([(v,) for v in schema.values[c]], "value string") for c in ("lang", "quality")}
    return C.expected_combinations(values, distinct=False).groupBy("lang", "quality").agg(F.count("*").cast("int").alias("n"))


@query("""WITH b AS (SELECT (row_number() OVER (ORDER BY item_id) - 1)::INT AS i FROM benchmark)
SELECT 0 AS size, '' AS seeds UNION ALL SELECT 1, i::VARCHAR FROM b UNION ALL SELECT 2, x.i || ',' || y.i FROM b x JOIN b y ON x.i < y.i""")
def seed_combinations(spark, d):
    """All choices of no, one or two seeds of a schema whose seeds are the benchmark's items."""
    n = len(schema_of(spark, d).seeds)
    return spark.createDataFrame([(len(c), ",".join(map(str, c))) for c in drawn_combinations(n, [0, 1, 2], n * n + 1)], "size int, seeds string")


@query("""SELECT p_partkey, unnest([1, 2]) AS position,
 unnest(CASE p_partkey % 4 WHEN 0 THEN [p_brand, ''] WHEN 1 THEN [p_brand, p_type] WHEN 2 THEN ['brand', p_brand] ELSE [p_brand, p_brand] END) AS brand,
 unnest(CASE p_partkey % 4 WHEN 0 THEN [p_type || ',new, ' || p_name, ''] WHEN 1 THEN [p_type, p_name] WHEN 2 THEN ['other', p_type] ELSE ['', p_type] END) AS kind FROM part""")
def label_csv_parse(spark, d):
    """Two rows are expected of answers: without a header and with surplus cells; with all columns by name in another order; with one
    of the names only, which is no header; with more rows than wanted and a short one."""

    def parse(parts):
        for p in parts:
            rows = [(k, i + 1, *r) for k, t in zip(p.p_partkey, p.text, strict=True) for i, r in enumerate(R.parse_labels(t, ["brand", "kind"], 2))]
            yield pd.DataFrame(rows, columns=["p_partkey", "position", "brand", "kind"])

    k = F.col("p_partkey") % 4
    glued = F.concat("p_brand", F.lit(","), "p_type", F.lit(",new, "), "p_name", F.lit("\n\n"))
    named = F.concat(F.lit("```\n Kind ,x,BRAND\n"), "p_type", F.lit(",,"), "p_brand", F.lit("\n,,\n"), "p_name", F.lit(",1,"), "p_type", F.lit("\n```"))
    half = F.concat(F.lit("brand,other\n"), "p_brand", F.lit(","), "p_type")
    long = F.concat("p_brand", F.lit("\n"), "p_brand", F.lit(", "), "p_type", F.lit("\nx,y\n"))
    p = table(spark, d, "part").select("p_partkey", F.when(k == 0, glued).when(k == 1, named).when(k == 2, half).otherwise(long).alias("text"))
    return p.mapInPandas(parse, "p_partkey long, position int, brand string, kind string")


_VARIANTS = """m AS (SELECT range AS mask, bit_count(range) > 1 AND (range & 3) <> 0 AS tied FROM range(512)),
p AS (SELECT mask, list_sort(list_filter(['capability', 'systematizedConcept', 'deploymentPopulation', 'contextualConstraints', 'systematizedInstance'], lambda n, i: (mask >> (i - 1)) & 1 = 1 OR (tied AND i <= 2))) AS f,
 list_sort(list_filter(['lang', 'quality', 'toxic'], lambda n, i: (mask >> (i + 4)) & 1 = 1)) AS c, (mask >> 8) & 1 = 1 AS s FROM m),
variants AS (SELECT (row_number() OVER (ORDER BY mask) - 1)::INT AS variant_id, array_to_string(f, ',') AS missing_fixed, array_to_string(c, ',') AS missing_constituents, s AS missing_seeds,
 CASE WHEN mask = 0 THEN '' ELSE array_to_string(f, ',') || '|' || array_to_string(c, ',') || '|' || s::INT::VARCHAR END AS distinct_key FROM p WHERE len(f) + len(c) + s::INT < 9)"""


@query(f"WITH {EX}, {_VARIANTS}, l AS (SELECT lang FROM ex WHERE lang IS NOT NULL GROUP BY 1) SELECT variant_id, CASE WHEN list_contains(string_split(missing_constituents, ','), 'lang') THEN 0 ELSE (SELECT count(*) FROM l) END::INT AS langs, CASE WHEN missing_seeds THEN 0 ELSE (SELECT count(*) FROM benchmark) END::INT AS seeds, missing_fixed, missing_constituents FROM variants")
def ablation_variants(spark, d):
    """What each ablation leaves of the schema of the documents."""
    schema = schema_of(spark, d)
    langs, seeds = len(set(schema.values["lang"])), len(schema.seeds)
    left = lambda gone, n: F.when(gone, 0).otherwise(n).cast("int")
    return W.variants(spark, schema).select("variant_id", left(F.array_contains(F.split("missing_constituents", ","), "lang"), langs).alias("langs"), left(F.col("missing_seeds"), seeds).alias("seeds"), "missing_fixed", "missing_constituents")


@query(f"""WITH models AS (SELECT DISTINCT 's' || s_nationkey || '_m-' || s_nationkey AS tag FROM supplier), variants AS (SELECT unnest(range(3))::INT AS variant_id), combos AS (SELECT (row_number() OVER (ORDER BY item_id) - 1)::INT AS combo_id FROM benchmark),
r AS (SELECT variant_id, printf('%s_v%03d_s%d_combo%03d_run%d', tag, variant_id, 1, combo_id, run) AS stem, unnest(['schema', 'baseline']) AS kind FROM models, variants, combos, (VALUES (1), (2)) x(run)),
c AS (SELECT *, unnest([0, 1, 2])::INT AS chunk, unnest([25, 25, 10])::INT AS chunk_rows FROM r WHERE kind = 'schema' OR variant_id = 0)
SELECT {ID_SQL("kind", "stem", "chunk")} AS custom_id, kind, stem, chunk, chunk_rows, (CASE WHEN kind = 'schema' THEN floor((200 + 350 * chunk_rows) * 12 / 10) ELSE 200 + 350 * chunk_rows END)::INT AS max_tokens FROM c""")
def request_cross_product(spark, d):
    """Models named after the suppliers' nations, three ablations, and a combination per item of the benchmark."""
    nation = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("k")).distinct()
    models = nation.select(F.concat(F.lit("s"), "k").alias("provider"), F.concat(F.lit("m/"), "k").alias("model"))
    items = table(spark, d, "benchmark").select(F.row_number().over(Window.orderBy("item_id")).alias("i"))
    combos = items.select((F.col("i") - 1).cast("int").alias("combo_id"), F.lit(1).alias("n_seeds"), F.array(F.col("i") - 1).alias("seeds"))
    return W.requests(models, spark.range(3).select(F.col("id").cast("int").alias("variant_id")), combos, 2, 60).select("custom_id", "kind", "stem", "chunk", "chunk_rows", "max_tokens")


@query("""SELECT p_partkey, CASE p_partkey % 6
 WHEN 0 THEN 'k,example_text' || chr(10) || p_partkey || ',"1,000 ' || p_type || ',' || p_name || '"'
 WHEN 1 THEN 'k,example_text' || chr(10) || p_partkey || ',"' || p_type || ' (one, two)"'
 WHEN 2 THEN 'example_text,k' || chr(10) || '"' || p_type || ', ' || p_name || ',really",' || p_partkey
 WHEN 3 THEN 'k,example_text,more' || chr(10) || p_partkey || ',,'
 WHEN 4 THEN 'k,example_text' || chr(10) || p_partkey || ',"' || p_type || chr(10) || 'a, b"'
 ELSE 'k,text' || chr(10) || p_partkey || ',"' || p_type || ', ' || p_name || '"' END || chr(10) AS fixed FROM part""")
def csv_repair(spark, d):
    """Surplus commas without spaces, commas in parentheses, the text first, a short row, a cell over two lines, cells that are quoted lines."""
    k, kind, name = F.col("p_partkey").cast("string"), F.col("p_type"), F.col("p_name")
    row = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    shapes = [
        row("```csv\nk,example_text\n", k, ",1,000 ", kind, ",", name, "\n```"),
        row("k,example_text\n", k, ",", kind, " (one, two)"),
        row("example_text,k\n", kind, ", ", name, ",really, ", k),
        row("k,example_text,more\n", k),
        row("k,example_text\n", k, ',"', kind, '\na, b"\n'),
        row('"k,text"\n"', k, ",", kind, ", ", name, '"'),
    ]
    text = F.element_at(F.array(*shapes), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", R.repaired(text).alias("fixed"))


@query("""
select p_brand as doc, p_partkey::varchar as k,
  case p_partkey % 3 when 0 then p_type || chr(10) || p_name when 1 then p_type || ', ' || p_name else p_type end as example_text
from part
""")
def csv_repair_splits(spark, d):
    """A document for each brand in splits of seven lines: cells over two lines, also where a split ends between them, and surplus commas."""
    key, kind = F.col("p_partkey"), F.col("p_partkey") % 3
    k = key.cast("string")
    first = F.when(kind == 0, F.concat(k, F.lit(',"'), "p_type")).when(kind == 1, F.concat_ws(", ", F.concat_ws(",", k, "p_type"), "p_name")).otherwise(F.concat_ws(",", k, "p_type"))
    second = F.when(kind == 0, F.concat("p_name", F.lit('"'))).otherwise("")
    part = table(spark, d, "part")
    rows = part.select(F.col("p_brand").alias("doc"), F.posexplode(F.array(first, second)).alias("i", "value"), (2 * key).alias("n"))
    lines = rows.select("doc", (F.col("n") + F.col("i")).cast("long").alias("at"), "value")
    heads = part.select(F.col("p_brand").alias("doc")).distinct().select("doc", F.lit(-1).cast("long").alias("at"), F.lit("k,example_text").alias("value"))
    cells = X.repaired_cells(X.records(lines.unionByName(heads).select("doc", F.floor(F.col("at") / 7).alias("split"), "at", "value")))
    return cells.where("at >= 0").select("doc", F.col("cells")[0].alias("k"), F.col("cells")[1].alias("example_text"))


@query("""
select p_partkey::varchar as custom_id,
  case p_partkey % 6 when 0 then p_name when 1 then p_type || p_name end as text,
  case p_partkey % 6 when 2 then 'errored: {"type":"' || p_type || '"}' when 3 then 'expired' when 4 then 'status 429: {"code":"slow"}' when 5 then 'no text' end as error
from part
""")
def result_triage(spark, d):
    """Result lines in both forms, answered and not: the text of each, or why there is none."""
    text = lambda *cs: F.struct(F.array(*(F.struct(F.lit("text").alias("type"), F.col(c).alias("text")) for c in cs)).alias("content"))
    part = table(spark, d, "part").withColumn("custom_id", F.col("p_partkey").cast("string"))
    line = lambda *cs: F.to_json(F.struct("custom_id", *cs))
    answer = lambda code, body: F.struct(F.lit(code).alias("status_code"), body.alias("body")).alias("response")
    result = lambda kind, *more: F.struct(F.lit(kind).alias("type"), *more).alias("result")
    forms = [
        line(answer(200, F.struct(F.col("p_name").alias("output_text")))),
        line(result("succeeded", text("p_type", "p_name").alias("message"))),
        line(result("errored", F.struct(F.col("p_type").alias("type")).alias("error"))),
        line(result("expired")),
        line(answer(429, F.struct(F.lit("").alias("output_text"))), F.struct(F.lit("slow").alias("code")).alias("error")),
        line(result("succeeded", F.struct(F.array().cast("array<string>").alias("content")).alias("message"))),
    ]
    lines = part.select(F.get(F.array(*forms), (F.col("p_partkey") % 6).cast("int")).alias("value"))
    return runs.read_answers(result_lines(lines))


@query("""
with x as (select p_partkey::varchar as id, p_type as model, p_size::int as most, 'Write ' || p_name as said, p_partkey % 2 = 0 as apart from part)
select id as custom_id, case when apart then 'messages' else 'responses' end as form,
  case when apart then '{"custom_id":"' || id || '","params":{"model":"' || model || '","max_tokens":' || most || ',"system":"Be brief.","messages":[{"role":"user","content":"' || said || '"}]}}'
  else '{"custom_id":"' || id || '","method":"POST","url":"/v1/responses","body":{"model":"' || model || '","input":[{"role":"system","content":"Be brief."},{"role":"user","content":"' || said || '"}],"max_output_tokens":' || most || '}}' end as line
from x
""")
def request_payloads(spark, d):
    """A request per part as a line for one of two services."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(message("system", F.lit("Be brief.")), message("user", F.concat(F.lit("Write "), "p_name")))
    body = F.struct(F.col("p_type").alias("model"), F.col("p_size").cast("int").alias("max_tokens"), messages.alias("messages"))
    asked = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("custom_id"), (F.col("p_partkey") % 2 == 0).alias("apart"), body.alias("body"))
    lines = [W.payload(asked.where("apart" if form == "messages" else "not apart"), form).withColumn("form", F.lit(form)) for form in ("messages", "responses")]
    return lines[0].unionByName(lines[1]).select(F.get_json_object("value", "$.custom_id").alias("custom_id"), "form", F.col("value").alias("line"))
