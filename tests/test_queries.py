"""Each query with SQL gives the rows of its SQL in DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pytest

from assayer.operators.spherical import exact_kappa, log_bessel
from assayer.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["coverage_counts", "coverage_vary_curve", "coverage_constrained", "marginal_distribution", "multi_value_combos", "outlier_codes", "novelty_min_avg", "dc_score_by_label", "chunk_plan", "custom_ids", "csv_repair", "csv_repair_splits", "required_split", "seed_combinations", "label_csv_parse", "coverage_vary_all", "response_text", "chunk_combination", "example_texts", "shortfall_chunks", "label_ids", "vmf_log_likelihood", "scope_flags", "ablation_variants", "rerun_filter", "existing_output_skip", "seed_lookup", "collection_stream", "result_triage", "request_payloads"]


def canon(value):
    return round(value, 5) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = catalogue.queries()[name](spark, D)
    got = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(canon(x) for x in r) for r in got.fetchall()), key=repr)
    assert sorted((tuple(canon(r[c]) for c in names) for r in df.collect()), key=repr) == want


def test_realism_category_stats(spark, tmp_path):
    """Label 0 has seeds, 1 none, 2 nothing but seeds, 3 a single generated vector, which has no fit."""
    r = np.random.default_rng(6)
    labels = [*([0] * 8), *([2] * 12), *([0] * 9), *([1] * 7), 3]
    rows = [(i, (r.normal(size=8) + 1).astype(np.float32).tolist(), label) for i, label in enumerate(labels)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {}
    for label in (0, 1):
        x = {i: np.array(e, float) / np.linalg.norm(np.array(e, float)) for i, e, k in rows if k == label}
        mean = sum(x.values()) / len(x)
        size = np.linalg.norm(mean)
        kappa = exact_kappa(size, 8)
        ll = {i: 3 * np.log(kappa) - 4 * np.log(2 * np.pi) - log_bessel(3, kappa) + kappa * (e @ mean / size) for i, e in x.items()}
        seeds, made = [i for i in x if i < 20], [i for i in x if i >= 20]
        if not seeds:
            want[f"label={label}"] = (len(made), 0, None, 1.0, None, None, None)
            continue
        held = np.mean([ll[i] >= np.percentile([ll[j] for j in seeds], 10) for i in made])
        far = np.array([[1 - x[i] @ x[j] for j in seeds] for i in made])
        low, mean_far = far.min(1).mean(), far.mean(1).mean()
        want[f"label={label}"] = (len(made), len(seeds), np.mean([ll[j] for j in seeds]), held, low, mean_far, low * held)
    df = catalogue.queries()["realism_category_stats"](spark, str(tmp_path))
    names = ("n_generated", "n_seeds", "seed_validity", "containment", "novelty_min", "novelty_avg", "extrapolation")
    got = {x.grp: tuple(x[c] for c in names) for x in df.collect()}
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert got[k] == tuple(v if v is None else pytest.approx(v, abs=1e-4) for v in values)
