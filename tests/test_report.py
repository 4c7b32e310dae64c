"""The report of a small dataset: hand-computed coverage, shapes of the rest, rows with their metrics."""

import json
import math

import numpy as np
import pytest

from assayer import report
from assayer.schema import Schema

DOC = {
    "fixedFields": {"capability": "c", "deploymentPopulation": "people", "contextualConstraints": "none"},
    "constituents": {"a": {"required": True, "value": ["x", "y"]}, "b": {"required": True, "value": ["p", "q"]}, "c": {"value": ["m"]}},
    "invalidCombinations": [["x", "p", "m"], ["y", "q", "m"]],
}
ROWS = [(0, "x", "p", "m"), (1, "x; y", "p", None), (2, "y", "q", "none"), (3, "x", None, "m"), (4, "z", "p", ""), (5, "x", "p", "m")]


@pytest.fixture(scope="module")
def inputs(spark):
    r = np.random.default_rng(0)
    rows = spark.createDataFrame([(*x, f"t{x[0]}") for x in ROWS], "row_id long, a string, b string, c string, emb string")
    table = lambda n: spark.createDataFrame([(i, r.normal(size=5).tolist()) for i in range(n)], "id long, emb array<double>")
    return rows, table(6), table(4)


def test_report(inputs, tmp_path):
    rows, vectors, seeds = inputs
    got = report.evaluate(rows, Schema.parse(DOC), vectors, seeds, style=vectors, style_seeds=seeds, subset=[0, 2], exclusions=[["y", "p"]], options=report.Options(k=3, boots=5, least_samples=2))
    d = got.document
    assert (d["coverage"]["completeness_ratio"], d["coverage"]["missing_combinations_sample"]) == (0.75, [["x", "q"]])
    assert [round(x, 6) for x in d["coverage_vary"]["scores"]] == [0.25, 0.5, 0.583333]
    assert (d["coverage_vary"]["group_count_mean"], d["coverage_vary"]["group_count_median"]) == (1.25, 1.0)
    assert [round(x, 6) for x in d["coverage_vary_constrained"]["scores"]] == [0.333333, 0.5, 0.555556]
    assert d["coverage_constrained"]["coverage_constrained"] == 2 / 3 and d["coverage"]["holistic_completeness_score"] == 0.5
    assert d["summary"]["coverage_vary"] == pytest.approx(1 - 0.583333, abs=1e-6) and 0 < d["summary"]["dist_diversity"] <= 1
    assert d["summary"]["marginal_distribution"]["a"] == pytest.approx({"x": 66.6667, "y": 33.3333}, abs=1e-3)
    assert d["realism_full"]["invalid_combo_coverage"] == {"x | p | m": 2, "y | q | m": 0}
    assert 0 <= d["realism_subset"]["calibrated_sinkhorn_distance"] <= 1 and 0 < d["realism_full"]["style_realism_score"] < 1
    assert d["row_level"]["n_rows"] == 6 and sum(d["row_level"]["outlier_counts"].values()) == 6
    out = {r.row_id: r for r in got.rows.collect()}
    assert {i for i, r in out.items() if r.outlier >= 2} == {0, 5} and out[3].emb == "t3"
    unit = {r.id: np.array(r.emb) / np.linalg.norm(r.emb) for r in vectors.collect()}
    middle = sum(unit.values()) / np.linalg.norm(sum(unit.values()))
    near = {i: min(1 - u @ (np.array(s.emb) / np.linalg.norm(s.emb)) for s in seeds.collect()) for i, u in unit.items()}
    own = unit[0] + unit[5]
    for i, r in out.items():
        assert r.dataset_center_dist == pytest.approx(1 - unit[i] @ middle) and r.min_seed_dist == pytest.approx(near[i])
    assert out[0].centroid_dist == pytest.approx(1 - unit[0] @ own / np.linalg.norm(own))
    assert any(x.startswith("Realism (subset") for x in got.lines())
    report.write(got, str(tmp_path / "r.json"), str(tmp_path / "rows"))
    assert json.loads((tmp_path / "r.json").read_text())["summary"]["coverage"] == 0.75


def test_marginal_values(inputs):
    rows, vectors, seeds = inputs
    doc = {**DOC, "constituents": {**DOC["constituents"], "a": {"required": True, "value": ["y", "w", "v"]}}, "invalidCombinations": []}
    got = report.evaluate(rows, Schema.parse(doc), vectors, seeds, options=report.Options(transport=False))
    a = got.document["coverage"]["marginal_coverage"]["a"]
    assert (a["missing_values_sample"], a["new_values_sample"], a["new_values"]) == (["v", "w"], ["x", "z"], 2)
    assert {tuple(r) for r in got.frames["marginal_values"].select("col", "value", "kind").collect()} == {("a", "v", "missing"), ("a", "w", "missing"), ("a", "x", "new"), ("a", "z", "new")}


def test_numbered(spark):
    from assayer.sources.tables import numbered

    df = spark.range(0, 1000, 1, 7).where("id % 3 > 0 and id not between 200 and 500").withColumnRenamed("id", "a b")
    assert [r.row_id for r in numbered(df).orderBy("a b").collect()] == list(range(df.count()))


def test_command_line(inputs, tmp_path, capsys):
    from assayer import __main__ as cli

    _, vectors, seeds = inputs
    (tmp_path / "s.json").write_text(json.dumps(DOC))
    (tmp_path / "d.csv").write_text("a, b ,c,text\n" + "".join(f'{a},{b or ""},{c or ""},"t ""{i}"",\nx"\n' for i, a, b, c in ROWS))
    vectors.write.parquet(str(tmp_path / "v"))
    seeds.write.parquet(str(tmp_path / "seeds"))
    cli.main(["evaluate", *(x for k, v in (("schema", "s.json"), ("dataset", "d.csv"), ("vectors", "v"), ("seeds", "seeds"), ("out-json", "o.json"), ("out-csv", "rows")) for x in (f"--{k}", str(tmp_path / v))), "--not-realistic", '[["y", "p"]]'])
    assert "combinations: 3 of 4" in capsys.readouterr().out
    got = json.loads((tmp_path / "o.json").read_text())
    assert got["coverage"]["completeness_ratio"] == 0.75 and got["row_level"]["n_rows"] == 6 and got["realism_full"]["style_realism_score"] is None


def test_report_without_rows(inputs):
    rows, vectors, seeds = inputs
    got = report.evaluate(rows.where("false"), Schema.parse(DOC), vectors.where("false"), seeds)
    assert got.document["summary"]["coverage"] == 0.0 and math.isnan(got.document["summary"]["dist_diversity"]) and got.rows.collect() == []


def test_subset_of_unknown_seeds(inputs):
    rows, vectors, seeds = inputs
    with pytest.raises(ValueError):
        report.evaluate(rows, Schema.parse(DOC), vectors, seeds, subset=[9])


def test_realism_per_category(inputs):
    """Categories are the composite labels of rows; those of seeds are given."""
    rows, vectors, seeds = inputs
    schema = Schema.parse({**DOC, "invalidCombinations": []})
    label = "a=x+b=p+c=m"
    labels = seeds.sparkSession.createDataFrame([(0, label), (1, label), (2, "a=z+b=z+c=z")], "id long, label string")
    got = report.evaluate(rows, schema, vectors, seeds, seed_labels=labels, options=report.Options(transport=False, least_samples=2))
    part = got.document["realism_full"]
    assert part["seed_has_labels"] and set(part["category_stats"]) == {label}
    stats = part["category_stats"][label]
    unit = lambda df: {r.id: np.array(r.emb) / np.linalg.norm(r.emb) for r in df.collect()}
    v, s = unit(vectors), unit(seeds)
    far = [[1 - v[i] @ s[j] for j in (0, 1)] for i in (0, 5)]
    assert (stats["n_generated"], stats["n_seeds"]) == (2, 2)
    assert stats["novelty_min"] == pytest.approx(np.min(far, 1).mean()) and stats["novelty_avg"] == pytest.approx(np.mean(far))
    assert stats["extrapolation"] == pytest.approx(stats["novelty_min"] * stats["containment"])
    assert report.evaluate(rows, schema, vectors, seeds, options=report.Options(transport=False)).document["realism_full"]["category_stats"] == {}


def test_folder_of_datasets(spark, inputs, tmp_path):
    from assayer import __main__ as cli

    rows, vectors, seeds = inputs
    (tmp_path / "schema.json").write_text(json.dumps(DOC))
    folder = tmp_path / "data"
    folder.mkdir()
    for name in ("one_labeled", "two_labeled"):
        lines = ["text,a,b,c", *(f"t{i},{a or ''},{b or ''},{c or ''}" for i, a, b, c in ROWS[: 6 if name == "one_labeled" else 4])]
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    (folder / "one_labeled_metrics.csv").write_text("x\n")
    both = [vectors.selectExpr(f"'{n}' as dataset", "*") for n in ("one_labeled", "two_labeled")]
    both[0].unionByName(both[1].where("id < 4")).write.parquet(str(tmp_path / "v"))
    seeds.write.parquet(str(tmp_path / "s"))
    (tmp_path / "rules.json").write_text('[["y", "p"]]')
    args = ["evaluate", "--schema", str(tmp_path / "schema.json"), "--vectors", str(tmp_path / "v"), "--seeds", str(tmp_path / "s"), "--not-realistic", str(tmp_path / "rules.json")]
    cli.main([*args, "--input-dir", str(folder), "--out-json", str(tmp_path), "--out-csv", str(tmp_path)])
    got = [json.loads((tmp_path / f"{n}_metrics.json").read_text()) for n in ("one_labeled", "two_labeled")]
    assert [g["row_level"]["n_rows"] for g in got] == [6, 4] and all(g["coverage_constrained"]["excluded_count"] == 1 for g in got)
    with pytest.raises(SystemExit):
        cli.main(args)


def test_row_metrics_of_a_folder(spark, inputs, tmp_path):
    """Each dataset has the metrics that it has alone, and more datasets make no more jobs. Headers differ in order and names."""
    from assayer import __main__ as cli
    from assayer.sources import tables as T

    _, vectors, seeds = inputs
    folder = tmp_path / "data"
    folder.mkdir()
    cells = lambda r: [f'"t{r[0]}, ""x""\ny"', *(x or "" for x in r[1:])]
    for k, name in enumerate(("one_labeled", "two_labeled", "three_labeled")):
        some = ROWS[: 6 - k] if k else ROWS
        order = [0, 1, 2, 3] if k else [2, 3, 0, 1]
        head = ["text" if k else " Example ", "a", " b", "c"]
        (folder / f"{name}.csv").write_text("\n".join(",".join(x[i] for i in order) for x in [head, *map(cells, some)]) + "\n")
    moved = lambda n, k: vectors.selectExpr(f"'{n}' as dataset", "id", f"transform(emb, (x, i) -> x + {k} * i) as emb")
    v = moved("one_labeled", 0).unionByName(moved("two_labeled", 1).where("id > 0")).unionByName(moved("three_labeled", 2))
    schema, context, options = Schema.parse(DOC), spark.sparkContext, report.Options(least_samples=2)
    paths = {n: str(folder / f"{n}.csv") for n in ("one_labeled", "two_labeled", "three_labeled")}
    every = T.read_folder(spark, list(paths.values()))
    shown = ["row_id", "example", "a", "b", "c"]
    key = lambda r: [None if x is None else round(x, 9) if isinstance(x, float) else x for x in r]
    rows = lambda df, columns: sorted((key(r) for r in df.select(*columns).collect()), key=repr)

    def together(names: list[str], group: str) -> tuple:
        context.setJobGroup(group, group)
        got = report.folder_row_metrics(every.where(f"dataset in ({', '.join(map(repr, names))})"), schema, v, seeds, options)
        out = rows(got, ["dataset", *shown, "outlier", "centroid_dist", "dataset_center_dist", "min_seed_dist"])
        return out, len(context.statusTracker().getJobIdsForGroup(group))

    all_rows, jobs = together(list(paths), "all")
    one_rows, one_jobs = together(["two_labeled"], "one")
    assert jobs <= one_jobs + 3 and one_rows == [r for r in all_rows if r[0] == "two_labeled"]
    for name, path in paths.items():
        alone = T.read_dataset(spark, path)
        assert rows(every.where(f"dataset = '{name}'"), shown) == rows(alone, shown)
        got = report.row_metrics(alone, schema, v.where(f"dataset = '{name}'").drop("dataset"), seeds, options)
        # Vectors without a row, as the second and third have, count for the middle of a dataset.
        assert [r[1:] for r in all_rows if r[0] == name] == rows(got, [*shown, "outlier", "centroid_dist", "dataset_center_dist", "min_seed_dist"])
    (tmp_path / "s.json").write_text(json.dumps(DOC))
    v.write.parquet(str(tmp_path / "v"))
    seeds.write.parquet(str(tmp_path / "seeds"))
    cli.main(["row-metrics", *(x for k, p in (("schema", "s.json"), ("input-dir", "data"), ("vectors", "v"), ("seeds", "seeds"), ("out", "out")) for x in (f"--{k}", str(tmp_path / p)))])
    assert spark.read.csv(str(tmp_path / "out"), header=True, multiLine=True, escape='"').groupBy("dataset").count().count() == 3


def test_categories_without_a_fit_are_named(spark, inputs):
    rows, _, seeds = inputs
    emb = lambda i: [1.0, 2.0, 3.0, 4.0, 5.0] if i in (0, 5) else [float("nan")] * 5 if i == 2 else [float(i), 1.0, 0.0, 2.0, 1.0]
    from assayer.operators import spherical as S

    table = spark.createDataFrame([(g, i, emb(i)) for g, ids in {"alike": (0, 5), "odd": (1, 2), "good": (1, 3), "few": (2,)}.items() for i in ids], "grp string, id long, emb array<double>")
    moments = S.mean_vectors(table)
    assert {(r.grp, r.n, r.reason) for r in S.skipped(moments, 2).collect()} == {("alike", 2, "no variance"), ("odd", 2, "not finite")}
    assert [r.grp for r in S.fit_of(moments, 2).collect()] == ["good"]
    v = spark.createDataFrame([(i, emb(0)) for i in range(6)], "id long, emb array<double>")
    with pytest.warns(RuntimeWarning, match="no variance"):
        got = report.evaluate(rows, Schema.parse(DOC), v, seeds, options=report.Options(transport=False, least_samples=2))
    assert got.document["coverage"]["skipped_categories_count"] == got.frames["skipped_categories"].count() > 0
