"""python -m assayer COMMAND: evaluation of datasets and runs of generation and labelling from the command line."""

from __future__ import annotations

import argparse
import datetime
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report, runs
from .operators import splits as X
from .operators import workflow as W
from .schema import Schema, parse_indices
from .sources import tables as T
from .workers import ship


def _schema(spark: SparkSession, path: str) -> Schema:
    return T.read_schema(spark, path)


def _vectors(spark: SparkSession, path: str | None) -> DataFrame | None:
    return spark.read.parquet(path) if path else None


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """One dataset, or each labelled dataset of a folder; vectors(id, emb) then have a column `dataset` with the file's stem."""
    if bool(a.dataset) == bool(a.input_dir):
        raise SystemExit("give either --dataset or --input-dir")
    schema, vectors, style = _schema(spark, a.schema), _vectors(spark, a.vectors), _vectors(spark, a.style)
    seeds, style_seeds = _vectors(spark, a.seeds), _vectors(spark, a.style_seeds)
    options = report.Options(k=a.coverage_k)
    rules, subset = T.read_exclusions(spark, a.not_realistic), parse_indices(a.seed_subset) if a.seed_subset else None
    files = [(r.stem, r.path) for r in T.labelled_files(spark, a.input_dir).collect()] if a.input_dir else [(None, a.dataset)]
    for stem, path in files:
        own = lambda v, stem=stem: v if v is None or stem is None else v.where(F.col("dataset") == stem).drop("dataset")
        got = report.evaluate(T.read_dataset(spark, path), schema, own(vectors), seeds, style=own(style), style_seeds=style_seeds, subset=subset, exclusions=rules, options=options)
        at = lambda given, ending, stem=stem: given if stem is None else f"{given or a.input_dir}/{stem}_metrics{ending}"
        report.write(got, at(a.out_json, ".json"), at(a.out_csv, ""))
        print("\n".join([*([f"{stem}: {got.document['row_level']['n_rows']} rows"] if stem else []), *got.lines()]))


def row_metrics(spark: SparkSession, a: argparse.Namespace) -> None:
    """The row metrics of all labelled datasets of a folder as one table, in as many jobs as for one; vectors have a column `dataset`."""
    paths = [r.path for r in T.labelled_files(spark, a.input_dir).collect()]
    if not paths:
        raise SystemExit("no labelled datasets in the folder")
    got = report.folder_row_metrics(T.read_folder(spark, paths), _schema(spark, a.schema), _vectors(spark, a.vectors), _vectors(spark, a.seeds))
    got.write.partitionBy("dataset").csv(a.out, header=True, escape='"')


def stage(spark: SparkSession, a: argparse.Namespace) -> None:
    models = [tuple(m.split("=", 1)) for m in a.models]
    skipped = {int(x) for x in a.exclude_s.split(",") if x.strip()}
    sizes = [s for s in range(0, a.max_s + 1, a.inc_s) if s not in skipped]
    only = spark.read.text(a.rerun).withColumnRenamed("value", "name") if a.rerun else None
    asked = runs.stage(spark, a.folder, _schema(spark, a.schema), models, a.n, a.runs, sizes, a.max_combinations, a.ablation, a.chunk, only, domain=a.domain or "")
    print(f"{asked.count()} requests in {a.folder}")
    _payloads(spark, a)


def _payloads(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.forms:
        print(runs.write_payloads(spark, a.folder, dict(f.split("=", 1) for f in a.forms.split(",")), a.model if "model" in a else ""))


def _ready(spark: SparkSession, a: argparse.Namespace) -> bool:
    """Whether the batch is done, by the service's JSON document of it (taken for done without one); SystemExit if it came to nothing."""
    state = W.batch_state("\n".join(r.value for r in spark.read.text(a.status).collect())) if a.status else "done"
    if state == "failed":
        raise SystemExit("the batch failed")
    if state == "open":
        print("the batch is not complete yet")
    return state == "done"


def status(spark: SparkSession, a: argparse.Namespace) -> None:
    for r in runs.status(spark, a.folder, a.results).toLocalIterator():
        print(" ".join(f"{k}={v}" for k, v in r.asDict().items()))


def collect(spark: SparkSession, a: argparse.Namespace) -> None:
    """The whole files of the results; with --stream of a folder of results, of which only new files are read."""
    if not _ready(spark, a):
        return
    _collected(spark, (runs.collect_stream if a.stream else runs.collect)(spark, a.folder, a.results), a)


def collect_local(spark: SparkSession, a: argparse.Namespace) -> None:
    """Answers of a function module:name, which takes a request's body and gives a text; without one, of the built-in stub."""
    module, _, name = (a.generator or "assayer.runs:stub").partition(":")
    _collected(spark, runs.run_local(spark, a.folder, getattr(importlib.import_module(module), name), a.rounds, a.chunk), a)


def _collected(spark: SparkSession, got: runs.Collected, a: argparse.Namespace) -> None:
    _new_version(got.texts.select("stem", "kind", "text"), a.folder, "texts", ["kind", "stem"], "text")
    _new_version(got.texts.where("examples is not null").select("stem", F.col("examples").alias("text")), a.folder, "examples", ["stem"], "text")
    if not got.raw.isEmpty():
        _new_version(got.raw, a.folder, "raw_responses", ["kind", "stem"], "text")
    runs.summary(runs.manifest(spark, a.folder), a.ablation).write.mode("append").csv(f"{a.folder}/summary", header=True)
    _failures(got.failures, a.folder)


def stage_labels(spark: SparkSession, a: argparse.Namespace) -> None:
    vocabulary = runs.load_vocabulary("\n".join(r.value for r in spark.read.text(a.vocabulary).collect()))
    done = T.labelled_files(spark, a.texts).select(F.regexp_replace("stem", "_labeled$", "").alias("stem"))
    done = done.where("false") if a.all else done
    print(f"{runs.stage_labels(runs.read_texts(spark, a.texts), done, vocabulary, a.folder).count()} requests in {a.folder}")
    _payloads(spark, a)


def collect_labels(spark: SparkSession, a: argparse.Namespace) -> None:
    if not _ready(spark, a):
        return
    vocabulary = runs.load_vocabulary("\n".join(r.value for r in spark.read.text(a.vocabulary).collect()))
    got = runs.collect_labels(a.folder, a.results, runs.read_texts(spark, a.texts), list(vocabulary))
    _new_version(got.labels.drop("position"), a.folder, "labels", ["stem"], "csv")
    if not got.raw.isEmpty():
        _new_version(got.raw.select("stem", "text"), a.folder, "raw_labels", ["stem"], "text")
    _failures(got.failures, a.folder)


def scan_labels(spark: SparkSession, a: argparse.Namespace) -> None:
    done = T.labelled_files(spark, a.texts)
    for r in T.unlabelled(runs.read_texts(spark, a.texts).select("stem"), done).orderBy("stem").toLocalIterator():
        print(r.stem)


def repair(spark: SparkSession, a: argparse.Namespace) -> None:
    """Files of any size: each in splits, written as parts in order."""
    ship(spark)
    rows = X.csv_rows(X.repaired_cells(X.records(X.physical_lines(spark, a.files))))
    rows.select(F.regexp_extract("doc", r"([^/]+)$", 1).alias("file"), "text").write.partitionBy("file").text(a.out)


def _new_version(df: DataFrame, folder: str, name: str, by: list[str], form: str) -> None:
    """A folder of its own for each collection, so that an earlier one stays until someone removes it; `versions` in the folder says which
    is the current one (`runs.current`)."""
    at = f"{folder}/{name}-{datetime.datetime.now(datetime.UTC):%Y%m%dT%H%M%S%f}"
    out = df.repartition(*by).write.partitionBy(*by)
    out.text(at) if form == "text" else out.csv(at, header=True, quoteAll=True, escape='"')
    runs.add_version(df.sparkSession, folder, name, at)
    print(at)


def _failures(failures: DataFrame, folder: str) -> None:
    failures.write.mode("overwrite").json(f"{folder}/failures")
    print(f"{failures.count()} failures")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="assayer", description=__doc__)
    add = top.add_subparsers(dest="command", required=True)

    def command(f, *names: str, **options) -> argparse.ArgumentParser:
        sub = add.add_parser(f.__name__.replace("_", "-"))
        sub.set_defaults(run=f)
        for n in names:
            sub.add_argument(f"--{n}", required=True)
        for n, default in options.items():
            kind = {"action": "store_true"} if default is False else {"default": default, "type": type(default) if default is not None else str}
            sub.add_argument(f"--{n.replace('_', '-')}", **kind)
        return sub

    command(evaluate, "schema", "vectors", "seeds", dataset=None, input_dir=None, style=None, style_seeds=None, seed_subset=None, not_realistic=None, coverage_k=10, out_json=None, out_csv=None)
    command(row_metrics, "schema", "input-dir", "vectors", "seeds", "out")
    command(stage, "schema", "folder", runs=1, n=100, chunk=25, max_s=0, inc_s=1, exclude_s="", max_combinations=5, ablation=False, rerun=None, domain=None, forms=None).add_argument("--models", nargs="+", required=True, help="provider=model")
    command(collect, "folder", "results", ablation=False, stream=False, status=None)
    command(status, "folder", "results")
    command(collect_local, "folder", generator=None, rounds=5, chunk=25, ablation=False)
    command(stage_labels, "texts", "vocabulary", "folder", all=False, forms=None, model="")
    command(collect_labels, "folder", "results", "texts", "vocabulary", status=None)
    command(scan_labels, "texts")
    command(repair, "files", "out")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("assayer").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
