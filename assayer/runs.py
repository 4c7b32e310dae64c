"""Runs of generation and labelling as folders of a shared store: requests staged, answers collected, labels put beside texts.

A run's folder has `requests` (custom_id, body) and `manifest` (custom_id and what it was asked for), both JSON tables. Any service
that answers with result lines can stand between staging and collecting; `answered` asks one through a function in Spark's tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .operators import repair as R
from .operators import workflow as W
from .schema import Schema, leaves, seed_combinations
from .sources.tables import read_results, stream_results, write_requests
from .store import written
from .workers import ship

# The columns of the experiment summaries.
SUMMARY = ["filename", "seed_idx"]
ABLATION_SUMMARY = [*SUMMARY, "missing_fixed", "missing_constituents", "missing_seed_examples", "variant_id"]


def load_vocabulary(text: str) -> dict[str, list[str]]:
    """The label columns and their values; ValueError unless `columns` is an object with some."""
    columns = json.loads(text).get("columns")
    if not isinstance(columns, dict) or not columns:
        raise ValueError("the vocabulary has no columns")
    return {str(k): [str(v) for v in vs] for k, vs in columns.items()}


def combinations(spark: SparkSession, schema: Schema, sizes: list[int], most: int) -> DataFrame:
    seeds = schema.seeds
    rows = [(i, len(c), list(c), "\n".join(f"- {seeds[j]}" for j in c)) for i, c in enumerate(seed_combinations(len(seeds), sizes, most))]
    return spark.createDataFrame(rows, "combo_id int, n_seeds int, seed_idx array<int>, seed_texts string")


def variant_table(spark: SparkSession, schema: Schema, ablation: bool, seedless: bool = True) -> DataFrame:
    """The whole schema, or its ablations too, each with its document as JSON and its system message."""
    rows = W.variants(spark, schema, seedless)
    rows = rows.collect() if ablation else rows.where("variant_id = 0").collect()
    lean = []
    for r in rows:
        document = W.variant_document(schema, r)
        shown = json.dumps({k: v for k, v in document.items() if k != "seedExamples"}, ensure_ascii=False)
        lean.append((r.variant_id, r.missing_fixed, r.missing_constituents, r.missing_seeds, shown, system_message(document)))
    return spark.createDataFrame(lean, "variant_id int, missing_fixed string, missing_constituents string, missing_seeds boolean, document string, system string")


def generation_prompt(kind: Column, rows: Column, document: Column, seeds: Column, plain: Column, columns: list[str]) -> Column:
    """plain: one example per line; else CSV of example_text and the label columns. A baseline sees the seeds alone."""
    form = F.when(plain | (kind == "baseline"), "Give one example per line and nothing else.").otherwise(F.lit("Answer as CSV with the header example_text," + ",".join(columns) + ". Quote every cell."))
    task = F.concat(F.lit("Write "), rows.cast("string"), F.lit(" new and different examples. "), form)
    about = F.when(kind == "schema", F.concat(F.lit("\nThey follow this schema:\n"), document)).otherwise("")
    return F.concat(task, about, F.when(seeds != "", F.concat(F.lit("\nExamples that people wrote:\n"), seeds)).otherwise(""))


SYSTEM = "You write examples that people in the described setting could have written. Keep to the asked form; add no comments."
NOTES = {
    "capability": "what the examples are to measure.",
    "systematizedConcept": "what is meant by it, apart from any setting.",
    "deploymentPopulation": "who would write the examples; use their words, their knowledge and their manner.",
    "contextualConstraints": "the setting that all examples belong to, said or unsaid.",
    "systematizedInstance": "the parts of an example: some always there, others in some examples; their order is free.",
}
PARTS_NOTE = "the parts that the concept is made of. A required one is in every example, an optional one in some; several values of one are split by semicolons."
SEEDS_NOTE = "Examples that people wrote show manner and detail. Take neither their scenes nor their sentences."


def system_message(document: dict) -> str:
    """The system message for a schema or an ablation of it, with a line for each of the parts that it has."""
    fixed, parts = document.get("fixedFields") or {}, leaves(document.get("constituents") or {})
    lines = [f"{name}: {note}" for name, note in NOTES.items() if name in fixed]
    lines += [f"constituents: {PARTS_NOTE}"] if any(leaf.get("value") for _, leaf in parts) else []
    lines += [SEEDS_NOTE] if document.get("seedExamples") else []
    return "\n".join([SYSTEM, *(["The schema has these parts."] if lines else []), *lines])


def stage(
    spark: SparkSession, folder: str, schema: Schema, models: list[tuple[str, str]], n: int, runs: int = 1, sizes: list[int] | None = None, most: int = 5, ablation: bool = False, chunk: int = 25,
    only: DataFrame | None = None, done: DataFrame | None = None, domain: str = "",
) -> DataFrame:
    """Requests of model x variant x seed combination x run x chunk; returns the manifest.

    only(name): just the files of these names; done(stem, kind): not these. domain: words about the setting for every request."""
    variants, combos = variant_table(spark, schema, ablation), combinations(spark, schema, sizes or [0], most)
    asked = spark.createDataFrame(models, "provider string, model string")
    planned = W.requests(asked, variants, combos, runs, n, chunk)
    planned = planned if only is None else W.rerun(planned, only)
    planned = planned if done is None else W.without_output(planned, done)
    seeds = F.when(F.col("missing_seeds"), "").otherwise(F.col("seed_texts"))
    prompt = generation_prompt(F.col("kind"), F.col("chunk_rows"), F.col("document"), seeds, F.col("variant_id") > 0, schema.columns)
    full = planned.withColumn("prompt", prompt)
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    plain = F.when(F.col("kind") == "baseline", F.lit(SYSTEM)).otherwise(F.col("system"))
    system = F.concat_ws("\n", plain, F.lit(domain.strip() or None))
    body = F.struct("provider", "model", "max_tokens", F.array(said("system", system), said("user", F.col("prompt"))).alias("messages"))
    write_requests(full.select("custom_id", body.alias("body")), f"{folder}/requests")
    write_requests(full.drop("prompt", "document", "system", "seed_texts"), f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(f"{folder}/manifest")


def write_payloads(spark: SparkSession, folder: str, forms: dict[str, str], model: str = "") -> str:
    """The staged requests as lines for their services, in `payloads/provider=...`; forms: provider -> form of `workflow.payload`. Requests
    that name no provider (those for labels) are the provider `any`. ValueError if a provider has no form."""
    asked = spark.read.json(f"{folder}/requests")
    if "provider" not in asked.schema["body"].dataType.names:
        asked = asked.withColumn("body", F.struct(F.lit("any").alias("provider"), "body.*"))
    found = {r.provider for r in asked.select("body.provider").distinct().collect()}
    if lost := found - forms.keys():
        raise ValueError(f"no form is given for the requests of {sorted(lost)}")
    for provider in sorted(found):
        W.payload(asked.where(F.col("body.provider") == provider), forms[provider], model).write.mode("overwrite").text(f"{folder}/payloads/provider={provider}")
    return f"{folder}/payloads"


def status(spark: SparkSession, folder: str, results: DataFrame | str) -> DataFrame:
    """(asked, answered, failed, waiting) per provider, model and kind of the manifest, as far as it has these columns."""
    asked = manifest(spark, folder)
    by = [c for c in ("provider", "model", "kind") if c in asked.columns]
    answers = read_answers(read_results(spark, results) if isinstance(results, str) else results).withColumn("came", F.lit(True))
    both = asked.join(answers.select("custom_id", "came", F.col("text").isNotNull().alias("good")), "custom_id", "left")
    n = lambda c: F.count(F.when(c, 1))
    return both.groupBy(*by).agg(F.count("*").alias("asked"), n(F.col("good")).alias("answered"), n(~F.col("good")).alias("failed"), n(F.col("came").isNull()).alias("waiting"))


def read_answers(results: DataFrame) -> DataFrame:
    """(custom_id, text, error) with no text where the status is not 200; of several answers to an id the longest text, then the last
    in order; of several errors the last in order."""
    best = F.max_by("text", F.struct(F.length("text"), "text"))
    return _texts(results).groupBy("custom_id").agg(best.alias("text"), F.max("error").alias("error"))


def _texts(results: DataFrame) -> DataFrame:
    """(custom_id, text, error) of results(custom_id, status, body[, error]), one by one; error only where there is no text."""
    error = F.col("error") if "error" in results.columns else F.lit(None).cast("string")
    read = results.select("custom_id", F.when(F.coalesce("status", F.lit(200)) == 200, W.response_text(F.col("body"))).alias("text"), error.alias("error"))
    return read.withColumn("error", F.when(F.col("text").isNull(), F.coalesce("error", F.lit("no text"))))


def add_version(spark: SparkSession, folder: str, name: str, at: str) -> None:
    """A line in the folder's list of versions. It is written when the version itself is whole, so that readers never see half of one."""
    spark.createDataFrame([(name, at)], "name string, at string").coalesce(1).write.mode("append").json(f"{folder}/versions")


def current(spark: SparkSession, folder: str, name: str) -> str | None:
    """The path of the newest version of texts, examples or labels of a run; versions carry the time in their names."""
    found = spark.read.schema("name string, at string").json(f"{folder}/versions").where(F.col("name") == name)
    return found.agg(F.max("at").alias("at")).first().at


class Collected(NamedTuple):
    """texts: stem, kind, text and, of CSV, examples (its text column, one a line); failures: custom_id, error; raw: stem, kind, text of
    the answers to a file that could not be put together."""

    texts: DataFrame
    failures: DataFrame
    raw: DataFrame


def collect(spark: SparkSession, folder: str, results: DataFrame | str) -> Collected:
    """The files whose chunks are all there, put together: CSV by the names of its columns, repaired where it does not parse."""
    ship(spark)
    asked = manifest(spark, folder)
    found, failures = W.with_manifest(read_answers(read_results(spark, results) if isinstance(results, str) else results), asked)
    lost = asked.join(found.select("custom_id"), "custom_id", "left_anti")
    unanswered = lost.join(failures, "custom_id", "left_anti").select("custom_id", F.lit("no answer").alias("error"))
    # What was asked for later, to make up for missing rows, may stay without an answer.
    needed = lost.where("round is null") if "round" in asked.columns else lost
    whole = found.join(needed.select("stem", "kind").distinct(), ["stem", "kind"], "left_anti")
    chunks = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"])
    files = whole.groupBy("stem", "kind", (F.col("variant_id") == 0).alias("whole_schema")).agg(chunks.alias("chunks"))
    return _collected(put_together(files), failures.unionByName(unanswered))


def put_together(files: DataFrame) -> DataFrame:
    """(stem, kind, chunks, text, csv) of whole files(stem, kind, whole_schema, chunks); no text where the answers have no rows."""
    csv = (F.col("kind") == "schema") & F.col("whole_schema")
    plain = R.plain_lines(F.array_join("chunks", "\n"))
    return files.select("stem", "kind", "chunks", F.when(csv, R.combined_csv(F.col("chunks"))).otherwise(F.when(plain != "", plain)).alias("text"), csv.alias("csv"))


def _collected(made: DataFrame, failures: DataFrame) -> Collected:
    broken = made.where("text is null")
    raw = broken.select("stem", "kind", F.array_join("chunks", "\n\n").alias("text"))
    unusable = broken.select(F.concat_ws("__", "kind", "stem").alias("custom_id"), F.lit("no rows in the answers").alias("error"))
    texts = made.where("text is not null").select("stem", "kind", "text", F.when(F.col("csv"), R.text_lines(F.col("text"))).alias("examples"))
    return Collected(texts, failures.unionByName(unusable), raw)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROGRESS = "stem string, kind string, known boolean, whole_schema boolean, lacking long, ids array<string>, chunks array<long>, texts array<string>, errors array<string>"


def _progress(changed: DataFrame) -> DataFrame:
    """PROGRESS of files(stem, kind, known, whole_schema, needed, answers): the best answer to each request, and how many chunks are lacking.

    An answer with a text is better than one without, a longer text better than a shorter one, then the later in order; of errors the last."""
    text = lambda a: F.struct(a["custom_id"].alias("custom_id"), a["text"].isNotNull().alias("has"), F.coalesce(F.length(a["text"]), F.lit(0)).alias("length"), a["text"].alias("text"), a["error"].alias("error"), a["chunk"].alias("chunk"), a["first"].alias("first"))
    in_order = F.array_sort(F.transform("answers", text))
    # The list is the variable of an outer lambda, and so is sorted once.
    last = lambda o: F.filter(o, lambda a, i: ~F.coalesce(F.get(o, i + 1)["custom_id"] == a["custom_id"], F.lit(False)))
    best = changed.withColumn("best", F.transform(F.array(in_order), last)[0])
    met = F.size(F.filter("best", lambda a: a["first"] & a["has"]))
    of = lambda name: F.transform("best", lambda a: a[name])
    return best.select("stem", "kind", "known", "whole_schema", (F.col("needed") - met).alias("lacking"), of("custom_id").alias("ids"), of("chunk").alias("chunks"), of("text").alias("texts"), of("error").alias("errors"))


def follow(spark: SparkSession, folder: str, results: str, files_per_batch: int = 64, **trigger) -> StreamingQuery:
    """A stream over the files of result lines in a folder, which keeps for each asked file the distinct answers it has, and gives the best of
    them and the number it lacks.

    A file that lacks none is put together in the batch that brought its last chunk, and anew when a better answer to one of its chunks comes; batches
    go to `stream/given` and `stream/progress` in the run's folder, written over when a batch is run again. The stream goes on where it
    stopped. Ids are looked up in the manifest as it is when the stream is started. trigger: availableNow by default."""
    ship(spark)
    asked = manifest(spark, folder)
    first = F.col("round").isNull() if "round" in asked.columns else F.lit(True)
    asked = asked.select("custom_id", F.col("stem").alias("name"), "kind", "chunk", first.alias("first"), (F.col("variant_id") == 0).alias("whole_schema"))
    asked = asked.join(asked.groupBy("name", "kind").agg(F.count(F.when(F.col("first"), 1)).alias("needed")), ["name", "kind"]).withColumn("known", F.lit(True))
    answers = _texts(stream_results(spark, results, files_per_batch)).join(asked, "custom_id", "left")
    keyed = answers.select(
        F.coalesce("name", "custom_id").alias("stem"), F.coalesce("kind", F.lit("")).alias("kind"), "custom_id", "text", "error", F.coalesce("chunk", F.lit(0)).cast("long").alias("chunk"),
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("first", "known", "whole_schema")), F.coalesce("needed", F.lit(0)).alias("needed"),
    )
    answer = F.struct("custom_id", "text", "error", "chunk", "first")
    kept = keyed.groupBy("stem", "kind").agg(F.max("known").alias("known"), F.max("whole_schema").alias("whole_schema"), F.max("needed").alias("needed"), F.collect_set(answer).alias("answers"))

    def give(changed: DataFrame, batch: int) -> None:
        at = f"{folder}/stream/progress/batch={batch}"
        _progress(changed).write.mode("overwrite").parquet(at)
        rows = F.filter(F.arrays_zip("chunks", "texts"), lambda x: x["texts"].isNotNull())
        whole = spark.read.schema(PROGRESS).parquet(at).where("known and lacking <= 0").withColumn("chunks", F.transform(F.array_sort(rows), lambda x: x["texts"])).where(F.size("chunks") > 0)
        put_together(whole).write.mode("overwrite").parquet(f"{folder}/stream/given/batch={batch}")

    store = "spark.sql.streaming.stateStore"
    conf = {f"{store}.providerClass": ROCKS, f"{store}.rocksdb.changelogCheckpointing.enabled": "true", f"{store}.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = kept.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/stream/marks")
        return out.trigger(**(trigger or {"availableNow": True})).foreachBatch(give).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def collect_stream(spark: SparkSession, folder: str, results: str, files_per_batch: int = 64) -> Collected:
    """As `collect`, of a folder of results of which only the files that came since the last call are read."""
    follow(spark, folder, results, files_per_batch).awaitTermination()
    latest = lambda rows, columns: rows.groupBy("stem", "kind").agg(F.max_by(F.struct(*columns), "batch").alias("x")).select("stem", "kind", "x.*")
    progress = latest(spark.read.schema(f"{PROGRESS}, batch int").parquet(f"{folder}/stream/progress"), ["known", "ids", "texts", "errors"])
    given = spark.read.schema("stem string, kind string, chunks array<string>, text string, csv boolean, batch int").parquet(f"{folder}/stream/given")
    answers = progress.select("known", F.explode(F.arrays_zip("ids", "texts", "errors")).alias("x")).select("known", F.col("x.ids").alias("custom_id"), F.col("x.texts").alias("text"), "x.errors")
    failures = answers.where("not known or text is null").select("custom_id", F.when(~F.col("known"), "unknown id").otherwise(F.col("errors")).alias("error"))
    unanswered = manifest(spark, folder).join(answers, "custom_id", "left_anti").select("custom_id", F.lit("no answer").alias("error"))
    return _collected(latest(given, ["chunks", "text", "csv"]), failures.unionByName(unanswered))


#: A service: (body of a request) -> text, or None where it has none.
Generator = Callable[[dict], str | None]


def stub(body: dict) -> str | None:
    """A service that needs no network: as many rows as are asked for, made of a digest of the request, in the form that is asked for."""
    import hashlib
    import re

    asked = body["messages"][-1]["content"]
    n = re.search(r"Write (\d+) new", asked)
    header = re.search(r"with the header ([^.]*)\.", asked)
    mark = hashlib.sha256(asked.encode()).hexdigest()[:8]
    if n is None:
        return None
    rows = [f"example {i} of {mark}" for i in range(int(n[1]))]
    if header is None:
        return "\n".join(rows)
    names = header[1].split(",")
    return "\n".join([header[1], *(",".join([f'"{r}"', *[f"v{i % 3}"] * (len(names) - 1)]) for i, r in enumerate(rows))])


def answered(requests: DataFrame, generator: Generator) -> DataFrame:
    """(custom_id, status, body): what the generator says to each of requests(custom_id, body); 500 where it fails or says nothing."""
    ship(requests.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for custom_id, body in zip(p.custom_id, p.body, strict=True):
                try:
                    text = generator(json.loads(body))
                except Exception as e:  # noqa: BLE001  a failure of one request is that request's result
                    text = None
                    print(f"{custom_id}: {type(e).__name__}: {e}")
                out.append((custom_id, 500 if text is None else 200, json.dumps({"output_text": text or ""})))
            yield pd.DataFrame(out, columns=["custom_id", "status", "body"])

    return requests.select("custom_id", F.to_json("body").alias("body")).mapInPandas(run, "custom_id string, status int, body string")


def run_local(spark: SparkSession, folder: str, generator: Generator, rounds: int = 5, chunk: int = 25) -> Collected:
    """Staged requests answered by the generator; files that are short of rows are asked for anew, until none is, a round brings no
    rows, or `rounds` have passed. Answers are kept in the run's folder."""
    ship(spark)
    todo = spark.read.json(f"{folder}/requests")
    for turn in range(rounds):
        answered(todo, generator).write.mode("overwrite").parquet(f"{folder}/answers/turn={turn}")
        answers = spark.read.parquet(f"{folder}/answers").drop("turn")
        asked = manifest(spark, folder)
        rows = R.per_cell(R.row_count, "int")(F.col("text"))
        made = read_answers(answers).join(asked, "custom_id").select("stem", "kind", "chunk", F.coalesce(rows, F.lit(0)).alias("rows"))
        made = made.where("chunk is not null")
        # A file without rows in its last round gets no further one.
        last = asked.groupBy("stem", "kind").agg(F.max("round").alias("round")) if "round" in asked.columns else None
        alive = made if last is None else made.join(asked.select("stem", "kind", "chunk", "round").join(last, ["stem", "kind", "round"]), ["stem", "kind", "chunk"], "left_semi")
        alive = alive.groupBy("stem", "kind").agg(F.sum("rows").alias("some")).where("some > 0").select("stem", "kind")
        first = asked.where("chunk = 0").join(alive, ["stem", "kind"], "left_semi")
        more = W.shortfall(first.drop("chunk", "chunk_rows", "custom_id", "max_tokens", "round"), made, chunk)
        more = more.withColumn("custom_id", W.custom_id(F.col("kind"), F.col("stem"), F.col("chunk"))).withColumn("max_tokens", W.token_budget(F.col("chunk_rows"), F.col("kind"))).withColumn("round", F.lit(turn + 1))
        bodies = spark.read.json(f"{folder}/requests").join(first.select("custom_id", "stem", "kind"), "custom_id").select("stem", "kind", "body")
        said = F.transform("body.messages", lambda m: F.struct(F.regexp_replace(m["content"], r"^Write \d+ ", F.concat(F.lit("Write "), F.col("chunk_rows").cast("string"), F.lit(" "))).alias("content"), m["role"].alias("role")))
        new = more.join(bodies, ["stem", "kind"]).select("custom_id", F.struct(F.col("body.provider").alias("provider"), F.col("body.model").alias("model"), "max_tokens", said.alias("messages")).alias("body"))
        if turn + 1 == rounds or more.isEmpty():
            break
        new.write.json(f"{folder}/requests-{turn + 1}")
        more.write.mode("append").json(f"{folder}/manifest")
        todo = spark.read.json(f"{folder}/requests-{turn + 1}")
    return collect(spark, folder, spark.read.parquet(f"{folder}/answers").drop("turn"))


def summary(asked: DataFrame, ablation: bool = False) -> DataFrame:
    """A row per file with the seeds (and what was left out) behind it."""
    one = asked.select(F.concat("stem", F.lit(".csv")).alias("filename"), F.col("seed_idx").cast("string").alias("seed_idx"), "missing_fixed", "missing_constituents", F.col("missing_seeds").alias("missing_seed_examples"), "variant_id").distinct()
    return one.select(ABLATION_SUMMARY if ablation else SUMMARY)


def examples_of(files: DataFrame) -> DataFrame:
    """files(stem, text) -> (stem, position, text): the non-blank trimmed lines."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return files.select("stem", F.posexplode(lines).alias("position", "text"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, path, text) of the .txt files under a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(path, r"([^/]+)\.txt$", 1).alias("stem"), path.alias("path"), F.col("value").alias("text"))


def stage_labels(files: DataFrame, labelled: DataFrame, vocabulary: dict[str, list[str]], folder: str) -> DataFrame:
    """Requests for the files(stem, text[, path]) with some text that are not among labelled(stem); returns the manifest."""
    todo = files.join(labelled.select("stem"), "stem", "left_anti")
    asked = todo.where(F.trim("text") != "").withColumn("custom_id", W.label_id(F.col("path") if "path" in files.columns else F.concat("stem", F.lit(".txt"))))
    prompt = W.labelling_prompt(F.col("text"), json.dumps(vocabulary, ensure_ascii=False))
    body = F.struct(W.label_budget(F.col("text")).alias("max_tokens"), F.lit(0).alias("temperature"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"))
    write_requests(asked.select("custom_id", body.alias("body")), f"{folder}/requests")
    write_requests(asked.select("custom_id", "stem"), f"{folder}/manifest")
    return manifest(files.sparkSession, folder)


class Labelled(NamedTuple):
    """labels: stem, position, example_text and the label columns, empty where the answer has too few rows; failures: custom_id, error; raw:
    stem, text, rows, expected of the answers that do not have a row for each text. Those without any give no labels."""

    labels: DataFrame
    failures: DataFrame
    raw: DataFrame


def collect_labels(folder: str, results: DataFrame | str, files: DataFrame, columns: list[str]) -> Labelled:
    """The labels of the answers beside the texts that they are for."""
    spark = files.sparkSession
    ship(spark)
    asked = manifest(spark, folder)
    found, failures = W.with_manifest(read_answers(read_results(spark, results) if isinstance(results, str) else results), asked)
    unanswered = asked.join(found.select("custom_id"), "custom_id", "left_anti").join(failures, "custom_id", "left_anti").select("custom_id", F.lit("no answer").alias("error"))
    texts = examples_of(files.join(found.select("stem"), "stem", "left_semi"))
    sized = found.select("custom_id", "stem", F.col("text").alias("answer")).join(texts.groupBy("stem").agg(F.count("*").alias("rows")), "stem")
    has = R.per_cell(lambda a: len(R.label_rows(a, columns)), "int")(F.col("answer"))
    sized = written(sized.withColumn("found", has), "answers")
    raw = sized.where("found <> rows").select("stem", F.col("answer").alias("text"), F.col("found").alias("rows"), F.col("rows").alias("expected"))
    empty = sized.where("found = 0").select("custom_id", F.lit("no labels in the answer").alias("error"))
    texts = texts.join(sized.where("found = 0").select("stem"), "stem", "left_anti")

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(s, i, *r) for s, a, n in zip(p.stem, p.answer, p.rows, strict=True) for i, r in enumerate(R.parse_labels(a, columns, int(n)))]
            yield pd.DataFrame(rows, columns=["stem", "position", *columns])

    labels = sized.where("found > 0").select("stem", "answer", "rows").mapInPandas(parse, "stem string, position int, " + ", ".join(f"`{c}` string" for c in columns))
    beside = W.positional_zip(texts.withColumnRenamed("text", "example_text"), labels, "stem")
    return Labelled(beside, failures.unionByName(unanswered).unionByName(empty), raw)
