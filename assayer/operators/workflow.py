"""Planning, assembling and labelling of generated datasets as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FIXED, Schema, without
from ..sources.tables import numbered


def chunk_plan(jobs: DataFrame, n_col: str = "n", size: int = 25) -> DataFrame:
    """A row per chunk of at most size rows: chunk (from 0) and chunk_rows."""
    chunks = F.ceil(F.col(n_col) / size).cast("int")
    some = jobs.where(F.col(n_col) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return some.withColumn("chunk_rows", F.least(F.lit(size), F.col(n_col) - F.col("chunk") * size).cast("int"))


def token_budget(rows: Column, kind: Column) -> Column:
    base = F.least(F.lit(40000), 200 + 350 * rows)
    return F.when(kind == "schema", F.floor(base * 12 / 10)).otherwise(base).cast("int")


def label_budget(text: Column) -> Column:
    return (500 + F.floor(F.length(text) / 3)).cast("int")


def custom_id(kind: Column, stem: Column, chunk: Column, most: int = 64) -> Column:
    """kind__stem__chunkNNN; where that is longer than most, the stem is cut and marked with eight digits of its SHA-1."""
    suffix = F.format_string("__chunk%03d", chunk.cast("int"))
    room = F.lit(most - 2) - F.length(kind) - F.length(suffix)
    mark = F.substring(F.sha1(stem), 1, 8)
    cut = F.when(room > 9, F.concat(F.substr(stem, F.lit(1), room - 9), F.lit("_"), mark)).otherwise(mark)
    return F.concat(kind, F.lit("__"), F.when((room > 0) & (F.length(stem) <= room), stem).otherwise(cut), suffix)


def label_id(path: Column, most: int = 64) -> Column:
    """label__stem__digest for the text file at path: other characters than letters, digits, _ and - as one _, ten digits of the path's SHA-1."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1), "[^a-zA-Z0-9_-]+", "_")
    return F.concat(F.lit("label__"), F.substring(stem, 1, most - 19), F.lit("__"), F.substring(F.sha1(path), 1, 10))


def model_tag(provider: Column, model: Column) -> Column:
    return F.translate(F.concat_ws("_", provider, model), "/:", "--")


def requests(models: DataFrame, variants: DataFrame, combos: DataFrame, runs: int, n: int, size: int = 25) -> DataFrame:
    """model x run x variant x combination x chunk, with stem, custom_id and token budget."""
    every = models.crossJoin(variants).crossJoin(combos).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn("n", F.lit(n))
    stem = F.format_string("%s_v%03d_s%d_combo%03d_run%d", model_tag(F.col("provider"), F.col("model")), F.col("variant_id"), F.col("n_seeds"), F.col("combo_id"), F.col("run"))
    planned = chunk_plan(every.withColumn("stem", stem), "n", size)
    kinds = planned.withColumn("kind", F.explode(F.array(F.lit("schema"), F.lit("baseline")))).where((F.col("kind") == "schema") | (F.col("variant_id") == 0))
    return kinds.withColumn("custom_id", custom_id(F.col("kind"), F.col("stem"), F.col("chunk"))).withColumn("max_tokens", token_budget(F.col("chunk_rows"), F.col("kind")))


def assemble(chunks: DataFrame, keys: list[str], order: str = "chunk", text: str = "text") -> DataFrame:
    """The chunks' texts of each key, joined by newlines in order."""
    sorted_ = F.array_sort(F.collect_list(F.struct(order, text)))
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(sorted_, lambda s: s[text]), "\n").alias("text"), F.count("*").alias("chunks"))


def with_manifest(results: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, failures) of results(custom_id, text[, error]) by custom_id."""
    both = results.join(manifest.withColumn("_known", F.lit(True)), "custom_id", "left")
    ok = F.col("_known").isNotNull() & F.col("text").isNotNull()
    why = F.coalesce("error", F.lit("no text")) if "error" in results.columns else F.lit("no text")
    failed = both.where(~F.coalesce(ok, F.lit(False))).select("custom_id", F.when(F.col("_known").isNull(), "unknown id").otherwise(why).alias("error"))
    return both.where(ok).drop("_known", "error"), failed


BODY = "struct<output_text: string, output: array<struct<content: array<struct<type: string, text: string, value: string>>>>, choices: array<struct<message: struct<content: string>>>, content: array<struct<text: string>>>"


def response_text(body: Column) -> Column:
    """The first non-blank of the plain output, the joined output parts, the first choice and the joined content of a response in JSON."""
    b = F.from_json(body, BODY)
    parts = F.flatten(F.transform(b["output"], lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type: string, text: string, value: string>>"))))
    said = F.array_join(F.filter(F.transform(F.filter(parts, lambda p: p["type"].isin("output_text", "text")), lambda p: F.coalesce(p["text"], p["value"])), lambda t: t.isNotNull()), "")
    some = lambda c: F.when(F.trim(c) != "", c)
    blocks = F.array_join(b["content"]["text"], "")
    return F.coalesce(some(b["output_text"]), some(said), some(F.try_element_at(b["choices"], F.lit(1))["message"]["content"]), some(blocks))


def payload(requests: DataFrame, form: str, model: str = "") -> DataFrame:
    """(value): requests(custom_id, body) as JSON lines for a service.

    responses: the body as the input of a posted request, system messages among the others; messages: parameters with the system
    messages apart. model: where the body names none. Bodies may have a temperature."""
    names = requests.schema["body"].dataType.names
    of = lambda name: F.col(f"body.{name}")
    named = of("model") if "model" in names else F.lit(model)
    heat = [of("temperature").alias("temperature")] if "temperature" in names else []
    if form == "responses":
        body = F.struct(named.alias("model"), of("messages").alias("input"), of("max_tokens").alias("max_output_tokens"), *heat)
        line = F.struct("custom_id", F.lit("POST").alias("method"), F.lit("/v1/responses").alias("url"), body.alias("body"))
    elif form == "messages":
        system = F.array_join(F.filter(of("messages"), lambda m: m["role"] == "system")["content"], "\n")
        rest = F.filter(of("messages"), lambda m: m["role"] != "system")
        line = F.struct("custom_id", F.struct(named.alias("model"), of("max_tokens").alias("max_tokens"), F.when(system != "", system).alias("system"), rest.alias("messages"), *heat).alias("params"))
    else:
        raise ValueError(f"no form of requests: {form}")
    return requests.select(F.to_json(line).alias("value"))


# What services say of a batch that is done, and of one that came to nothing; anything else is under way.
DONE = ("completed", "ended")
FAILED = ("failed", "errored", "cancelled", "canceled", "expired")


def batch_state(document: str) -> str:
    """done, failed or open: what a service's JSON document says of a batch in `status` or `processing_status`."""
    said = json.loads(document)
    word = str(said.get("status") or said.get("processing_status") or "").lower()
    return "done" if word in DONE else "failed" if word in FAILED else "open"


def positional_zip(texts: DataFrame, labels: DataFrame, key: str, order: str = "position") -> DataFrame:
    """Labels put beside the texts of the same key and position; labels are padded to the texts."""
    return texts.join(labels, [key, order], "left")


def variants(spark: SparkSession, schema: Schema, seedless: bool = True) -> DataFrame:
    """(variant_id, missing_fixed, missing_constituents, missing_seeds, distinct_key): what each ablation leaves out; 0 is the whole schema.

    The first two fixed fields go together as soon as more than one part goes; ablations of nothing or of everything are left out.
    A mask's bits say which parts go, so 2 ** parts rows are made by a range, in the order of the masks."""
    names, columns = list(FIXED[:5]), schema.columns
    flags = len(names) + len(columns) + bool(seedless)
    bit = lambda i: F.col("id").bitwiseAND(1 << i) != 0
    several = F.bit_count("id") > 1
    tied = several & (bit(0) | bit(1))
    gone = [F.when(bit(i) | (tied if i < 2 else F.lit(False)), F.lit(n)) for i, n in enumerate(names)]
    gone_columns = [F.when(bit(len(names) + i), F.lit(c)) for i, c in enumerate(columns)]
    listed = lambda cs: F.array_sort(F.array_compact(F.array(*cs))) if cs else F.array().cast("array<string>")
    seeds = bit(flags - 1) if seedless else F.lit(False)
    rows = spark.range(1 << flags).select("id", listed(gone).alias("f"), listed(gone_columns).alias("c"), seeds.alias("missing_seeds"))
    rows = rows.where(F.size("f") + F.size("c") + F.col("missing_seeds").cast("int") < flags)
    text = rows.select(F.array_join("f", ",").alias("missing_fixed"), F.array_join("c", ",").alias("missing_constituents"), "missing_seeds")
    key = F.when((F.col("missing_fixed") == "") & (F.col("missing_constituents") == "") & ~F.col("missing_seeds"), "").otherwise(F.concat_ws("|", "missing_fixed", "missing_constituents", F.col("missing_seeds").cast("int").cast("string")))
    return numbered(text.withColumn("distinct_key", key)).select(F.col("row_id").cast("int").alias("variant_id"), "missing_fixed", "missing_constituents", "missing_seeds", "distinct_key")


def variant_document(schema: Schema, row) -> dict:
    split = lambda s: set(filter(None, s.split(",")))
    return without(schema.document, split(row.missing_fixed), split(row.missing_constituents), row.missing_seeds)


def labelling_prompt(text: Column, options_json: str) -> Column:
    return F.concat(F.lit(f"Assign to the text between the marks one or more of the allowed values of each column.\nAllowed values: {options_json}\nAnswer as CSV with a header.\n<<<\n"), text, F.lit("\n>>>"))


def rerun(planned: DataFrame, names: DataFrame) -> DataFrame:
    """The planned(stem) files that names(name) lists by stem or file name; the extension does not matter."""
    wanted = names.select(F.regexp_replace(F.regexp_extract(F.trim("name"), r"([^/]*)$", 1), r"\.(txt|csv)$", "").alias("stem")).distinct()
    return planned.join(wanted, "stem", "left_semi")


def without_output(planned: DataFrame, done: DataFrame) -> DataFrame:
    """The planned(stem, kind) files that are not among done(stem, kind)."""
    return planned.join(done.select("stem", "kind").distinct(), ["stem", "kind"], "left_anti")


def seed_indices(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """texts(text) with seed_idx: the last index that seeds(idx, text) has for the text, null for none."""
    last = seeds.groupBy("text").agg(F.max("idx").alias("seed_idx"))
    return texts.join(last, "text", "left")


def shortfall(planned: DataFrame, made: DataFrame, size: int = 25) -> DataFrame:
    """What is still to be asked for: planned(stem, kind, n) less made(stem, kind, rows), in chunks whose numbers go on from those planned before."""
    have = made.groupBy("stem", "kind").agg(F.sum("rows").alias("have"), F.max("chunk").alias("last"))
    left = planned.join(have, ["stem", "kind"], "left").withColumn("missing", F.greatest(F.col("n") - F.coalesce("have", F.lit(0)), F.lit(0)))
    return chunk_plan(left, "missing", size).withColumn("chunk", (F.col("chunk") + F.coalesce("last", F.lit(-1)) + 1).cast("int")).drop("have", "last", "missing")
