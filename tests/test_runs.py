"""Runs on disk: staging, collecting, labelling, and the command line over them."""

import csv
import glob
import json
import random

import pytest

from assayer import __main__ as cli
from assayer import runs
from assayer.operators import workflow as W
from assayer.schema import Schema

DOC = {"fixedFields": {"capability": "c"}, "constituents": {"k": {"required": True, "value": ["a", "b"]}}, "seedExamples": ["one", "two", "three"]}


def line(i, text, status=200):
    return json.dumps({"custom_id": i, "response": {"status_code": status, "body": {"output_text": text}}})


def test_generation(spark, tmp_path):
    folder = str(tmp_path / "run")
    asked = runs.stage(spark, folder, Schema.parse(DOC), [("p", "m/1")], 30, 1, [0, 2], 9)
    rows = {r.custom_id: r for r in asked.collect()}
    assert len(rows) == 4 * 2 * 2 and {r.chunk_rows for r in rows.values()} == {25, 5}
    sent = {r.custom_id: r.body for r in spark.read.json(f"{folder}/requests").collect()}
    assert set(sent) == set(rows)
    for i, r in rows.items():
        prompt = sent[i].messages[-1].content
        assert f"Write {r.chunk_rows} new" in prompt and ("- one" in prompt) == (0 in r.seed_idx) and ("capability" in prompt) == (r.kind == "schema")
    whole = [r for r in rows.values() if r.n_seeds == 0]
    answers = [line(r.custom_id, f"```csv\nexample_text,k\nt{r.chunk}, more,a\n```" if r.kind == "schema" else f" b{r.chunk} \n\n") for r in whole]
    part = [r for r in rows.values() if r.n_seeds and r.chunk == 0][:1]
    answers += [line(part[0].custom_id, "x"), line("unknown", "x"), line([r for r in rows.values() if r.n_seeds and r.chunk == 1][0].custom_id, "x", 500)]
    (tmp_path / "results.jsonl").write_text("\n".join(answers) + "\n\n")
    texts, failures, raw = runs.collect(spark, folder, str(tmp_path / "results.jsonl"))
    got = {r.kind: r.text for r in texts.collect() if "_s0_" in r.stem}
    assert got["baseline"] == "b0\nb1"
    assert list(csv.reader(got["schema"].splitlines())) == [["example_text", "k"], ["t0, more", "a"], ["t1, more", "a"]]
    assert [r.examples for r in texts.collect() if r.kind == "schema"] == ["t0, more\nt1, more"] and raw.isEmpty()
    lost = {r.custom_id: r.error for r in failures.collect()}
    assert lost["unknown"] == "unknown id" and sorted(set(lost.values())) == ["no answer", "status 500", "unknown id"]
    assert len(lost) == len(rows) - len(whole) - 1 + 1
    cli.main(["collect", "--folder", folder, "--results", str(tmp_path / "results.jsonl")])
    assert len(glob.glob(f"{folder}/texts-*/kind=*/stem=*")) >= 2 and runs.summary(asked).count() == 4


def test_ablations_ask_for_plain_lines(spark, tmp_path):
    asked = runs.stage(spark, str(tmp_path / "run"), Schema.parse(DOC), [("p", "m")], 1, ablation=True)
    kinds = {(r.variant_id > 0, r.kind) for r in asked.collect()}
    assert kinds == {(False, "schema"), (False, "baseline"), (True, "schema")}
    assert all("Answer as CSV" not in r.body.messages[-1].content for r in spark.read.json(str(tmp_path / "run/requests")).collect() if "v000" not in r.custom_id)


def test_labels(spark, tmp_path, capsys):
    texts = tmp_path / "texts"
    texts.mkdir()
    (texts / "one.txt").write_text("first\n\n second \nthird\n")
    (texts / "two.txt").write_text("x\n")
    (texts / "two_labeled.csv").write_text("example_text,k\nx,a\n")
    (tmp_path / "v.json").write_text(json.dumps({"columns": {"k": ["a", "b"]}}))
    folder = str(tmp_path / "run")
    cli.main(["scan-labels", "--texts", str(texts)])
    assert capsys.readouterr().out.split() == ["one"]
    cli.main(["stage-labels", "--texts", str(texts), "--vocabulary", str(tmp_path / "v.json"), "--folder", folder])
    asked = runs.manifest(spark, folder).collect()
    assert [r.stem for r in asked] == ["one"]
    (tmp_path / "results.jsonl").write_text(line(asked[0].custom_id, "k\na\nb") + "\n")
    labels, failures, raw = runs.collect_labels(folder, str(tmp_path / "results.jsonl"), runs.read_texts(spark, str(texts)), ["k"])
    assert sorted((r.position, r.example_text, r.k) for r in labels.collect()) == [(0, "first", "a"), (1, "second", "b"), (2, "third", "")]
    assert failures.collect() == [] and [(r.stem, r.rows, r.expected) for r in raw.collect()] == [("one", 2, 3)]
    cli.main(["collect-labels", "--folder", folder, "--results", str(tmp_path / "results.jsonl"), "--texts", str(texts), "--vocabulary", str(tmp_path / "v.json")])
    first = runs.current(spark, folder, "labels")
    assert glob.glob(f"{first}/stem=one/*.csv")
    cli.main(["collect-labels", "--folder", folder, "--results", str(tmp_path / "results.jsonl"), "--texts", str(texts), "--vocabulary", str(tmp_path / "v.json")])
    assert runs.current(spark, folder, "labels") > first and glob.glob(f"{first}/stem=one/*.csv") and runs.current(spark, folder, "examples") is None


def test_files_that_cannot_be_put_together(spark, tmp_path):
    folder = str(tmp_path / "run")
    asked = runs.stage(spark, folder, Schema.parse(DOC), [("p", "m")], 1).collect()
    (tmp_path / "r.jsonl").write_text("\n".join(line(r.custom_id, "k,k\n1,2\n" if r.kind == "schema" else "one, two") for r in asked))
    texts, failures, raw = runs.collect(spark, folder, str(tmp_path / "r.jsonl"))
    assert [(r.kind, r.text) for r in texts.collect()] == [("baseline", "one,two")]
    assert [(r.kind, r.text) for r in raw.collect()] == [("schema", "k,k\n1,2\n")]
    assert [r.error for r in failures.collect()] == ["no rows in the answers"]


def test_only_and_done(spark, tmp_path):
    one = lambda **k: {(r.stem, r.kind) for r in runs.stage(spark, str(tmp_path / "-".join(["run", *k])), Schema.parse(DOC), [("p", "m")], 1, 2, **k).collect()}
    every = one()
    stem = sorted(every)[0][0]
    assert one(only=spark.createDataFrame([(f"x/{stem}.csv",)], "name string")) == {x for x in every if x[0] == stem}
    assert one(done=spark.createDataFrame([(stem, "schema")], "stem string, kind string")) == every - {(stem, "schema")}


def test_run_local_asks_again_for_missing_rows(spark, tmp_path):
    folder = str(tmp_path / "run")
    runs.stage(spark, folder, Schema.parse(DOC), [("p", "m")], 10, chunk=6)

    def short(body):
        """The stub, with at most 4 rows an answer, and nothing for a baseline."""
        text = runs.stub(body)
        return "\n".join(text.split("\n")[:5]) if "with the header" in body["messages"][-1]["content"] else None

    texts, failures, raw = runs.run_local(spark, folder, short, rounds=4)
    got = {r.kind: list(csv.reader(r.text.splitlines())) for r in texts.collect()}
    assert set(got) == {"schema"} and got["schema"][0] == ["example_text", "k"] and len(got["schema"]) == 11
    assert {r.error for r in failures.collect()} == {"no text"} and raw.isEmpty()
    cli.main(["collect-local", "--folder", folder])
    assert len(glob.glob(f"{folder}/texts-*/kind=*/stem=*")) == 2


def test_label_targets(spark, tmp_path):
    from assayer.sources.tables import label_targets

    for name in ("a.txt", "a_labeled.csv", "b.txt", "deep/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    with pytest.warns(UserWarning, match="no folder"):
        got = label_targets(spark, [str(tmp_path), str(tmp_path / "none")]).collect()
    assert {(r.txt.rsplit("/", 1)[1], r.exists) for r in got} == {("a.txt", True), ("b.txt", False), ("c.txt", False)}
    assert label_targets(spark, [str(tmp_path)], recursive=False).count() == 2


@pytest.mark.parametrize("text", ["{}", '{"columns": {}}', '{"columns": ["k"]}'])
def test_vocabulary_needs_columns(text):
    with pytest.raises(ValueError):
        runs.load_vocabulary(text)


def test_repair_command(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,example_text\n1,hello, world\n")
    cli.main(["repair", "--files", str(tmp_path / "a.csv"), "--out", str(tmp_path / "out")])
    assert "hello, world" in "".join(open(f).read() for f in glob.glob(f"{tmp_path}/out/file=a.csv/*.txt"))


def test_the_state_of_a_stream_is_a_native_aggregate(spark, tmp_path):
    """No call of Python per file; the best answer stays, also over batches."""
    folder, results = str(tmp_path / "run"), tmp_path / "results"
    results.mkdir()
    asked = runs.stage(spark, folder, Schema.parse(DOC), [("p", "m/1")], 25, 1, [0], 1).where("kind = 'baseline'").collect()
    for k, text in enumerate(("b", "longer", "c")):
        (results / f"part-{k}.jsonl").write_text(line(asked[0].custom_id, text) + "\n")
        query = runs.follow(spark, folder, str(results))
        query.awaitTermination()
        assert [o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]] == ["stateStoreSave"]
    got = spark.read.parquet(f"{folder}/stream/given").where(f"stem = '{asked[0].stem}'").orderBy("batch").collect()
    assert [r.text for r in got] == ["b", "longer", "longer"]


def test_a_stream_collects_what_a_batch_does(spark, tmp_path):
    """Answers in several files, in any order, repeated, bettered, failed and unknown: after each file the stream has what a batch has."""
    r = random.Random(4)
    folder, results = str(tmp_path / "run"), tmp_path / "results"
    results.mkdir()
    asked = runs.stage(spark, folder, Schema.parse(DOC), [("p", "m/1")], 60, 1, [0, 1], 3).collect()
    said = [line(q.custom_id, f"example_text,k\nt{q.chunk},a" if q.kind == "schema" else f"b{q.chunk}") for q in asked[:-2]]
    better = [line(q.custom_id, f"example_text,k\nlonger {q.chunk},a\nx,b" if q.kind == "schema" else f"b{q.chunk}\nmore") for q in asked[:4]]
    bad = [line(asked[0].custom_id, "x", 500), line(asked[-2].custom_id, "x", 500), line("unknown", "x"), line("other", "x", 500), line(asked[5].custom_id, "   ")]
    lines = [*said, *r.sample(said, 5), *better, *bad]
    r.shuffle(lines)
    given = set()
    for k in range(3):
        (results / f"part-{k}.jsonl").write_text("\n".join(lines[k::3]) + "\n")
        got = runs.collect_stream(spark, folder, str(results))
        want = runs.collect(spark, folder, str(results))
        rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
        assert rows(got.texts.select("stem", "kind", "text", "examples")) == rows(want.texts.select("stem", "kind", "text", "examples"))
        assert rows(got.failures.select("custom_id", "error")) == rows(want.failures.select("custom_id", "error")) and rows(got.raw) == rows(want.raw)
        given |= {(q.stem, q.kind) for q in got.texts.collect()}
    assert len(given) > 1
    # A call without new files reads none and says the same.
    assert rows(runs.collect_stream(spark, folder, str(results)).texts) == rows(got.texts) and len(glob.glob(f"{folder}/stream/progress/batch=*")) == 3
    cli.main(["collect", "--stream", "--folder", folder, "--results", str(results)])
    assert len(glob.glob(f"{folder}/texts-*/kind=*/stem=*")) == len(given)


def test_label_answers_that_are_no_table(spark, tmp_path):
    """They are kept as they came, and their files stay without labels, so that they are asked for again."""
    folder = str(tmp_path / "run")
    files = spark.createDataFrame([("none", "a\nb"), ("odd", "a"), ("good", "a"), ("more", "a")], "stem string, text string")
    asked = {r.stem: r.custom_id for r in runs.stage_labels(files, files.where("false"), {"k": ["x"]}, folder).collect()}
    said = {"none": "``` \n\n```", "odd": 'x"y\nz"w', "good": "k\nx", "more": "k\nx\ny"}
    (tmp_path / "r.jsonl").write_text("\n".join(line(asked[s], t) for s, t in said.items()))
    got = runs.collect_labels(folder, str(tmp_path / "r.jsonl"), files, ["k"])
    assert sorted((r.stem, r.k) for r in got.labels.collect()) == [("good", "x"), ("more", "x"), ("odd", 'x"y')]
    assert {r.stem: (r.rows, r.expected) for r in got.raw.collect()} == {"none": (0, 2), "more": (2, 1), "odd": (2, 1)}
    assert {(r.custom_id, r.error) for r in got.failures.collect()} == {(asked["none"], "no labels in the answer")}


def test_results_in_both_forms(spark, tmp_path):
    """A response with a status code, or a result with a type: texts, and why there is none."""
    message = lambda *texts: {"content": [{"type": "text", "text": t} for t in texts]}
    results = {
        "a": {"response": {"status_code": 200, "body": {"output_text": "A"}}},
        "b": {"result": {"type": "succeeded", "message": message("B", "b")}},
        "c": {"result": {"type": "succeeded", "message": message()}},
        "d": {"result": {"type": "errored", "error": {"type": "overloaded"}}},
        "e": {"result": {"type": "expired"}},
        "f": {"result": {"type": "canceled"}},
        "g": {"response": {"status_code": 429, "body": {}}, "error": {"code": "slow"}},
        "h": {"response": {"status_code": 200, "body": {"output": [{"content": [{"type": "output_text", "text": "H"}]}]}}},
    }
    folder, path = str(tmp_path / "run"), tmp_path / "results"
    path.mkdir()
    rows = [(i, f"s{i}", "baseline", 0, 0, "p", "m") for i in [*results, "z"]]
    spark.createDataFrame(rows, "custom_id string, stem string, kind string, chunk int, variant_id int, provider string, model string").write.json(f"{folder}/manifest")
    (path / "one.jsonl").write_text("\n".join(json.dumps({"custom_id": i, **r}) for i, r in results.items()))
    batch, stream = runs.collect(spark, folder, str(path)), runs.collect_stream(spark, folder, str(path))
    for got in (batch, stream):
        assert {r.stem: r.text for r in got.texts.collect()} == {"sa": "A", "sb": "Bb", "sh": "H"}
        why = {"c": "no text", "d": 'errored: {"type":"overloaded"}', "e": "expired", "f": "canceled", "g": 'status 429: {"code":"slow"}', "z": "no answer"}
        assert {r.custom_id: r.error for r in got.failures.collect()} == why
    assert [tuple(r) for r in runs.status(spark, folder, str(path)).collect()] == [("p", "m", "baseline", 9, 3, 5, 1)]


def test_payloads(spark, tmp_path):
    folder = str(tmp_path / "run")
    runs.stage(spark, folder, Schema.parse(DOC), [("p", "m/1"), ("q", "n")], 3, domain="In a town.")
    with pytest.raises(ValueError, match="q"):
        runs.write_payloads(spark, folder, {"p": "responses"})
    runs.write_payloads(spark, folder, {"p": "responses", "q": "messages"})
    lines = lambda provider: [json.loads(r.value) for r in spark.read.text(f"{folder}/payloads/provider={provider}").collect()]
    sent = {r.custom_id: r.body for r in spark.read.json(f"{folder}/requests").collect()}
    for x in lines("p"):
        body, asked = x["body"], sent[x["custom_id"]]
        assert (x["method"], x["url"], body["model"], body["max_output_tokens"]) == ("POST", "/v1/responses", "m/1", asked.max_tokens)
        assert [(m["role"], m["content"]) for m in body["input"]] == [(m.role, m.content) for m in asked.messages]
    for x in lines("q"):
        params, asked = x["params"], sent[x["custom_id"]]
        assert (params["model"], params["max_tokens"], params["system"]) == ("n", asked.max_tokens, asked.messages[0].content)
        assert [(m["role"], m["content"]) for m in params["messages"]] == [("user", asked.messages[1].content)] and params["system"].endswith("In a town.")
    assert len(lines("p")) == len(lines("q")) == 2
    labels = str(tmp_path / "labels")
    runs.stage_labels(spark.createDataFrame([("s", "a")], "stem string, text string"), spark.createDataFrame([], "stem string"), {"k": ["x"]}, labels)
    runs.write_payloads(spark, labels, {"any": "messages"}, "m")
    (row,) = [json.loads(r.value)["params"] for r in spark.read.text(f"{labels}/payloads/provider=any").collect()]
    assert "system" not in row and (row["model"], row["temperature"]) == ("m", 0)


def test_a_batch_is_collected_when_it_is_done(spark, tmp_path, capsys):
    args = lambda name: ["collect", "--folder", str(tmp_path), "--results", str(tmp_path), "--status", str(tmp_path / name)]
    (tmp_path / "open.json").write_text('{"status": "in_progress"}')
    (tmp_path / "bad.json").write_text('{\n"processing_status": "Expired"}')
    cli.main(args("open.json"))
    assert "not complete" in capsys.readouterr().out
    with pytest.raises(SystemExit, match="failed"):
        cli.main(args("bad.json"))
    assert [W.batch_state(json.dumps(d)) for d in ({"status": "completed"}, {"processing_status": "ended"}, {}, {"status": "cancelled"})] == ["done", "done", "open", "failed"]


def test_system_message_has_the_parts_that_are_there(spark):
    doc = {"fixedFields": {"capability": "c", "deploymentPopulation": "p"}, "constituents": {"k": {"value": ["a"]}}, "seedExamples": ["s"]}
    whole = runs.system_message(doc).split("\n")
    assert [x.split(":")[0] for x in whole[2:5]] == ["capability", "deploymentPopulation", "constituents"] and whole[5] == runs.SEEDS_NOTE
    rows = {r.variant_id: r for r in runs.variant_table(spark, Schema.parse(doc), True).collect()}
    assert rows[0].system == "\n".join(whole)
    for r in rows.values():
        assert ("capability:" in r.system) == ("capability" not in r.missing_fixed) and ("constituents:" in r.system) == (r.missing_constituents == "") and (runs.SEEDS_NOTE in r.system) == (not r.missing_seeds)
    assert runs.system_message({}) == runs.SYSTEM
