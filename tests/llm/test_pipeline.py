"""The pipeline against its stages written plainly, on a small corpus with copies, near copies, shared passages and junk."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from assayer.llm import quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    r = random.Random(8)
    words = [a + b for a in "ba ke lo mi nu ru so ti".split() for b in "dan fel gor his jal".split()]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    shared = prose(70)
    out = [" ".join(prose(r.randrange(80, 160))) for _ in range(60)]
    out += [" ".join([*prose(30), *shared, *prose(30)]) for _ in range(6)]
    out += out[:8] + ["junk!! " * r.randrange(20, 60) + f"x{i}" for i in range(60)]
    for i in range(20, 26):
        near = out[i].split()
        out.append(" ".join([*near[:40], "another", *near[41:]]))
    return [(i, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in enumerate([*out, None, ""])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int("junk" not in (t or "junk")), 0) for i, t, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def similar(a, b):
    both = len(a & b)
    return both and 100 * both >= 80 * len(a | b)


def shingles(text, width=2):
    w = text.encode().lower().split()
    return {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def plainly(texts):
    """texts {doc_id: text} through exact, near and substring dedup."""
    last = {t: i for i, t in sorted(texts.items())}
    texts = {i: t for i, t in texts.items() if last[t] == i}
    sets, comp = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    links = [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])]
    for _ in sets:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    texts = {i: t for i, t in texts.items() if comp[i] == i}
    seen, out = {}, {}
    words = {i: t.encode().split() for i, t in texts.items()}
    for i in sorted(words):
        for j in range(len(words[i]) - 49):
            seen.setdefault(tuple(words[i][j : j + 50]), i)
    for i, w in words.items():
        gone = {k for j in range(len(w) - 49) if seen[tuple(w[j : j + 50])] < i for k in range(j, j + 50)}
        out[i] = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else texts[i]
    return out


def test_pipeline(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    machine = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    accepted = {r.doc_id for r in quality.score(docs, machine).where("predicted = 1").collect()}
    clean = {i for i, t, *_ in corpus() if t and "junk" not in t}
    assert clean <= accepted and not any("junk" in (t or "") for i, t, *_ in corpus() if i in accepted)
    want = plainly({i: t or "" for i, t, *_ in corpus() if i in accepted})
    assert len(want) < len(accepted)

    rows, by = corpus_pipeline.run(spark, folder).collect(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id for r in rows} == set(want)
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for i, t in want.items():
        ids = np.array([*by.encode(t, add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in pieces) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)


def test_stages_of_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []
