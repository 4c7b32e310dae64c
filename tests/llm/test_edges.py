"""Nulls, repeated rows, clashing names, long texts and hot groups in the operators that pipelines put rows through."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

from assayer.llm import bpe, counts, exact, media, neardup, packing, quality, substring

RANKS, VOCABULARY = (public_tokenizers.path(f"byte_bpe_50k.{k}") for k in ("tiktoken", "json"))

#: Names that the operators use inside.
NAMES = ["_sha", "_n", "row", "text_key", "tag", "_new", "new", "sha", "digest", "keep_id", "keep_sha", "body", "kept", "_row", "_digest", "a.b"]


def frame(spark, rows):
    """rows(doc_id, text) with columns of clashing names and one of a type without an order."""
    names = ", ".join(f"`{n}` int" for n in NAMES)
    df = spark.createDataFrame([(i, t, *range(len(NAMES)), {"k": k}) for k, (i, t) in enumerate(rows)], f"doc_id long, text string, {names}, m map<string, int>")
    return df.repartition(3)


def content(rows):
    return sorted(((r.doc_id, r.text, *(r[n] for n in NAMES)) for r in rows), key=repr)


ROWS = [(1, "one two"), (1, "one two"), (2, "one two"), (None, "one two"), (None, "alone"), (None, "alone"), (3, None), (4, ""), (5, "x"), (5, "y")]


def stored(spark, df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


@pytest.mark.parametrize("from_files", [True, False])
@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_dedup(spark, tmp_path, from_files, digest):
    df = frame(spark, ROWS)
    df = stored(spark, df, tmp_path, "d") if from_files else df
    same = collections.defaultdict(list)
    for i, t in ROWS:
        same[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in same.items()}
    want = [(i, keep[t or ""], len(same[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS]
    found = exact.exact_dedup(df, digest)
    assert sorted((tuple(r)[:5] for r in found.collect()), key=repr) == sorted(want, key=repr)
    places = {(r.locator.file, r.locator.place) for r in found.collect()} if from_files else None
    assert places is None or len(places) == len(ROWS)
    kept = exact.kept_rows(df)
    assert kept.columns == df.columns
    assert content(kept.collect()) == sorted(((i, t, *range(len(NAMES))) for i, t in [(2, "one two"), (None, "alone"), (4, ""), (5, "x"), (5, "y")]), key=repr)


def test_near_dedup_keeps_all_columns(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(10**6)}" for _ in range(80)]
    near = " ".join([*words[:40], "other", *words[41:]])
    rows = [(7, " ".join(words)), (9, near), (None, near), (None, "q w e r t y"), (None, "q w e r t y"), (None, None), (None, ""), (3, None), (8, "z " * 5)]
    kept = neardup.kept_rows(frame(spark, rows))
    assert content(kept.collect()) == sorted(((i, t, *range(len(NAMES))) for i, t in [rows[0], rows[3], rows[5], rows[6], rows[7], rows[8]]), key=repr)


def test_substring_dedup_keeps_all_columns(spark):
    base = [f"w{i}" for i in range(300)]
    text = lambda *w: " ".join(w)
    rows = [(1, text(*base[:90])), (2, text("a", *base[10:80], "b")), (2, text("a", *base[10:80], "b")), (3, text(*base[:90])), (None, text(*base[200:260])), (4, text(*base[200:261])), (5, None), (6, "")]
    want = [rows[0], (2, "a b"), (2, "a b"), (3, ""), rows[4], (4, "w260"), rows[6], rows[7]]
    assert content(substring.kept_texts(frame(spark, rows)).collect()) == sorted(((i, t, *range(len(NAMES))) for i, t in want), key=repr)


def test_quality_keeps_all_columns(spark):
    rows = [(i, "plain good words here and there " * 9 if i % 2 else "!!BUY " * 30) for i in range(60)] + [(None, None), (1, rows_text := "plain good words here and there " * 9), (1, rows_text)]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    machine = quality.train(df, labels, quality.Setup(epochs=10))
    kept = quality.kept_rows(df, machine)
    assert kept.columns == df.columns
    assert content(kept.where("doc_id is not null").collect()) == sorted(((i, t, *range(len(NAMES))) for i, t in rows if i is not None and "good" in t), key=repr)
    assert quality.score(df, machine).count() == len(rows)


def test_a_passage_of_many_documents(spark):
    """A passage that many documents share, with a window of one word over and over, and copies of whole documents."""
    r = random.Random(11)
    base = [f"p{r.randrange(10**6)}" for _ in range(75)]
    own = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    docs = [own(r.randrange(30)) + base[r.randrange(10) : 75 - r.randrange(10)] + own(r.randrange(40)) for _ in range(150)]
    docs += [own(5) + ["x"] * r.randrange(40, 200) + own(5) + ["x"] * 60 for _ in range(20)]
    docs += [docs[3], docs[3], docs[160]]
    rows = list(enumerate(docs))
    r.shuffle(rows)
    first = {}
    for i, w in sorted(rows):
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    want = {}
    for i, w in rows:
        gone = {k for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for k in range(j, j + 50)}
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring.substring_dedup(df).collect()} == want


def test_texts_longer_than_a_portion(spark):
    """Texts of 3 and 9 MB, beyond what operators take at a time, beside short ones."""
    r = random.Random(12)
    words = [f"word{i}" for i in range(5000)]
    long = " ".join(r.choice(words) for _ in range(330_000))
    longest = " ".join(r.choice(words) for _ in range(1_000_000))
    rows = [(1, "a b c"), (2, long), (3, longest), (4, "x " + long), (5, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substring.substring_dedup(df).collect()}
    assert got == {1: (3, 0), 2: (330_000, 0), 3: (1_000_000, 0), 4: (330_001, 330_000), 5: (4, 0)}
    near = {x.doc_id: x.component_id for x in neardup.near_duplicates(df, 2).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 4: 2, 5: 5}
    by = bpe.codec(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken"))
    ids = {x.doc_id: x.n_tokens for x in bpe.encode_decode(df, __import__("public_tokenizers").path("byte_bpe_50k.tiktoken")).collect()}
    assert ids == {i: len(by.bpe.encode_ordinary(t)) for i, t in rows}


def test_null_ids_repeated_rows_and_texts_longer_than_a_portion(spark):
    """Operators that treat each row for itself: rows of a null id and repeated rows stay apart, and a long text is a row as any other."""
    long = "a long text, of words. " * 400_000
    rows = [(1, "one text"), (1, "one text"), (None, "no id"), (None, "no id"), (None, None), (2, ""), (3, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(RANKS), special_tokens={})
    ids = {t: plain.encode_ordinary(t or "") for t in {t for _, t in rows}}
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.encode_decode(docs, RANKS).collect()), key=repr)
    assert got == sorted(((i, len(ids[t]), hashlib.sha256(np.array(ids[t], "<u4").tobytes()).hexdigest()) for i, t in rows), key=repr)
    got = sorted(((r.doc_id, r.n_bytes, r.payload_sha256) for r in media.text_media(docs).collect()), key=repr)
    assert got == sorted(((i, len((t or "").encode()), hashlib.sha256(media.padded((t or "").encode())).hexdigest()) for i, t in rows), key=repr)
    got = sorted(((r.doc_id, r.n_tokens) for r in counts.count_with_edits(docs, RANKS).collect()), key=repr)
    assert got == sorted(((i, len(ids[t])) for i, t in rows), key=repr)
    got = packing.pack(docs, VOCABULARY).groupBy("doc_id").agg(F.sum("length").alias("n"), F.count(F.when(F.col("piece") == 0, 1)).alias("rows")).collect()
    want = {i: (sum(len(ids[t]) + 1 for j, t in rows if i == j), sum(i == j for j, _ in rows)) for i, _ in rows}
    assert {r.doc_id: (r.n, r.rows) for r in got} == want
