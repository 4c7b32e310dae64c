"""Sharding, spelling variants and alignment against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayer.llm import alignment, queries, sharding, spelling

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
D = "/root/testdata/sf0.001"


def docs(spark, rows):
    """With columns that the operators have names for inside."""
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, row int, shard string, slot int").repartition(3)


# ---- sharding


def check_shards(rows, out, shards):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=repr) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    slots = collections.defaultdict(list)
    for r in out:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


@pytest.mark.parametrize("bucket_bytes", [200, 1 << 20])
def test_shards(spark, bucket_bytes):
    rows = [(i, f"text {i}") for i in range(90)] + [(None, None)] * 20 + [(7, "same")] * 60 + [(8, ""), (9, "long " * 400), (10, "ünï")]
    check_shards(rows, sharding.digests(docs(spark, rows), sharding.Setup(bucket_bytes=bucket_bytes)).collect(), 16)


def test_shards_of_few_and_no_rows(spark):
    check_shards([(1, "a"), (2, None)], sharding.digests(docs(spark, [(1, "a"), (2, None)])).collect(), 16)
    assert sharding.digests(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        sharding.shuffled(docs(spark, []), sharding.Setup(bucket_bytes=0))


def test_shards_are_written_in_order_whatever_the_splits(spark, tmp_path):
    rows = [(i, f"t{i} " * (i % 30)) for i in range(400)]
    docs(spark, rows).coalesce(1).write.parquet(str(tmp_path / "d"))
    setup = sharding.Setup(shards=5, bucket_bytes=4_000)
    first = sharding.shuffled(spark.read.parquet(str(tmp_path / "d")), setup, str(tmp_path / "one"))
    second = sharding.shuffled(spark.read.parquet(str(tmp_path / "d")).repartition(1).select("*"), setup)
    assert first.select("row.*").columns == ["doc_id", "text", "row", "shard", "slot"]
    place = lambda df: {r.doc_id: (r.shard, r.slot) for r in df.select("row.doc_id", "shard", "slot").collect()}
    once = place(first)
    assert place(sharding.shuffled(spark.read.parquet(str(tmp_path / "d")), setup)) == once
    assert place(second).keys() == once.keys()
    assert place(sharding.shuffled(spark.read.parquet(str(tmp_path / "d")), sharding.Setup(shards=5, bucket_bytes=4_000, seed=8))) != once
    assert sorted(p.name for p in (tmp_path / "one").glob("shard=*")) == [f"shard={i}" for i in range(5)]
    for file in (tmp_path / "one").glob("shard=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(file)).select("slot").collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots)))


def test_fisher_yates_is_uniform():
    seen = collections.Counter(tuple(sharding.fisher_yates(4, np.random.default_rng(i)).tolist()) for i in range(24_000))
    assert len(seen) == 24 and max(abs(n - 1_000) for n in seen.values()) < 160
    assert sharding.fisher_yates(0, np.random.default_rng(1)).tolist() == [] and sharding.fisher_yates(1, np.random.default_rng(1)).tolist() == [0]


# ---- spelling variants


def plain_variants(rows):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    letters = {c for w in words for c in w}
    forms, near_counts = {}, {}
    for w in words:
        near = {w[:k] + w[k + 1 :] for k in range(len(w))}
        near |= {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters}
        near = [x for x in near - {w} if x in words]
        near_counts[w] = len(near)
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n, near_counts[w], forms[w] and words[forms[w]]))
    return out


def got_variants(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


@pytest.mark.parametrize("trie_bytes", [100, 4_000, 1 << 20])
def test_spelling_variants(spark, trie_bytes):
    r = random.Random(4)
    stems = ["lantern", "lanterne", "lanternes", "aaaaaa", "aaaaaaa", "aabaaa", "größer", "grösser", "ÿÿÿÿÿÿ", "ÿÿÿÿÿ×", "Éclairs", "éclairs", "x" * 300, "x" * 299 + "y"]
    stems += ["".join(r.choice("abc") for _ in range(r.randint(6, 8))) for _ in range(60)]
    rows = [(i, " ".join(r.choices(stems, [1 / (k + 1) for k in range(len(stems))], k=200))) for i in range(60)]
    rows += [(None, "lantern LANTERN lan-tern " * 30), (None, None), (5, ""), (6, "aaaaaa," * 900), (6, "aaaaaa," * 900), (7, "日本lantern日本"), (8, "lanter " * 6)]
    # A chain of forms.
    rows += [(100 + i, "chainx " * 3125 + "chainxx " * 625 + "chainxxx " * 125 + "chainxxxx " * 25 + "chainxxxxx " * 5) for i in range(2)]
    got = got_variants(spelling.variants(docs(spark, rows), spelling.Setup(trie_bytes=trie_bytes, round_bytes=3 * trie_bytes, waiting=50)))
    assert len(got) == len(set(got)) and set(got) == plain_variants(rows)
    assert {w: x for w, _, x, *_ in got}["chainxxxxx"] == "chainx"


def test_spelling_variants_of_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert set(got_variants(queries.op12_spelling_variants(spark, "/root/testdata/sf0.01"))) == plain_variants([(x.doc_id, x.text) for x in table.collect()])


def test_no_spelling_variants(spark):
    assert spelling.variants(docs(spark, [])).collect() == []
    assert spelling.variants(docs(spark, [(1, "a few words"), (2, None)])).collect() == []


def test_automaton_finds_what_edits_make():
    words = sorted({bytes(x) for n in range(1, 6) for x in np.ndindex(*[2] * n)} | {b"\1" * 40, b"\1" * 39 + b"\0"})
    words = [bytes(c + 97 for c in w) for w in words]
    trie = spelling.Trie.unpacked(*spelling.Trie.of(sorted(words), list(range(1, len(words) + 1))).packed())
    assert len(trie.n) <= 2 * len(words)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    for w in words:
        assert sorted(trie.neighbours(w)) == sorted((x, i + 1) for i, x in enumerate(sorted(words)) if near(w, x))


# ---- alignment


def plain_alignment(rows):
    by_a, by_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    by_a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}

    def b_bytes(piece):
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    found, counts = [], collections.Counter()
    for i, t in rows:
        one = []
        if t:
            a = by_a.encode(" " + t, add_special_tokens=False).ids
            b = by_b.encode(t)
            ta = [bytes(shown[c] for c in by_a.id_to_token(x)) for x in a]
            tb = [b_bytes(by_b.id_to_piece(x)) for x in b]
            if b"".join(ta) == b"".join(tb) == (" " + t).encode():
                ends_a, ends_b = np.cumsum(list(map(len, ta))).tolist(), np.cumsum(list(map(len, tb))).tolist()
                i0 = j0 = 0
                for e in sorted(set(ends_a) & set(ends_b)):
                    i1, j1 = ends_a.index(e, i0) + 1, ends_b.index(e, j0) + 1
                    one.append((a[i0:i1], b[j0:j1]))
                    i0, j0 = i1, j1
        found.append((i, one))
        counts.update((x[-1], y[-1]) for x, y in one)
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for i, one in found:
        pairs = [(x[-1], y[-1]) for x, y in one]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in one)
        out.append((i, sum(len(x) for x, _ in one), sum(len(y) for _, y in one), len(one), len(one), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if one else ""))
    return sorted(out, key=repr)


TEXTS = [
    "plain words, and 12,345 more!", " lead", "trail ", "  two  spaces   three ", " ", "  ", "\n", "tab\tand\r\nline\n\n", "naïve façade — “quoted”", "日本語のテキスト", "emoji 😀👩‍👩‍👧 end", "é combining",
    "<s> </s> <unk> <0x41> <|endoftext|>", "a▁b", "▁", "\x00\x01 control", "ﬁ ligature ² ½", "עברית العربية", "x" * 700, "ab " * 900, " nbsp　wide", "don't I'LL we're", "", None, "A", "�",
]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_alignment(spark, monkeypatch, most):
    monkeypatch.setattr(alignment, "MOST_PAIRS", most)
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (3, TEXTS[0]), (None, TEXTS[0]), (None, None)]
    got = alignment.align(docs(spark, rows), A, B)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_alignment(rows)


def test_alignment_of_documents(spark):
    table = spark.read.parquet(f"{D}/documents.parquet")
    got = queries.op13_tokenizer_alignment(spark, D)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_alignment([(x.doc_id, x.text) for x in table.collect()])
    assert alignment.align(table.where("false"), A, B).collect() == []


def test_stretches_are_encoded_as_in_the_text():
    r = random.Random(2)
    pieces, pool = alignment.Pieces(B), [" ", " ", "  ", "a", "the", "\n", "é", "日", "😀", "\t", "-", "0", "▁", "ing", "\x00"]
    assert pieces.apart
    for _ in range(3_000):
        text = "".join(r.choices(pool, k=r.randint(1, 30)))
        assert pieces.encode(text).tolist() == pieces.model.encode(text), repr(text)
