"""The ten operators against brute-force versions on small tables with nulls, empty and repeated texts and extra columns."""

import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from assayer.llm import bpe, chat, counts, exact, lm, media, neardup, packing, quality, substring

RANKS, VOCABULARY = (public_tokenizers.path(f"byte_bpe_50k.{k}") for k in ("tiktoken", "json"))
SCHEMA = "doc_id long, text string, n long, row string, key binary"


def texts():
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta", "epsilon", "zeta.", "eta", "ñu", "the", "of"]
    base = [r.choice(words) + str(r.randrange(40)) for _ in range(260)]
    out = [None, "", " \n\t", "one", "a b", "a b", "a" * 5000, "x " * 3000, "</s> <|endoftext|> \x1c ½"]
    for _ in range(40):
        a = r.randrange(200)
        w = base[a : a + r.randrange(10, 60)]
        out.append(" ".join(w + [r.choice(words) for _ in range(r.randrange(5))] + base[: r.randrange(60)]))
    near = base[:80]
    out += [" ".join([*near[:i], "new", *near[i + 1 :]]) for i in range(0, 80, 9)] + [out[20], out[20]]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "r", b"k") for i, t in texts()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def body(t):
    return (t or "").encode()


def test_language_model(docs, empty):
    got = {r.doc_id: r for r in lm.score(docs, setup=lm.Setup(head=50, rounds=3)).collect()}
    c = collections.Counter()
    tokens = {i: [*body(t).lower().split(), b" "] for i, t in texts()}
    for i, ws in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * len(ws)
        assert r.score < 0
    assert lm.score(empty).collect() == []


def plain_scores(rows, setup):
    """{doc_id: score}: the model written out: dense features, a loop over contexts, the same updates."""
    words = lm.Words(setup)
    tokens = {i: [lm.START, lm.START, *(words[w] for w in body(t).lower().split()), lm.END] for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    unigram = collections.Counter(w for i in train for w in tokens[i][2:])

    def factor(choice, outer, inner, buckets, pairs):
        code = lambda a, b: (words.buckets[b] % buckets, words.buckets[a] % buckets)
        seen = collections.Counter((code(a, b), choice(w)) for i in train for a, b, w in zip(tokens[i], tokens[i][1:], tokens[i][2:], strict=False))
        total = np.zeros(outer * inner)
        for (_, k), n in seen.items():
            total[k] += n
        of = total.reshape(outer, inner) + 0.5
        bias, w = np.log(of / of.sum(1, keepdims=True)).ravel(), np.zeros((2 * buckets + pairs, outer * inner))
        active = lambda c: (c[0], buckets + c[1], 2 * buckets + ((c[0] * buckets + c[1]) * 2654435761 >> 7) % pairs)

        def probs(c):
            z = np.exp(bias + sum(w[f] for f in active(c))).reshape(outer, inner)
            return (z / z.sum(1, keepdims=True)).ravel()

        for _ in range(setup.rounds):
            grad, mass = np.zeros_like(w), np.zeros_like(w)
            for c in {c for c, _ in seen}:
                here = np.array([seen.get((c, k), 0) for k in range(outer * inner)], float)
                expected = (probs(c).reshape(outer, inner) * here.reshape(outer, inner).sum(1, keepdims=True)).ravel()
                for f in active(c):
                    grad[f] += here - expected
                    mass[f] += expected
            w += setup.rate * np.clip((grad - setup.prior * w) / (mass + setup.prior), -1.5, 1.5)
        return lambda a, b, x: np.log10(probs(code(a, b))[choice(x)])

    first = factor(lambda w: words.classes[w], 1, setup.classes, setup.buckets, setup.pairs)
    second = factor(lambda w: words.groups[w], setup.classes, setup.groups, setup.near, setup.near_pairs)
    total, size = collections.Counter(), collections.Counter()
    for w, n in unigram.items():
        total[words.groups[w]] += n
        size[words.groups[w]] += 1
    word = lambda w: np.log10((unigram[w] + 1) / (total[words.groups[w]] + size[words.groups[w]] + 1))
    return {i: sum(first(a, b, w) + second(a, b, w) + word(w) for a, b, w in zip(t, t[1:], t[2:], strict=False)) for i, t in tokens.items()}


def test_scores_of_the_language_model(docs):
    setup = lm.Setup(classes=5, buckets=6, pairs=7, groups=3, near=4, near_pairs=5, rounds=3, head=40)
    rows = [(i, t) for i, t in texts() if len(t or "") < 400]
    want = plain_scores(rows, setup)
    got = {r.doc_id: r.score for r in lm.score(docs.where(F.coalesce(F.length("text"), F.lit(0)) < 400), setup=setup).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 * max(1, abs(want[i])) for i in want)


def test_probabilities_sum_to_one():
    for outer, n in ((1, 64), (8, 64)):
        m = lm.Factor(np.arange(n), outer, 16, 32)
        m.weights += np.random.default_rng(0).normal(size=m.weights.shape)
        assert np.allclose(np.exp(m.log_probs(np.arange(256))).reshape(256, outer, -1).sum(2), 1)


def test_language_model_of_held_out_rows(spark):
    """On the given tables: most documents that were not learnt from are likelier under the model than under the base."""
    rows = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score > r.base_score for r in rows) > 0.8 * len(rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_bpe(docs, empty):
    by, r = bpe.codec(RANKS), random.Random(1)
    some = list("ab'sl  \n\t.1²½é中  \x1c_!9tß😀")
    for _ in range(300):
        x = "".join(r.choice(some) for _ in range(r.randrange(90)))
        for leaf in (1, 7, 30):
            ids = bpe.Tree(by, x, leaf).encode()
            assert ids.tolist() == by.bpe.encode_ordinary(x)
            assert bpe.decode_tree(by, ids, 3).decode() == x
    got = {x.doc_id: x for x in bpe.encode_decode(docs, RANKS, leaf=64).collect()}
    for i, t in texts():
        ids = np.array(by.bpe.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(body(t)).hexdigest())
    assert bpe.encode_decode(empty, RANKS).collect() == []


def test_media(docs, empty):
    got = {r.doc_id: r for r in media.text_media(docs).collect()}
    for i, t in texts():
        samples = np.frombuffer(media.padded(body(t)), np.uint8).reshape(-1, 576).astype(float)
        assert got[i].feature.startswith(f"mean={samples.mean():.4f};std={samples.std():.4f};left={samples[:, :64].mean():.4f};dhash=")
        assert (got[i].n_segments, got[i].position, got[i].caption) == (1 + bool((t or "").strip()), bool((t or "").strip()), f"bytes of a text, {len(body(t))}")
        p = media.padded(body(t))
        assert len(p) % 576 == 0 and len(p) and p.startswith(body(t))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body(t)), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[4].feature == got[5].feature and media.text_media(empty).collect() == []
    seq = media.segments('<p>a<b>b</b></p><figure><img src="sha256:d" alt="x"><figcaption>cap</figcaption></figure>tail<script>no</script>')
    assert [(s["kind"], s["text"], s["digest"], s["caption"]) for s in seq] == [("text", "ab", None, None), ("media", None, "d", "cap"), ("text", "tail", None, None)]


def test_malformed_pages():
    short = lambda page: [(s["kind"][0], s["text"] or s["digest"], s["caption"]) for s in media.segments(page)]
    img = lambda d: f'<img src="sha256:{d}" alt="alt {d}">'
    for page, want in {
        "<![foo bar]>a<![CDATA[x]]>b": [("t", "ab", None)],
        "a<![": [("t", "a<![", None)],
        f"<figure><figcaption>before</figcaption>{img(1)}{img(2)}</figure>z": [("m", "1", "before"), ("m", "2", "before"), ("t", "z", None)],
        f"<figure>{img(1)}<figcaption>open<p>more</figure><p>rest": [("m", "1", "open more"), ("t", "rest", None)],
        f"<figure>{img(1)}<figcaption>open<h2>head</h2><p>rest": [("m", "1", "open"), ("t", "head", None), ("t", "rest", None)],
        f"<figure>{img(1)}<figure>{img(2)}<figcaption>in</figcaption></figure><figure>{img(3)}</figure><figcaption>out</figcaption></figure>": [("m", "1", "out"), ("m", "2", "in"), ("m", "3", "out")],
        "<figure><figcaption>no media</figcaption></figure>": [("t", "no media", None)],
        "x<figcaption>no figure</figcaption>y": [("t", "x", None), ("t", "no figure", None), ("t", "y", None)],
        f"<figure>{img(1)}": [("m", "1", "alt 1")],
        "<p>a<script>b": [("t", "a", None)],
        "</figure></p></figcaption>a<img><img src=''>": [("t", "a", None)],
        "a<b": [("t", "a<b", None)],
    }.items():
        assert short(page) == want, page


def test_unclosed_and_lazy_elements():
    short = lambda page: [s["text"] or s["digest"] for s in media.segments(page)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for page, want in {
        "<noscript>a<p>b</p>": ["a", "b"],
        "<div><template>a</div>b<p>c<template>d</template>": ["b", "c"],
        "<noscript>a<p>b</p></noscript>c": ["c"],
        "<img src=a><noscript><img src=a><img src=b></noscript>": [sha("a"), sha("b")],
        "<template><img src=a></template>x": ["x"],
        "<picture><source srcset='u.jpg 1x, v.jpg 2x'></picture><img data-src=w>": [sha("u.jpg"), sha("w")],
        "<!DOCTYPE [<p>x": ["x"],
        "a<!--b<p>c": ["ab", "c"],
        '<p title="x>y">z</p>': ["z"],
        "<p title=\"x>y</p>": ["y"],
        "<script>if(a<b)'</p>'</script>t": ["t"],
        "1 < 2 &lt; 3": ["1 < 2 < 3"],
    }.items():
        assert short(page) == want, page


@pytest.mark.parametrize("page", ['<img src="' * 100_000, "<a " * 333_000, "<!--" * 250_000, "<a " * 333_000 + "x='>", '<p title="' * 100_000 + ">", "<?" * 300_000, "<noscript>" * 80_000 + "</noscript>", "<template>" * 50_000 + "</div>" * 50_000, "<figcaption>" * 80_000])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    media.segments(page)
    assert time.perf_counter() - began < 5


def test_random_markup_is_read_to_its_end():
    """Words outside of tags are found whatever stands before them; nothing fails."""
    r = random.Random(8)
    parts = ["<p>", "</p>", "<a ", '"', "'", "=", ">", "<", " ", "<noscript>", "<!--", "-->", "<figure>", "</figure>", "<figcaption>", "<img src=", "&amp;", "/", "<template>", "</div>", "<div>"]
    for _ in range(3000):
        page = "".join(r.choices(parts, k=r.randint(0, 25)))
        got = media.segments(page + "'\"--></p></figcaption></figure><p>end</p>")
        assert any("end" in (s["text"] or s["caption"] or "") for s in got), page


def test_payloads_of_addresses(spark):
    given = spark.createDataFrame([("one", b"x" * 600), ("two", b"")], "digest string, body binary")
    got = {r.digest: r for r in media.described(media.store(given)).collect()}
    assert (got["one"].payload_bytes, got["two"].payload_bytes) == (1152, 576) and got["one"].payload_sha256 == hashlib.sha256(media.padded(b"x" * 600)).hexdigest()


def test_pages_of_the_table(spark):
    """Every visible word of the given pages is in some segment, in order, and resolving changes neither order nor captions."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: media.segments(r.html or "") for r in pages.collect()}
    assert any(s["kind"] == "text" for p in want.values() for s in p)
    got = collections.defaultdict(list)
    known = {s["digest"]: 9 for p in list(want.values())[::2] for s in p if s["digest"]}
    store = spark.createDataFrame([("d", 1), *known.items()], "digest string, media_bytes long")
    for r in media.page_sequences(pages, store).collect():
        got[r.page_id].append(r)
    for k, p in want.items():
        sha = lambda t: t and hashlib.sha256(t.encode()).hexdigest()
        assert [(s["position"], s["kind"], sha(s["text"]), s["digest"], s["caption"], known.get(s["digest"])) for s in p] == [tuple(r)[1:] for r in sorted(got[k], key=lambda r: r.position)]


def test_resolve_keeps_positions(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="sha256:d"><p>b</p><img src="sha256:none">'), (2, None)], "page_id long, html string")
    store = spark.createDataFrame([("d", 7), ("d", 7)], "digest string, size long")
    got = {r.doc_id: r.segments for r in media.resolve(media.parse_pages(pages), store).collect()}
    assert [(s.segment.position, s.segment.kind, s.media and s.media.size) for s in got[1]] == [(0, "text", None), (1, "media", 7), (2, "text", None), (3, "media", None)]
    assert got[2] == []


def test_counts_under_edits(docs, empty):
    by, r = bpe.codec(RANKS), random.Random(2)
    some = list("ab'sl  \n\t.1²é 9ß")
    for _ in range(200):
        s = "".join(r.choice(some) for _ in range(r.randrange(80)))
        tree = counts.TokenTree.of(by, s, 5)
        for _ in range(6):
            a = r.randrange(len(s) + 1)
            b, new = min(len(s), a + r.randrange(5)), "".join(r.choice(some) for _ in range(r.randrange(6)))
            tree.edit(a, b, new)
            s = s[:a] + new + s[b:]
            assert (tree.text(), tree.total) == (s, len(by.bpe.encode_ordinary(s)))
    got = {x.doc_id: x for x in counts.count_with_edits(docs, RANKS).collect()}
    for i, t in texts():
        s = t or ""
        assert got[i].n_tokens == len(by.bpe.encode_ordinary(s))
        n, seed = len(s), zlib.crc32(str(i).encode())
        a, b, c = (seed * k % (n + 1) for k in (1, 7, 13))
        for a, b, new in ((a, a + 9, " replaced words"), (b, b, "in sert\n"), (c, c + 5, "")):
            a, b = min(a, len(s)), min(b, len(s))
            s = s[:a] + new + s[b:]
        assert (got[i].n_tokens_edited, got[i].text_crc32) == (len(by.bpe.encode_ordinary(s)), zlib.crc32(s.encode()))
    assert counts.count_with_edits(empty, RANKS).collect() == []


def test_trees_are_kept_and_edited_again(spark, docs):
    """Edits from a table, on trees that were written, twice; only what is near an edit is encoded."""
    by, r = bpe.codec(RANKS), random.Random(6)
    now = {i: t or "" for i, t in texts()}
    kept = counts.trees(docs, RANKS, 20).cache()
    for _ in range(2):
        edits = [(i, k, r.randrange(-2, len(t) + 3), r.randrange(len(t) + 9), r.choice(["", "x y", "é", None])) for i, t in now.items() if i % 3 for k in range(3)]
        table = spark.createDataFrame(edits, "doc_id long, place int, start long, `end` long, new string")
        got = counts.edit_trees(counts.with_edits(kept, table), RANKS, with_trees=True).collect()
        for i, _, a, b, new in sorted(edits, key=lambda e: e[:2]):
            s = now[i]
            a, b = max(0, min(a, len(s))), max(0, min(b, len(s)))
            now[i] = s[:a] + (new or "") + s[max(a, b) :]
        assert {x.doc_id: "".join(x.segments) for x in got} == now
        assert all((x.n_tokens_edited, sum(x.tokens)) == (len(by.bpe.encode_ordinary(now[x.doc_id])),) * 2 for x in got)
        assert all(x.chars_encoded == 0 for x in got if not x.doc_id % 3)
        kept = spark.createDataFrame([(x.doc_id, x.n_bytes, x.n_chars, x.segments, x.tokens) for x in got], counts.TREE)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, width):
    sets = {}
    for i, t in texts():
        w = body(t).lower().split()
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if _ > 3:
            break
    got = neardup.near_duplicates(docs, width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


@pytest.mark.parametrize("largest", [50, 2**63 - 1])
def test_near_duplicates_with_null_ids(spark, largest):
    """Rows without an id link like others; of their components without any id one row stays."""
    r = random.Random(9)
    new = lambda: [f"w{r.randrange(10**9)}" for _ in range(60)]
    other = lambda w, *at: [f"n{r.randrange(10**9)}" if i in at else x for i, x in enumerate(w)]
    a, b, c, d, e, f = (new() for _ in range(6))
    rows = [(1, a), (None, other(a, 30)), (None, b), (None, other(b, 7)), (None, c), (None, c), (None, other(c, 59)), (None, new()), (7, e), (None, e), (largest, f)]
    rows += [(9, other(d, 5, 9)), (None, d), (4, other(d, 40, 50)), (None, []), (None, [])]  # 9 and 4 are linked by d alone
    sets = [{tuple(w[j : j + 2]) for j in range(len(w) - 1)} for _, w in rows]
    comp = list(range(len(rows)))
    for _ in range(4):
        for x, s in enumerate(sets):
            for y, t in enumerate(sets):
                if s & t and 100 * len(s & t) >= 80 * len(s | t):
                    comp[x] = comp[y] = min(comp[x], comp[y])
    assert comp[11] == comp[12] == comp[13] and 100 * len(sets[11] & sets[13]) < 80 * len(sets[11] | sets[13])
    ids = {k: min((i for (i, _), m in zip(rows, comp, strict=True) if m == k and i is not None), default=None) for k in comp}
    df = spark.createDataFrame([(i, " ".join(w), k) for k, (i, w) in enumerate(rows)], "doc_id long, text string, n long").repartition(3)
    got = neardup.near_duplicates(df, 2).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == sorted(((i, len(s), ids[k]) for (i, _), s, k in zip(rows, sets, comp, strict=True)), key=repr)
    assert {x.doc_id for x in got if x.kept and x.doc_id is not None} == {i for i in ids.values() if i is not None}
    assert sum(x.kept for x in got) == len(ids)
    kept = neardup.kept_rows(df, 2).collect()
    assert sorted(comp[x.n] for x in kept) == sorted(ids)
    assert all(x.doc_id == ids[comp[x.n]] and x.text == " ".join(rows[x.n][1]) for x in kept)


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty).collect() == []


def test_parities_never_rule_out():
    r = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(r.integers(0, 1 << 62, r.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: r.integers(0, len(a) + 1)], r.integers(0, 1 << 62, r.integers(1, 60)).astype(np.uint64)]))
        p = neardup.parities([a, b]).view(np.uint64)
        assert sum(int(x).bit_count() for x in p[0] ^ p[1]) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_dedup(docs, digest):
    same = collections.defaultdict(list)
    for i, t in texts():
        same[t or ""].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_dedup(docs, digest, files_per_batch=2).collect()}
    assert got == {i: (max(same[t or ""]), len(same[t or ""]), i == max(same[t or ""]), hashlib.sha256(body(t)).hexdigest()) for i, t in texts()}


def test_exact_dedup_of_nothing(empty):
    assert exact.exact_dedup(empty).collect() == []


def test_substring_dedup(docs, spark, empty):
    r = random.Random(3)
    base = [r.choice("abcdef") for _ in range(400)]
    rows = texts()
    for i in range(60):
        w = []
        for _ in range(r.randrange(1, 5)):
            k, a, n = r.randrange(5), r.randrange(340), r.randrange(20, 80)
            w += base[a : a + n] if k < 2 else ["a"] * n if k == 2 else ["a", "b"] * (n // 2) if k == 3 else [r.choice("abcdefghij") for _ in range(n)]
        rows.append((1000 + i, " ".join(w)))
    first, words = {}, {i: body(t).split() for i, t in rows}
    for i in sorted(words):
        for j in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][j : j + 50]), i)
    want = {}
    for i, w in words.items():
        gone = {k for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for k in range(j, j + 50)}
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring.substring_dedup(df).collect()} == want
    assert substring.substring_dedup(empty).collect() == []


def test_substring_dedup_of_null_and_shared_ids(spark):
    """Null ids are one document before all others; rows of one id and word sequence lose the same words, whatever their white space."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    own = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    rows = [(None, base[:120] + own(5)), (None, base[:80]), (None, base[300:360]), (1, own(9) + base[10:90] + own(3)), (2, base[200:280]), (3, own(4) + base[210:275] + own(6)), (4, base[300:360]), (5, own(60)), (6, base[:80])]
    rows += [(3, rows[5][1]), (3, rows[5][1]), (1, rows[3][1]), (2, base[190:260] + own(2)), (-7, base[100:170])]
    first = {}
    rank = lambda i: (i is not None, i or 0)
    for i, w in sorted(rows, key=lambda x: rank(x[0])):
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), rank(i))
    want, texts_want = [], []
    table = [(i, (" ", "\n", "  ", "\t ")[k % 4].join(w), 0) for k, (i, w) in enumerate(rows)]
    for (i, w), (_, text, _) in zip(rows, table, strict=True):
        gone = {k for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < rank(i) for k in range(j, j + 50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
        texts_want.append((i, kept if gone else text))
    df = spark.createDataFrame(table, "doc_id long, text string, n_chars long").repartition(3)
    assert sorted(map(tuple, substring.substring_dedup(df).collect()), key=repr) == sorted(want, key=repr)
    assert sorted(((x.doc_id, x.text) for x in substring.kept_texts(df).collect()), key=repr) == sorted(texts_want, key=repr)


def test_chat(spark):
    turns = [(1, 1, "user", "a\\(b\\\\([NEXT]["), (1, 0, "user", None), (1, 2, "assistant", "\\"), (1, 3, "assistant", ""), (1, 4, "x]y[", "[/ROLE][ROLE:x]\n"), (2, 0, None, "x[]"), (None, 0, "user", "n")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    back = chat.format_conversations(df).select("conv_id", "blocks", chat.read_back(F.col("formatted")).alias("t")).collect()
    got = {r.conv_id: (r.blocks, [(t.role, t.text) for t in r.t]) for r in back}
    assert got[1] == (3, [("user", ""), ("user", turns[0][3]), ("assistant", "\\"), ("assistant", ""), ("x]y[", turns[4][3])])
    assert got[2] == (1, [("", "x[]")]) and got[None] == (1, [("user", "n")])
    assert chat.digests(df.where("false")).collect() == []


def test_chat_loss_spans(spark):
    turns = [(1, 0, "user", "[ü\\"), (1, 1, "assistant", "😀 a[b]\\(c"), (1, 2, "assistant", ""), (1, 3, "assistant", "[NEXT]"), (1, 4, "a[s]", "assistant"), (1, 5, "assistant", "é\n"), (2, 0, "user", "q"), (3, 0, "assistant", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    want = {c: [t or "" for i, _, role, t in turns if i == c and role == "assistant"] for c in (1, 2, 3)}
    rows = chat.format_conversations(df).select("formatted", "conv_id", "loss", chat.loss_texts(F.col("formatted"), F.col("loss")).alias("said")).collect()
    assert {r.conv_id: r.said for r in rows} == want
    for r in rows:
        cut = [r.formatted[s.start : s.start + s.length] for s in r.loss]
        assert cut == [t.replace("\\", "\\\\").replace("[", "\\(") for t in want[r.conv_id]]
        for s in r.loss:
            assert r.formatted[: s.start].endswith(("[ROLE:assistant]", "[NEXT]")) and r.formatted[s.start + s.length :].startswith(("[NEXT]", "[/ROLE]"))
    for r in chat.digests(df).collect():
        said = "".join(want[r.conv_id])
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_long_conversations(spark):
    """More turns than a slice of running sums has, with blocks over its edges."""
    r = random.Random(5)
    turns = [(c, t, r.choice(["user", "assistant", "assistant"]), "ab[\\c"[: r.randrange(6)]) for c, n in ((1, 255), (2, 256), (3, 257), (4, 1500), (5, 1)) for t in range(n)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(4)
    rows = chat.format_conversations(df).select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.loss_texts(F.col("formatted"), F.col("loss")).alias("said")).collect()
    for x in rows:
        assert [(t.role, t.text) for t in x.t] == [(role, text) for c, _, role, text in turns if c == x.conv_id]
        assert x.said == [text for c, _, role, text in turns if c == x.conv_id and role == "assistant"]
    assert len(rows) == 5


def test_pairwise_terms_of_the_factorisation_machine():
    """The sum-of-squares identity against the sum over explicit pairs of all features."""
    setup = quality.Setup(slots=64, rank=3)
    m, r = quality.Machine(setup), np.random.default_rng(7)
    m.w, m.v, m.bias = r.normal(size=m.w.shape).astype(np.float32), r.normal(size=m.v.shape).astype(np.float32), 0.25
    m.mean, m.spread = r.normal(size=quality.N_DENSE).astype(np.float32), r.uniform(1, 2, quality.N_DENSE).astype(np.float32)
    bodies = [b"", b"a", b"one two two three", b"Some, more; WORDS here\nand there 12 " * 9]
    dense, slots, weights, ends = quality._features(bodies, quality.WordHashes(), setup)
    got = m.logits(dense, slots, weights, ends)
    for i in range(len(bodies)):
        x = np.zeros(setup.slots + quality.N_DENSE)
        x[slots[ends[i] : ends[i + 1]]] = weights[ends[i] : ends[i + 1]]
        x[setup.slots :] = m.scaled(dense[i : i + 1])[0]
        pairs = sum(float(m.v[a].astype(float) @ m.v[b].astype(float)) * x[a] * x[b] for a in range(len(x)) for b in range(a + 1, len(x)) if x[a] and x[b])
        assert abs(got[i] - (m.bias + float(m.w.astype(float) @ x) + pairs)) < 1e-4 * max(1, abs(got[i]))


def test_quality_of_held_out_rows(spark):
    """On the given tables: rows that were not learnt from are told apart."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 50 and len(bad) > 5
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95


def test_quality(spark, docs, empty):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["good", "plain", "words", "here"]) for _ in range(60)) if i % 2 else "BUY!! " * 40) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    m = quality.train(df, labels, quality.Setup(epochs=8))
    assert all(x.predicted == x.doc_id % 2 for x in quality.score(df, m).collect())
    assert {x.doc_id for x in quality.kept_rows(df, m).collect()} == {i for i, _ in rows if i % 2}
    assert len(quality.score(docs, m).collect()) == len(texts()) and quality.score(empty, m).collect() == []
    assert all(0 <= x.score <= 1 for x in quality.score(docs, quality.train(empty, labels)).collect())


def test_evolution_beats_best_fit():
    """Sets of pieces that best fit, largest first, packs into more bins than needed; no piece is lost and no bin overfull on the way."""
    setup, gains = packing.Setup(capacity=100, generations=300), 0
    for seed in range(8):
        sizes = np.random.default_rng(seed).integers(3, 60, 150)
        plain = packing.fresh(sizes, 100)
        best = packing.evolve(sizes, [], setup, seed)
        for p in best:
            assert (p >= 0).all() and np.bincount(p, sizes).max() <= 100 and np.bincount(p).min() > 0
        gains += int(plain.max() - best[0].max())
        assert best[0].max() <= plain.max()
    assert gains >= 2


def test_best_sets():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 50):
        sizes = r.integers(1, 101, n)
        bins, fills = np.full(n, -1, np.int32), []
        packing.best_sets(np.arange(n), sizes, 100, bins, fills, 12, r)
        assert (bins >= 0).all() and fills == np.bincount(bins, sizes, len(fills)).astype(int).tolist() and max(fills, default=0) <= 100
    sizes = np.array([60, 25, 15, 50, 30, 20])
    bins, fills = np.full(6, -1, np.int32), []
    packing.best_sets(np.arange(6), sizes, 100, bins, fills, 12, r)
    assert fills == [100, 100]


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    by = Tokenizer.from_file(VOCABULARY)
    setup = packing.Setup(capacity=128, shard=16, levels=3)
    rows = packing.pack(docs, VOCABULARY, setup).collect()
    bins, of = collections.defaultdict(list), collections.defaultdict(list)
    for x in rows:
        bins[x.sequence_id].append((x.offset, x.length))
        of[x.doc_id].append(x)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 128
    for i, t in texts():
        ids = np.array([*by.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        parts = sorted(of[i], key=lambda x: x.piece)
        assert [(x.start, x.length) for x in parts] == packing.piece_bounds(len(ids), 128)
        assert all(x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in parts)
    assert len(bins) <= 1.1 * sum(x.length for x in rows) / 128 + 2
    assert packing.pack(empty, VOCABULARY).collect() == []
