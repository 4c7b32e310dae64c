"""A hashed maximum-entropy language model with class-factored softmax (operator 1).

A word's class is a hash of its ending, so a word never seen has one too; the end of a text is a class of its own. Within a class,
words fall into groups by a hash. Given the two words before, P(word) = P(class | words before) P(group | class, words before)
P(word | group). The first two are softmaxes over sums of weights of hashed features: a bias, the word before (2-gram), the one
before that (skip) and both together (3-gram); the last is the group's add-one unigram distribution over all counts. What the
softmaxes need of the corpus are counts of (hashed words before, class) and (hashed words before, class and group): they are gathered
in one pass with the word counts, and the weights are fitted by gradient updates that tasks compute from their share of these counts
and the driver adds up. All tables but the word counts have a fixed size. Probabilities of the words that were learnt and of one
unknown word per group sum to 1.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, ship, spread, text_bytes, written

START, END = 0, 1  # places of the two marks in a worker's word table
_MARKS = b".,;:!?\"'()"


@dataclass(frozen=True)
class Setup:
    """classes, buckets: sizes of the hashed tables of the class part; pairs: of its 3-gram features; groups: of the words of a class,
    with near and near_pairs as the sizes of their context tables; prior: precision of the weights' Gaussian prior; head: most words
    whose counts are broadcast."""

    classes: int = 64
    buckets: int = 128
    pairs: int = 4096
    groups: int = 64
    near: int = 32
    near_pairs: int = 64
    rounds: int = 12
    rate: float = 0.5
    prior: float = 20.0
    head: int = 131_072


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2


class Words(dict):
    """word -> its place in a worker's bounded table, with class, group (numbered over all classes) and context bucket."""

    BOUND = 400_000

    def __init__(self, setup: Setup):
        super().__init__()
        self.setup = setup
        self.words, self.classes, self.groups, self.buckets = [b"", b""], [-1, 0], [-1, 0], [0, 0]

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self.words)
        core = word.strip(_MARKS) or word
        self.words.append(word)
        kind = 1 + zlib.crc32(core[-3:]) % (self.setup.classes - 1)
        self.classes.append(kind)
        self.groups.append(kind * self.setup.groups + zlib.crc32(word, 13) % self.setup.groups)
        self.buckets.append(1 + zlib.crc32(core[-4:], 7) % (self.setup.buckets - 1))
        return place

    def flat(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all tokens, each text behind two start marks and closed by an end; tokens per text without the start marks."""
        split = [body.lower().split() for body in bodies]
        sizes = np.array([len(w) for w in split], np.int64)
        some = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        out = np.zeros(len(some) + 3 * len(split), np.int64)
        ends = np.cumsum(sizes + 3)
        is_word = np.ones(len(out), bool)
        for k in (sizes + 3, sizes + 2):
            is_word[ends - k] = False
        is_word[ends - 1] = False
        out[is_word], out[ends - 1] = some, END
        return out, sizes + 1


def _contexts(flat: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens that are not start marks: places, context codes (buckets of the word before and of the one before it) of the class
    and of the group part, classes and groups."""
    buckets, classes, groups = np.array(words.buckets), np.array(words.classes), np.array(words.groups)
    b, token, some = buckets[flat], flat[2:] != START, words.setup.near
    places = flat[2:][token]
    return places, (b[1:-1] * words.setup.buckets + b[:-2])[token], (b[1:-1] % some * some + b[:-2] % some)[token], classes[places], groups[places]


#: Kinds of counts besides those of words, which are the numbers of their groups.
CLASS_CELL, GROUP_CELL = -1, -2


def gather(docs: DataFrame, setup: Setup) -> DataFrame:
    """(kind, key, n): counts of all tokens of docs(doc_id, body). kind: a word's group with the word, or a negative one with a context code
    and class or group as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(setup), np.zeros(2, np.int64)
        size = {CLASS_CELL: setup.buckets**2 * setup.classes, GROUP_CELL: setup.near**2 * setup.classes * setup.groups}
        seen, waiting = {k: np.zeros(n, np.int64) for k, n in size.items()}, {k: [] for k in size}

        def batch(kinds, keys, numbers) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.binary()), pa.array(numbers, pa.int64())], names=["kind", "key", "n"])

        def flush() -> pa.RecordBatch:
            at = np.flatnonzero(counts)
            return batch(np.array(words.groups)[at], [words.words[i] for i in at], counts[at])

        def count(least: int) -> None:
            for k, codes in waiting.items():
                if sum(map(len, codes)) >= least:
                    seen[k] += np.bincount(np.concatenate([*codes, np.empty(0, np.int64)]), minlength=size[k])
                    codes.clear()

        for part in portions(batches, 3_000_000):
            flat, _ = words.flat(part.column(1).to_pylist())
            places, context, near, kind, group = _contexts(flat, words)
            waiting[CLASS_CELL].append(context * setup.classes + kind)
            waiting[GROUP_CELL].append(near * setup.classes * setup.groups + group)
            count(2_000_000)
            more = np.bincount(places, minlength=len(words.words))
            more[: len(counts)] += counts
            counts = more
            if len(words.words) > Words.BOUND:
                yield flush()
                words, counts = Words(setup), np.zeros(2, np.int64)
        if counts.any():
            yield flush()
        count(0)
        for k, cells in seen.items():
            at = np.flatnonzero(cells)
            if len(at):
                yield batch(np.full(len(at), k), pa.FixedSizeBinaryArray.from_buffers(pa.binary(4), len(at), [None, pa.py_buffer(at.astype("<u4").tobytes())]).cast(pa.binary()), cells[at])

    return docs.mapInArrow(run, "kind int, key binary, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Factor:
    """P(choice | outer, context) from weights of hashed features; there are inner choices for each of outer classes."""

    def __init__(self, totals: np.ndarray, outer: int, buckets: int, pairs: int):
        self.shape, self.buckets, self.pairs = (outer, len(totals) // outer), buckets, pairs
        of = (totals.reshape(self.shape) + 0.5).astype(np.float64)
        self.bias = np.log(of / of.sum(1, keepdims=True)).ravel()
        self.weights = np.zeros((2 * buckets + pairs, len(totals)), np.float32)

    def features(self, codes: np.ndarray) -> np.ndarray:
        """The sparse rows: indices of the active features besides the bias."""
        b = self.buckets
        return np.stack([codes // b, b + codes % b, 2 * b + (codes * 2654435761 >> 7) % self.pairs], 1)

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        rows = self.features(codes)
        z = (self.bias + self.weights[rows[:, 0]] + self.weights[rows[:, 1]] + self.weights[rows[:, 2]]).reshape(-1, *self.shape)
        z -= z.max(2, keepdims=True)
        return (z - np.log(np.exp(z).sum(2, keepdims=True))).reshape(len(codes), -1)

    def table(self) -> np.ndarray:
        """log10 of the probabilities of all contexts, a slice of contexts at a time."""
        out = np.empty((self.buckets**2, len(self.bias)), np.float32)
        for low in range(0, len(out), 128):
            out[low : low + 128] = self.log_probs(np.arange(low, min(low + 128, len(out)))) / math.log(10)
        return out

    def gradient(self, codes: np.ndarray, kinds: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected counts of every feature and choice, and the expected ones."""
        some, at = np.unique(codes, return_inverse=True)
        grad, mass = np.zeros(self.weights.shape), np.zeros(self.weights.shape)
        order = np.argsort(at, kind="stable")
        at, kinds, n = at[order], kinds[order], n[order]
        for low in range(0, len(some), 256):
            here = slice(*np.searchsorted(at, [low, low + 256]))
            few = some[low : low + 256]
            seen = np.bincount((at[here] - low) * len(self.bias) + kinds[here], n[here], len(few) * len(self.bias)).reshape(len(few), *self.shape)
            expected = (np.exp(self.log_probs(few)).reshape(seen.shape) * seen.sum(2, keepdims=True)).reshape(len(few), -1)
            lack = seen.reshape(len(few), -1) - expected
            for rows in self.features(few).T:
                used, of = np.unique(rows, return_inverse=True)
                active = (of[None] == np.arange(len(used))[:, None]).astype(np.float64)
                grad[used] += active @ lack
                mass[used] += active @ expected
        return grad, mass


def fit(contexts: DataFrame, model: Factor, setup: Setup) -> Factor:
    """Gradient updates, scaled by the expected counts; contexts(code, kind, n) is a written table of bounded size."""
    spark = contexts.sparkSession
    for _ in range(setup.rounds):
        now = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            parts = [np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(3)]) for b in batches if b.num_rows]
            if parts:
                codes, kinds, n = np.concatenate(parts, 1)
                grad, mass = now.value.gradient(codes, kinds, n)
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (grad, mass)], names=["grad", "mass"])

        shape, grad, mass = model.weights.shape, 0.0, 0.0
        for row in contexts.coalesce(4).mapInArrow(run, "grad binary, mass binary").toLocalIterator():
            grad = grad + np.frombuffer(row.grad, np.float32).reshape(shape)
            mass = mass + np.frombuffer(row.mass, np.float32).reshape(shape)
        now.unpersist()
        model.weights += (setup.rate * np.clip((grad - setup.prior * model.weights) / (mass + setup.prior), -1.5, 1.5)).astype(np.float32)
    return model


def score(docs: DataFrame, training: Column | None = None, setup: Setup = Setup()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    Learns from the rows where training holds (default: those not held out). A null text is empty: its one token is the end.
    Repeated rows count as often as they occur. With nothing to learn from, all counts are 0. Extra columns are not read."""
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    texts = spread(text_bytes(docs))
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    counts = written(gather(texts.where(~held if training is None else training), setup), "counts")
    kinds = {r.kind: (r.n, r.v) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    cells = setup.classes * setup.groups
    totals, sizes = (np.array([kinds.get(k, (0, 0))[i] for k in range(cells)], np.int64) for i in (0, 1))
    n, v = int(totals.sum()), int(sizes.sum())

    h = F.hex("key")  # of a little-endian number
    whole = F.conv(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))), 16, 10).cast("long")

    def fitted(kind: int, choices: int, model: Factor) -> Factor:
        rows = counts.where(F.col("kind") == kind).select(F.floor(whole / choices).alias("code"), (whole % choices).alias("kind"), "n")
        return fit(written(rows.repartition(4, "code"), "contexts"), model, setup) if n else model

    classes = fitted(CLASS_CELL, setup.classes, Factor(totals.reshape(-1, setup.groups).sum(1), 1, setup.buckets, setup.pairs))
    groups = fitted(GROUP_CELL, cells, Factor(totals, setup.classes, setup.near, setup.near_pairs))

    # Frequent words are broadcast, at most setup.head of them; the bound comes from a histogram of counts of fixed size.
    words = counts.where("kind >= 0")
    step = F.floor(F.log2("n") * 4).cast("int")
    histogram = words.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, so_far = None, 0
    for r in histogram:
        so_far += r.words
        if so_far > setup.head:
            break
        least = r.least
    frequent = words.where(F.col("n") >= (least if least is not None else 1 << 62))
    head = {}
    for b in frequent.select("key", "n").toArrow().to_batches():
        head |= zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
    end = head.pop(b"", int(totals[0]))
    per_group = np.log10(totals + sizes + 1.0)
    known = sc.broadcast((head, end, classes, groups, per_group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, end, classes, groups, per_group = known.value
        by_class, by_group = classes.table(), groups.table()
        words, task, done = Words(setup), TaskContext.get().partitionId() << 36, 0
        count = np.array([0, end], np.int64)
        for part in portions(batches, 1_500_000):
            if len(words.words) > Words.BOUND:
                words, count = Words(setup), np.array([0, end], np.int64)
            flat, sizes = words.flat(part.column(1).to_pylist())
            count = np.concatenate([count, np.fromiter((head.get(w, -1) for w in words.words[len(count) :]), np.int64, len(words.words) - len(count))])
            places, context, near, kind, group = _contexts(flat, words)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            ln = by_class[context, kind] + by_group[near, group]
            c = count[places]
            context_part = np.bincount(owner, ln - per_group[group], len(sizes))
            logs = np.bincount(owner, np.where(c < 0, 0.0, np.log10(np.maximum(c, 0) + 1.0)), len(sizes))
            found = np.bincount(owner, c > 0, len(sizes)).astype(np.int64)
            rare = c < 0
            pair, times = np.unique(owner[rare] * len(words.words) + places[rare], return_counts=True)
            of, word = np.divmod(pair, len(words.words))
            ids = part.column(0)
            rows = np.arange(done, done + len(sizes)) + task
            done += len(sizes)
            # A text's own row has a key with a space, which no word has; its figures are in that row alone.
            keys = [b" %d" % r for r in rows] + [words.words[i] for i in word]
            zero, zeros = np.zeros(len(of), np.int64), np.zeros(len(of))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rows, rows[of]])), pa.concat_arrays([ids, ids.take(pa.array(of))]), pa.array(keys, pa.binary()), pa.array(np.concatenate([np.zeros(len(rows), np.int64), times])),
                 pa.array(np.concatenate([sizes, zero])), pa.array(np.concatenate([found, zero])), pa.array(np.concatenate([logs, zeros])), pa.array(np.concatenate([context_part, zeros]))],
                names=["row", "doc_id", "key", "times", "n_tokens", "found", "logs", "near"],
            )

    rows = texts.mapInArrow(run, "row long, doc_id long, key binary, times long, n_tokens long, found long, logs double, near double")
    rare = words.where(F.col("n") < (least if least is not None else 1 << 62)).select("key", "n")
    some = F.coalesce("n", F.lit(0))
    summed = rows.join(rare, "key", "left").groupBy("row", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("found") + F.when(some > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("logs") + F.col("times") * F.log10(some + 1.0)).alias("logs"),
        F.sum("near").alias("near"),
    )
    return summed.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"), (F.col("logs") + F.col("near")).alias("score"),
    )
