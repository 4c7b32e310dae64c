"""Quality classifier (operator 9): a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), linear in the number of active features.
It is fitted by Adam on a bounded sample of labelled rows, at most `most_rows` of them, chosen by the hash of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, portions, ship, spread, text_bytes

N_DENSE = 18


@dataclass(frozen=True)
class Setup:
    """most_rows: bound of the sample that the model is fitted on; slots: hashed word features; rank: of the interactions."""

    most_rows: int = 4_000
    slots: int = 4_096
    rank: int = 6
    epochs: int = 40
    rate: float = 0.02
    decay: float = 1e-3
    seed: int = 5


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _statistics(body: bytes, words: list[bytes], hashes: np.ndarray) -> list[float]:
    """Structure of a text, each figure between about 0 and 3, and its length as metadata."""
    raw = np.frombuffer(body, np.uint8)
    n, m = max(1, len(raw)), max(1, len(words))
    kinds = np.bincount(raw, minlength=256)
    upper, lower, digit = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
    white = kinds[[9, 10, 11, 12, 13, 32]].sum()
    high = kinds[128:].sum()
    mark = kinds[33:127].sum() - upper - lower - digit
    letters = max(1, upper + lower + high)
    same = int((hashes[1:] == hashes[:-1]).sum()) if len(hashes) else 0
    lines = body.split(b"\n")
    return [
        upper / letters, 4 * digit / n, 4 * mark / n, 4 * white / n, high / n,
        10 * kinds[33] / m, 10 * (kinds[35] + kinds[36] + kinds[37] + kinds[38] + kinds[42]) / m, 10 * kinds[124] / m,
        3 * (kinds[44] + kinds[46]) / m, same / m, len(np.unique(hashes)) / m,
        min(3.0, n / m / 8), np.log1p(len(raw)) / 6, np.log1p(len(words)) / 5,
        len(set(lines)) / len(lines), min(3.0, len(words) / len(lines) / 30), np.log1p(len(lines)) / 4,
        3 * kinds[[60, 62, 123, 125, 61, 59, 95]].sum() / m,
    ]


def _features(bodies: list[bytes], hashes: WordHashes, setup: Setup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dense statistics, and the words of all texts as (slots, weights, ends): every word counts 1 / sqrt(words of the text)."""
    dense, slots, ends = np.zeros((len(bodies), N_DENSE), np.float32), [], [0]
    for i, body in enumerate(bodies):
        words = body.split()
        h = hashes.of(words)
        dense[i] = _statistics(body, words, h)
        slot, n = np.unique((h >> np.uint64(20)) % np.uint64(setup.slots), return_counts=True)
        w = np.log1p(n).astype(np.float32)
        slots.append((slot.astype(np.int64), w / max(1e-6, float(np.sqrt((w * w).sum())))))
        ends.append(ends[-1] + len(slot))
    return dense, np.concatenate([s for s, _ in slots] or [np.empty(0, np.int64)]), np.concatenate([w for _, w in slots] or [np.empty(0, np.float32)]), np.array(ends)


class Machine:
    def __init__(self, setup: Setup):
        rng = np.random.default_rng(setup.seed)
        n = setup.slots + N_DENSE
        self.setup, self.bias = setup, 0.0
        self.w, self.v = np.zeros(n, np.float32), rng.normal(0, 0.01, (n, setup.rank)).astype(np.float32)
        self.mean, self.spread = np.zeros(N_DENSE, np.float32), np.ones(N_DENSE, np.float32)

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.spread, -4, 4).astype(np.float32) * np.float32(0.5)

    def _sums(self, dense, slots, weights, ends):
        """Per text: the linear part, sum v x and sum v^2 x^2."""
        x, d = self.scaled(dense), self.setup.slots
        linear, first, second = x @ self.w[d:], x @ self.v[d:], (x * x) @ (self.v[d:] ** 2)
        if len(slots):
            some = np.flatnonzero(np.diff(ends))
            at = ends[:-1][some]
            linear[some] += np.add.reduceat(self.w[slots] * weights, at)
            vx = self.v[slots] * weights[:, None]
            first[some] += np.add.reduceat(vx, at)
            second[some] += np.add.reduceat(vx * vx, at)
        return x, linear, first, second

    def logits(self, dense, slots, weights, ends) -> np.ndarray:
        _, linear, first, second = self._sums(dense, slots, weights, ends)
        return self.bias + linear + 0.5 * (first * first - second).sum(1)

    def fit(self, dense, slots, weights, ends, labels) -> None:
        """Adam over batches; both labels weigh alike."""
        s, d = self.setup, self.setup.slots
        if not len(labels):
            return
        self.mean, self.spread = dense.mean(0), dense.std(0) + np.float32(1e-3)
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        rng = np.random.default_rng(s.seed)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w, self.v)]
        t = 0
        for _ in range(s.epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), 256):
                pick = order[at : at + 256]
                sizes = ends[pick + 1] - ends[pick]
                to = np.concatenate([[0], np.cumsum(sizes)])
                index = np.repeat(ends[pick] - to[:-1], sizes) + np.arange(to[-1])
                sl, we = slots[index], weights[index]
                x, linear, first, second = self._sums(dense[pick], sl, we, to)
                z = self.bias + linear + 0.5 * (first * first - second).sum(1)
                err = ((1 / (1 + np.exp(-z)) - labels[pick]) / len(pick)).astype(np.float32)
                own = np.repeat(np.arange(len(pick)), sizes)
                gw, gv = s.decay * self.w, s.decay * self.v
                e = err[own] * we
                gw[:d] += np.bincount(sl, e, d).astype(np.float32)
                gw[d:] += x.T @ err
                word = e[:, None] * (first[own] - self.v[sl] * we[:, None])
                for f in range(s.rank):
                    gv[:d, f] += np.bincount(sl, word[:, f], d).astype(np.float32)
                gv[d:] += x.T @ (err[:, None] * first) - ((x * x).T @ err)[:, None] * self.v[d:]
                self.bias -= s.rate * float(err.sum())
                t += 1
                for p, g, (m, q) in zip((self.w, self.v), (gw, gv), state, strict=True):
                    m += 0.1 * (g - m)
                    q += 0.001 * (g * g - q)
                    p -= s.rate * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)


def train(docs: DataFrame, labels: DataFrame, setup: Setup = Setup(), training: Column | None = None) -> Machine:
    """A machine fitted on the labelled rows of docs where training holds (default: those not held out), at most setup.most_rows.

    Labels that are null are not read; of an id with several labels the largest counts. The sample are the ids that come first by
    hash, both labels in like numbers while they last."""
    ship(docs.sparkSession)
    allowed = ~held_out(F.col("doc_id")) if training is None else training
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where(allowed)
    half = max(1, setup.most_rows // 2)
    each = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for q in (0, 1)]
    ids = {r.doc_id: r.quality for part in each for r in part.collect()}
    machine = Machine(setup)
    if not ids:
        return machine
    chosen = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, quality int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in portions(batches):
            dense, slots, weights, ends = _features(part.column(1).to_pylist(), hashes, setup)
            rows = [(d.tobytes(), slots[a:b].astype(np.int32).tobytes(), weights[a:b].tobytes()) for d, a, b in zip(dense, ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], names=["doc_id", "dense", "slots", "weights"])

    rows = text_bytes(docs).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").mapInArrow(run, "doc_id long, dense binary, slots binary, weights binary").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.dense, r.slots))
    if rows:
        slots = [np.frombuffer(r.slots, np.int32).astype(np.int64) for r in rows]
        machine.fit(
            np.stack([np.frombuffer(r.dense, np.float32) for r in rows]), np.concatenate(slots), np.concatenate([np.frombuffer(r.weights, np.float32) for r in rows]),
            np.cumsum([0, *map(len, slots)]), np.array([ids[r.doc_id] for r in rows], np.float32),
        )
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score, predicted: one row per row of docs; a null text is scored as an empty one, repeated rows alike, null ids stay null.
    An empty table gives no rows. Extra columns are not read."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, by = WordHashes(), sent.value
        for part in portions(batches):
            z = by.logits(*_features(part.column(1).to_pylist(), hashes, by.setup)).astype(np.float64)
            s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return spread(text_bytes(docs)).mapInArrow(run, "doc_id long, score double, predicted int")


def kept_rows(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The rows of docs, with their columns, of any names, that score least or more. A null text is scored as an empty one and stays
    or goes as it is; repeated rows are scored each for itself; no rows give no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, by = WordHashes(), sent.value
        for batch in batches:
            bodies = pc.struct_field(batch.column(0), "text").cast(pa.binary()).fill_null(b"")
            whole = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), bodies], names=["row", "body"])
            stay = [np.zeros(0, bool)]
            for part in portions([whole]):
                z = by.logits(*_features(part.column(1).to_pylist(), hashes, by.setup)).astype(np.float64)
                stay.append(1 / (1 + np.exp(-np.clip(z, -60, 60))) >= least)
            yield batch.filter(pa.array(np.concatenate(stay)))

    rows = spread(docs).select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, rows.schema).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
