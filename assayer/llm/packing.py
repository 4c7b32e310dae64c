"""Best-fit packing by a grouping genetic algorithm (operator 10).

Pieces shorter than a sequence are dealt to shards of bounded size. A shard is evolved on several islands: an individual is a
grouping of the shard's pieces into bins; crossover injects whole well-filled bins of one parent into the other, takes out the
bins that held the same pieces, the least-filled ones and some others, and fits the displaced pieces back: bin by bin, each with
the set of pieces, around the largest one left, that fills it best. Between epochs each island's elite migrates to the next
island of its shard; epochs go on while they bring a gain. The best individual of a shard stands; bins that it left with room
are pooled with those of other shards and packed again.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import codec
from .common import free_since, mark, portions, ship, spread, text_bytes, union_all, written

SPECIAL = "<|endoftext|>"


@dataclass(frozen=True)
class Setup:
    """capacity: tokens of a sequence; end_id: follows each document; shard: pieces evolved together, about; epochs: at most; moved: bins of
    either parent that a crossover moves, at most; pool: pieces that a best set is chosen among; loose: share of room from which a bin is
    packed again."""

    capacity: int = 1024
    end_id: int = 2
    shard: int = 4096
    islands: int = 2
    epochs: int = 4
    generations: int = 60
    population: int = 5
    moved: int = 12
    pool: int = 32
    loose: float = 0.01
    levels: int = 3
    seed: int = 11


@lru_cache(2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def piece_bounds(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones at the end, a shorter one first if there is a rest."""
    if length <= capacity:
        return [(0, length)]
    rest = length % capacity
    return [(0, rest)] * bool(rest) + [(s, capacity) for s in range(rest, length, capacity)]


def pieces(docs: DataFrame, path: str, setup: Setup = Setup()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): one row per piece of each row of docs; null: empty text, which is its end id."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, end = codec(path), np.array([setup.end_id], "<u4").tobytes()
        for part in portions(batches, 8_000_000):
            out: list[tuple] = []
            for doc_id, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                text = body.decode("utf-8", "replace")
                # The library takes this string in a text for its id.
                ids = np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes() if SPECIAL in text else by.encode(text)
                ids = memoryview(ids + end)
                out += [(doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(piece_bounds(len(ids) // 4, setup.capacity))]
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return spread(text_bytes(docs)).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(todo: np.ndarray, sizes: np.ndarray, capacity: int, bins: np.ndarray, fills: list[int]) -> None:
    """Put the items of todo, in this order, each into the fullest bin with room for it, else into a new one; bins and fills change."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, f in enumerate(fills):
        stacks[capacity - f].append(b)
        mask |= 1 << (capacity - f)
    for i, s in zip(todo.tolist(), sizes[todo].tolist(), strict=True):
        free = mask >> s
        if free:
            room = s + (free & -free).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        fills[b] += s
        stacks[room - s].append(b)
        mask |= 1 << (room - s)
        bins[i] = b


def fresh(sizes: np.ndarray, capacity: int, rng: np.random.Generator | None = None) -> np.ndarray:
    """Best fit, largest first; with rng the order is disturbed."""
    key = -sizes.astype(np.float64) if rng is None else -sizes * rng.uniform(0.8, 1.2, len(sizes))
    bins = np.full(len(sizes), -1, np.int32)
    best_fit(np.argsort(key, kind="stable"), sizes, capacity, bins, [])
    return bins


def fitness(bins: np.ndarray, sizes: np.ndarray) -> tuple[int, float]:
    fills = np.bincount(bins, sizes)
    return -len(fills), float((fills * fills).sum())


def best_sets(todo: np.ndarray, sizes: np.ndarray, capacity: int, bins: np.ndarray, fills: list[int], pool: int, rng: np.random.Generator) -> None:
    """Put the items of todo into new bins, each filled as far as the largest item left and a set of others, out of at most pool
    drawn ones that fit beside it, allow. The sums that sets reach are the bits of a number."""
    left = todo[np.argsort(-sizes[todo], kind="stable")].tolist()
    sizes_, total = sizes.tolist(), int(sizes[todo].sum())
    falling = [-sizes_[i] for i in left]
    while left and total > capacity:
        room = capacity - sizes_[left[0]]
        low = bisect.bisect_left(falling, -room, 1)
        drawn = range(low, len(left)) if len(left) - low <= pool else sorted(rng.choice(len(left) - low, pool, replace=False) + low)
        reached, limit = [1], (1 << (room + 1)) - 1
        for k in drawn:
            reached.append((reached[-1] | reached[-1] << sizes_[left[k]]) & limit)
        want, chosen = reached[-1].bit_length() - 1, []
        for k, before in zip(reversed(drawn), reversed(reached[:-1]), strict=True):
            if not before >> want & 1:
                chosen.append(k)
                want -= sizes_[left[k]]
        fill = 0
        for k in [*chosen, 0]:
            fill += sizes_[left[k]]
            bins[left.pop(k)] = len(fills)
            del falling[k]
        fills.append(fill)
        total -= fill
    if left:
        bins[left] = len(fills)
        fills.append(total)


def crossed(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, setup: Setup, rng: np.random.Generator) -> np.ndarray:
    """A child of a with well-filled bins of b."""
    capacity = setup.capacity
    fills_a, fills_b = np.bincount(a, sizes), np.bincount(b, sizes)
    some = lambda of, n: rng.choice(of, min(len(of), n), replace=False)
    taken = np.zeros(len(fills_b), bool)
    taken[some(np.flatnonzero(fills_b >= np.quantile(fills_b, 0.5)), int(rng.integers(0, setup.moved + 1)))] = True
    injected = taken[b]
    gone = np.zeros(len(fills_a), bool)
    gone[a[injected]] = True
    gone[np.argsort(fills_a, kind="stable")[:2]] = True
    gone[some(np.arange(len(fills_a)), setup.moved)] = True
    gone[some(np.flatnonzero(fills_a < capacity), setup.moved)] = True
    stay = ~gone[a] & ~injected
    child = np.full(len(a), -1, np.int32)
    new_b, new_a = np.cumsum(taken) - 1, np.cumsum(~gone) - 1 + int(taken.sum())
    child[injected], child[stay] = new_b[b[injected]], new_a[a[stay]]
    fills = np.concatenate([fills_b[taken], fills_a[~gone]]).astype(np.int64).tolist()
    best_sets(np.flatnonzero(child < 0), sizes, capacity, child, fills, setup.pool, rng)
    return child


def evolve(sizes: np.ndarray, population: list[np.ndarray], setup: Setup, seed: int) -> list[np.ndarray]:
    """A population after some generations, the elite first; it starts from best fit where there is none."""
    rng = np.random.default_rng(seed)
    bound = -(-int(sizes.sum()) // setup.capacity)
    rank = lambda p: fitness(p, sizes)
    found = [(rank(p), p) for p in population or [fresh(sizes, setup.capacity)]]
    best = lambda: sorted(found, key=lambda x: x[0], reverse=True)[: setup.population]
    while len(found) < setup.population and -found[0][0][0] > bound:
        p = fresh(sizes, setup.capacity, rng)
        found.append((rank(p), p))
    for _ in range(setup.generations):
        found = best()
        if -found[0][0][0] <= bound or len(found) < 2:
            break
        a, b = (0, rng.integers(1, len(found))) if rng.random() < 0.7 else rng.choice(len(found), 2, replace=False)
        child = crossed(found[a][1], found[b][1], sizes, setup, rng)
        found.append((rank(child), child))
    return [p for _, p in best()]


def _epoch(shards: DataFrame, setup: Setup, epoch: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, island, raw, population = (batch.column(c)[i].as_py() for c in range(4))
                sizes = np.frombuffer(raw, np.int32).astype(np.int64)
                best = evolve(sizes, [np.frombuffer(p, np.int32) for p in population], setup, setup.seed + 7919 * shard + 31 * island + epoch)
                bins, squares = fitness(best[0], sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array([island], pa.int32()), pa.array([raw], pa.binary()), pa.array([[p.astype(np.int32).tobytes() for p in best]], pa.list_(pa.binary())), pa.array([-bins], pa.int64()), pa.array([squares])],
                    names=["shard", "island", "sizes", "population", "n_bins", "squares"],
                )

    return shards.select("shard", "island", "sizes", "population").mapInArrow(run, "shard long, island int, sizes binary, population array<binary>, n_bins long, squares double")


def pack_level(items: DataFrame, n: int, setup: Setup, level: int) -> DataFrame:
    """items(row, length), n of them -> (row, length, sequence_id, offset, fill)."""
    shards = -(-n // setup.shard)
    dealt = items.select(F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)).alias("shard"), "row", "length")
    lists = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("items"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array([x["length"] for x in items], np.int32).tobytes() for items in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["shard", "items", "sizes"])

    lists = written(lists.mapInArrow(sizes, "shard long, items array<struct<row: long, length: long>>, sizes binary"), "shards")
    none = F.array().cast("array<binary>")
    islands = lists.select("shard", F.explode(F.sequence(F.lit(0), F.lit(setup.islands - 1))).alias("island"), "sizes", none.alias("population"))
    # A task evolves several shards, one after the other: tasks do not grow in number with the shards.
    session = lists.sparkSession
    width = min(shards * setup.islands, max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))
    before, point = None, mark()
    for epoch in range(setup.epochs):
        islands = written(_epoch(islands.repartition(width, "shard", "island"), setup, epoch), "islands")
        free_since(point, islands)
        bins = islands.groupBy("shard").agg(F.min("n_bins").alias("n")).agg(F.sum("n").alias("n")).first().n
        if epoch + 1 == setup.epochs or bins == before:
            break
        before = bins
        elite = islands.select("shard", F.pmod(F.col("island") + 1, F.lit(setup.islands)).alias("island"), F.slice("population", 1, 1).alias("elite"))
        islands = islands.join(elite, ["shard", "island"]).select("shard", "island", "sizes", F.array_distinct(F.concat("elite", "population")).alias("population"))
    best = islands.groupBy("shard").agg(F.max_by(F.element_at("population", 1), F.struct(-F.col("n_bins"), "squares", -F.col("island"))).alias("best"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, items, best = (batch.column(c)[i].as_py() for c in range(3))
                rows, lengths = (np.array([x[k] for x in items], np.int64) for k in ("row", "length"))
                bins = np.frombuffer(best, np.int32).astype(np.int64)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
                offset = np.empty(len(rows), np.int64)
                offset[order] = before - before[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
                fill = np.bincount(bins, lengths).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows, lengths, bins + (shard << 20) + (level << 56), offset, fill[bins])], names=["row", "length", "sequence_id", "offset", "fill"])

    return lists.select("shard", "items").join(best, "shard").mapInArrow(place, "row long, length long, sequence_id long, offset long, fill long")


def pack(docs: DataFrame, path: str, setup: Setup = Setup()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A null or empty text is one piece, its end id. Repeated rows are packed each for itself; null ids stay null. An empty table
    gives no rows. Extra columns are not read."""
    found = written(pieces(docs, path, setup).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") == setup.capacity
    done, items = [], found.where(~whole).select("row", "length")
    for level in range(setup.levels):
        n = items.count()
        if not n:
            break
        last = level + 1 == setup.levels or n <= setup.shard
        placed = written(pack_level(items, n, setup, level), "placed")
        room = F.col("fill") < setup.capacity * (1 - setup.loose)
        done.append(placed if last else placed.where(~room))
        if last:
            break
        items = placed.where(room).select("row", "length")
    own = found.where(whole).select(*found.columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("row")
    if done:
        own = own.unionByName(found.where(~whole).join(union_all(done).select("row", "sequence_id", "offset"), "row").drop("row"))
    return own
