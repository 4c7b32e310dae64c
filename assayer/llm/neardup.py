"""Near-duplicates by one-permutation hashing (operator 5).

A document's set of word shingles is hashed once; the top bits of a hash choose its bin, the least hash of a bin is the
bin's value. An empty bin borrows from the bins in an order that is random per bin and the same for all documents (optimal
densification), so that borrowed bins of two sets agree independently. BANDS x ROWS bins form bucket keys; at similarity 0.8
all bands miss with probability (1 - 0.8**ROWS)**BANDS, 6e-8 at 32 x 4.

Sets that are equal are one node. A bucket is searched by stars: its least node is compared with the others, then leaves the
bucket; of what is left the least nodes of 4, 16, ... hashed parts lead the next stars, until no bucket spans two components. A pair is skipped only if that cannot
lose a link: nodes already in one component, sizes further apart than the threshold, or parities of hashed cells that differ in more
places than similar sets have different items. Links are confirmed on the full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import WordHashes, free_since, mark, mix, portions, ship, spread, text_bytes, union_all, written

BANDS, ROWS = 32, 4
BITS = 1024
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of width words; of fewer words, the whole run as one; none of none."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    span = min(width, len(words))
    total = np.full(n, np.uint64(span))
    for i in range(span):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(total)


@lru_cache(2)
def _lenders(bins: int) -> np.ndarray:
    """For each bin the order in which it asks the others for a value."""
    return np.stack([np.random.default_rng(i).permutation(bins) for i in range(bins)], 1)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """uint64[sets, bins]; bins are equal ranges of the hash space, so a sorted set has each bin's least value first."""
    table = np.full((len(sets), bins), _EMPTY)
    edges = (np.arange(bins, dtype=object) * (1 << 64) // bins).astype(np.uint64)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        to = np.append(at[1:], len(s))
        table[i, at < to] = s[at[at < to]]
    own = table != _EMPTY
    lenders = _lenders(bins)
    rows, cols = np.nonzero(~own & own.any(1, keepdims=True))
    for order in lenders:
        if not len(rows):
            break
        lent = order[cols]
        have = own[rows, lent]
        table[rows[have], cols[have]] = table[rows[have], lent[have]]
        rows, cols = rows[~have], cols[~have]
    return table


def band_keys(table: np.ndarray, bands: int) -> np.ndarray:
    """int64[sets, bands]: a key per band, different bands never share one by design."""
    rows = table.shape[1] // bands
    keys = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (table.shape[0], 1))
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + table[:, r::rows])
    return keys.view(np.int64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """int64[sets, BITS / 64]: whether each of BITS cells has an odd number of a set's hashes. Two sets differ in at least as many items as cells."""
    odd = np.stack([np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1 for s in sets]).astype(np.uint8)
    return np.packbits(odd, axis=1).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hashes = WordHashes()
    for part in portions(batches):
        yield part, [shingles(hashes.of(body.lower().split()), width) for body in part.column(1).to_pylist()]


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null for the empty set), keys (a bucket key per band), cells (parities)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, width):
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            keys = band_keys(signatures(sets, bands * rows), bands)
            lists, cells = (pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel())) for x in (keys, parities(sets)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists, cells], names=["doc_id", "n_shingles", "digest", "keys", "cells"])

    return spread(text_bytes(docs)).mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>, cells array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, width):
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "digest", "items"])

    return docs.mapInArrow(run, "doc_id long, digest binary, items array<long>")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp): the least node that each node of edges(a, b) reaches. Labels fall along links and pointers are halved."""
    before = mark()
    both = union_all([edges.select(F.col("a").alias("node"), F.col("b").alias("to")), edges.select(F.col("b").alias("node"), F.col("a").alias("to"))])
    links = written(both.where("node <> to").distinct(), f"{name}-links")
    labels = written(links.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("comp")), f"{name}-labels")
    while True:
        near = links.join(labels.select(F.col("node").alias("to"), "comp"), "to").groupBy("node").agg(F.min("comp").alias("near"))
        low = labels.join(near, "node", "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("low"))
        far = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        new = low.join(far, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("new"), "comp")
        new = written(new.select("node", F.col("new").alias("comp"), (F.col("new") != F.col("comp")).alias("moved")), f"{name}-labels")
        still, labels = new.where("moved").isEmpty(), new.drop("moved")
        free_since(before, links, new)
        if still:
            return labels


def _surrogates(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes with a number that is no doc_id as the node of each set that only rows without an id have."""
    ids = found.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = (0, -1) if ids.low is None else ids
    number, most = F.monotonically_increasing_id(), nodes.rdd.getNumPartitions() << 33
    if high + most < 1 << 63:
        other = F.lit(high) + 1 + number
    elif low - most >= -1 << 63:
        other = F.lit(low) - 1 - number
    else:
        raise ValueError("doc_ids leave no numbers for rows without an id")
    return nodes.withColumn("node", F.coalesce("node", other))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs.

    Words are what is left between spaces and control whites after lower-casing A-Z. A null or empty text has the empty set,
    links with nothing and is its own component. Rows that share a doc_id are one node. Rows with equal sets are linked.
    A row with a null id is a document of its own: its component_id is the smallest doc_id of its component, null where there
    is none, and of a component without any id one row is kept. Extra columns are not read; an empty table gives no rows."""
    return _linked(docs, width, threshold, bands, rows).drop("digest")


def _linked(docs: DataFrame, width: int, threshold: float, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """near_duplicates with the digests of the sets."""
    ship(docs.sparkSession)
    percent = round(threshold * 100)
    found = written(sketches(docs, width, bands, rows).withColumn("row", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), "sketches")
    nodes = found.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("cells").alias("cells"), F.min("row").alias("row"))
    nodes = written(nodes.select("digest", "node", "n", "keys", "cells", "row", F.col("node").isNull().alias("nameless")), "nodes")
    nameless = not nodes.where("node is null").isEmpty()
    if nameless:
        nodes = written(_surrogates(nodes, found), "nodes")
    # With fewer than percent / (100 - percent) shingles only equal sets are similar enough.
    searched = nodes.where(F.col("n") * (100 - percent) + (100 - percent) >= percent).select("node", "n", F.explode("keys").alias("key"))
    # What is grouped is written before it is joined to the rows: then a hot key's rows are split by adaptive execution.
    shared = written(searched.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key"), "shared-keys")
    buckets = written(searched.join(shared, "key").select("key", "node", "n", F.col("node").alias("comp")), "buckets")
    inside = written(buckets.select("node").distinct().join(nodes.select("node", "digest", "nameless"), "node"), "candidates")
    texts = text_bytes(docs).join(inside.select(F.col("node").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    items = full_sets(texts, width).join(inside.select(F.col("node").alias("doc_id"), "digest"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    items = items.select(F.col("doc_id").alias("node"), "items")
    if nameless:
        others = full_sets(text_bytes(docs.where("doc_id is null")), width).join(inside.where("nameless").select("node", "digest"), "digest")
        items = items.unionByName(others.dropDuplicates(["node"]).select("node", "items"))
    items = written(items, "sets")

    maps: list[DataFrame] = []
    leaders, cells = 1, []
    point = mark()
    while not buckets.isEmpty():
        # The leader of each of so many parts of a bucket; parts are hashed, so a large bucket is aggregated before it is shuffled.
        part = F.pmod(F.xxhash64("node", F.lit(leaders)), F.lit(leaders)) if leaders > 1 else F.lit(0)
        top = buckets.groupBy("key", part.alias("part")).agg(F.min(F.struct("node", "n", "comp", *cells)).alias("top")).select("key", "top")
        top = written(top, "leaders")
        wanted = (F.col("comp") != F.col("top.comp")) & (F.least("n", "top.n") * 100 >= F.greatest("n", "top.n") * percent)
        if cells:  # similar sets differ in at most this share of their sizes' sum
            differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"top.{c}"))) for c in cells))
            wanted &= differ * (100 + percent) <= (F.col("n") + F.col("top.n")) * (100 - percent)
        pairs = buckets.join(top, "key").where(wanted).select(F.struct(F.col("top.node").alias("node"), F.col("top.comp").alias("comp")).alias("x"), F.struct("node", "comp").alias("y"))
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        pairs = written(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb")), "pairs")
        rest = buckets.join(top.select("key", F.col("top.node").alias("node")), ["key", "node"], "left_anti")
        if not pairs.isEmpty():
            sized = pairs.join(items.withColumnRenamed("node", "b").withColumnRenamed("items", "y"), "b").join(items.withColumnRenamed("node", "a").withColumnRenamed("items", "x"), "a")
            both = F.size(F.array_intersect("x", "y"))
            tested = written(sized.select("a", "b", "ca", "cb", both.alias("both"), (F.size("x") + F.size("y") - both).alias("all")), "tested")
            edges = tested.where(F.col("both") * 100 >= F.col("all") * percent).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
            if not edges.isEmpty():
                maps.append(components(edges))
                rest = _relabelled(rest, maps[-1])
        rest = _narrowed(rest)
        if not cells:  # few rows are left after the first star; they carry the parities from now on
            cells = [f"c{i}" for i in range(BITS // 64)]
            rest = written(rest, "buckets").join(nodes.select("node", *(F.col("cells")[i].alias(c) for i, c in enumerate(cells))), "node")
        buckets = written(rest, "buckets")
        free_since(point, buckets, *maps)
        leaders *= 4

    at = nodes.select("digest", "node", "nameless", "row", F.col("node").alias("comp"))
    for labels in maps:
        at = _relabelled(at, labels)
    if nameless:
        named = F.when(~F.col("nameless"), F.col("node"))
        names = at.groupBy("comp").agg(F.min(named).alias("id"), F.min(F.when(F.col("node") == F.col("comp"), F.col("row"))).alias("lead"))
        at = at.join(names, "comp").select("digest", "id", F.when(F.col("id").isNull(), F.col("lead")).alias("lead"))
    else:
        at = at.select("digest", F.col("comp").alias("id"), F.lit(None).cast("long").alias("lead"))
    out = found.select("doc_id", "n_shingles", "digest", "row").join(at, "digest", "left")
    own = F.coalesce("id", "doc_id")
    leads = F.col("digest").isNull() | F.coalesce(F.col("row") == F.col("lead"), F.lit(False))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.when(F.col("doc_id").isNull(), leads).otherwise(own == F.col("doc_id")).alias("kept"), "digest")


def _relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    new = labels.select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    return rows.join(new, "comp", "left").withColumn("comp", F.coalesce("new", "comp")).drop("new")


def _narrowed(buckets: DataFrame) -> DataFrame:
    """Without the buckets that lie in one component."""
    wide = buckets.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    return buckets.join(written(wide, "wide-keys"), "key")


def _with_digest(docs: DataFrame, width: int) -> DataFrame:
    """(row, digest): each row of docs as a struct and the digest of its set; null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, width):
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary())], names=["row", "digest"])

    both = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))
    return both.mapInArrow(run, StructType([both.schema["row"], StructField("digest", BinaryType())]))


def kept_rows(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs whose doc_id names their component, with their columns, of any names; of a component without any id one row.

    Rows that share such a doc_id all stay, and so does every row with a null id and no words; a null text is one without words.
    No rows give no rows."""
    linked = _linked(docs, width, threshold).where("kept")
    stay = linked.select(F.col("doc_id").alias("keep_id")).where("keep_id is not null").distinct()
    out = docs.join(stay.hint("shuffle_hash"), docs["doc_id"].cast("long") == stay["keep_id"], "left_semi")
    nameless = docs.where(docs["doc_id"].isNull())
    if nameless.isEmpty():
        return out
    others = _with_digest(nameless, width)
    first = others.join(linked.where("doc_id is null").select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    rows = union_all([x.select("row") for x in (first, others.where("digest is null"))])
    return out.unionByName(rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))
