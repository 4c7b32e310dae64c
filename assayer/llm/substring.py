"""Substring deduplication by recompression (operator 7).

A document is a string of word symbols. A round first names maximal runs of one symbol, then names pairs (a, b) where a is in
the left and b in the right half of the alphabet; halves and names are hashes of what they stand for, so every task names alike
and equal substrings get equal symbols except near their ends. With each symbol goes the stretch of words on which it depends;
a window of WINDOW words fixes all symbols whose stretch lies in it. After three rounds a stretch without runs has at most 36
words, so every window of 50 fixes some symbol of the third level; in windows with runs a lower level steps in, at the last
the words themselves. Of the symbols of the highest level that a window fixes it picks the least by hash: equal windows pick
the same symbol, wherever they stand. Only windows whose symbol occurs in another document can repeat there.

Consecutive windows that pick one occurrence form a stretch, named by two independent 64-bit hashes of all its words. Equal
stretches are one class: of its documents the smallest stands for it, and the others lose the whole stretch. Only where a
symbol has several classes are their stretches spelled out in windows, once a class, to be compared as hashes of the same kind.
So a passage or text with many copies costs a row per copy and stretch, not one per copy and window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, free_since, mark, mix, portions, ship, spread, text_bytes, written

WINDOW, LEVELS = 50, 3
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = {int(b): np.uint64(pow(int(b), -1, 1 << 64)) for b in (_B1, _B2)}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out)


def stretch_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = _B1) -> np.ndarray:
    """A hash of words[start:end] for each pair, from prefix sums: sum of words[i] * base**(i - start)."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(base, len(words) + 1)[:-1], dtype=np.uint64)])
    undo = _powers(_INVERSE[int(base)], len(words) + 1)
    return mix((total[end] - total[start]) * undo[start] + (end - start).astype(np.uint64))


class Level:
    """Symbols with the words [start, end) that they stand for and the words [low, high) on which they depend."""

    def __init__(self, sym, start, end, low, high):
        self.sym, self.start, self.end, self.low, self.high = sym, start, end, low, high

    def _near(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before = np.concatenate([[-1], self.low[:-1]])
        after = np.concatenate([self.high[1:], [len(where) and self.high[-1] + 1]])
        return before, after

    def runs(self) -> Level:
        """Maximal runs of a symbol become one; every symbol now depends on its neighbours, which show where the run ends."""
        n = len(self.sym)
        first = np.concatenate([[True], self.sym[1:] != self.sym[:-1]])
        at = np.flatnonzero(first)
        last = np.append(at[1:], n) - 1
        before, after = self._near(self.sym)
        length = (last - at + 1).astype(np.uint64)
        sym = np.where(length > 1, mix(self.sym[at] * _B2 + length), self.sym[at])
        return Level(sym, self.start[at], self.end[last], before[at], after[last])

    def pairs(self, round_no: int) -> Level:
        """(left, right) neighbours become one; a lone left symbol depends on what follows it, a lone right one on what precedes."""
        right = (mix(self.sym + np.uint64(round_no * int(_B1) % (1 << 64))) >> np.uint64(40)) & np.uint64(1) == 1
        joined = np.concatenate([~right[:-1] & right[1:], [False]])
        second = np.concatenate([[False], joined[:-1]])
        before, after = self._near(self.sym)
        low, high = np.where(right & ~second, before, self.low), np.where(~right & ~joined, after, self.high)
        at = np.flatnonzero(~second)
        two = joined[at]
        to = at + two
        nxt = np.minimum(to, len(self.sym) - 1)
        sym = np.where(two, mix(mix(self.sym[at] * _B1 + np.uint64(round_no)) + self.sym[nxt]), self.sym[at])
        return Level(sym, self.start[at], self.end[nxt], low[at], high[nxt])


def parsed(words: np.ndarray, levels: int = LEVELS) -> list[Level]:
    at = np.arange(len(words))
    out = [Level(words, at, at + 1, at, at + 1)]
    for r in range(1, levels + 1):
        out.append(out[-1].runs().pairs(r))
    return out


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the least, leftmost value in [a, b) for each pair, by a sparse table."""
    tables, size = [np.arange(len(values))], 1
    most = int((b - a).max())
    while 2 * size <= most:
        x, y = tables[-1][:-size], tables[-1][size:]
        tables.append(np.where(values[x] <= values[y], x, y))
        size *= 2
    k = np.frexp((b - a).astype(np.float64))[1] - 1
    out = np.empty(len(a), np.int64)
    for j, t in enumerate(tables):
        m = k == j
        x, y = t[a[m]], t[b[m] - (1 << j)]
        out[m] = np.where(values[x] <= values[y], x, y)
    return out


def anchors(words: np.ndarray, valid: np.ndarray, window: int = WINDOW, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows that pick one symbol occurrence: the key of what the symbol depends on, the first window, their number.

    valid: the starts of windows, ascending."""
    keys = np.zeros(len(valid), np.uint64)
    place = np.full(len(valid), -1)
    open_ = np.arange(len(valid))
    n = len(words)
    for depth, level in reversed(list(enumerate(parsed(words, levels)))):
        if not len(open_):
            break
        inside = (level.low >= 0) & (level.high <= n) & (level.high - level.low <= window)
        at = np.flatnonzero(inside)
        low, high = level.low[at], level.high[at]
        if len(at):
            # low and high never fall from symbol to symbol, so a window fixes a contiguous range of them.
            upto = np.concatenate([[0], np.cumsum(np.bincount(low, minlength=n + 1))])
            ends = np.concatenate([[0], np.cumsum(np.bincount(high, minlength=n + 1))])
            a, b = upto[valid[open_]], ends[valid[open_] + window + 1]
            some = a < b
            own = mix(stretch_hashes(words, low, high) + np.uint64(depth))
            chosen = _least(own, a[some], b[some]) if some.any() else np.empty(0, np.int64)
            keys[open_[some]] = own[chosen]
            place[open_[some]] = at[chosen] * (levels + 1) + depth
            open_ = open_[~some]
    starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)])) if len(valid) else np.empty(0, np.int64)
    return keys[starts], valid[starts], np.diff(np.append(starts, len(valid)))


#: Documents of a group: null, which min and max pass over, comes before all other ids.
_SEVERAL = "low < high OR (nameless AND high IS NOT NULL)"


def _ids() -> tuple[Column, Column, Column]:
    return F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(F.col("doc_id").isNull()).alias("nameless")


def _later() -> Column:
    """Whether the group of _ids has an id before the row's."""
    return F.coalesce(F.col("doc_id").isNotNull() & (F.col("nameless") | (F.col("low") < F.col("doc_id"))), F.lit(False))


def _tag(doc_id: Column, body: Column) -> Column:
    """One number for a row's id and text; only with an equal id does it stand for the row."""
    return F.xxhash64(doc_id.cast("long"), body)


def _same_id(a: Column, b: Column) -> Column:
    """a <=> b in a form that stays a condition beside the tag, so that the tag alone deals the rows."""
    return F.coalesce(a == b, a.isNull() & b.isNull())


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _flat(docs: list[list[bytes]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The documents' words one after the other, each document followed by a symbol of its own; where each begins."""
    parts = []
    for i, words in enumerate(docs):
        parts += [hashes.of(words), mix(np.array([i], np.uint64) + np.uint64(1 << 63))]
    return np.concatenate([*parts, np.empty(0, np.uint64)]), np.cumsum([0, *(len(w) + 1 for w in docs)])


def _names(flat: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each stretch."""
    return stretch_hashes(flat, start, start + length), stretch_hashes(mix(flat + _B2), start, start + length, _B2)


def _first_of(owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of the first occurrence of each (owner, a, b), in the order of owners."""
    if not len(owner):
        return np.empty(0, np.int64)
    order = np.lexsort((b, a, owner))
    o, x, y = owner[order], a[order], b[order]
    return order[np.concatenate([[True], (o[1:] != o[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])]


def _ranges(first: np.ndarray, number: np.ndarray) -> np.ndarray:
    """first[0], ..., first[0] + number[0] - 1, first[1], ..."""
    to = np.cumsum(number)
    return np.repeat(first - (to - number), number) + np.arange(to[-1] if len(to) else 0)


_READ = "doc_id long, tag long, n_words long, sha256 string, keys array<long>, firsts array<int>, numbers array<int>, s1 array<long>, s2 array<long>, new array<boolean>"


def _stretches(keyed: DataFrame, window: int, levels: int) -> DataFrame:
    """A row per row of keyed(doc_id, body, tag) with its word sequence's digest and its stretches. new: the first of its class in the text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in portions(batches, 1_500_000):
            words = [body.split() for body in part.column(1).to_pylist()]
            flat, begin = _flat(words, hashes)
            valid = np.concatenate([*(np.arange(b, b + len(w) - window + 1) for b, w in zip(begin, words, strict=False) if len(w) >= window), np.empty(0, np.int64)]).astype(np.int64)
            keys, first, number = anchors(flat, valid, window, levels)
            s1, s2 = _names(flat, first, number + window - 1)
            to = np.searchsorted(first, begin)
            owner = np.repeat(np.arange(len(words)), np.diff(to))
            new = np.zeros(len(first), bool)
            new[_first_of(owner, s1, s2)] = True
            offsets = pa.array(to, pa.int32())
            lists = (keys.view(np.int64), (first - begin[owner]).astype(np.int32), number.astype(np.int32), s1.view(np.int64), s2.view(np.int64), new)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([len(w) for w in words], pa.int64()), pa.array(map(_sha, words), pa.string()), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists)],
                names=["doc_id", "tag", "n_words", "sha256", "keys", "firsts", "numbers", "s1", "s2", "new"],
            )

    return spread(keyed).mapInArrow(read, _READ)


def _places(part: pa.RecordBatch, name: str, hashes: WordHashes) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, flat symbols and begins of the texts; owner, first and number of their stretches that are in the list of this name."""
    column = lambda c: part.column(part.schema.get_field_index(c))
    words = [body.split() for body in column("body").to_pylist()]
    flat, begin = _flat(words, hashes)
    owner, first, number = [], [], []
    for i in range(part.num_rows):
        listed = lambda c, i=i: column(c)[i].values.to_numpy(zero_copy_only=False)
        mine = column(name)[i].values
        a, b = (mine.field(k).to_numpy(zero_copy_only=False) for k in ("s1", "s2"))
        at = np.flatnonzero(np.isin(listed("s1"), a) & np.isin(listed("s2"), b))
        owner.append(np.full(len(at), i))
        first.append(listed("firsts")[at] + begin[i])
        number.append(listed("numbers")[at])
    return words, flat, begin, *(np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (owner, first, number))


def repeats(docs: DataFrame, window: int = WINDOW, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """What to remove: (doc_id, tag, n_words, sha256, again) per row of docs, and (doc_id, sha256, kept, n_removed, kept_sha256)
    of the documents that may lose some, not all, of their words. again: a smaller doc_id has the same word sequence."""
    ship(docs.sparkSession)
    keyed = text_bytes(docs).withColumn("tag", _tag(F.col("doc_id"), F.col("body")))
    point = mark()
    found = written(_stretches(keyed, window, levels).withColumn("row", F.monotonically_increasing_id()), "stretches")

    # What is grouped is written before it is joined to the rows: then a hot key's rows are split by adaptive execution.
    copies = written(found.groupBy("sha256").agg(*_ids()).where(_SEVERAL), "copies")
    rows = written(found.select("row", "doc_id", "tag", "n_words", "sha256").join(copies, "sha256", "left").select("row", "doc_id", "tag", "n_words", "sha256", _later().alias("again")), "word-sequences")

    # Copies lose all their words; the search is among the first documents of each word sequence, in one spelling of its white space.
    one = rows.where(~F.col("again") & (F.col("n_words") >= window)).groupBy("sha256", "doc_id").agg(F.min("row").alias("row")).select("row")
    stretch = F.explode(F.arrays_zip("keys", "s1", "s2", "new")).alias("p")
    picked = found.join(one.hint("shuffle_hash"), "row", "left_semi").select("row", "doc_id", stretch).where("p.new").select("row", "doc_id", F.col("p.keys").alias("key"), "p.s1", "p.s2")
    shared = written(picked.groupBy("key").agg(*_ids()).where(_SEVERAL).select("key"), "shared-keys")
    picked = written(picked.join(shared, "key"), "shared-stretches")
    classes = written(picked.groupBy("key", "s1", "s2").agg(*_ids()), "classes")
    several = written(classes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("contested")), "contested")
    told = picked.join(classes, ["key", "s1", "s2"]).select("row", "key", "s1", "s2", _later().alias("later")).join(several, "key", "left").where("later OR contested")
    mine = F.struct("s1", "s2")
    lists = told.groupBy("row").agg(F.collect_list(F.when(F.col("later"), mine)).alias("whole"), F.collect_list(F.when(~F.col("later"), mine)).alias("open"))
    lists = found.select("row", F.col("doc_id").alias("_id"), "tag", "sha256", "firsts", "numbers", "s1", "s2").join(lists, "row")
    texts = keyed.join(lists.hint("shuffle_hash"), "tag").where(_same_id(F.col("doc_id"), F.col("_id"))).drop("_id")
    texts = written(texts.dropDuplicates(["tag", "row"]).drop("tag"), "searched")
    free_since(point, rows, texts)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in portions(batches, 400_000):
            _, flat, _, owner, first, number = _places(part, "open", hashes)
            at, own = _ranges(first, number), np.repeat(owner, number)
            h1, h2 = _names(flat, at, window)
            pick = _first_of(own, h1, h2)
            rows_, ids = (part.column(part.schema.get_field_index(c)).take(pa.array(own[pick])) for c in ("row", "doc_id"))
            yield pa.RecordBatch.from_arrays([rows_, ids, pa.array(h1[pick].view(np.int64)), pa.array(h2[pick].view(np.int64))], names=["row", "doc_id", "h1", "h2"])

    windows = written(texts.where(F.size("open") > 0).mapInArrow(spelled, "row long, doc_id long, h1 long, h2 long"), "windows")
    least = written(windows.groupBy("h1", "h2").agg(*_ids()).where(_SEVERAL), "shared-windows")
    hits = windows.join(least, ["h1", "h2"]).where(_later()).groupBy("row").agg(F.collect_list(F.struct("h1", "h2")).alias("hits"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in portions(batches):
            words, flat, begin, owner, first, number = _places(part, "whole", hashes)
            edge = np.zeros(len(flat) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + number + window - 1, -1)
            _, _, _, owner, first, number = _places(part, "open", hashes)
            at, own = _ranges(first, number), np.repeat(owner, number)
            h1, h2 = (h.view(np.int64) for h in _names(flat, at, window))
            ends = np.searchsorted(own, np.arange(part.num_rows + 1))
            hits = part.column(part.schema.get_field_index("hits"))
            for i in range(part.num_rows):
                if hits[i].is_valid and len(hits[i].values):
                    a, b = (hits[i].values.field(k).to_numpy(zero_copy_only=False) for k in ("h1", "h2"))
                    here = slice(ends[i], ends[i + 1])
                    gone = at[here][np.isin(h1[here], a) & np.isin(h2[here], b)]
                    np.add.at(edge, gone, 1)
                    np.add.at(edge, gone + window, -1)
            stay = np.cumsum(edge)[:-1] == 0
            kept = [b" ".join([w[i] for i in np.flatnonzero(stay[b : b + len(w)])]) for b, w in zip(begin, words, strict=False)]
            removed = [len(w) - int(stay[b : b + len(w)].sum()) for b, w in zip(begin, words, strict=False)]
            ids, own_sha = (part.column(part.schema.get_field_index(c)) for c in ("doc_id", "sha256"))
            shas = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([ids, own_sha, pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "sha256", "kept", "n_removed", "kept_sha256"])

    cut = texts.join(hits, "row", "left").mapInArrow(remove, "doc_id long, sha256 string, kept binary, n_removed long, kept_sha256 string")
    return rows.drop("row"), cut.where("n_removed > 0")


def substring_dedup(docs: DataFrame, window: int = WINDOW, levels: int = LEVELS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per row of docs.

    Words are what stands between spaces and control whites. A word goes if a window of words around it also starts in a
    document with a smaller doc_id; windows are judged on the input. A null or empty text has no words; a text of fewer words
    than a window loses none; rows that share a doc_id never take words from each other. Null is one such id, before all others.
    An empty table gives no rows; extra columns are not read."""
    rows, cut = repeats(docs, window, levels)
    whole = F.col("again") & (F.col("n_words") >= window)
    return rows.join(cut.drop("kept"), ["doc_id", "sha256"], "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def kept_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeats cut from text (and n_chars set anew where there is such a column): all its rows, columns and order of columns.

    Texts without repeats, null and empty ones stay as they are; a text that is all repeats becomes empty. Rows alike are cut
    alike. No rows give no rows. Columns may have any names."""
    rows, cut = repeats(docs, window)
    whole = rows.where(F.col("again") & (F.col("n_words") >= window)).select("doc_id", "tag", F.lit("").alias("new"))
    part = cut.select("doc_id", "sha256", "kept").join(rows.select("doc_id", "sha256", "tag"), ["doc_id", "sha256"])
    changed = whole.unionByName(part.select("doc_id", "tag", F.col("kept").cast("string").alias("new"))).dropDuplicates(["tag", "doc_id"])
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(F.struct("*").alias("row"), _tag(F.col("doc_id"), body).alias("tag"))
    both = keyed.join(changed.hint("shuffle_hash"), (keyed["tag"] == changed["tag"]) & _same_id(F.col("row.doc_id").cast("long"), changed["doc_id"]), "left")
    out = {f.name: F.col("row").getField(f.name) for f in docs.schema}
    out["text"] = F.coalesce("new", out["text"])
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("new").isNull(), out["n_chars"]).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType)
    return both.select(*(v.alias(k) for k, v in out.items()))
