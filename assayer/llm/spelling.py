"""Spelling variants (operator 12): words of the corpus at an edit distance of one, and for each its commonest such neighbour.

The vocabulary, sorted, is cut into compact tries (an edge per run of letters without a branch) of bounded size. Some of them at a
time are broadcast; each word's automaton of distance one is run over each of them depth first, and the words in which it accepts
are the word's neighbours. Tasks reduce what they find to a count and a best neighbour per word, and a shuffle by word reduces that of
all tries. The automaton is the same for all words: after d letters at most the word's places d - 1, d and d + 1 can have been reached with
one edit, and place d with none, so a state is four bits and a step looks up three comparisons.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_since, mark, portions, ship, spread, text_bytes, union_all, written

#: Letters are U+0041 to 005A, 0061 to 007A and 00C0 to 00FF. In Latin-1 each is a byte; capitals of ASCII are lowered, all else parts words.
_LETTERS = bytes(b if b in range(0x61, 0x7B) or b >= 0xC0 else b + 32 if b in range(0x41, 0x5B) else 32 for b in range(256))


@dataclass(frozen=True)
class Setup:
    """least_length, least_times: of a word; factor: how often as common a form is at least; trie_bytes: most of a trie;
    round_bytes: of all tries that are broadcast together; waiting: distinct words a task counts before it hands them on."""

    least_length: int = 6
    least_times: int = 5
    factor: int = 5
    trie_bytes: int = 4 << 20
    round_bytes: int = 16 << 20
    waiting: int = 400_000


def runs(body: bytes) -> list[bytes]:
    """The maximal runs of letters of a UTF-8 text, in Latin-1."""
    return body.decode("utf-8", "replace").encode("latin-1", "replace").translate(_LETTERS).split()


def spoken(run: bytes, start: int) -> bytes:
    """The run, or without one letter where 199 divides the checksum of id and run. start: the checksum of the id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % 199:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """(word, n), written: the words that are long and common enough, counted over all texts of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        least = setup.least_length

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for part in portions(batches):
            for doc_id, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for one, times in Counter([r for r in runs(body) if len(r) >= least]).items():
                    word = spoken(one, start)
                    if len(word) >= least:
                        counts[word] += times
            if len(counts) > setup.waiting:
                yield flush()
                counts.clear()
        if counts:
            yield flush()

    words = spread(text_bytes(docs)).mapInArrow(run, "word string, n long")
    return written(words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= setup.least_times), "vocabulary")


@dataclass
class Trie:
    """A compact trie, level by level: node i's children are first[i] to first[i + 1] - 1, in the order of their letters; its edge has the
    letters edges[at[i]:at[i + 1]], of which letters[i] is the first; n[i] is the count of the word that ends there, or 0. Node 0 is
    the root. It has at most two nodes a word."""

    edges: bytes
    letters: bytes
    at: array
    first: array
    n: array

    @classmethod
    def of(cls, words: list[bytes], counts: list[int]) -> Trie:
        """words are distinct and sorted."""
        edges, letters = bytearray(), bytearray()
        at, first, n = array("i"), array("i"), array("q")
        # Nodes to come: the words lo to hi have `end` letters in common, the node's edge being those from `start`.
        nodes = [(0, len(words), 0, 0)]
        for lo, hi, start, end in nodes:
            whole = lo < hi and len(words[lo]) == end
            at.append(len(edges))
            first.append(len(nodes))
            n.append(counts[lo] if whole else 0)
            letters.append(words[lo][start] if end else 0)
            edges += words[lo][start:end] if lo < hi else b""
            lo += whole
            while lo < hi:
                letter = words[lo][end]
                to = bisect_left(words, words[lo][:end] + bytes([letter + 1]), lo, hi) if letter < 255 else hi
                nodes.append((lo, to, end, _common(words[lo], words[to - 1])))
                lo = to
        at.append(len(edges))
        first.append(len(nodes))
        return cls(bytes(edges), bytes(letters), at, first, n)

    def packed(self) -> list[bytes]:
        return [self.edges, self.letters, self.at.tobytes(), self.first.tobytes(), self.n.tobytes()]

    @classmethod
    def unpacked(cls, edges: bytes, letters: bytes, *rest: bytes) -> Trie:
        arrays = [array(kind) for kind in "iiq"]
        for a, raw in zip(arrays, rest, strict=True):
            a.frombytes(raw)
        return cls(edges, letters, *arrays)

    def neighbours(self, word: bytes) -> list[tuple[bytes, int]]:
        """The words at distance one with their counts."""
        edges, letters, at, first, n, step = self.edges, self.letters, self.at, self.first, self.n, STEP
        size, found, find = len(word), [], self.letters.find
        # Places of the word with one before the first and two past the last that no letter equals.
        w = b"\0" + word + b"\0\0"
        stack = [(0, 0, FIRST, b"")]
        while stack:
            node, depth, state, prefix = stack.pop()
            low, high = first[node], first[node + 1]
            x, y, z = w[depth : depth + 3]
            if state & CLEAN:
                children = range(low, high)
            else:  # no more edits: a child goes on with one of three letters at most
                children = [find(x, low, high)] if state & 1 else []
                if state & 2 and not (state & 1 and x == y):
                    children.append(find(y, low, high))
                if state & 4 and not (state & 1 and x == z or state & 2 and y == z):
                    children.append(find(z, low, high))
            for child in children:
                if child < 0:
                    continue
                c = letters[child]
                s = step[state << 3 | (x == c) | (y == c) << 1 | (z == c) << 2]
                if not s:
                    continue
                d, here, to = depth + 1, at[child] + 1, at[child + 1]
                while here < to:
                    if d > size:
                        s = 0
                        break
                    c = edges[here]
                    s = step[s << 3 | (w[d] == c) | (w[d + 1] == c) << 1 | (w[d + 2] == c) << 2]
                    if not s:
                        break
                    here += 1
                    d += 1
                if not s or d > size + 1:
                    continue
                if n[child] and d >= size - 1 and s >> (size - d + 1) & 1:
                    found.append((prefix + edges[at[child] : to], n[child]))
                if d <= size and first[child] < first[child + 1]:
                    stack.append((child, d, s, prefix + edges[at[child] : to]))
        return found


def _common(a: bytes, b: bytes) -> int:
    """Letters that both begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


#: A state after d letters: bits 0 to 2 for places d - 1, d, d + 1 reached with one edit, bit 3 for place d without any. A letter is
#: compared with the word's letters at d - 1, d, d + 1 (bits 0 to 2).
CLEAN = 8
FIRST = CLEAN | 4


def _next(state: int, same: int) -> int:
    clean = state & CLEAN
    stays = 1 if clean or state & same & 1 else 0  # a letter more than the word has, or one edit before
    goes = 2 if state & same & 2 or clean and not same & 2 else 0  # another letter
    ahead = CLEAN if clean and same & 2 else 0
    return ahead | stays | goes | (4 if state & same & 4 or ahead else 0)  # a letter less


STEP = bytes(_next(state, same) for state in range(16) for same in range(8))


#: What a word adds to a trie besides its letters, at most: two nodes.
_NODES = 34


def tries(words: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """(trie, bytes, parts), written: the sorted vocabulary in stretches, each as a trie of at most setup.trie_bytes, or of one word."""
    total = words.agg(F.sum(F.length("word") + _NODES)).first()[0] or 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[bytes] = []
        counts: list[int] = []
        size = 0

        def batch() -> pa.RecordBatch:
            packed = Trie.of(some, counts).packed()
            return pa.RecordBatch.from_arrays([pa.array([sum(map(len, packed))]), pa.array([packed], pa.list_(pa.binary()))], names=["bytes", "parts"])

        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                word = word.encode("latin-1")
                if some and size + len(word) + _NODES > setup.trie_bytes:
                    yield batch()
                    some, counts, size = [], [], 0
                some.append(word)
                counts.append(n)
                size += len(word) + _NODES
        if some:
            yield batch()

    parts = int(-(-total // setup.trie_bytes)) or 1
    cut_up = words.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(cut, "bytes long, parts array<binary>")
    return written(cut_up.select(F.monotonically_increasing_id().alias("trie"), "bytes", "parts"), "tries")


def neighbours(words: DataFrame, shards: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """(word, n, n_near, best, best_n): one row per word of words(word, n); best: of its near words the commonest, then the first."""
    spark = words.sparkSession
    rounds: list[list[int]] = [[]]
    held = 0
    for r in shards.select("trie", "bytes").orderBy("trie").collect():  # a row per trie
        if rounds[-1] and held + r.bytes > setup.round_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append(r.trie)
        held += r.bytes
    total = words.count()
    dealt = written(words.select("word", "n").repartition(max(1, min(total // 1_000, 20_000))), "words")
    found = []
    for ids in rounds:
        sent = spark.sparkContext.broadcast([[bytes(x) for x in r.parts] for r in shards.where(F.col("trie").isin(ids)).collect()] if ids else [])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = [Trie.unpacked(*parts) for parts in sent.value]
            for b in batches:
                some = b.column(0).to_pylist()
                n_near, best, best_n = [], [], []
                for word in some:
                    own = word.encode("latin-1")
                    near = [x for t in held for x in t.neighbours(own)]
                    top = min(near, key=lambda x: (-x[1], x[0]), default=(None, None))
                    n_near.append(len(near))
                    best.append(top[0] and top[0].decode("latin-1"))
                    best_n.append(top[1])
                arrays = [b.column(0), b.column(1), pa.array(n_near, pa.int64()), pa.array(best, pa.string()), pa.array(best_n, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["word", "n", "n_near", "best", "best_n"])

        found.append(written(dealt.mapInArrow(run, "word string, n long, n_near long, best string, best_n long"), "near"))
        sent.unpersist()
    reduced = union_all(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))).alias("top"))
    return written(reduced.select("word", "n", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n")), "neighbours")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root), written, of forms(word, form): the last word that forms lead to. Pointers are doubled; forms rise in count, so there is
    no circle, and the rounds are few."""
    links = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        point = mark()
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = written(moved, "roots")
        still = moved.where("moved").isEmpty()
        links = moved.drop("moved")
        free_since(point, moved)
        if still:
            return links


def variants(docs: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the vocabulary of docs(doc_id, text).

    A null or empty text has no words; a null id is an empty one in the checksum that thins runs. Repeated rows count as often as they
    occur. A word longer than a trie has one to itself. Of near words as common as each other the first in the order of code points is the
    best. An empty table, or one without common words, gives no rows. Other columns are not read."""
    ship(docs.sparkSession)
    words = vocabulary(docs, setup)
    near = neighbours(words, tries(words, setup), setup)
    is_form = F.col("best_n") >= F.col("n") * setup.factor
    near = near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n"))
    last = roots(near.where("form is not null"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
