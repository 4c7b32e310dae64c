"""Alignment of two tokenizers' tokens (operator 13).

Each text is encoded by a byte-level BPE (A) and by a piece BPE (B), and the ends of the tokens, counted in bytes, are merged by two
pointers: where both have an end the text is cut into groups, and the two tokens that end there are linked. Tasks give the groups as a
digest and the links of a document as pairs of ids with their number; Spark counts the pairs of all documents, takes each side's largest
counts, and joins both back to the documents' links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from .bpe import Codec, codec
from .common import ship, spread, text_bytes, written

SPACE = "▁"
#: Most pairs of ids whose counts are broadcast to the documents' links (40 bytes a pair at most); of more, both sides are shuffled.
MOST_PAIRS = 1_000_000


class Pieces:
    """The piece BPE. No piece has the mark of a space behind another character, so that a text falls into stretches, a run of spaces and
    what follows up to the next space, that are encoded alike alone and in the text; common ones are encoded once."""

    BOUND, LONGEST = 400_000, 64
    _STRETCH = re.compile(r" +[^ ]*")

    def __init__(self, path: str):
        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        raw = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if self.model.is_byte(i) and (m := raw.fullmatch(p)) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array(list(map(len, self.bytes)), np.int64)
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.space = pieces.index(SPACE) if SPACE in pieces else None
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        """Of a text that stands behind the space that the model puts before it."""
        ids = self.model.encode(text) if text else [self.space]
        return np.array(ids, "<u4").tobytes()

    def _stretch(self, stretch: str) -> bytes:
        if len(stretch) > self.LONGEST:
            return self._ids(stretch[1:])
        found = self.known.get(stretch)
        if found is None:
            if len(self.known) >= self.BOUND:
                self.known.clear()
            found = self.known[stretch] = self._ids(stretch[1:])
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text that is not empty."""
        if not self.apart or self.space is None or SPACE in text:
            return np.frombuffer(self._ids(text), "<u4")
        return np.frombuffer(b"".join(map(self._stretch, self._STRETCH.findall(" " + text))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


@lru_cache(2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places i, j where the rising ends a[i] and b[j] are equal. The pointer of b that belongs to each of a comes from a search of all of
    a at once."""
    j = np.searchsorted(b, a)
    i = np.flatnonzero(b[np.minimum(j, len(b) - 1)] == a)
    return i, j[i]


class Shown:
    """Decimal ids with what follows them, as bytes: a comma within a group's side, a bar between the sides, a semicolon behind a group."""

    def __init__(self, n: int):
        self.parts = [b"%d%s" % (i, mark) for i in range(n) for mark in (b",", b"|", b";")]

    def of(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> bytes:
        """`a1,a2|b1;...` of groups that end with a's tokens i and b's tokens j."""
        side_a, side_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        side_a[i], side_b[j] = 1, 2
        group_a, group_b = np.searchsorted(i, np.arange(len(a))), np.searchsorted(j, np.arange(len(b)))
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.concatenate([[0], j + 1])[group_a]] = a.astype(np.int64) * 3 + side_a
        out[np.arange(len(b)) + (i + 1)[group_b]] = b.astype(np.int64) * 3 + side_b
        return b"".join(map(self.parts.__getitem__, out.tolist()))[:-1]


@lru_cache(2)
def _shown(n: int) -> Shown:
    return Shown(n)


ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def aligned(text: str, by_a: Codec, by_b: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of both sides, and the places of the tokens that end groups; all empty where a side's bytes are not those of the text behind a
    space."""
    none = np.empty(0, np.int64)
    if not text:
        return none, none, none, none
    whole = f" {text}".encode()
    a, b = np.frombuffer(by_a.encode(" " + text), "<u4"), by_b.encode(text)
    if by_a.decode(a) != whole or by_b.decode(b) != whole:
        return none, none, none, none
    return a, b, *merged(np.cumsum(by_a.sizes[a]), np.cumsum(by_b.sizes[b]))


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """ROW per row of docs: the digest of its groups, and its links as pairs of ids with their number."""
    ship(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_a, by_b = codec(path_a), _pieces(path_b)
        shown = _shown(max(len(by_a.sizes), len(by_b.sizes)))
        width = len(by_b.sizes)
        for p in parts:
            out: list[tuple] = []
            size = 0
            for doc_id, body in zip(p.doc_id, p.body, strict=True):
                a, b, i, j = aligned(body.decode("utf-8", "replace"), by_a, by_b)
                pairs, times = np.unique(a[i].astype(np.int64) * width + b[j], return_counts=True)
                sha = hashlib.sha256(shown.of(a, b, i, j)).hexdigest() if len(a) else ""
                out.append((doc_id, len(a), len(b), len(i), len(i), sha, (pairs // width).astype(np.int32), (pairs % width).astype(np.int32), times.astype(np.int32)))
                size += len(body)
                if size > 4_000_000:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in ROW.split(", ")]
    return spread(text_bytes(docs)).mapInPandas(run, ROW)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of docs(doc_id, text).

    A's vocabulary is a byte-level BPE's, given ` text`; B's is a piece model's, which puts the space itself. Strings of special tokens are
    plain text. n_best: the document's links whose pair is as common as any of its B id; count_sum: its links' pairs' counts, added up.
    A null or empty text, or one that a side does not give back byte by byte, has zeros and an empty digest. Repeated rows count
    as often as they occur; null ids stay null. An empty table gives no rows; other columns are not read."""
    found = written(links(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "links", "zstd")
    each = found.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("x")).select("row", "x.a", "x.b", F.col("x.times").cast("long").alias("times"))
    counts = written(each.groupBy("a", "b").agg(F.sum("times").alias("n")), "pairs")
    most_a, most_b = (counts.groupBy(c).agg(F.max("n").alias(f"most_{c}")) for c in "ab")
    pairs = written(counts.join(most_a, "a").join(most_b, "b").select("a", "b", "n", "most_a", "most_b"), "counted")
    few = pairs.count() <= MOST_PAIRS
    joined = each.join(F.broadcast(pairs) if few else pairs, ["a", "b"])
    best = F.sum(F.when(F.col("n") == F.col("most_b"), F.col("times")).otherwise(0))
    summed = written(joined.groupBy("row").agg(best.alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")), "sums")
    some = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.drop("a", "b", "times").join(summed, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", some("n_best"), some("count_sum"), "groups_sha256")
