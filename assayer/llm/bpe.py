"""Byte-level BPE (operator 2): a codec for whole texts, and encoding and decoding by a monoid tree.

A text is cut in halves down to leaves; a leaf is encoded alone; two neighbours are joined by re-encoding a window around
their boundary. A position q with a non-space character before it and white space at it always starts a match of the split
pattern, whatever stands to its left, and the matches before q see no further than q. So tokens left of such a position and
right of another are the same in the parts and in the whole: a window between two of them, grown until it reaches them or
the ends of the parts, is all that a join has to encode anew. Decoding joins byte strings up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame

from .common import portions, ship, spread, text_bytes

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_joins long"
LEAF = 2048


class Codec:
    """A vocabulary: encodes a text to ids packed as little-endian unsigned 32-bit integers, and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = {i: b for b, i in ranks.items()}
        self.sizes = np.array([len(self.pieces.get(i, b"")) for i in range(max(self.pieces, default=-1) + 1)], np.int64)

    def encode(self, text: str) -> bytes:
        return self.bpe.encode_to_numpy(text).astype("<u4", copy=False).tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


@lru_cache(4)
def codec(path: str) -> Codec:
    """From a rank file, or from the vocabulary of a byte-level BPE in JSON (ids in the order of the merges)."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    return Codec({bytes(map(shown.__getitem__, k)): v for k, v in vocab.items() if not (k.startswith("<|") and k.endswith("|>"))})


_CUT = re.compile(r"(?<=\S)(?=[\t\n\v\f\r ])")


def _cut_left(text: str, start: int, at: int) -> int:
    """The last sure cut in (start, at), else start; the window doubles until one is in it."""
    size = 64
    while True:
        low = max(start, at - size)
        found = [m.start() for m in _CUT.finditer(text, low, at) if m.start() > low]
        if found:
            return found[-1]
        if low == start:
            return start
        size *= 2


def _cut_right(text: str, at: int, end: int) -> int:
    """The first sure cut in (at, end), else end."""
    size = 64
    while True:
        high = min(end, at + size)
        found = next((m.start() for m in _CUT.finditer(text, at, high) if at < m.start() < high), None)
        if found is not None:
            return found
        if high == end:
            return end
        size *= 2


class Tree:
    """Encoding of one text as a monoid of segments (start, end, ids)."""

    def __init__(self, codec: Codec, text: str, leaf: int = LEAF):
        self.codec, self.text, self.leaf, self.joins = codec, text, max(1, leaf), 0

    def encode(self) -> np.ndarray:
        return self._encode(0, len(self.text))

    def _encode(self, start: int, end: int) -> np.ndarray:
        if end - start <= self.leaf:
            return np.frombuffer(self.codec.encode(self.text[start:end]), "<u4")
        half = (start + end) // 2
        return self._join(self._encode(start, half), self._encode(half, end), start, half, end)

    def _join(self, left: np.ndarray, right: np.ndarray, start: int, at: int, end: int) -> np.ndarray:
        self.joins += 1
        a, b = _cut_left(self.text, start, at), _cut_right(self.text, at, end)
        window = np.frombuffer(self.codec.encode(self.text[a:b]), "<u4")
        keep = len(left) - self._tokens(left[::-1], len(self.text[a:at].encode()))
        skip = self._tokens(right, len(self.text[at:b].encode()))
        return np.concatenate([left[:keep], window, right[skip:]])

    def _tokens(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many of the first ids make up n_bytes; the cut is an edge of tokens."""
        if not n_bytes:
            return 0
        some = 64
        while True:
            total = np.cumsum(self.codec.sizes[ids[:some]])
            if total[-1] >= n_bytes or some >= len(ids):
                n = int(np.searchsorted(total, n_bytes)) + 1
                if total[n - 1] != n_bytes:
                    raise AssertionError("a cut inside a token")
                return n
            some *= 4


def decode_tree(codec: Codec, ids: np.ndarray, leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return codec.decode(ids)
    half = len(ids) // 2
    return decode_tree(codec, ids[:half], leaf) + decode_tree(codec, ids[half:], leaf)


def encode_decode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """One row per row of docs: ids of the whole text (null: empty) by the ranks in path, and the bytes decoded from them.

    An empty text has no tokens and the digest of no bytes. Repeated rows are encoded each for itself and null ids stay
    null; other columns are not read; no rows give no rows. No shuffle: a text is encoded where it is read."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = codec(path)
        for part in portions(batches, 8_000_000):
            out: list[tuple] = []
            for doc_id, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                tree = Tree(by, body.decode("utf-8", "replace"), leaf)
                ids = tree.encode()
                out.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode_tree(by, ids)).hexdigest(), tree.joins))
            kinds = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_joins"])

    return spread(text_bytes(docs)).mapInArrow(run, OUT)
