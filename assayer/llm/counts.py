"""Token counts under edits (operator 4): a segment tree over pre-token segments of each document, kept as a table.

The text is cut at sure cuts (see bpe) into segments of some hundred characters; the leaves of a complete binary tree hold
the segments' token counts, inner nodes their sums. `trees` encodes every document once and keeps segments and counts;
`edit_trees` works from such a table, not from the documents: an edit re-encodes the segments that it touches and one beside
them on either side when their common cut may have moved; their text then lives in the first of these leaves and the sums on
the paths above are corrected. The tree keeps its shape, and the edited trees can be written and edited again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _CUT, Codec, codec
from .common import portions, ship, spread, text_bytes, written

SEGMENT = 256
TREE = "doc_id long, n_bytes long, n_chars long, segments array<string>, tokens array<int>"
EDITED = "doc_id long, n_tokens long, n_edits int, n_tokens_edited long, chars_edited long, chars_encoded long, text_crc32 long"


class TokenTree:
    def __init__(self, codec: Codec, texts: list[str], tokens: list[int] | None = None):
        """Of segments; their tokens are counted where they are not known."""
        self.codec, self.texts, self.encoded = codec, texts, 0
        width = 1 << max(0, len(texts) - 1).bit_length()
        self.width = width
        self.tokens, self.chars = np.zeros(2 * width, np.int64), np.zeros(2 * width, np.int64)
        self.tokens[width : width + len(texts)] = list(map(self._count, texts)) if tokens is None else tokens
        self.chars[width : width + len(texts)] = list(map(len, texts))
        low = width
        while low > 1:
            for sums in (self.tokens, self.chars):
                sums[low // 2 : low] = sums[low : 2 * low : 2] + sums[low + 1 : 2 * low : 2]
            low //= 2
        self.encoded = 0

    @classmethod
    def of(cls, codec: Codec, text: str, segment: int = SEGMENT) -> TokenTree:
        cuts, last = [0], 0
        for m in _CUT.finditer(text):
            if m.start() - last >= segment:
                last = m.start()
                cuts.append(last)
        cuts.append(len(text))
        return cls(codec, [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])

    @property
    def leaves(self) -> np.ndarray:
        """The tokens of the segments."""
        return self.tokens[self.width : self.width + len(self.texts)]

    def _count(self, part: str) -> int:
        self.encoded += len(part)
        return len(self.codec.encode(part)) // 4

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(self.texts)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at, and the characters before that leaf."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at - before >= self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return node - self.width, before

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters [start, end) by new and put the sums right."""
        size = self.length
        start = max(0, min(start, size))
        end = max(start, min(end, size))
        if size == 0:
            return self._put(0, 0, new)
        # A cut stays sure only if neither of the characters at it changes: so the one before and the one after belong to it.
        first, before = self._leaf(max(0, start - 1))
        last, at = self._leaf(min(size - 1, end))
        first, last = min(first, len(self.texts) - 1), min(last, len(self.texts) - 1)
        whole = "".join(self.texts[first : last + 1])
        self._put(first, last, whole[: start - before] + new + whole[end - before :])
        return None

    def _put(self, first: int, last: int, text: str) -> None:
        for i in range(first, last + 1):
            part = text if i == first else ""
            self.texts[i] = part
            more, longer = self._count(part) - self.tokens[self.width + i], len(part) - self.chars[self.width + i]
            node = self.width + i
            while node:
                self.tokens[node] += more
                self.chars[node] += longer
                node //= 2


def planned_edits(n_chars: Column, doc_id: Column) -> Column:
    """Three edits that follow from the text's length and id: a replacement, an insertion and a deletion, in this order."""
    at = lambda k: (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("None")).cast("binary")) * k % (n_chars + 1)).cast("long")
    edit = lambda start, end, new: F.struct(start.alias("start"), end.alias("end"), F.lit(new).alias("new"))
    return F.array(edit(at(1), at(1) + 9, " replaced words"), edit(at(7), at(7), "in sert\n"), edit(at(13), at(13) + 5, ""))


def trees(docs: DataFrame, path: str, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, n_bytes, n_chars, segments, tokens), one row per row of docs, each text encoded once. A null text is empty: one segment of
    no tokens. Repeated rows have a tree each, null ids stay null; no rows give no rows. Other columns are not read."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = codec(path)
        for part in portions(batches, 4_000_000):
            built = [TokenTree.of(by, body.decode("utf-8", "replace"), segment) for body in part.column(1).to_pylist()]
            sizes = pc.binary_length(part.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), sizes, pa.array([t.length for t in built], pa.int64()), pa.array([t.texts for t in built], pa.list_(pa.string())), pa.array([t.leaves for t in built], pa.list_(pa.int32()))],
                names=["doc_id", "n_bytes", "n_chars", "segments", "tokens"],
            )

    return spread(text_bytes(docs)).mapInArrow(run, TREE)


def with_edits(kept: DataFrame, edits: DataFrame) -> DataFrame:
    """The trees with a column of their edits(doc_id, place, start, end, new), in the order of place; a tree without edits has none."""
    one = F.struct(F.col("place"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce("new", F.lit("")).alias("new"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["new"].alias("new")))
    per = edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(listed.alias("edits"))
    return kept.join(per, "doc_id", "left").select(*kept.columns, F.coalesce("edits", F.array().cast("array<struct<start: long, end: long, new: string>>")).alias("edits"))


def edit_trees(kept: DataFrame, path: str, with_trees: bool = False) -> DataFrame:
    """What the edits of kept(trees' columns, edits array<struct<start, end, new>>) do, one row per row: tokens before and after them,
    applied one after the other, and the characters that had to be encoded. An edit's range is in characters and is clipped to the text
    as it then is. with_trees: with the edited trees' columns, so that they can be kept and edited again.

    Rows stay apart whatever their ids, null ones too; no rows give no rows; other columns are not read. The tree of an empty text can be
    edited as any other."""
    ship(kept.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = codec(path)
        for part in portions(batches, 4_000_000, sizes="n_bytes"):
            out: list[tuple] = []
            for doc_id, texts, tokens, edits in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "segments", "tokens", "edits")), strict=True):
                tree = TokenTree(by, texts, tokens)
                before = tree.total
                for e in edits:
                    tree.edit(e["start"], e["end"], e["new"])
                whole = tree.text().encode()
                out.append((doc_id, before, len(edits), tree.total, tree.length, tree.encoded, zlib.crc32(whole), *((len(whole), tree.length, tree.texts, tree.leaves.tolist()) if with_trees else ())))
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.list_(pa.string()), pa.list_(pa.int32())][: len(out[0])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split(" ")[0] for c in ddl.split(", ")])

    ddl = EDITED + (", " + TREE.split(", ", 1)[1] if with_trees else "")
    return kept.select("doc_id", "n_bytes", "segments", "tokens", "edits").mapInArrow(run, ddl)


def count_with_edits(docs: DataFrame, path: str, segment: int = SEGMENT) -> DataFrame:
    """One row per row of docs: tokens of the whole text, and after the planned edits applied to its tree, from a written table of trees.

    A null text is empty. Repeated rows and rows of null ids stay apart; a text of any length is one row, whose tree its worker holds. No rows
    give no rows; extra columns are not read."""
    kept = written(trees(docs, path, segment), "token-trees", "zstd")
    return edit_trees(kept.withColumn("edits", planned_edits(F.col("n_chars"), F.col("doc_id"))), path)
