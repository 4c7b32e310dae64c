"""Media columns (operator 3): interleaved sequences of text and media references, with payloads resolved by digest.

HTML is parsed to an ordered array of segments; a segment is a text or a reference with the digest of its payload and its
caption. Payloads are stored as grey images (binary PGM, 8 bits a sample, rows of 576) in a table of the shared folder; what
is resolved are descriptors read from the stored bytes, joined by digest, so positions and captions stay where they were.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import portions, ship, spread, text_bytes, written

ROW = 576
SEGMENTS = "array<struct<position: int, kind: string, text: string, digest: string, caption: string>>"
# Elements without visible text (the raw ones have no elements inside), media elements, elements that may stay open or have no end,
# and elements that end a text.
_RAW, _SKIP, _MEDIA = {"script", "style"}, {"script", "style", "template", "noscript"}, {"img", "source", "embed", "video", "audio"}
_LEFT_OPEN = {"p", "li", "tr", "td", "th", "dt", "dd", "option", "br", "hr", "img", "source", "embed", "input", "meta", "link", "wbr", "col", "area", "base", "track", "param"}
_BREAK = {
    "p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "ul", "ol", "pre", "blockquote", "td", "th",
    "body", "title", "nav", "header", "footer", "main", "aside", "dl", "dt", "dd", "hr", "form",
}
#: Elements that no caption has inside: where one begins, a caption that was never closed ends.
_BEYOND_CAPTION = {"article", "section", "table", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "header", "footer", "body", "main", "aside"}


class _Figure:
    def __init__(self) -> None:
        self.media: list[int] = []
        self.captions: list[str] = []


_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE) for tag in _SKIP}


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str], int]]:
    """(kind, name or text, attributes, place behind it) of a page, kind being start, end or text, in time linear in its length.

    A quote that is never closed is a character as any other, so that a tag is unfinished only where no > follows at all: from there on
    the page is text. A comment without an end is its mark alone; a declaration without one ends before the next < (and is text if it is a marked section)."""
    last = {c: page.rfind(c) for c in (">", '"', "'", "-->")}
    at = 0
    while at < len(page):
        i = page.find("<", at)
        if i != at:
            yield "text", html.unescape(page[at : i if i >= 0 else len(page)]), {}, i if i >= 0 else len(page)
        if i < 0:
            return
        name = _NAME.match(page, i) if last[">"] > i else None
        if page.startswith("<!--", i):
            at = page.find("-->", i + 2) + 3 if last["-->"] >= i + 2 else i + 4
        elif name is None and page[i + 1 : i + 2] in ("!", "?", "/") and page[i + 1 : i + 2]:
            rest = page.find("<", i + 1)
            at = page.find(">", i) + 1 if last[">"] > i else rest if rest > 0 else len(page)
            if last[">"] < i and page.startswith("<![", i):
                yield "text", html.unescape(page[i:at]), {}, at
        elif name is None:
            # Without a > behind it nothing that follows is a tag.
            at = i + 1 if last[">"] > i else len(page)
            yield "text", html.unescape(page[i:at]), {}, at
        else:
            at, attributes = name.end(), {}
            while found := _ATTRIBUTE.match(page, at):
                at, value = found.end(), ""
                if found[2]:
                    quote = page[at : at + 1]
                    if quote in last and quote != ">" and last[quote] > at:
                        end = page.find(quote, at + 1)
                        value, at = page[at + 1 : end], end + 1
                    else:
                        value = _BARE.match(page, at)[0]
                        at += len(value)
                if last[">"] < at:
                    break
                attributes[found[1].lower()] = html.unescape(value)
            if last[">"] < at:
                # The last > stands within quotes.
                yield "text", html.unescape(page[i:]), {}, len(page)
                return
            at = page.find(">", at) + 1
            yield "end" if name[1] else "start", name[2].lower(), attributes, at
            if not name[1] and name[2].lower() in _RAW:
                end = _ENDS[name[2].lower()].search(page, at)
                at = end.start() if end else len(page)


def _address(attributes: dict[str, str]) -> str:
    """The address of a media element: src, else that of a lazy loader, else the first of srcset."""
    first = (attributes.get("srcset") or "").strip().split(maxsplit=1)
    return attributes.get("src") or attributes.get("data-src") or (first[0].rstrip(",") if first else "")


class _Segments:
    """Texts and media references in the order of the page.

    A figure's caption, wherever in the figure it stands, goes to its media that have no nearer figure with a caption; else the alt
    text does. A caption of a figure without media, or without a figure, is text. Whatever is not closed ends with what holds it. Skipped
    elements that the page never closes are read as if they were not there; a noscript element's media count unless they stand in the
    page before."""

    def __init__(self) -> None:
        self.segments: list[dict] = []
        self.text: list[str] = []
        self.skipped: str | None = None
        self.inside, self.around = Counter(), Counter()
        self.known: set[str] = set()
        self.figures: list[_Figure] = []
        self.caption: list[str] | None = None

    def read(self, page: str) -> list[dict]:
        last_end: dict[str, int] = {}
        for kind, value, attributes, behind in tokens(page):
            if kind == "text":
                self.handle_data(value)
            elif kind == "end":
                self.handle_endtag(value)
            elif value in _SKIP and value not in _RAW:
                if value not in last_end:
                    last_end[value] = max((m.start() for m in _ENDS[value].finditer(page)), default=-1)
                if last_end[value] >= behind:
                    self.handle_starttag(value, attributes)
            else:
                self.handle_starttag(value, attributes)
        return self.finish()

    def add_text(self, text: str) -> None:
        if text := text.strip():
            self.segments.append({"position": len(self.segments), "kind": "text", "text": text, "digest": None, "caption": None})

    def flush(self) -> None:
        self.add_text("".join(self.text))
        self.text = []

    def end_caption(self) -> None:
        if self.caption is None:
            return
        caption, self.caption = "".join(self.caption).strip(), None
        if self.figures and caption:
            self.figures[-1].captions.append(caption)
        else:
            self.add_text(caption)

    def end_figure(self) -> None:
        self.end_caption()
        self.flush()
        if not self.figures:
            return
        figure = self.figures.pop()
        caption = " ".join(figure.captions)
        if caption and figure.media:
            for i in figure.media:
                self.segments[i]["caption"] = caption
        else:
            self.add_text(caption)
            if self.figures:
                self.figures[-1].media += figure.media

    def handle_starttag(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in _MEDIA and self.skipped in (None, "noscript"):
            if src := _address(attributes):
                digest = src.removeprefix("sha256:") if src.startswith("sha256:") else hashlib.sha256(src.encode("utf-8", "replace")).hexdigest()
                if self.skipped and digest in self.known:
                    return
                self.known.add(digest)
                self.flush()
                if self.figures:
                    self.figures[-1].media.append(len(self.segments))
                self.segments.append({"position": len(self.segments), "kind": "media", "text": None, "digest": digest, "caption": attributes.get("alt") or None})
        elif self.skipped:
            self.inside[tag] += 1
        elif tag in _SKIP:
            if tag not in _RAW:
                self.skipped, self.inside = tag, Counter()
        elif tag in ("figure", "figcaption"):
            self.end_caption()
            self.flush()
            if tag == "figure":
                self.figures.append(_Figure())
            else:
                self.caption = []
        elif tag in _BREAK:
            if tag in _BEYOND_CAPTION:
                self.end_caption()
            elif self.caption:
                self.caption.append(" ")
            self.flush()
        if not self.skipped and tag not in _LEFT_OPEN and tag not in _SKIP:
            self.around[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if self.inside[tag] > 0:
                self.inside[tag] -= 1
                return
            if tag == self.skipped or not self.around[tag]:
                self.skipped = None if tag == self.skipped else self.skipped
                return
            self.skipped = None  # with the element that holds it
        if self.around[tag] > 0:
            self.around[tag] -= 1
        if tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_figure()
        elif tag in _BREAK and self.caption is None:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            (self.text if self.caption is None else self.caption).append(data)

    def finish(self) -> list[dict]:
        self.end_caption()
        self.flush()
        while self.figures:
            self.end_figure()
        return self.segments


def segments(page: str) -> list[dict]:
    return _Segments().read(page)


def parse_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc_id, segments): one row per row of pages; a null or empty page has no segments. A malformed page is read to its end, in time
    linear in its length. Repeated rows and null ids stay apart; extra columns are not read; no pages give no rows."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for part in portions(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([segments(b.decode("utf-8", "replace")) for b in part.column(1).to_pylist()], kind)], names=["doc_id", "segments"])

    bodies = pages.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    schema = StructType([bodies.schema["doc_id"], *StructType.fromDDL(f"segments {SEGMENTS}").fields])
    return spread(bodies).mapInArrow(run, schema)


def stored(payload: bytes) -> bytes:
    """A payload (a positive multiple of ROW bytes) as a grey image."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def read_samples(media: bytes) -> np.ndarray:
    """The samples of a stored image, uint8[rows, columns]."""
    magic, width, height, most, samples = media[:2], *map(int, media.split(b"\n", 3)[1].split()), int(media.split(b"\n", 3)[2]), media.split(b"\n", 3)[3]
    if magic != b"P5" or most != 255 or len(samples) != width * height:
        raise ValueError("not a grey image of 8-bit samples")
    return np.frombuffer(samples, np.uint8).reshape(height, width)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and an 8 x 8 grid of brightness steps between neighbours, as text."""
    columns = samples.mean(0).reshape(9, -1).mean(1)
    bands = np.array_split(samples, 8) if len(samples) >= 8 else [samples] * 8
    grid = np.stack([b.mean(0).reshape(9, -1).mean(1) for b in bands])
    bits = int("".join("1" if x else "0" for x in (grid[:, 1:] > grid[:, :-1]).ravel()), 2)
    return f"mean={samples.mean():.4f};std={samples.std():.4f};left={columns[0]:.4f};dhash={bits:016x}"


def padded(body: bytes) -> bytes:
    return body + b"\xff" * (max(1, -(-len(body) // ROW)) * ROW - len(body))


DESCRIBED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(payloads: DataFrame) -> DataFrame:
    """(digest, media), written, of payloads(body): each padded and stored as an image, under the digest of its bytes or, of
    payloads(digest, body), under the one given, such as that of an address."""
    given = "digest" in payloads.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            padded_ = list(map(padded, part.column(part.schema.get_field_index("body")).to_pylist()))
            digests = part.column(1) if given else pa.array([hashlib.sha256(p).hexdigest() for p in padded_], pa.string())
            yield pa.RecordBatch.from_arrays([digests, pa.array(map(stored, padded_), pa.binary())], names=["digest", "media"])

    return written(payloads.select("body", *(["digest"] if given else [])).mapInArrow(run, "digest string, media binary"), "media", "zstd")


def described(media: DataFrame) -> DataFrame:
    """A row per row of media(digest, media): what the stored bytes say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, text="media"):
            out: list[tuple] = []
            for digest, image in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                samples = read_samples(image)
                payload = samples.tobytes()
                out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
            kinds = pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in DESCRIBED.split(", ")])

    return media.mapInArrow(run, DESCRIBED)


def text_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, html) per row of docs(doc_id, body): a page of the text and, in a figure, a reference to the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            pages, sizes = [], []
            for body in part.column(1).to_pylist():
                digest, caption = hashlib.sha256(padded(body)).hexdigest(), f"bytes of a text, {len(body)}"
                pages.append(f'<p>{html.escape(body.decode("utf-8", "replace"))}</p><figure><img src="sha256:{digest}"><figcaption>{caption}</figcaption></figure>')
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(pages, pa.string())], names=["doc_id", "n_bytes", "html"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, html string")


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, caption, n_segments: one
    row per row of docs.

    Each text becomes a page of the text followed by a figure of its bytes; the page is parsed and its sequence resolved against the
    stored payloads, and the columns are read from the resolved sequence. A null text is empty: its payload is one row of bytes 255.
    Repeated rows refer to one payload; rows of one doc_id and null ids stay apart. No rows give no rows; extra columns are not read."""
    ship(docs.sparkSession)
    texts = spread(text_bytes(docs))
    descriptors = described(store(texts))
    pages = text_pages(texts).withColumn("row", F.struct("doc_id", "n_bytes"))
    # What is carried through the join are the texts' digests; they keep their places as the texts would.
    light = lambda s: s.withField("text", F.sha2(s["text"], 256))
    sequences = parse_pages(pages, "row", "html").withColumn("segments", F.transform("segments", light))
    found = resolve(sequences, descriptors)
    one = F.filter("segments", lambda s: s["segment"]["kind"] == "media")[0]
    return found.select(
        "doc_id.doc_id", "doc_id.n_bytes", *(one["media"][c].alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")),
        one["segment"]["position"].alias("position"), one["segment"]["caption"].alias("caption"), F.size("segments").alias("n_segments"),
    )


def page_sequences(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(page_id, position, kind, text_sha256, digest, caption, media_bytes): a row per segment of pages(page_id, html), resolved against
    known(digest, media_bytes)."""
    found = resolve(parse_pages(pages), known.select("digest", "media_bytes"))
    s = found.select(F.col("doc_id").alias("page_id"), F.explode("segments").alias("s")).select("page_id", "s.segment.*", F.col("s.media.media_bytes").alias("media_bytes"))
    return s.select("page_id", "position", "kind", F.sha2("text", 256).alias("text_sha256"), "digest", "caption", "media_bytes")


def resolve(sequences: DataFrame, store: DataFrame) -> DataFrame:
    """sequences(doc_id, segments) with store(digest, ...) put into each reference as a struct `media` (null where no payload is known).

    The rows of sequences stay apart, whatever their ids, which may be of any type; segments keep their order by position. Of a digest
    that the store has several times one row counts; the store's rows are written first, so that the join is split where a reference is hot."""
    extra = [c for c in store.columns if c != "digest"]
    numbered = sequences.select(F.monotonically_increasing_id().alias("number"), "doc_id", "segments")
    rows = numbered.select("number", "doc_id", F.posexplode_outer("segments").alias("at", "segment"))
    found = written(store.dropDuplicates(["digest"]).select("digest", F.struct(*extra).alias("media")), "resolved")
    joined = rows.withColumn("digest", F.col("segment.digest")).join(found, "digest", "left").drop("digest")
    back = joined.groupBy("number").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("at", "segment", "media")))).alias("segments"))
    return back.select("doc_id", F.transform("segments", lambda s: F.struct(s["segment"].alias("segment"), s["media"].alias("media"))).alias("segments"))
