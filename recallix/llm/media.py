"""Media columns: interleaved document sequences (operator 5).

HTML is parsed into an ordered sequence of text items and media references. A reference names its payload by digest;
payloads stand once for each digest in a store, and a join on the digest resolves them. Items keep their position, and
a reference keeps its caption, whatever happens to the payload.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, col, importable

WIDTH = 64
ITEM = "struct<pos: int, kind: string, text: string, digest: string, n_bytes: long, caption: string>"
_SKIP = {"script", "style", "noscript", "template"}
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "table", "section", "article", "nav", "header", "footer", "figure", "figcaption", "blockquote", "pre", "title", "body", "html", "main", "aside"}
_MEDIA = {"img", "video", "audio", "source", "embed"}


class _Sequence(HTMLParser):
    """Text and media references in the order of the page. A figure's caption, else the alt text, is the caption."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skip = 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None

    def cut(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "n_bytes": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        if tag in _MEDIA:
            a = dict(attrs)
            source = a.get("src") or ""
            size = a.get("data-bytes") or ""
            self.cut()
            item = {"kind": "media", "text": source, "digest": source[7:] if source.startswith("sha256:") else None, "n_bytes": int(size) if size.isdecimal() and len(size) < 19 else None, "caption": a.get("alt")}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)
        elif tag in _BREAKS:
            if self.caption is None:
                self.cut()
            if tag == "figure":
                self.figure = []
            elif tag == "figcaption":
                self.caption = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _SKIP:
            self.skip -= 1

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.figure or []:
                item["caption"] = text
            if not self.figure and text:
                self.items.append({"kind": "text", "text": text, "digest": None, "n_bytes": None, "caption": None})
            self.caption = None
        elif tag == "figure":
            self.figure = None
        if tag in _BREAKS and self.caption is None:
            self.cut()

    def handle_data(self, data):
        if not self.skip:
            (self.words if self.caption is None else self.caption).append(data)


def parse(page: str | None) -> list[dict]:
    """The items of a page, numbered from 0. Broken HTML gives what can be read of it."""
    p = _Sequence()
    p.feed(page or "")
    p.close()
    if p.caption:
        p.words, p.caption = p.caption, None
    p.cut()
    return [{"pos": i} | x for i, x in enumerate(p.items)]


def _parts(batch: pa.RecordBatch, rows: int, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows, whose last columns have ``size`` bytes together unless one row has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        room = (ends[start - 1] if start else 0) + size
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, room, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, items) of every page: an array of ``ITEM``. Null and empty pages have no items; repeated rows repeat."""
    importable(pages.sparkSession)
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, 1000):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([parse(x) for x in part.column(1).to_pylist()], kind)], ["id", "items"])

    return pages.select(col(id_col).alias("id"), col(html_col).cast("string").alias("html")).mapInArrow(run, f"id {pages.schema[id_col].dataType.simpleString()}, items array<{ITEM}>")


def resolve(items: DataFrame, store: DataFrame) -> DataFrame:
    """Media references of sequences with what ``store`` has under their digest, one row each: (id, pos, digest,
    n_bytes, caption, and the store's other columns; null where the digest is unknown).

    The store has one row for each digest and only narrow columns (what was computed from a payload, or where it is):
    a digest that a third of all references name is then split by adaptive execution without copying payloads."""
    refs = items.select("id", F.explode("items").alias("i")).where("i.kind = 'media'").select("id", "i.pos", "i.digest", "i.n_bytes", "i.caption")
    return refs.join(store, "digest", "left")


def encode(payload: bytes) -> bytes:
    """A payload of whole rows of 64 samples as a binary PGM image (8-bit grey)."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def decode(media: bytes) -> bytes:
    """The samples of an image that ``encode`` made; raises if it is damaged."""
    magic, size, top, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or top != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit PGM image")
    return samples


def feature(samples: bytes) -> str:
    """Height, mean and spread of the samples, and the share of each eighth of the scale in parts of a thousand."""
    x = np.frombuffer(samples, np.uint8)
    share = np.bincount(x >> 5, minlength=8) * 1000 // len(x)
    return f"{len(x) // WIDTH}:{x.mean():.4f}:{x.std():.4f}:{'-'.join(map(str, share.tolist()))}"


def _payload(data: bytes) -> bytes:
    return data + bytes(max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def _image(text: str | None) -> tuple[int, str, bytes]:
    """A whole text's bytes (their number), and the digest and the image of the payload made of them."""
    data = (text or "").encode("utf-8", "surrogatepass")
    image = encode(_payload(data))
    return len(data), hashlib.sha256(image).hexdigest(), image


def page(text: str | None) -> str:
    """A whole text as HTML: a paragraph for each line that has words, and after the first half of them (the larger one)
    a figure that refers to the payload. The caption tells what the payload is, in few words for any text."""
    size, digest, _ = _image(text)
    lines = [f"<p>{html.escape(x)}</p>" for x in (text or "").split("\n") if x.strip()]
    figure = f'<figure><img src="sha256:{digest}" data-bytes="{size}"><figcaption>{len(lines)} lines, {size} bytes</figcaption></figure>'
    half = (len(lines) + 1) // 2
    return f"<article>{''.join(lines[:half])}{figure}{''.join(lines[half:])}</article>"


def document_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, html) of every document: see ``page``. Pages are made as they are read, not stored."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, 500):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([page(x) for x in part.column(1).to_pylist()], pa.string())], ["id", "html"])

    source = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, html string")


def store_documents(docs: DataFrame, text_col: str) -> Table:
    """(digest, media): the payloads of all texts as images, written where rows are read, without a shuffle. Of equal
    payloads in one batch only the first is kept."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[str] = set()
            for part in _parts(b, 500):
                new = {}
                for text in part.column(0).to_pylist():
                    _, digest, image = _image(text)
                    if digest not in seen:
                        new[digest] = image
                        seen.add(digest)
                yield pa.RecordBatch.from_arrays([pa.array(new.keys(), pa.string()), pa.array(new.values(), pa.binary())], ["digest", "media"])

    return Table(docs.select(col(text_col).cast("string").alias("text")).mapInArrow(run, "digest string, media binary"), "media")


def payload_facts(store: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), one row for each
    digest, computed from the stored bytes as they are read back."""
    importable(store.sparkSession)
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, media in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                image = media.as_py()
                own = hashlib.sha256(image).hexdigest()
                if own != digest:
                    raise ValueError("a stored payload is damaged")
                samples = decode(image)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(image), own, feature(samples)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)

    facts = store.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return facts.dropDuplicates(names)


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's text as a stored medium: (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, pos, caption).

    Null and empty texts have 0 bytes and a payload of 64 zeros. Equal texts have equal payloads, stored under one
    digest; repeated rows repeat; rows without an id stay; an empty table gives no rows; other columns play no part.
    """
    store = store_documents(docs, text_col).df
    seq = sequences(document_pages(docs, id_col, text_col), "id", "html")
    rows = resolve(seq, payload_facts(store))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
