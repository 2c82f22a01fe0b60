"""Media columns: HTML pages as interleaved sequences of text and media references, with payloads resolved by digest.

parse() turns HTML into an ordered array of structs (position, kind, text, digest, url, caption): text blocks, and references to media
with their url and, where that is "sha256:<digest>", the digest, and with the caption of their figure or else their alt text. A
store is a table of (digest, media); resolve() joins on the digest, so each reference finds its payload by content, and gives the
elements back in their order, captions still at their positions. A reference to another url has no digest and stays unresolved. Payload
bytes of text are kept as 8-bit grey images (binary PGM, 64 samples a row): to_media() writes, from_media() reads back.

op7_media_columns stores the payload of each document, makes a page of what it reads back (page_of), with the text's lines as
paragraphs and references to its payload and to a url in between, and parses and resolves that. op7_page_elements parses pages.

Equal payloads have one digest; features are made of the stored bytes and kept as one row a digest in a written table, so that large
payloads are not shuffled and Spark can split the references to a digest that very many documents have.

Defined results: null and empty texts are 64 zero bytes; null HTML has no elements; a reference whose digest is not in the store has
a null payload; a caption without a medium is text; repeated rows come back each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import common as C

UNIT = 64
PREFIX = "sha256:"
ELEMENTS = "array<struct<position:int,kind:string,text:string,digest:string,url:string,caption:string>>"
_BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "article", "section", "figure", "br", "tr", "ul", "ol", "table", "body", "nav", "header", "footer", "pre", "blockquote"}
_SILENT = {"script", "style", "head", "template"}


#: What may stand in a head; any other tag ends it, as its end tag may be left out.
_HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template", "head", "html"}


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[list] = []  # kind, text, url, caption
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.figure: int | None = None
        self.silent: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.out.append(["text", text, None, None])

    def end_caption(self) -> None:
        if self.caption is None:
            return
        text, self.caption = " ".join("".join(self.caption).split()), None
        media = [e for e in self.out[self.figure or 0 :] if e[0] == "media"]
        for e in media:
            e[3] = text or e[3]
        if text and not media:
            self.out.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if self.silent == ["head"] and tag not in _HEAD:
            self.silent = []
        if tag in _SILENT or (self.silent and tag == "title"):
            self.silent.append(tag)
        if tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.end_caption()
            self.figure = len(self.out)
        if tag == "figcaption":
            self.flush()
            self.end_caption()
            self.caption = []
        if tag in ("img", "audio", "video", "source") and not self.silent:
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                self.out.append(["media", None, a["src"], a.get("alt")])

    def handle_endtag(self, tag):
        if tag in self.silent:
            del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
        if tag in _BLOCKS:
            self.flush()
        if tag in ("figcaption", "figure"):
            self.end_caption()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def sequence(html: str | None, stored_only: bool = True) -> list[dict]:
    """The elements of a page; stored_only: without references to urls that are no digests."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    p.end_caption()
    out = [e for e in p.out if not stored_only or e[0] == "text" or e[2].startswith(PREFIX)]
    return [{"position": i, "kind": k, "text": t, "digest": u[len(PREFIX) :] if u and u.startswith(PREFIX) else None, "url": u, "caption": c} for i, (k, t, u, c) in enumerate(out)]


def parse(pages: DataFrame, html: str = "html", into: str = "elements") -> DataFrame:
    """pages with the column into, all elements, in place of html."""

    @F.pandas_udf(ELEMENTS)
    def parsed(s):
        return s.map(lambda x: sequence(x, False))

    return pages.withColumn(into, parsed(F.col(html))).drop(html)


def resolve(pages: DataFrame, store: DataFrame, key: str, into: str = "elements") -> DataFrame:
    """One row an element: key, its struct's fields, and the store's columns for its digest (null for text or an unknown digest). A store that is a written table with one row a digest is joined as it is; of others one row a digest is taken."""
    rows = pages.select(key, F.explode(into).alias("_e")).select(key, "_e.*")
    one = store if hasattr(store, "scratch_path") else store.dropDuplicates(["digest"])
    return rows.join(one.hint("merge"), "digest", "left")


def to_media(payload: Column) -> Column:
    """Binary PGM of a payload whose length is a positive multiple of UNIT."""
    return F.concat(F.concat(F.lit(f"P5\n{UNIT} "), (F.octet_length(payload) / UNIT).cast("long").cast("string"), F.lit("\n255\n")).cast("binary"), payload)


def padded(text: Column) -> Column:
    data = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(data)
    pad = F.when(n == 0, UNIT).otherwise(F.pmod(-n, F.lit(UNIT)))
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), pad)))


def from_media(media: bytes) -> bytes:
    """The samples of a binary PGM."""
    magic, shape, depth, data = media.split(b"\n", 3)
    w, h = map(int, shape.split())
    if magic != b"P5" or depth != b"255" or len(data) != w * h:
        raise ValueError("not a grey image of 8-bit samples")
    return data


def text_of(media: Column, n_bytes: Column) -> Column:
    """The text that a medium holds, without the zeros after it."""
    head = F.length(F.lit(f"P5\n{UNIT} \n255\n")) + F.length(F.floor((n_bytes + UNIT - 1) / UNIT).cast("string"))
    head = F.when(n_bytes == 0, F.length(F.lit(f"P5\n{UNIT} 1\n255\n"))).otherwise(head)
    return F.substring(media, head + 1, n_bytes).cast("string")


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def page_of(name: Column, text: Column, digest: Column) -> Column:
    """HTML of a text: its first line, a figure of its payload with a caption, its other lines with a picture of a url after the middle one, and its payload again with an alt text. The head has no end tag."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("<p>"), _escaped(x)))
    half = F.floor(F.size(lines) / 2).cast("int") + 1
    own = F.concat(F.lit(f'src="{PREFIX}'), digest, F.lit('"'))
    part = lambda a, n: F.array_join(F.slice(lines, a, n), "")
    return F.concat(
        F.lit("<html><head><title>"), name, F.lit("</title><body>"), part(F.lit(1), F.lit(1)),
        F.lit("<figure><img "), own, F.lit(' alt="payload"><figcaption>'), name, F.lit("</figcaption></figure>"), part(F.lit(2), F.greatest(F.lit(0), half - 1)),
        F.lit('<img src="https://media.test/'), name, F.lit('.png" alt="elsewhere">'), part(half + 1, F.size(lines)),
        F.lit("<p><video "), own, F.lit(' alt="again"></video></body></html>'),
    )


def describe(store: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, feature) of each stored media, from its samples as read back. Write it with small batches (see common.text_batches)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media")):
                media = media.as_py()
                data = from_media(media)
                x = np.frombuffer(data, np.uint8)
                mean = float(x.mean(dtype=np.float64))
                spread = float(np.sqrt(max(0.0, np.dot(x.astype(np.float32), x.astype(np.float32)) / len(x) - mean * mean)))
                bands = np.bincount(x >> 5, minlength=8)
                out.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), f"{UNIT}x{len(data) // UNIT};mean={mean:.3f};spread={spread:.2f};bands=" + ",".join(map(str, bands))))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    return store.select("digest", "media").mapInArrow(read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string")


def summary(elements: str = "elements") -> list[Column]:
    """Numbers of a sequence's elements and texts, and the checksum of its texts in order."""
    texts = F.transform(F.filter(elements, lambda e: e["kind"] == "text"), lambda e: e["text"])
    return [F.size(elements).alias("n_elements"), F.size(texts).alias("n_texts"), F.crc32(F.array_join(texts, "\n").cast("binary")).alias("texts_crc32")]


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, by the reference of its page's figure; position, caption and the numbers of elements tell the page's order."""
    docs = C.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), to_media(padded(F.col("text"))).alias("media"))
    with C.text_batches(spark), C.Scratch() as scratch:
        stored = scratch.keep(docs.withColumn("digest", F.sha2("media", 256)), "media-store")
        known = C.materialize(describe(stored).dropDuplicates(["digest"]).withColumn("media_sha256", F.col("digest")), "media-described")
        name = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
        pages = parse(stored.select("doc_id", "n_bytes", page_of(name, text_of(F.col("media"), F.col("n_bytes")), F.col("digest")).alias("html")))
        media = F.filter("elements", lambda e: e["kind"] == "media")
        seq = C.materialize(pages.select(F.struct("doc_id", "n_bytes", *summary(), F.size(media).alias("n_media")).alias("_key"), F.slice(media, 1, 1).alias("elements")), "page-figures")
    found = resolve(seq, known, "_key")
    return found.select("_key.*", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op7_page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, n_elements, n_texts, texts_crc32, n_media) of each page's sequence."""
    with C.text_batches(spark):
        pages = parse(C.read(spark, sf_dir, "pages").select("page_id", "html"))
        return C.materialize(pages.select("page_id", *summary(), F.size(F.filter("elements", lambda e: e["kind"] == "media")).alias("n_media")), "page-elements")
